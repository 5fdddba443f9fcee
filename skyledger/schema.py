"""Column layout of the station tables."""

from __future__ import annotations

from pyspark.sql import types as T

HOUR_KEYS = ["site", "year", "month", "day", "hour"]
MINUTE_KEYS = [*HOUR_KEYS, "minute"]

# The measured columns, in file order.
READINGS = ["wind_dir", "wind_spd", "wind_stead", "p", "t_2m", "t_10m", "t_top", "rh", "precip"]


def _layout(keys: list[str]) -> T.StructType:
    site, *parts = keys
    return T.StructType(
        [T.StructField(site, T.StringType())]
        + [T.StructField(c, T.IntegerType()) for c in parts]
        + [T.StructField(c, T.DoubleType()) for c in READINGS]
    )


MINUTE_SCHEMA = _layout(MINUTE_KEYS)
HOUR_SCHEMA = _layout(HOUR_KEYS)

# A reading at or below its threshold stands for "missing".
MINUTE_SENTINELS = {
    "wind_dir": -999.0,
    "wind_spd": -999.0,
    "p": -999.0,
    "t_2m": -999.0,
    "t_10m": -999.0,
    "t_top": -999.0,
    "wind_stead": -9.0,
    "rh": -99.0,
    "precip": -99.0,
}
HOUR_SENTINELS = {
    "wind_dir": -99.0,
    "wind_spd": -99.0,
    "p": -99.0,
    "t_2m": -99.0,
    "t_10m": -99.0,
    "t_top": -99.0,
    "wind_stead": -9.0,
    "rh": -99.0,
    "precip": -99.0,
}

# Thresholds of the analysis.
MINUTES_PER_HOUR = 60
GUST_SPEED = 10.0          # m/s
GUST_EXCESS = 0.5          # share of the hour's mean a refined gust must exceed it by
HIGH_GUST_SD = 2.0         # m/s
HIGH_GUST_BAND = (3.0, 5.0)
THAW_TEMPERATURE = -1.8    # deg C
MAX_WIND_SD = 5.0
MAX_WIND = 35.0
