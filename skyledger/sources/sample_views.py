"""Station-shaped views of the supplied benchmark tables.

``orders`` plays the hour table, ``lineitem`` the minute table, ``events`` a
stream of single observations. The order key spreads over a calendar of 29
years x 12 months x 24 hours x 28 days, three keys in a row being the same hour
at three sites; every full calendar adds three more sites, so hours stay unique
at any scale and an hour may be complete at one site only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import number

# Calendar of the views.
FIRST_YEAR = 1994
YEARS = 29
LAST_YEAR = FIRST_YEAR + YEARS - 1
HOURS_PER_SITE = YEARS * 12 * 24 * 28
SITES = 3    # sites that share a calendar
COMPLETE_ROWS = 4    # rows of a complete hour in the minute view

MINUTE_SPEED_STEP = 4.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _calendar(key: str) -> list[Column]:
    hour = f"({key} div {SITES})"
    site = f"{key} % {SITES} + {SITES} * ({hour} div {HOURS_PER_SITE}) + 1"
    return [
        F.concat(F.lit("S"), F.expr(site).cast("string")).alias("site"),
        F.expr(f"{FIRST_YEAR} + {hour} % {YEARS}").cast("int").alias("year"),
        F.expr(f"{hour} div {YEARS} % 12 + 1").cast("int").alias("month"),
        F.expr(f"{hour} div {YEARS * 12 * 24} % 28 + 1").cast("int").alias("day"),
        F.expr(f"{hour} div {YEARS * 12} % 24").cast("int").alias("hour"),
    ]


def _temperature(amount: str) -> Column:
    return (F.floor(F.col(amount)) % 719 - 490) / 10.0


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour table; some readings hold sentinels, and calm hours have speed 0."""
    customer = F.col("o_custkey")
    key = F.col("o_orderkey")
    t_2m = _temperature("o_totalprice")
    return _table(spark, sf_dir, "orders").select(
        *_calendar("o_orderkey"),
        F.when(customer % 31 == 0, -99.0).otherwise((customer % 360).cast("double")).alias("wind_dir"),
        ((key % 200) / 10.0).alias("wind_spd"),
        F.when(customer % 13 == 0, -9.0).otherwise((customer % 100).cast("double")).alias("wind_stead"),
        (990 + customer % 40).cast("double").alias("p"),
        t_2m.alias("t_2m"),
        (t_2m + (customer % 41 - 20) / 10.0).alias("t_10m"),
        F.when(customer % 17 == 0, -99.0).otherwise(t_2m + 0.5).alias("t_top"),
        F.when(customer % 19 == 0, -99.0).otherwise((customer % 101).cast("double")).alias("rh"),
        F.when(customer % 23 == 0, -99.0).otherwise((key % 7) / 2.0).alias("precip"),
    )


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute table; several rows of an hour may carry the same minute number."""
    part = F.col("l_partkey")
    supplier = F.col("l_suppkey")
    t_2m = _temperature("l_extendedprice")
    speed = F.when(part % 29 == 0, -999.0).otherwise(F.col("l_quantity") / MINUTE_SPEED_STEP)
    return _table(spark, sf_dir, "lineitem").select(
        *_calendar("l_orderkey"),
        F.col("l_linenumber").alias("minute"),
        F.when(supplier % 37 == 0, -999.0).otherwise((supplier % 360).cast("double")).alias("wind_dir"),
        speed.alias("wind_spd"),
        F.when(supplier % 11 == 0, -9.0).otherwise((supplier % 100).cast("double")).alias("wind_stead"),
        (990 + part % 40).cast("double").alias("p"),
        F.when(part % 43 == 0, -999.0).otherwise(t_2m).alias("t_2m"),
        (t_2m + (part % 41 - 20) / 10.0).alias("t_10m"),
        (t_2m + 0.5).alias("t_top"),
        F.when(supplier % 13 == 0, -99.0).otherwise((supplier % 101).cast("double")).alias("rh"),
        F.when(part % 23 == 0, -99.0).otherwise((part % 7) / 2.0).alias("precip"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single observations with an instant, a site and a speed."""
    return _table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_type").alias("site"),
        (F.col("value") / number(10)).alias("wind_spd"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
