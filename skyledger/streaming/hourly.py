"""The hourly roll-up over minute files as they arrive."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import hour_instant
from ..operators.quality import complete_groups, null_negative
from ..operators.rollup import propagate_missing, speed_aggregates
from ..schema import GUST_SPEED, HOUR_KEYS, MINUTES_PER_HOUR


def stream_complete_hours(
    minutes: DataFrame,
    delay: str = "2 hours",
    expected: int = MINUTES_PER_HOUR,
    gust_speed: float = GUST_SPEED,
) -> DataFrame:
    """Complete hours of a stream of minutes, each emitted once its hour is ``delay`` in the past.

    Same statistics and columns as the batch job. State is one set of partial
    aggregates per site and open hour; later minutes of a closed hour are
    dropped by the watermark. Write it in append mode.
    """
    # watermarks need a zoned timestamp: the hour's distance from the epoch, whatever the session's zone
    epoch = F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz")
    event_time = F.timestamp_seconds(F.timestamp_diff("SECOND", epoch, hour_instant()))
    hours = (
        null_negative(minutes.select(*HOUR_KEYS, "wind_spd"))
        .withColumn("_event_time", event_time)
        .withWatermark("_event_time", delay)
        .groupBy(*HOUR_KEYS, "_event_time")
        .agg(*speed_aggregates(F.col("wind_spd"), gust_speed))
        .drop("_event_time")
    )
    return complete_groups(propagate_missing(hours), expected).withColumn("date", hour_instant())
