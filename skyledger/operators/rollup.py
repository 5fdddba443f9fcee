"""Hourly roll-up of minute readings."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import hour_instant
from ..schema import GUST_EXCESS, GUST_SPEED, HOUR_KEYS
from .quality import null_negative

STATISTICS = ["wind_mean", "gust_time", "wind_sd", "wind_max", "wind_min", "wind_med"]
ADDABLE = ["gust_time", "wind_max", "wind_min"]    # follow from those of an hour's parts, to the last digit


def propagate_missing(summary: DataFrame) -> DataFrame:
    """E3. NULL every statistic of a group that misses a reading."""
    return summary.withColumns({c: F.when(F.col("na_ct") == 0, F.col(c)) for c in STATISTICS if c in summary.columns})


def counted_readings(minutes: DataFrame) -> DataFrame:
    """How often (``times``) each hour has each reading; a missing or negative one is NULL."""
    readings = null_negative(minutes.select(*HOUR_KEYS, "wind_spd"))
    return readings.groupBy(*HOUR_KEYS, F.col("wind_spd").alias("speed")).agg(F.count(F.lit(1)).alias("times"))


def hourly_summary(
    minutes: DataFrame,
    *,
    gust: Literal["simple", "refined"] = "simple",
    na: Literal["propagate", "skip"] = "propagate",
    gust_speed: float = GUST_SPEED,
    excess: float = GUST_EXCESS,
    statistics: Sequence[str] = tuple(STATISTICS),
) -> DataFrame:
    """Z1 without the completeness rule: one row of statistics per site and hour.

    The minutes are read once. Each task counts equal readings of an hour before
    anything is shuffled, so a crowded hour arrives as the readings a sensor can
    give, each with its count. Put in order within the hour, running counts give
    the order statistics: the median is the mean of the readings that hold its
    lower and upper middle place. The refined gusts (E2b) are readings above the
    hour's own mean, which the same counts give. No buffer holds an hour.

    If only simple gusts, extremes and counts are wanted (``statistics``), each
    task adds them up by hour, and no reading is shuffled.
    """
    wanted = [c for c in STATISTICS if c in statistics]
    if gust == "simple" and set(wanted) <= set(ADDABLE):
        summary = _added_up(minutes, gust_speed)
    else:
        summary = _placed_readings(minutes, gust, gust_speed, excess)
    summary = summary.select(*HOUR_KEYS, *wanted, "nrow", "na_ct")
    if na == "propagate":
        summary = propagate_missing(summary)
    return summary.withColumn("date", hour_instant())


def _added_up(minutes: DataFrame, gust_speed: float) -> DataFrame:
    speed = F.col("wind_spd")
    return null_negative(minutes.select(*HOUR_KEYS, "wind_spd")).groupBy(*HOUR_KEYS).agg(
        F.count_if(speed >= gust_speed).alias("gust_time"),
        F.max(speed).alias("wind_max"),
        F.min(speed).alias("wind_min"),
        F.count(F.lit(1)).alias("nrow"),
        F.count_if(speed.isNull()).alias("na_ct"),
    )


def _placed_readings(minutes: DataFrame, gust: str, gust_speed: float, excess: float) -> DataFrame:
    hour = Window.partitionBy(*HOUR_KEYS)
    speed, times = F.col("speed"), F.col("times")
    known = F.when(speed.isNotNull(), times).otherwise(F.lit(0))
    up_to = F.sum(known).over(hour.orderBy("speed"))    # equal readings are one row
    # dealt by hour before anything else: with all sums over the hour unused, Spark would count each partition's hours once
    # more before the shuffle, though equal readings are all that meet there. The number keeps adaptive execution from
    # merging partitions: a task sorts its readings and holds its hours, so merged ones need many times their shuffled size
    tasks = int(minutes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = counted_readings(minutes).repartition(tasks, *HOUR_KEYS).withColumns(
        {
            "_up_to": up_to,
            "_known": F.sum(known).over(hour),
            "_mean": F.try_divide(F.sum(speed * times).over(hour), F.sum(known).over(hour)),
        }
    )

    def at_place(place: Column) -> Column:
        return F.min(F.when(speed.isNotNull() & (F.col("_up_to") >= place), speed))

    gusty = speed >= gust_speed
    if gust == "refined":
        gusty = gusty & (speed >= F.col("_mean") + excess * F.col("_mean"))
    away = speed - F.col("_mean")
    count = F.max("_known")
    # the least reading with at least half of all readings up to it, and with more than half
    lower = at_place(F.floor((F.col("_known") + 1) / 2))
    upper = at_place(F.floor(F.col("_known") / 2) + 1)
    return placed.groupBy(*HOUR_KEYS).agg(
        F.max("_mean").alias("wind_mean"),
        F.coalesce(F.sum(F.when(gusty, times)), F.lit(0)).alias("gust_time"),
        F.sqrt(F.try_divide(F.sum(away * away * times), F.nullif(count - 1, F.lit(0)))).alias("wind_sd"),
        F.max("speed").alias("wind_max"),
        F.min("speed").alias("wind_min"),
        ((lower + upper) / 2).alias("wind_med"),
        F.sum("times").alias("nrow"),
        F.coalesce(F.sum(F.when(speed.isNull(), times)), F.lit(0)).alias("na_ct"),
    )
