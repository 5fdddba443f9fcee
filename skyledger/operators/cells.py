"""Trend cells: moments per site, month and year that merge with those of new files.

A cell keeps, per measure, the count, the mean and the squared deviations from
it, and counts of events. Cells of the same place merge exactly like the rows
behind them would: the deviations add up, plus what the means lie apart. So a
year that arrives is read alone, and the trends of all years follow from the
stored cells, a dozen rows a site and year.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

CELL_KEYS = ["site", "month", "year"]
_DYNAMIC = "spark.sql.sources.partitionOverwriteMode"


def cell_sums(measures: Sequence[str], events: Mapping[str, Column]) -> list[Column]:
    """The aggregates of a cell: ``c_w``, ``c_mean``, ``c_ssd`` per measure, a count per event, and ``hours``."""
    sums = [F.count(F.lit(1)).alias("hours"), *(F.count_if(e).alias(name) for name, e in events.items())]
    for c in measures:
        value = F.col(c).cast("double")
        sums += [F.count(c).alias(f"{c}_w"), F.avg(value).alias(f"{c}_mean"), (F.var_pop(value) * F.count(c)).alias(f"{c}_ssd")]
    return sums


def trend_cells(hours: DataFrame, measures: Sequence[str], events: Mapping[str, Column], by: Sequence[str] = tuple(CELL_KEYS)) -> DataFrame:
    """One row per cell of ``hours``: they are read once, and map-side states are all that is shuffled."""
    return hours.groupBy(*by).agg(*cell_sums(measures, events))


def merged_cells(cells: DataFrame, measures: Sequence[str], events: Sequence[str], by: Sequence[str] = tuple(CELL_KEYS)) -> DataFrame:
    """Cells with equal ``by`` as one: counts add up, means weigh by their counts, deviations are taken to the new mean.

    ``by`` may be coarser than the cells: without the site, all sites count as one.
    """
    place = Window.partitionBy(*by)
    centred = cells.withColumns(
        {
            f"{c}_centre": F.try_divide(F.sum(F.col(f"{c}_mean") * F.col(f"{c}_w")).over(place), F.sum(f"{c}_w").over(place))
            for c in measures
        }
    )
    sums = [F.sum(name).alias(name) for name in ("hours", *events)]
    for c in measures:
        w, mean, centre = F.col(f"{c}_w"), F.col(f"{c}_mean"), F.col(f"{c}_centre")
        away = mean - centre
        sums += [F.sum(w).alias(f"{c}_w"), F.max(centre).alias(f"{c}_mean"), F.sum(F.col(f"{c}_ssd") + w * away * away).alias(f"{c}_ssd")]
    return centred.groupBy(*by).agg(*sums)


def add_cells(cells: DataFrame, path: str, batch: str) -> None:
    """Stores the cells of one batch of files; a batch of the same name replaces itself, others are not touched."""
    spark = cells.sparkSession
    before = spark.conf.get(_DYNAMIC)
    spark.conf.set(_DYNAMIC, "dynamic")
    try:
        cells.coalesce(1).withColumn("batch", F.lit(batch)).write.mode("overwrite").partitionBy("batch").parquet(path)
    finally:
        spark.conf.set(_DYNAMIC, before)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all batches, to be merged."""
    return spark.read.parquet(path)
