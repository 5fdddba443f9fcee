"""Stored tables, literal tables and even grids."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A3. A stored table; filters on ``year`` prune its folders."""
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, order: Sequence[str] = ("year", "month", "day", "hour")) -> None:
    """A6. Store a table in one folder per year.

    Range partitioning on the whole time order gives each task a stretch of
    time, so a year holding much of the data is written by many tasks and
    each task still writes few files.
    """
    df.repartitionByRange(*order).write.mode("errorifexists").partitionBy("year").parquet(path)


def literal_table(spark: SparkSession, columns: dict[str, Sequence[Any]], schema: str) -> DataFrame:
    """A4. A small table from in-code vectors of equal length."""
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema)


def grid_values(lo: Column, hi: Column, count: int) -> Column:
    """A5. Array of ``count`` (at least 2) evenly spaced numbers from ``lo`` to ``hi``."""
    step = (hi - lo) / (count - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: lo + i * step)
