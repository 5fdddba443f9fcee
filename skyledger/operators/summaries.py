"""Counts, means, correlations and column-wise intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """E4. Rows per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def event_counts(df: DataFrame, event: Column, *keys: str) -> DataFrame:
    """E4. Rows per key that satisfy ``event``; a key without one is listed with zero."""
    return df.groupBy(*keys).agg(F.count_if(event).alias("n"))


def means_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """E5/E6. Means per key as ``mean_<column>``, missing values skipped."""
    return df.groupBy(*keys).agg(*(F.avg(c).alias(f"mean_{c}") for c in columns))


def overall_mean(df: DataFrame, column: str) -> DataFrame:
    """E7. One row: the mean of a column, missing values skipped."""
    return df.agg(F.avg(column).alias(f"mean_{column}"))


def correlation(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """E8. Pearson correlation over the complete pairs."""
    return df.groupBy(*by).agg(
        F.corr(x, y).alias("correlation"),
        F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("pairs"),
    )


def column_intervals(df: DataFrame, row_id: Sequence[str], value: str = "value", prob: float = 0.90) -> DataFrame:
    """E16. Mean and central interval of the draws of each row.

    Meant for draws of a model: a group is as large as the number of draws.
    """
    tail = (1 - prob) / 2
    bounds = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    return (
        df.groupBy(*row_id)
        .agg(F.avg(value).alias("mean"), bounds.alias("_b"))
        .select(*row_id, "mean", F.col("_b")[0].alias("lower"), F.col("_b")[1].alias("upper"))
    )
