"""Cleaning rules and row filters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.scalars import finite, hour_literal
from ..schema import HIGH_GUST_BAND, MAX_WIND, MAX_WIND_SD, MINUTES_PER_HOUR


def null_sentinels(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """B1. NULL every reading at or below its column's threshold (and every NaN)."""
    return df.withColumns(
        {c: F.when((F.col(c) > s) & ~F.isnan(c), F.col(c)) for c, s in thresholds.items()}
    )


def null_negative(df: DataFrame, column: str = "wind_spd") -> DataFrame:
    """B2. NULL negative readings."""
    return df.withColumn(column, F.when((F.col(column) >= 0) & ~F.isnan(column), F.col(column)))


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """C1/C12. Rows with a value in every named column (default: all columns)."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def complete_groups(summary: DataFrame, expected: int = MINUTES_PER_HOUR) -> DataFrame:
    """C2. Groups with exactly ``expected`` rows and no missing reading."""
    return summary.where((F.col("nrow") == expected) & (F.col("na_ct") == 0))


def open_band(df: DataFrame, column: str = "wind_sd", band: tuple[float, float] = HIGH_GUST_BAND) -> DataFrame:
    """C3. Rows strictly inside the band."""
    return df.where((F.col(column) > band[0]) & (F.col(column) < band[1]))


def month_view(df: DataFrame, month: int) -> DataFrame:
    """C4. One calendar month; to treat all months, group by ``month`` instead."""
    return df.where(F.col("month") == month)


def above(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """C5/C6/C7. Rows whose value exceeds the threshold; NULL never does."""
    return df.where(F.col(column) > threshold)


def plausible(df: DataFrame, max_sd: float = MAX_WIND_SD, max_wind: float = MAX_WIND) -> DataFrame:
    """C8. Rows within the plausibility caps."""
    return df.where((F.col("wind_sd") <= max_sd) & (F.col("wind_max") <= max_wind))


def non_negative(df: DataFrame, column: str = "wind_spd") -> DataFrame:
    """C9. Rows with a reading of at least zero; rows without a reading go too."""
    return df.where(F.col(column) >= 0)


def finite_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """C11. Rows free of NULL, NaN and infinities in the named (default: all floating) columns."""
    if columns is None:
        columns = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.where(reduce(and_, (finite(c) for c in columns), F.lit(True)))


def date_slice(df: DataFrame, first: date, last: date, column: str = "date") -> DataFrame:
    """C13. Rows whose calendar day lies in [first, last].

    Compared as instants, not through ``to_date``, so the bounds reach the scan.
    """
    at = F.col(column)
    start = F.lit(first).cast("timestamp_ntz")
    stop = F.date_add(F.lit(last), 1).cast("timestamp_ntz")
    return df.where((at >= start) & (at < stop))


def hour_slice(
    df: DataFrame,
    start: str,
    stop: str,
    column: str = "ts",
    value: str | None = None,
    band: tuple[float, float] | None = None,
) -> DataFrame:
    """C14. Rows between two hours (both ends included), optionally with a value in ``band``."""
    chosen = df.where(F.col(column).between(hour_literal(start), hour_literal(stop)))
    return censor(chosen, {value: band}) if value and band else chosen


def censor(df: DataFrame, limits: dict[str, tuple[float, float] | None]) -> DataFrame:
    """C15. Rows inside the closed limits of every limited column."""
    kept: list[Column] = [F.col(c).between(*band) for c, band in limits.items() if band is not None]
    return df.where(reduce(and_, kept)) if kept else df


def without_day(df: DataFrame, month: int, day: int) -> DataFrame:
    """C16. Drop one calendar day in every year."""
    return df.where(~((F.col("month") == month) & (F.col("day") == day)))
