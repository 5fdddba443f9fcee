"""Joins of station tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from ..schema import HOUR_KEYS


def attach_summary(hours: DataFrame, summary: DataFrame, keys: Sequence[str] = tuple(HOUR_KEYS)) -> DataFrame:
    """D1. Left join of the hour table with its summary.

    Missing key parts match each other, as they do when grouping. The
    null-safe keys also make the join shuffle both sides for itself, which
    lets adaptive execution split an hour that fills a partition; the summary
    it shuffles again is a sixtieth of the minutes.
    """
    right = summary.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return hours.join(right, on, "left").drop(*(f"_{k}" for k in keys))


def left_join_suffixed(
    left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """D2. Left equi-join that keeps clashing columns apart by suffixes."""
    clash = (set(left.columns) & set(right.columns)) - set(on)
    renamed_left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    renamed_right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return renamed_left.join(renamed_right, list(on), "left")


def at_instants(df: DataFrame, instants: DataFrame, by_site: bool = False) -> DataFrame:
    """D3. Rows whose ``date`` (with ``by_site``: site and date) occurs in ``instants``.

    Without ``by_site`` the distinct hours are bounded by the calendar, some
    9,000 a year; adaptive execution broadcasts them when they turn out small.
    """
    if by_site:
        kept = df.join(instants.select("site", "date"), ["site", "date"], "left_semi")
    else:
        kept = df.join(instants.select("date").distinct(), "date", "left_semi")
    return kept.select(*df.columns)


def spread_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], salts: int | None = None) -> DataFrame:
    """Join ``rows`` to a table of one row per key, however unevenly the rows spread over the keys.

    Equal rows are counted first (``_w`` says how many), then each key's rows
    are dealt over ``salts`` partitions and the table is repeated for each. If
    not said, that is as many as the session shuffles to: what is set for the
    size of the input lets one key use all of it.
    """
    salts = salts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = [c for c in rows.columns if c not in keys]
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_w"))
    dealt = counted.withColumn("_salt", F.pmod(F.xxhash64(*values), F.lit(salts)).cast("int"))
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*keys, "_salt"]).drop("_salt")


def interval_join(
    rows: DataFrame,
    windows: DataFrame,
    *,
    at: str = "ts",
    start: str = "window_start",
    stop: str = "window_end",
    on: Sequence[str] = ("site",),
) -> DataFrame:
    """D6. Pair each row with every window (ends included) of the same ``on`` that holds its instant.

    Windows are repeated for each day they touch and rows are matched on that
    day, so the join hashes on (site, day) and not on the site alone. A row has
    one day, so no pair appears twice.
    """
    days = F.sequence(F.to_date(start), F.to_date(stop))
    by_day = windows.where(F.col(start) <= F.col(stop)).withColumn("_day", F.explode(days))
    return (
        rows.withColumn("_day", F.to_date(at))
        .join(by_day, [*on, "_day"])
        .where(F.col(at).between(F.col(start), F.col(stop)))
        .drop("_day")
    )


def outside_intervals(
    rows: DataFrame, windows: DataFrame, *, at: str = "ts", start: str = "from_ts", stop: str = "to_ts",
    on: Sequence[str] = ("site",),
) -> DataFrame:
    """C10 by time. Rows that no window of the same ``on`` holds; the day keeps the join hashed."""
    days = F.sequence(F.to_date(start), F.to_date(stop))
    by_day = (
        windows.where(F.col(start) <= F.col(stop))
        .select(*(F.col(c).alias(f"_{c}") for c in on), F.col(start).alias("_start"),
                F.col(stop).alias("_stop"), F.explode(days).alias("_day"))
    )
    same = reduce(and_, (F.col(c) == F.col(f"_{c}") for c in on))
    held = F.col(at).between(F.col("_start"), F.col("_stop"))
    return rows.join(by_day, same & (F.to_date(at) == F.col("_day")) & held, "left_anti")
