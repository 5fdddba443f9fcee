"""Row positions in the order of composite keys, and exclusion by position.

The caller names the key columns; nothing else has to be known about the order,
so it cannot be stated wrongly. Nulls come first. Rows with equal keys follow
the hash of their other columns, so a position always means the same row.

Numbering deals the rows to ranges of the key, cut from a sample of keys, and
adds up the rows per range. Excluding positions only counts rows, by the leading
part of the key: all rows before, between and after the groups that hold an end
of a range are kept or dropped where they are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from ..session import stored

_SPAN = 4096             # consecutive values of a single whole-number key that are counted together
_POSITION_STRIDE = 1 << 20
_PUSHED_VALUES = 1000    # distinct key parts that are worth a filter in the scan
_EARLIER = (Window.unboundedPreceding, -1)


def _leading(df: DataFrame, order_by: Sequence[str], lead: int | None) -> Column:
    """The part of the key that rows are counted by: its first ``lead`` columns, all but the last one if not said, or
    stretches of a single one."""
    if len(order_by) > 1:
        return F.struct(*order_by[: lead or -1])
    only = order_by[0]
    whole = isinstance(df.schema[only].dataType, IntegralType)
    return F.struct((F.floor(F.col(only) / _SPAN) if whole else F.col(only)).alias(only))


def _total_order(df: DataFrame, order_by: Sequence[str]) -> list[Column]:
    rest = [c for c in df.columns if c not in order_by]
    return [*(F.col(c) for c in order_by), *([F.xxhash64(*rest)] if rest else [])]


def _starts(placed: DataFrame, part: str, rows: Column) -> DataFrame:
    """Rows in all parts before each part: one row a part, so its window sees as many rows as there are tasks."""
    totals = placed.groupBy(part).agg(rows.alias("_total"))
    before = F.sum("_total").over(Window.orderBy(part).rowsBetween(*_EARLIER))
    return totals.select(part, F.coalesce(before, F.lit(0)).alias("_start"))


def with_row_numbers(df: DataFrame, order_by: Sequence[str], name: str = "row") -> DataFrame:
    """B24. 1-based position of every row in the order of its keys.

    The rows are read twice, for a sample of keys and to be dealt to ranges of
    them, and written once in order; a crowded stretch of keys gets ranges of its
    own. Positions are a range's start plus the place in it.
    """
    order = _total_order(df, order_by)
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    starts = _starts(placed, "_part", F.count(F.lit(1)))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + place + 1).select(*df.columns, name)


def group_offsets(df: DataFrame, order_by: Sequence[str], lead: int | None = None) -> DataFrame:
    """``_group`` (the leading part of the key), its rows (``_rows``), and the rows of all groups before it (``_before``)."""
    counts = df.groupBy(_leading(df, order_by, lead).alias("_group")).agg(F.count(F.lit(1)).alias("_rows"))
    placed = stored(counts.repartitionByRange("_group").withColumn("_part", F.spark_partition_id()), "groups")
    inside = F.sum("_rows").over(Window.partitionBy("_part").orderBy("_group").rowsBetween(*_EARLIER))
    summed = placed.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    starts = _starts(placed, "_part", F.sum("_rows"))
    return summed.join(F.broadcast(starts), "_part").select("_group", "_rows", (F.col("_start") + F.col("_inside")).alias("_before"))


def merged_ranges(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same positions as disjoint ascending ranges."""
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted((lo, hi) for lo, hi in ranges if lo <= hi):
        if merged and lo <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def exclude_ranges(
    df: DataFrame, ranges: Iterable[tuple[int, int]], order_by: Sequence[str], lead: int | None = None
) -> DataFrame:
    """C10. Drop the rows at the given 1-based positions (ends included) in the order of the keys.

    Rows are read once to be counted and once to be kept or dropped by their
    group, without a shuffle. Only groups that hold an end of a range are ranked,
    at most two a range of the caller's list, and key filters let that pass skip
    what lies elsewhere. ``lead`` key columns make a group (default: all but the
    last); it bears on the work, not on the result.
    """
    spans = merged_ranges(ranges)
    if not spans:
        return df
    spark = df.sparkSession
    points = spark.createDataFrame(
        [(i, end, pos) for i, span in enumerate(spans) for end, pos in zip(("lo", "hi"), span, strict=True)],
        "_span long, _end string, _position long",
    ).withColumn("_stride", F.floor(F.col("_position") / _POSITION_STRIDE))
    first, last = F.col("_before") + 1, F.col("_before") + F.col("_rows")
    strides = F.sequence(F.floor(first / _POSITION_STRIDE), F.floor(last / _POSITION_STRIDE))
    found = stored(
        group_offsets(df, order_by, lead)
        .withColumn("_stride", F.explode(strides))
        .join(points, "_stride")
        .where(F.col("_position").between(first, last))
        .select("_group", "_before", "_span", "_end"),
        "ends",
    )
    # one row per merged range: the groups of its two ends; a range that runs past the last row has no last group
    ends = found.groupBy("_span").agg(
        F.max(F.when(F.col("_end") == "lo", F.col("_group"))).alias("_first"),
        F.max(F.when(F.col("_end") == "hi", F.col("_group"))).alias("_last"),
    )
    # in the order of the ranges, so of the keys
    dropped = ends.where(F.col("_first").isNotNull()).select(
        F.array_sort(F.array_agg(F.struct("_span", "_first", "_last"))).alias("_dropped")
    )
    partial = found.select("_group", "_before").distinct()

    rows = df.withColumn("_group", _leading(df, order_by, lead))
    between = F.exists(F.array("_dropped"), lambda spanned: _strictly_inside(F.col("_group"), spanned, len(spans)))
    # asked behind the join, which has made each row's group once: pushed below it, the search would make it at each step
    whole = (
        rows.join(F.broadcast(partial.select("_group", F.lit(True).alias("_partial"))), "_group", "left")
        .withColumn("_dropped", dropped.scalar())
        .where(~F.coalesce("_partial", between))
    )
    near = _where_ends_are(df, found, order_by[: lead or -1]).withColumn("_group", _leading(df, order_by, lead))
    rank = F.row_number().over(Window.partitionBy("_group").orderBy(*_total_order(df, order_by)))
    ranked = (
        near.join(F.broadcast(partial), "_group")
        .withColumn("_position", F.col("_before") + rank)
        .withColumn("_spans", _span_array(spans))
        .where(~F.exists("_spans", lambda s: F.col("_position").between(s["lo"], s["hi"])))
    )
    return whole.select(*df.columns).unionAll(ranked.select(*df.columns))


def _strictly_inside(group: Column, spanned: Column, most: int) -> Column:
    """Whether ``group`` lies between the two ends of one of the (at most ``most``) disjoint ascending ranges.

    Halving steps count the ranges that begin in an earlier group; only the last of them can hold this one.
    """
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(most.bit_length()))))
    return F.aggregate(
        steps,
        F.lit(0),
        lambda begun, step: F.when(F.get(spanned, begun + step - 1)["_first"] < group, begun + step).otherwise(begun),
        lambda begun: (begun > 0) & F.coalesce(group < F.get(spanned, begun - 1)["_last"], F.lit(True)),
    )


def _where_ends_are(df: DataFrame, found: DataFrame, leading: Sequence[str]) -> DataFrame:
    """``df`` behind filters on single key columns that every group in ``found`` passes."""
    for c in leading:
        seen = [r[0] for r in found.select(f"_group.{c}").distinct().limit(_PUSHED_VALUES + 1).collect()]
        if len(seen) <= _PUSHED_VALUES:
            known = F.col(c).isin([v for v in seen if v is not None])
            df = df.where(known | F.col(c).isNull() if None in seen else known)
    return df


def _span_array(spans: list[tuple[int, int]]) -> Column:
    return F.array(
        *(F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for lo, hi in spans)
    )
