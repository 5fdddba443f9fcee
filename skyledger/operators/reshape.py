"""Sampling, reshaping, zero-filling and stacking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


_DIGITS = 4         # hexadecimal digits by which hashes are counted at a time
_FEW = 1 << 12      # hashes that may be put in order on the driver


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """G1. ``n`` rows drawn without replacement: those whose hashed key comes first.

    Which hash is the ``n``-th is found from counts of the hashes' first digits,
    then, within the one beginning that holds it, of the next ones. The rows up
    to it are kept where they are read: nothing is put in order or moved, however
    large the sample. ``key`` must be unique for the draw to be fixed and exact;
    rows with equal keys are drawn together.
    """
    text = F.concat_ws(":", *(F.col(c).cast("string") for c in key), F.lit(str(seed)))
    hashed = df.withColumn("_hash", F.md5(text.cast("binary")))
    if n <= 0:
        return df.where(F.lit(False))
    last = _nth_hash(hashed.select("_hash"), n)
    return df if last is None else hashed.where(F.col("_hash") <= last).drop("_hash")


def _nth_hash(hashes: DataFrame, n: int) -> str | None:
    """The ``n``-th least hash; None if there are no more than ``n``."""
    known = ""
    while True:
        own = hashes.where(F.col("_hash").startswith(known)) if known else hashes
        first = F.substring("_hash", 1, len(known) + _DIGITS)
        counts = own.groupBy(first.alias("first")).agg(F.count(F.lit(1)).alias("rows")).collect()    # at most 16 ** _DIGITS
        before = 0
        for row in sorted(counts, key=lambda r: r["first"]):
            if before + row["rows"] >= n:
                break
            before += row["rows"]
        else:
            return None
        if not known and sum(r["rows"] for r in counts) == n:
            return None
        known, n = row["first"], n - before
        if row["rows"] <= _FEW or len(known) >= 32:
            few = hashes.where(F.col("_hash").startswith(known)).orderBy("_hash").limit(n)
            return few.agg(F.max("_hash")).first()[0]


def to_long(
    df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str = "var", value: str = "value"
) -> DataFrame:
    """G2. One row per kept row and column, values as doubles."""
    doubles = df.select(*keep, *(F.col(c).cast("double").alias(c) for c in columns))
    return doubles.unpivot(list(keep), list(columns), name, value)


def zero_fill(
    cells: DataFrame, columns: Sequence[str] = ("n",), years: tuple[int, int] | None = None
) -> DataFrame:
    """G3. Every month of every year, with the given counts as zero where ``cells`` has no row.

    ``cells`` holds at most one row per (month, year); its other columns stay
    NULL where it has none. The calendar spans the years of ``cells``, so count
    events as ``count_if`` over all rows, not over the events alone; ``years``
    can widen it.
    The cells, a dozen a year, are folded into one row and unfolded along the
    calendar: no join, and the table behind them is read once.
    """
    others = [c for c in cells.columns if c not in ("month", "year")]
    place = F.struct(F.col("month").cast("int").alias("month"), F.col("year").cast("int").alias("year"))
    first, last = F.min("year"), F.max("year")
    if years is not None:
        first, last = F.least(first, F.lit(years[0])), F.greatest(last, F.lit(years[1]))
    folded = cells.agg(
        first.cast("int").alias("_first"),
        last.cast("int").alias("_last"),
        F.map_from_entries(F.collect_list(F.struct(place, F.struct(*others)))).alias("_cells"),
    )
    rows = folded.where(F.col("_first").isNotNull()).select("_cells", F.explode(F.sequence("_first", "_last")).alias("year"))
    months = rows.select("_cells", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"), "year")
    found = months.withColumn("_cell", F.try_element_at("_cells", F.struct("month", "year")))
    return found.select(
        "month",
        "year",
        *(
            (F.coalesce(f"_cell.{c}", F.lit(0)).cast("long") if c in columns else F.col(f"_cell.{c}")).alias(c)
            for c in others
        ),
    )


def stack(*tables: DataFrame) -> DataFrame:
    """G4. Tables below each other; a column one of them lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
