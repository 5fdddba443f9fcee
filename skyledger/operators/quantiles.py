"""Exact quantiles of few, possibly huge groups.

``percentile`` keeps a group's distinct values in one task, which is fine for
an hour of minutes or a row's draws but not for a month of all stations. Here
an approximate sketch first brackets each wanted value between two cuts that
are sure to enclose it. The values of a bracket are counted in equal cells, and
only the cells that hold a wanted rank, a few millionths of evenly spread rows,
are put in order. Groups of every size take this one path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .joins import spread_join

ACCURACY = 100_000
_CUTS = 512      # steps of rank between cuts: many times the sketch's error
_CELLS = 4096    # equal cells of a bracket


def grouped_quantiles(df: DataFrame, group: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """One row per group: ``n`` and ``quantiles``, an array in the order of ``probabilities``.

    Between two order statistics the result is interpolated linearly, as
    ``percentile`` does. NULL and NaN values are left out. Equal values are
    counted and joined to the brackets in portions, so that no group has to
    fit a task.
    """
    keys = list(group)
    order = sorted(range(len(probabilities)), key=lambda i: probabilities[i])
    values = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("_v"))

    cut = F.percentile_approx("_v", [i / _CUTS for i in range(1, _CUTS)], ACCURACY)
    sketch = F.struct(
        F.count(F.lit(1)).alias("n"), F.concat(F.array(F.min("_v")), cut, F.array(F.max("_v"))).alias("cuts")
    )
    n = F.col("_s.n")
    places = [(n - 1) * float(probabilities[i]) + 1 for i in order]
    below = [F.greatest(F.floor((F.floor(p) - 1) * _CUTS / n) - 1, F.lit(0)).cast("int") for p in places]
    above = [F.least(F.ceil(F.ceil(p) * _CUTS / n) + 1, F.lit(_CUTS)).cast("int") for p in places]
    brackets = [
        n.alias("_n"),
        F.array(*(F.get("_s.cuts", i) for i in below)).alias("_lows"),
        F.array(*(F.get("_s.cuts", i) for i in above)).alias("_highs"),
    ]
    if keys:
        tagged = spread_join(values, values.groupBy(*keys).agg(sketch.alias("_s")).select(*keys, *brackets), keys)
    else:
        cuts = values.agg(sketch.alias("_s")).where(n > 0).select(F.struct(*brackets))
        tagged = values.select("_v", F.lit(1).alias("_w"), cuts.scalar().alias("_b")).select(F.lit(0).alias("_all"), "_v", "_w", "_b.*")
    own = keys or ["_all"]

    # Along _place, odd numbers are brackets, even ones the values between them, which only matter by their count.
    # Brackets are in order at both ends, so the first one that ends at a value or beyond it is the one to hold it.
    v, i = F.col("_v"), F.col("_i")
    lo, hi = F.get("_lows", i), F.get("_highs", i)
    inside = F.coalesce(lo <= v, F.lit(False))
    share = F.when(hi > lo, F.nanvl((v - lo) / (hi - lo), F.lit(1.0))).otherwise(0.0)
    counted = (
        tagged.withColumn("_i", F.size(F.filter("_highs", lambda high: high < v)))
        .withColumn("_inside", inside)
        .select(
            *own, "_n", "_w",
            (2 * i + F.col("_inside").cast("int")).alias("_place"),
            F.when(F.col("_inside"), F.floor(share * _CELLS).cast("int")).otherwise(0).alias("_cell"),
            F.when(F.col("_inside"), v).alias("_at"),
        )
        .groupBy(*own, "_n", "_place", "_cell", "_at")
        .agg(F.sum("_w").alias("_times"))
    )

    # at most _CELLS + 2 rows per group and probability
    upto = F.sum("_times").over(Window.partitionBy(*own).orderBy("_place", "_cell"))
    cells = counted.groupBy(*own, "_n", "_place", "_cell").agg(F.sum("_times").alias("_times")).withColumn("_upto", upto)
    n = F.col("_n")
    ranks = [r for i in order for r in ((n - 1) * float(probabilities[i]) + 1,) for r in (F.floor(r), F.ceil(r))]
    wanted = cells.withColumn("_want", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), r.alias("rank")) for k, r in enumerate(ranks)))))
    wanted = wanted.where((F.col("_upto") >= F.col("_want.rank")) & (F.col("_upto") - F.col("_times") < F.col("_want.rank"))).select(
        *own, "_place", "_cell", "_want.k", "_want.rank", (F.col("_upto") - F.col("_times")).alias("_before")
    )
    passed = F.col("_before") + F.sum("_times").over(
        Window.partitionBy(*own, "k").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    )
    listed = counted.where(F.col("_at").isNotNull()).join(wanted, [*own, "_place", "_cell"]).withColumn("_passed", passed)
    hit = (F.col("_passed") >= F.col("rank")) & (F.col("_passed") - F.col("_times") < F.col("rank"))
    picked = listed.where(hit).groupBy(*own, "_n").agg(*(F.max(F.when(F.col("k") == k, F.col("_at"))).alias(f"_r{k}") for k in range(len(ranks))))

    results = [None] * len(order)
    for j, i in enumerate(order):
        place = (n - 1) * float(probabilities[i]) + 1
        lo, hi, share = F.col(f"_r{2 * j}"), F.col(f"_r{2 * j + 1}"), place - F.floor(place)
        results[i] = F.when(lo.isNull() | hi.isNull(), F.raise_error(F.lit("quantile outside its bracket")).cast("double")).otherwise(
            F.when(lo == hi, lo).otherwise((1 - share) * lo + share * hi)
        )
    return picked.select(*keys, n.alias("n"), F.array(*results).alias("quantiles"))
