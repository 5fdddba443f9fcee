"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.session import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) to one row per node that has an edge to another one: node, component (its least node).

    Every round is two grouped minima and two joins, written to the shared
    folder; the number of rounds grows with the logarithm of the graph's size. A
    node's neighbours are never gathered: minima combine before the shuffle, and
    adaptive execution may split a hub's joins.
    """
    stars = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v")
        root = large.groupBy("u").agg(F.min("v").alias("root"))
        small = large.join(root, "u").where("v <> root").select(F.col("v").alias("u"), F.col("root").alias("v"))
        stars = stored(small.unionByName(root.select("u", F.col("root").alias("v"))).distinct(), "edges")
