"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree.

Every document of a source starts with the same number of copies, target over
source size. Whole copies are taken; the fractional parts are settled in pairs:
words move at random from one document's fraction to the other's until one of
them is integral, so a pair's expected words, and each document's expected
copies, stay as they were. Each chunk of a source ends with at most one
fraction; the fractions of many chunks meet in the next level of the tree.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.text import WORD
from skyledger.session import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
CHUNK = 4096
FAN = 1024
SEED = 17
_NEAR = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _sizes(docs: DataFrame) -> DataFrame:
    key = F.xxhash64("doc_id", "source", "text")
    return stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_key")), "sizes")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, docs, target: ``share`` of all sizes dealt by weight, none above ``cap`` of its source.

    Sources take the weights in turn, by code point, null last. Their order
    comes from a range-partitioned sort and one row count a partition. The cap
    is met by resharing: each round is one aggregate over the sources.
    """
    order = F.col("source").asc_nulls_last()
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    placed = stored(totals.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_at", 33)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    starts = sizes.sparkSession.createDataFrame(offsets, "part long, before long")
    rank = F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = placed.withColumn("part", part).join(F.broadcast(starts), "part").select("source", "source_size", "docs", weight.alias("weight"))

    most = F.lit(cap) * F.col("source_size")
    level, capped = 0.0, -1
    while True:
        full = most <= F.lit(level) * F.col("weight")
        row = weighed.agg(
            F.sum(F.col("source_size")).alias("all"),
            F.sum(F.when(full, most)).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("capped"),
        ).first()
        if row["capped"] == capped or not row["open"]:
            break
        capped = row["capped"]
        level = (share * (row["all"] or 0) - (row["full"] or 0.0)) / row["open"]
    target = F.least(most, F.lit(level) * F.col("weight")) if capped >= 0 else most
    return weighed.select("source", "source_size", "docs", target.alias("target"))


def settle(size: np.ndarray, fraction: np.ndarray, luck: np.ndarray) -> int:
    """Rounds ``fraction`` in place, pair by pair; gives the place of the one that may be left fractional, or -1."""
    held = -1
    for k in range(len(size)):
        if fraction[k] <= _NEAR or fraction[k] >= 1 - _NEAR:
            fraction[k] = round(fraction[k])
            continue
        if held < 0:
            held = k
            continue
        a, b, p, q = size[held], size[k], fraction[held], fraction[k]
        to_held = min((1 - p) * a, q * b)
        to_next = min(p * a, (1 - q) * b)
        if luck[k] * (to_held + to_next) < to_next:
            p, q = p + to_held / a, q - to_held / b
        else:
            p, q = p - to_next / a, q + to_next / b
        p_done, q_done = (x <= _NEAR or x >= 1 - _NEAR for x in (p, q))
        fraction[held], fraction[k] = round(p) if p_done else p, round(q) if q_done else q
        held = -1 if p_done and q_done else k if p_done else held
    return held


def even_out(size: np.ndarray, fraction: np.ndarray, gap: float) -> float:
    """Settled documents, largest first, change sides where that brings the ``gap`` (words still to be taken) nearer to 0;
    gives what is left of it. The last fraction of a source, often that of a long text, so costs it no more than a short one."""
    for k in range(len(size)):
        turn = size[k] if gap > 0 and fraction[k] == 0 else -size[k] if gap < 0 and fraction[k] == 1 else 0
        if turn and abs(gap - turn) < abs(gap):
            fraction[k] = 1 - fraction[k]
            gap -= turn
    return gap


def _settler(level: int, last: bool):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "_key"], ascending=False, kind="stable").reset_index(drop=True)
        fraction = part["fraction"].to_numpy(float).copy()
        size = part["size"].to_numpy(float)
        wanted = float(size @ fraction)
        random = np.random.default_rng([SEED, level, int(part["_key"].iloc[0]) & 0x7FFFFFFFFFFFFFFF, len(part)])
        held = settle(size, fraction, random.random(len(part)))
        if held >= 0 and last:
            fraction[held] = float(random.random() < fraction[held])
            held = -1
            even_out(size, fraction, wanted - float(size @ fraction))
        part["fraction"] = fraction
        part["done"] = np.arange(len(part)) != held
        return part

    return run


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies, source.

    ``size`` counts words (null text: 0). ``taken`` is ``copies`` times ``size``;
    copies are the whole part of target / source_size plus at most one. A
    source's taken words differ from its target by less than one document: by
    what the documents settled last cannot make up, mostly a few words. The
    result depends on the rows alone, not on their order or partitions; equal
    rows count each on its own. Documents without words and sources without
    words take 0. An empty table gives an empty result; other columns are ignored.

    A source is dealt to chunks of about ``chunk`` documents by a hash, however
    large it is; a chunk leaves at most one fraction to the next level.
    """
    return _decided(_sizes(docs), weights, share, cap, chunk).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def _decided(sizes: DataFrame, weights, share, cap, chunk) -> DataFrame:
    targets = stored(source_targets(sizes, weights, share, cap), "targets").withColumnRenamed("source", "_source")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = (
        sizes.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("whole", F.floor(copies + F.lit(_NEAR)).cast("long"))
        .withColumn("fraction", F.greatest(F.lit(0.0), copies - F.col("whole")))
        .withColumn("place", F.pmod("_key", F.ceil(F.col("docs") / chunk)))
        .drop("_source", "docs")
        .withColumn("done", (F.col("size") == 0) | (F.col("fraction") <= _NEAR))
    )
    largest = targets.agg(F.max("docs")).first()[0] or 0
    chunks, level, layers = -(-largest // chunk), 0, [dealt.where("done").withColumn("fraction", F.lit(0.0))]
    open_rows = dealt.where(~F.col("done"))
    while True:
        settled = stored(open_rows.groupBy("source", "place").applyInPandas(_settler(level, chunks <= 1), dealt.schema), "settled")
        layers.append(settled.where("done"))
        if chunks <= 1:
            break
        open_rows = settled.where(~F.col("done")).withColumn("place", F.floor(F.col("place") / FAN))
        chunks, level = -(-chunks // FAN), level + 1
    rows = reduce(DataFrame.unionByName, layers)
    copies = F.col("whole") + F.col("fraction").cast("long")
    return rows.withColumn("copies", copies).withColumn("taken", copies * F.col("size"))


def repeat_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` takes it; columns as in ``docs``."""
    key = F.xxhash64("doc_id", "source", "text").alias("_key")
    taken = _decided(_sizes(docs), weights, share, cap, chunk)
    taken = taken.select("_key", F.row_number().over(Window.partitionBy("_key").orderBy("copies")).alias("n"), "copies").where("copies > 0")
    keyed = docs.select(F.struct("*").alias("doc"), "doc_id", key).withColumn("n", F.row_number().over(Window.partitionBy("_key").orderBy("doc_id")))
    joined = keyed.join(taken, ["_key", "n"])
    return joined.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")
