"""Exact dedup by a heavy-hitter split, in DataFrame operations only.

Misra-Gries (Spark's ``freqItems``) names digests that may be frequent; an exact
count verifies them; the few winners are broadcast, and their rows find their
group, or are removed, where they are read. All other digests are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.session import stored

SUPPORT = 0.001


def _first() -> Column:
    """The best row of a group: smallest doc_id, null last, then the first row."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with white-space runs as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)


def frequent(digests: DataFrame, support: float) -> DataFrame:
    """Groups of more than ``support`` of all rows: digest, best row, size. At most ``1 / support`` rows."""
    spark = digests.sparkSession
    named = digests.stat.freqItems(["text_sha256"], support).first()[0] or []
    least = support * digests.count()
    candidates = spark.createDataFrame([(x,) for x in named], "text_sha256 string")
    return (
        digests.join(F.broadcast(candidates), "text_sha256")
        .groupBy("text_sha256")
        .agg(_first().alias("_best"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > least)
    )


def _digests(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", text_digest(F.col("text")).alias("text_sha256"))
    return stored(slim.withColumn("_row", F.monotonically_increasing_id()), "digests")


def duplicate_groups(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of ``[\\x20\\x09-\\x0D]``
    by one space; null is empty. The smallest doc_id of a group stays (null last).
    Exactly one row of a group is kept, also when a row with the same id and text
    repeats. An empty table gives an empty result; other columns are ignored.
    """
    digests = _digests(docs)
    winners = stored(frequent(digests, support), "winners")
    common = digests.join(F.broadcast(winners), "text_sha256")
    others = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    # counted in each task first; the way back is a join, which adaptive execution splits where a group is large
    groups = others.groupBy("text_sha256").agg(_first().alias("_best"), F.count(F.lit(1)).alias("group_size"))
    return common.unionByName(others.join(groups, "text_sha256")).select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` without later copies: equality, order and edge cases as in ``duplicate_groups``.

    Rows of frequent groups whose id isn't the winner's go where they are read.
    What is left is shuffled with its text once, by digest and id: rows of one
    digest spread by their ids, and rows that repeat id and text become one in
    each task first. A row stays if its id is the one that the digests name.
    """
    digests = _digests(docs)
    winners = stored(frequent(digests, support), "winners")
    hot = winners.select(F.col("text_sha256").alias("sha"), F.col("_best.doc_id").alias("keep"), F.lit(True).alias("hot"))
    marked = docs.select(F.struct("*").alias("doc"), "doc_id", text_digest(F.col("text")).alias("sha")).join(F.broadcast(hot), "sha", "left")
    left = marked.where(F.col("hot").isNull() | F.col("doc_id").eqNullSafe(F.col("keep")))
    best = digests.groupBy(F.col("text_sha256").alias("sha")).agg(_first().alias("_best"))
    key = ["sha", "_none", "_id"]
    named = best.select("sha", F.col("_best.last").alias("_none"), F.coalesce("_best.doc_id", F.lit(0)).alias("_id"))
    once = left.select("doc", "sha", F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id")).dropDuplicates(key)
    return once.join(named, key, "left_semi").select("doc.*")


ORACLE = """
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM t
"""
