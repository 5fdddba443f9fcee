"""Document fingerprints: MinHash over word shingles, in numpy arrays over whole batches.

A fingerprint is the least value of every universal hash permutation over a
text's shingles, 16 bits of each written as hex. Bands of equal minima are
joined in Spark, and the shingle sets of what they bring together are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.text import minima, mix, permutations, read_words, shingles, signed, slices

SIZE = 5
PERMUTATIONS = 128


def signatures(texts: pa.Array, size: int = SIZE, count: int = PERMUTATIONS) -> np.ndarray:
    """One row of ``count`` minima (16 bits) a text. Texts without words have all ones."""
    words = read_words(texts)
    values, splits = shingles(words.hash, words.splits, size)
    return (minima(values, splits, permutations(count)) & np.uint32(0xFFFF)).astype(">u2")


def written(signature: np.ndarray) -> str:
    return signature.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima, row by row: an estimate of the Jaccard similarity of the shingle sets."""
    return (a == b).mean(axis=1)


def fingerprint(docs: DataFrame, size: int = SIZE, count: int = PERMUTATIONS) -> DataFrame:
    """``docs`` as doc_id, text and fingerprint; a null text has the fingerprint of an empty one.

    Texts with fewer than ``size`` words have their whole sequence as one
    shingle. Equal texts have equal fingerprints. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            marks = pa.array([written(x) for x in signatures(part.column("text"), size, count)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), marks], ["doc_id", "text", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, fingerprint string")


def neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` as doc_id, text, _range, _guest: dealt to ranges of ids, every range also holding, as guests, the
    rows with the largest id before it. The first range's guests are the rows with the largest id of all.

    The cuts are ``parts`` approximate quantiles, and one id a range is
    remembered: bounded by ``parts``, whatever the number of rows.
    """
    cuts = docs.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    edges = [-float("inf"), *sorted({float(x) for x in cuts or []}), float("inf")]
    if len(edges) < 3:
        edges.insert(1, 0.0)
    slim = docs.select("doc_id", "text", F.col("doc_id").cast("double").alias("_id"))
    ranged = Bucketizer(splits=edges, inputCol="_id", outputCol="_bucket", handleInvalid="keep").transform(slim)
    # ids that are null come before all others, in a range of their own
    ranged = ranged.withColumn("_range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_bucket").cast("int")))
    last = sorted((r["_range"], r["last"]) for r in ranged.groupBy("_range").agg(F.max("doc_id").alias("last")).collect())
    spark = docs.sparkSession
    guests = [(part, last_id, last[(k + 1) % len(last)][0]) for k, (part, last_id) in enumerate(last)]
    table = spark.createDataFrame(guests, "_range int, _last long, _to int")
    both = ranged.join(F.broadcast(table), "_range", "left")
    own = F.struct(F.col("_range").alias("r"), F.lit(False).alias("g"))
    guest = F.struct(F.col("_to").alias("r"), F.lit(True).alias("g"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("_last")), F.array(own, guest)).otherwise(F.array(own))
    return both.select("doc_id", "text", F.explode(places).alias("_place")).select("doc_id", "text", F.col("_place.r").alias("_range"), F.col("_place.g").alias("_guest"))


def edited(text: str, following: str) -> str:
    """The last third of the text's code points replaced by as many of the next text's first ones, or all of them."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compare_neighbours(docs: DataFrame, parts: int | None = None, size: int = SIZE, count: int = PERMUTATIONS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that with the next smaller doc_id; after the smallest
    comes the largest. Null ids count as smallest; rows with one id follow each
    other by text, greater first. A table of one row is its own next. Null texts
    are empty; two texts without words are alike (1). An empty table gives an
    empty result; other columns are ignored.

    Texts are shuffled once, to ranges of ids, and sorted there.
    """
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = neighbours(docs, parts)
    # a range's rows in ascending order: its guests come first, the next document of a row is the row before it
    ordered = dealt.repartition(parts, "_range").sortWithinPartitions("_range", F.desc("_guest"), F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # range, text and signature of the row before
        for part in slices(batches):
            texts = [x or "" for x in part.column("text").to_pylist()]
            own = signatures(part.column("text"), size, count)
            ranges, guests = part.column("_range").to_pylist(), part.column("_guest").to_pylist()
            rows, other, changed = [], [], []
            for k, text in enumerate(texts):
                if not guests[k]:
                    if before is None or before[0] != ranges[k]:
                        raise ValueError("a range has no row before its first")
                    rows.append(k)
                    other.append(before[2])
                    changed.append(edited(text, before[1]))
                before = ranges[k], text, own[k]
            if not rows:
                continue
            new = signatures(pa.array(changed, pa.string()), size, count)
            mine = own[rows]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(rows)),
                    pa.array([len(texts[k]) for k in rows], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                    pa.array([written(x) for x in mine]),
                    pa.array([written(x) for x in new]),
                    pa.array(likeness(mine, new)),
                    pa.array(likeness(mine, np.array(other))),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return ordered.mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def _band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band of ``rows`` minima; keys of different bands differ."""
    n, count = signature.shape
    parts = signature.reshape(n, count // rows, rows).astype(np.uint64)
    return mix((parts * permutations(rows, 61)[0]).sum(axis=2, dtype=np.uint64) + permutations(count // rows, 67)[1])


def near_pairs(docs: DataFrame, threshold: float = 0.8, rows: int = 4, size: int = SIZE, count: int = PERMUTATIONS) -> DataFrame:
    """Documents beside the first one (least id, null last) of any band bucket they share, where the Jaccard
    similarity of the full shingle sets is ``threshold`` or more: doc_id, first_id, jaccard.

    A bucket gives one pair a member, never all pairs of its members. With 32
    bands of 4 minima a pair at 0.8 shares a bucket but for a chance of 5e-8.
    Null and empty texts pair with nothing; rows equal in id and text count
    once; an empty table gives an empty result; other columns are ignored.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = read_words(part.column("text"))
            values, splits = shingles(words.hash, words.splits, size)
            full = np.flatnonzero(np.diff(splits))
            keys = signed(_band_keys(minima(values, splits, permutations(count))[full] & np.uint32(0xFFFF), rows))
            at = pa.array(np.repeat(full, keys.shape[1]))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("doc_id", "_key")), pa.array(keys.ravel())], ["doc_id", "_key", "band"])

    banded = keyed.mapInArrow(bands, "doc_id long, _key long, band long")
    first = banded.groupBy("band").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key")).alias("first"))
    pairs = banded.join(first, "band").where(F.col("_key") != F.col("first._key"))
    pairs = pairs.select("doc_id", F.col("first.doc_id").alias("first_id"), F.col("_key").alias("_a"), F.col("first._key").alias("_b")).distinct()
    texts = keyed.dropDuplicates(["_key"])
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("_key").alias(f"_{side}"), F.col("text").alias(f"text_{side}")), f"_{side}")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices([batch], "text_a")):
            sets = []
            for side in "ab":
                words = read_words(part.column(f"text_{side}"))
                values, splits = shingles(words.hash, words.splits, size)
                sets.append([np.unique(values[lo:hi]) for lo, hi in zip(splits[:-1], splits[1:])])
            both = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*sets)], float)
            jaccard = both / np.array([max(1, len(a) + len(b)) for a, b in zip(*sets)] - both)
            keep = np.flatnonzero(jaccard >= threshold)
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("first_id").take(at), pa.array(jaccard[keep])], ["doc_id", "first_id", "jaccard"])

    return pairs.mapInArrow(verify, "doc_id long, first_id long, jaccard double")
