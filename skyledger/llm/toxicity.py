"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found through a block-max inverted index.

Features are words and word beginnings that, among the examples, hardly occur
without the label. The index over the examples keeps, for each feature and block
of examples, the greatest weight: blocks are scored in the order of their upper
bounds until no other can hold a nearer example, so the nearest are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyledger.llm.text import find_words, hash_spans, minima, permutations, released, signed, slices, utf8
from skyledger.session import stored

#: Bounds of the classifier: labelled examples of each class, features, and nearest examples that vote.
EXAMPLES, FEATURES, NEAREST = 4096, 4096, 16
#: Examples of the class without the label, in multiples of ``EXAMPLES``.
CLEAN = 2
BLOCK = 64
THRESHOLD = 0.7
_BEGINNINGS = (4, 5, 6, 7, 8, 9, 10)
_PRECISION = 0.5
_DOUBT = 0.02
_NOBODY = np.zeros(0, np.int64)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, without punctuation around them, and of their beginnings of 4 to 10 bytes, and the text of each."""
    data, at = utf8(texts)
    starts, ends, splits = find_words(data, at)
    text = np.repeat(np.arange(len(texts)), np.diff(splits))
    for _ in range(8):
        wide = starts < ends
        starts = starts + (wide & _PUNCTUATION[data[np.minimum(starts, len(data) - 1)]]) if len(data) else starts
        wide = starts < ends
        ends = ends - (wide & _PUNCTUATION[data[np.maximum(ends - 1, 0)]]) if len(data) else ends
    some = starts < ends
    starts, ends, text = starts[some], ends[some], text[some]
    hashes, owners = [hash_spans(data, starts, ends)], [text]
    for size in _BEGINNINGS:
        long = ends - starts > size
        hashes.append(hash_spans(data, starts[long], starts[long] + size) ^ np.uint64(size))
        owners.append(text[long])
    return np.concatenate(hashes), np.concatenate(owners)


def _counted(values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value) with their counts, by owner."""
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    first = np.flatnonzero(new)
    return values[first], owners[first], np.diff(np.append(first, len(values)))


@dataclass
class Index:
    """Examples as unit vectors over ``known`` (sorted feature hashes), in blocks, as postings by feature."""

    known: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    begin: np.ndarray  # feature x block: where its postings begin
    example: np.ndarray
    value: np.ndarray
    greatest: np.ndarray  # feature x block
    prior: float
    texts: np.ndarray  # hash of each example's text

    def own(self, text: int) -> np.ndarray:
        """Places of the examples with this very text."""
        return np.flatnonzero(self.texts == text)

    def vector(self, which: np.ndarray, count: np.ndarray) -> np.ndarray:
        raw = (1 + np.log(count)) * self.idf[which]
        return raw / np.sqrt((raw * raw).sum())

    def nearest(self, which: np.ndarray, weights: np.ndarray, k: int, leave: np.ndarray = _NOBODY) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest examples with a positive cosine but those to ``leave`` out, ties by place."""
        bound = weights @ self.greatest[which]
        order = np.argsort(-bound, kind="stable")
        place, near = np.zeros(0, np.int64), np.zeros(0)
        for b in order:
            if bound[b] <= 0 or len(near) == k and bound[b] < near[-1] - 1e-9:
                break
            score = np.zeros(BLOCK)
            for f, w in zip(which, weights):
                lo, hi = self.begin[f, b], self.begin[f, b + 1]
                score[self.example[lo:hi] - b * BLOCK] += w * self.value[lo:hi]
            hit = np.flatnonzero(score > 0)
            hit = hit[~np.isin(hit + b * BLOCK, leave)]
            place, near = np.concatenate([place, hit + b * BLOCK]), np.concatenate([near, score[hit]])
            best = np.lexsort((place, -np.round(near, 9)))[:k]
            place, near = place[best], near[best]
        return place, near

    def vote(self, place: np.ndarray, near: np.ndarray) -> float:
        """Share of the label among the neighbours, each weighted by its squared cosine and by the rows of its class
        that it stands for; a small weight goes to the rate among texts without any feature."""
        weight = near * near * self.weight[place]
        return float((weight @ self.toxic[place] + _DOUBT * self.prior) / (weight.sum() + _DOUBT))


def _examples(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``most`` documents with the label and ``CLEAN`` times as many without, by a hash of their id, and the count of each class."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [own.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k) for c, k in ((0, CLEAN * most), (1, most))]
    table = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    return table.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), totals


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 1 when divided by 3; never true for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _first_of_copies(ids: np.ndarray, marks: np.ndarray) -> set[int]:
    """The examples that share less than half of their minima with any earlier one."""
    seen: dict[tuple[int, int], list[int]] = defaultdict(list)
    kept = set()
    for k in np.argsort(ids, kind="stable"):
        same: dict[int, int] = defaultdict(int)
        for j, value in enumerate(marks[k]):
            for other in seen[j, int(value)]:
                same[other] += 1
        if max(same.values(), default=0) * 2 < marks.shape[1]:
            kept.add(int(ids[k]))
            for j, value in enumerate(marks[k]):
                seen[j, int(value)].append(int(ids[k]))
    return kept


def fit(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> Index | None:
    """The index, learned from at most ``most`` examples with the label and ``CLEAN`` times as many without (a documented bound); None without both classes.

    Near copies among the examples of one class count once. Document frequencies come from all of ``docs``.
    """
    table, totals = _examples(docs, labels, most)
    if len(totals) < 2:
        return None
    spark = docs.sparkSession
    factors = permutations(16, 29)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            value, owner, count = _counted(*features(part.column("text")))
            splits = np.searchsorted(owner, np.arange(part.num_rows + 1))
            marks = minima(value, splits, factors).astype(np.int64)
            lists = [signed(value), count, marks.ravel()]
            ends = [splits, splits, np.arange(part.num_rows + 1) * marks.shape[1]]
            made = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(x, pa.int64())) for e, x in zip(ends, lists)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), part.column("hash"), *made], ["doc_id", "toxic", "hash", "features", "counts", "marks"])

    table = table.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    seen = stored(table.mapInArrow(read, "doc_id long, toxic int, hash long, features array<long>, counts array<long>, marks array<long>"), "examples")
    rows = seen.select("doc_id", "toxic", "marks").toArrow()  # at most (1 + CLEAN) * most rows of 16 numbers
    if not rows.num_rows:
        return None
    ids, toxic, marks = rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy(), np.array(rows.column("marks").to_pylist())
    # within each class: a clean text and its copy with insults tell the two apart
    kept = set().union(*(_first_of_copies(ids[toxic == c], marks[toxic == c]) for c in (0, 1)))
    kept_ids = spark.createDataFrame([(x,) for x in sorted(kept)], "doc_id long")
    seen = seen.join(F.broadcast(kept_ids), "doc_id")

    sampled = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sampled) < 2:
        return None
    each = {c: totals[c] / sampled[c] for c in (0, 1)}
    hits = seen.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("n")
    )
    # Where the label holds for most rows, each counting for those of its class it stands for, and so much more often
    # than among all examples that chance would bring forth about one such feature in all.
    share, rate = F.col("hits") / F.col("n"), sampled[1] / (sampled[0] + sampled[1])
    rest = F.col("n") - F.col("hits")
    surprise = F.col("hits") * F.log(share / rate) + F.when(rest > 0, rest * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    mostly = F.col("hits") * each[1] > _PRECISION * (F.col("hits") * each[1] + rest * each[0])
    likely = hits.where(mostly & (surprise > float(np.log(max(1, hits.count())))))
    named = likely.orderBy(F.desc(surprise), "feature").limit(FEATURES).toArrow()
    known = np.sort(named.column("feature").to_numpy())
    shared = spark.sparkContext.broadcast(known)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(len(shared.value), np.int64), 0
        for part in slices(batches):
            which, _, _ = _known(part.column("text"), shared.value)
            total += np.bincount(which, minlength=len(total))
            texts += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1)), pa.array(np.append(total, texts))], ["which", "n"])

    spread = docs.select("text").mapInArrow(frequencies, "which long, n long").groupBy("which").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(len(known) + 1)
    for r in spread:
        frequency[r["which"]] = r["n"]
    idf = np.log(1 + frequency[-1] / np.maximum(1, frequency[:-1]))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, c in zip(batch.column("features").to_pylist(), batch.column("counts").to_pylist()):
                which, at = _place(np.array(x, np.int64), shared.value)
                out.append((which.tolist(), np.array(c, np.int64)[at].tolist()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "toxic", "hash")), *(pa.array([x[k] for x in out], pa.list_(pa.int64())) for k in (0, 1))], ["doc_id", "toxic", "hash", "which", "count"]
            )

    # at most (1 + CLEAN) * most rows of at most FEATURES numbers
    examples = seen.mapInArrow(vectors, "doc_id long, toxic int, hash long, which array<long>, count array<long>").toArrow().to_pylist()
    return _index(known, idf, examples, each)


def _place(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are known: their places in ``known`` and in ``values``."""
    if not len(known) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    at = np.flatnonzero(known[place] == values)
    return place[at], at


def _known(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known features of each text: place, text and count, by text and feature."""
    values, owners = features(texts)
    table = np.zeros(1 << 16, bool)
    table[known.view(np.uint64) >> np.uint64(48)] = True
    maybe = np.flatnonzero(table[values >> np.uint64(48)])
    place, at = _place(signed(values[maybe]), known)
    which, owner, count = _counted(place, owners[maybe[at]])
    return which, owner, count


def _index(known: np.ndarray, idf: np.ndarray, examples: list[dict], each: dict[int, float]) -> Index:
    none = [x for x in examples if not x["which"]]
    weigh = lambda rows: sum(each[x["toxic"]] for x in rows)
    prior = weigh([x for x in none if x["toxic"]]) / weigh(none) if none else weigh([x for x in examples if x["toxic"]]) / weigh(examples)
    # neighbours by their heaviest feature, so that a block's bounds are tight
    some = []
    for x in examples:
        if x["which"]:
            which = np.array(x["which"])
            raw = (1 + np.log(np.array(x["count"]))) * idf[which]
            some.append((int(which[raw.argmax()]), x["doc_id"], x["toxic"], which, raw / np.sqrt((raw * raw).sum()), x["hash"]))
    some.sort(key=lambda x: x[:2])
    blocks = -(-len(some) // BLOCK)
    feature = np.concatenate([x[3] for x in some]) if some else np.zeros(0, np.int64)
    example = np.repeat(np.arange(len(some)), [len(x[3]) for x in some]) if some else np.zeros(0, np.int64)
    value = np.concatenate([x[4] for x in some]) if some else np.zeros(0)
    order = np.lexsort((example, feature))
    feature, example, value = feature[order], example[order], value[order]
    cell = feature * blocks + example // BLOCK
    begin = np.searchsorted(cell, np.arange(len(known))[:, None] * blocks + np.arange(blocks + 1)[None, :])
    greatest = np.zeros((len(known), blocks))
    np.maximum.at(greatest, (feature, example // BLOCK), value)
    return Index(
        known,
        idf,
        np.array([x[1] for x in some], np.int64),
        np.array([x[2] for x in some], float),
        np.array([each[x[2]] / each[1] for x in some]),
        begin,
        example,
        value,
        greatest,
        prior,
        np.array([x[5] for x in some], np.int64),
    )


def score_documents(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES, nearest: int = NEAREST, text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, evidence; with ``text`` all
    columns of ``docs`` in ``doc`` instead of the first two.

    ``labels`` (doc_id, toxic 0 or 1) teach only where crc32 of the id as text
    leaves no 1 when divided by 3; a document labelled twice counts as toxic if
    one label says so; other labels are ignored. ``score`` is the share of toxic
    votes among the nearest examples, ``predicted`` 1 from 0.7 on, ``evidence``
    up to three neighbours (doc_id, cosine, toxic). Texts without any feature,
    null and empty ones among them, get the rate of toxic examples without one.
    Without examples of both classes all scores are 0. Equal texts score alike,
    and an example with the very text that is scored has no vote on it, so no
    label enters its own row's score. Very long texts are read whole; repeated
    rows repeat; an empty table gives an empty result.
    """
    index = fit(docs, labels, most)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part in slices(released(batches), "_text", 1 << 20):
            texts = part.column("_hash").to_numpy()
            scores = np.zeros(part.num_rows)
            evidence: list[list[dict]] = [[] for _ in range(part.num_rows)]
            if index is not None:
                scores[:] = index.prior
                which, owner, count = _known(part.column("_text"), index.known)
                edges = np.searchsorted(owner, np.arange(part.num_rows + 1))
                for k in np.flatnonzero(np.diff(edges)):
                    own = slice(edges[k], edges[k + 1])
                    place, near = index.nearest(which[own], index.vector(which[own], count[own]), nearest, index.own(texts[k]))
                    scores[k] = index.vote(place, near)
                    evidence[k] = [{"doc_id": int(index.ids[p]), "cosine": float(c), "toxic": int(index.toxic[p])} for p, c in zip(place[:3], near[:3])]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(scores), pa.array(evidence, kind)], ["doc", "score", "evidence"])

    own = F.coalesce("text", F.lit(""))
    asked = docs.select(F.struct("*" if text else "doc_id").alias("doc"), own.alias("_text"), F.xxhash64(own).alias("_hash"))
    more = StructType.fromDDL("score double, evidence array<struct<doc_id:bigint,cosine:double,toxic:int>>")
    made = asked.mapInArrow(score, StructType([asked.schema["doc"], *more.fields])).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    if text:
        return made
    return made.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "score", "predicted", "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """The rows of ``docs`` that ``score_documents`` doesn't predict as toxic, with their columns: nulls, empty and very
    long texts, repeated rows and an empty table as stated there."""
    return score_documents(docs, labels, most, text=True).where("predicted = 0").select("doc.*")
