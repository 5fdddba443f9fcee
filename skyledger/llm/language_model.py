"""Cross-entropy difference: how much better a target model predicts a text than a background model.

A text is never scored by counts of its own: what it added to a model is taken off first, so a text in the target scores
like an equally good one outside.

Both are bigram models of one make over one vocabulary. Words, contexts and
pairs of words are counted exactly, all of them: texts are read into chunks,
each chunk sends its distinct keys to ranges of keys, where they are added up
over all chunks, and gets the totals of its own keys back. What is counted
grows with the corpus, and nothing but three sums reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import most_frequent
from skyledger.llm.text import mix, read_words, signed, slices
from skyledger.session import stored

PRIOR = 20.0
#: Bytes of text a chunk, and tokens of the corpus for each range of keys.
_CHUNK, _RANGE = 16 << 20, 1 << 20
#: Tokens, about, whose own counts are taken at a time; a text is never split.
_TOKENS = 1 << 18
_UNKNOWN, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_KINDS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, byte by place, compressed behind their count."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel()


def _rising(values: np.ndarray) -> np.ndarray:
    """The steps between ascending unsigned numbers, which pack tighter."""
    return signed(np.diff(values, prepend=np.uint64(0)))


def _risen(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.view(np.uint64), dtype=np.uint64)


def _keys(words: np.ndarray, number: np.ndarray, splits: np.ndarray, cells: int | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """A chunk's distinct keys, ascending, and for each token the places of its pair, word and context among them.

    A key is a 64-bit hash, odd for words and even for pairs and contexts.
    """
    size = np.uint64(len(words) + 1)
    before = np.empty_like(number)
    before[1:] = number[:-1]
    before[splits[:-1][np.diff(splits) > 0]] = len(words)
    pair, place = np.unique(before.astype(np.uint64) * size + number.astype(np.uint64), return_inverse=True)
    context = np.append(words, _START)
    two = mix(mix(context[(pair // size).astype(np.int64)] + _KINDS[0]) + words[(pair % size).astype(np.int64)])
    if cells:
        two = mix((two & np.uint64(cells - 1)) + _KINDS[0])
    odd = np.uint64(1)
    keys, at = np.unique(np.concatenate([two & ~odd, mix(words + _KINDS[1]) | odd, mix(context + _KINDS[2]) & ~odd]), return_inverse=True)
    n, v = len(pair), len(words)
    return keys, [at[:n][place], at[n : n + v][number], at[n + v :][before]]


def _chunk(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _risen(_unpacked(row["words"])), _unpacked(row["number"]), _unpacked(row["splits"])


def _losses(pair: np.ndarray, word: np.ndarray, context: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """Nats a token: pair counts with ``PRIOR`` words of the word model mixed in, which has one more of each word."""
    return -np.log((pair + PRIOR * ((word + 1) / (total + v + 2))) / (context + PRIOR))


def _own_counts(place: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """For each token, how often its text holds the key at its ``place``."""
    out, lo = np.zeros(len(place), np.int64), 0
    while lo < len(splits) - 1:
        hi = max(lo + 1, int(np.searchsorted(splits, splits[lo] + _TOKENS, "right")) - 1)
        own = place[splits[lo] : splits[hi]]
        text = np.repeat(np.arange(hi - lo), np.diff(splits[lo : hi + 1]))
        _, inverse, count = np.unique(text * (own.max(initial=0) + 1) + own, return_inverse=True, return_counts=True)
        out[splits[lo] : splits[hi]] = count[inverse]
        lo = hi
    return out


def _vocabulary(docs: DataFrame, most: int) -> np.ndarray:
    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            word, n = np.unique(signed(read_words(part.column("text")).hash), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n.astype(np.int64))], ["word", "n"])

    words = docs.select("text").mapInArrow(distinct_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return np.sort(most_frequent(words, most).select("word").toArrow().column("word").to_numpy().view(np.uint64))


def _chunks(docs: DataFrame, known) -> DataFrame:
    """The texts as chunks of word numbers: chunk, doc_id (of each text), tokens, words (hashes), number (of each token), splits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, part in enumerate(slices(batches, most=_CHUNK)):
            found = read_words(part.column("text"))
            hashes = found.hash
            if known is not None:
                hashes = np.where(np.isin(hashes, known.value), hashes, _UNKNOWN)
            words, number = np.unique(hashes, return_inverse=True)
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id").cast(pa.int64()))
            packed = [pa.array([_packed(x)], pa.binary()) for x in (_rising(words), number.astype(np.int64), found.splits.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + k]), ids, pa.array([len(number)], pa.int64()), *packed], ["chunk", "doc_id", "tokens", "words", "number", "splits"]
            )

    return stored(
        docs.select("doc_id", "text").mapInArrow(read, "chunk long, doc_id array<long>, tokens long, words binary, number binary, splits binary"), "chunks"
    )


def _with_target(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """``chunks`` with ``target``: the places of the texts whose id is among ``ids``; null for none."""
    places = chunks.select("chunk", F.posexplode("doc_id").alias("place", "doc_id"))
    hits = places.join(ids, "doc_id", "left_semi").groupBy("chunk").agg(F.collect_list("place").alias("target"))
    return chunks.join(hits, "chunk", "left")


def _wanted(row: dict, texts: int) -> np.ndarray:
    out = np.zeros(texts, bool)
    out[row["target"] or []] = True
    return out


def _totals(chunks: DataFrame, cells: int | None) -> DataFrame:
    """For every chunk and range of keys the counts of its keys, in ascending order, in all documents (n) and in the
    target (t): chunk, part, n, t. Rows without a chunk have the words of a part: v, all, own."""
    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    bits = max(0, int(tokens // _RANGE).bit_length())

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                words, number, splits = _chunk(row)
                keys, places = _keys(words, number, splits, cells)
                wanted = np.repeat(_wanted(row, len(splits) - 1), np.diff(splits))
                n, t = (sum(np.bincount(p[which], minlength=len(keys)) for p in places) for which in (slice(None), wanted))
                part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                edge = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(keys))
                for lo, hi in zip(edge[:-1], edge[1:]):
                    packed = [pa.array([_packed(x)], pa.binary()) for x in (_rising(keys[lo:hi]), n[lo:hi], t[lo:hi])]
                    yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]]), pa.array([part[lo]]), *packed], ["chunk", "part", "keys", "n", "t"])

    def add(table: pa.Table) -> pa.Table:
        steps, n, t = ([_unpacked(x.as_py()) for x in table.column(c)] for c in ("keys", "n", "t"))
        edge = np.cumsum([0, *map(len, steps)])
        keys, place = np.unique(np.concatenate([_risen(x) for x in steps]), return_inverse=True)
        total = [np.bincount(place, np.concatenate(x)).astype(np.int64) for x in (n, t)]
        word = keys & np.uint64(1) == 1
        packed = [pa.array([*(_packed(x[place[lo:hi]]) for lo, hi in zip(edge[:-1], edge[1:])), None], pa.binary()) for x in total]
        sums = [pa.array([None] * len(n) + [int(x)], pa.int64()) for x in (word.sum(), total[0][word].sum(), total[1][word].sum())]
        part = table.column("part").to_pylist()
        columns = [pa.array([*table.column("chunk").to_pylist(), None], pa.int64()), pa.array([*part, part[0]], pa.int64()), *packed, *sums]
        return pa.table(columns, ["chunk", "part", "n", "t", "v", "all", "own"])

    sent = chunks.select("chunk", "words", "number", "splits", "target").mapInArrow(counts, "chunk long, part long, keys binary, n binary, t binary")
    return stored(sent.groupBy("part").applyInArrow(add, "chunk long, part long, n binary, t binary, v long, all long, own long"), "totals")


def score_against_target(docs: DataFrame, target_ids: DataFrame, vocabulary: int | None = None, cells: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, target_loss, background_loss, difference.

    ``target_ids`` (doc_id) names the documents the target model counts; the
    background model counts all; from both, a text's own counts are taken off
    before it is scored (copies of it in other rows stay). Losses are nats a token (words, A-Z lower-cased),
    ``difference`` is target less background: the lower, the more like the target.
    Null and empty texts have no tokens and losses of 0. Repeated ids in
    ``target_ids`` count once, null ids never; an empty target gives the uniform
    word model. Repeated rows repeat; an empty table gives an empty result;
    other columns are ignored.

    Every word and every pair has its own count (by 64-bit hashes). Only a caller who
    asks for it gets smaller models: of the ``vocabulary`` most frequent words, which
    then reach the driver, or of pairs hashed into ``cells`` (a power of two).
    """
    known = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(_vocabulary(docs, vocabulary))
    chunks = _with_target(_chunks(docs, known), target_ids.select("doc_id").dropna().distinct())
    totals = _totals(chunks, cells)
    sums = totals.where("chunk is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v", "all", "own"))).first()
    v = sums["v"] if known is None else len(known.value)
    sizes = [sums["own"], sums["all"]]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in ("words", "number", "splits", "target")}
        words, number, splits = _chunk(row)
        ids = left.column("doc_id").combine_chunks().flatten()
        count, full = np.diff(splits), np.flatnonzero(np.diff(splits))
        means = np.zeros((2, len(ids)))
        if len(full):
            _, places = _keys(words, number, splits, cells)
            right = right.sort_by("part")
            own = [_own_counts(p, splits) for p in places]
            within = np.repeat(count, count)
            for k, (column, total) in enumerate(zip("tn", sizes)):
                counted = np.concatenate([_unpacked(x.as_py()) for x in right.column(column)])
                mine = np.repeat(_wanted(row, len(ids)), count) if column == "t" else True
                losses = _losses(*(counted[p] - o * mine for p, o in zip(places, own)), total - within * mine, v)
                means[k, full] = np.add.reduceat(losses, splits[:-1][full]) / count[full]
        columns = [ids, pa.array(count.astype(np.int64)), *map(pa.array, means), pa.array(means[0] - means[1])]
        return pa.table(columns, ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])

    own = chunks.select("chunk", "doc_id", "words", "number", "splits", "target").groupBy("chunk")
    counted = totals.where("chunk is not null").select("chunk", "part", "n", "t").groupBy("chunk")
    return own.cogroup(counted).applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, difference double")
