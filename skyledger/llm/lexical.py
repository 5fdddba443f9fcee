"""Ranked lexical search by branch and bound over document FP-trees.

1. One pass over the texts counts every document's terms and keeps the counts of
   those terms that some item holds: its restricted vector. Document frequencies
   come from the same pass.
2. Each task grows FP-trees over its vectors: a vector's terms are put in order
   of frequency, and documents with the same first terms share a path. A subtree
   knows the greatest tf of each term and the least m among its documents.
3. For each item, subtrees are entered depth first, best bound first; one whose
   bound is below the item's k-th score so far is left out. The bound is the
   score of a document with the subtree's greatest tf and least m, which no
   document of the subtree exceeds, so the result is exact.

A task keeps k documents an item; these meet in two steps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from skyledger.llm.text import hash_spans, slices, utf8
from skyledger.session import stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Items searched in one pass: at most so many, with so many bytes of text (one item may be longer).
ITEMS, ITEM_BYTES = 1024, 1 << 20
#: A tree holds about so many (document, term) cells; its leaves so many documents.
CELLS, LEAF = 1 << 22, 32
#: Tasks whose best documents meet in the first step.
_TASKS = 256
_APART = np.zeros(256, bool)
_APART[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_APART[65:91] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LAST = np.iinfo(np.int64).max


def find_terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of every term, and each text's part of them."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_APART[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, at)


class Vocabulary:
    """The terms of a block of items: number ``i`` is the term ``names[i]``, lower-cased bytes."""

    def __init__(self, terms: Iterable[bytes]):
        names = sorted(set(terms))
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in names])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(names), np.uint8)
        hashes = hash_spans(self.data, self.at[:-1], self.at[1:])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.names = names

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which spans are terms of the vocabulary, and their numbers. Hashes find the term, its bytes confirm it."""
        if not len(starts) or not self.names:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = hash_spans(data, starts, ends)
        near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.names) - 1)
        number = self.order[near]
        size = ends - starts
        hit = np.flatnonzero((self.hashes[near] == hashes) & (size == np.diff(self.at)[number]))
        number, size, begin = number[hit], size[hit], starts[hit]
        if not len(hit):
            return hit, number
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        same = _LOWER[data[place + np.repeat(begin, size)]] == self.data[place + np.repeat(self.at[number], size)]
        whole = np.logical_and.reduceat(same, first)
        return hit[whole], number[whole]


def _terms(text: str | None) -> set[bytes]:
    data, at = utf8(pa.array([text], pa.string()))
    starts, ends, _ = find_terms(data, at)
    raw = _LOWER[data].tobytes()
    return {raw[a:b] for a, b in zip(starts, ends)}


def _vectors(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n, terms, tfs of each document; of each task, one row with ``summary``: terms and the documents that hold them."""
    kind = docs.schema["doc_id"].dataType
    schema = StructType(
        [StructField("doc_id", kind), StructField("n", LongType()), StructField("terms", ArrayType(IntegerType())),
         StructField("tfs", ArrayType(IntegerType())), StructField("summary", BooleanType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        many = max(1, len(words.names))
        held = np.zeros(many, np.int64)

        def table(ids, n, at, terms, tfs, summary):
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (terms, tfs)]
            return pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), *lists, pa.array(np.full(len(n), summary))], ["doc_id", "n", "terms", "tfs", "summary"])

        ids_type = None
        for batch in slices(batches):
            ids = batch.column("doc_id")
            ids_type = ids.type
            data, at = utf8(batch.column("text"))
            starts, ends, splits = find_terms(data, at)
            hit, number = words.numbers(data, starts, ends)
            cell, tf = np.unique((np.searchsorted(splits, hit, "right") - 1) * many + number, return_counts=True)
            doc, number = cell // many, cell % many
            held += np.bincount(number, minlength=many)
            yield table(ids, np.diff(splits), np.searchsorted(doc, np.arange(len(ids) + 1)), number, tf, False)
        if ids_type is not None:
            some = np.flatnonzero(held)
            yield table(pa.nulls(1, ids_type), np.zeros(1), np.array([0, len(some)]), some, held[some], True)

    return docs.select("doc_id", "text").mapInArrow(count, schema)


@dataclass
class Tree:
    """``lo``, ``hi``: each node's documents; ``below``: its children (a leaf has none); ``tf``, ``m``: greatest tf a term and least m."""

    lo: list[int]
    hi: list[int]
    below: list[np.ndarray]
    tf: np.ndarray
    m: np.ndarray


def grow(paths: list[bytes], tf: np.ndarray, m: np.ndarray, leaf: int = LEAF) -> Tree:
    """The FP-tree of documents in the order of their ``paths`` (four bytes a term, most frequent first).

    Terms that all documents of a node share are passed over; siblings with few documents share a leaf.
    """
    lo, hi, below, parent = [0], [len(paths)], [[]], [-1]
    todo = [0]

    def add(node: int, start: int, stop: int) -> None:
        below[node].append(len(lo))
        for column, value in ((lo, start), (hi, stop), (below, []), (parent, node)):
            column.append(value)

    while todo:
        node = todo.pop()
        first, last = lo[node], hi[node]
        if last - first <= leaf or paths[first] == paths[last - 1]:
            continue
        a, b = paths[first], paths[last - 1]
        depth = next((k for k in range(0, min(len(a), len(b)), 4) if a[k : k + 4] != b[k : k + 4]), min(len(a), len(b)))
        cuts = [first, *(i for i in range(first + 1, last) if paths[i][depth : depth + 4] != paths[i - 1][depth : depth + 4]), last]
        start = first
        for i in range(1, len(cuts)):
            wide = cuts[i] - cuts[i - 1] > leaf
            if i + 1 < len(cuts) and not wide and cuts[i + 1] - start <= leaf:
                continue
            if wide and start < cuts[i - 1]:
                add(node, start, cuts[i - 1])
                start = cuts[i - 1]
            if wide:
                todo.append(len(lo))
            add(node, start, cuts[i])
            start = cuts[i]
    most, least = np.zeros((len(lo), tf.shape[1]), tf.dtype), np.full(len(lo), _LAST)
    for node in range(len(lo) - 1, -1, -1):
        if not below[node]:
            most[node], least[node] = tf[lo[node] : hi[node]].max(0, initial=0), m[lo[node] : hi[node]].min(initial=_LAST // 16)
        if node:
            np.maximum(most[parent[node]], most[node], out=most[parent[node]])
            least[parent[node]] = min(least[parent[node]], least[node])
    return Tree(lo, hi, [np.array(x, np.int64) for x in below], most, least)


def scores(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Rows' scores: ``tf`` has a column a weight."""
    tf = tf.astype(np.int64)
    return (weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[:, None]))).sum(1)


class Best:
    """The k best (score, doc_id) pairs so far; equal scores by ascending id, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """A subtree bounded below this holds none of the best."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, score: np.ndarray, ids: list) -> None:
        keep = np.flatnonzero(score >= self.least())
        if len(keep):
            rows = [(int(score[i]), ids[i]) for i in keep]
            self.rows = sorted(self.rows + rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.k]


def search_tree(tree: Tree, tf: np.ndarray, m: np.ndarray, ids: list, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Adds the tree's documents that belong to the best; gives the number of documents scored."""
    stack, scored = [(_LAST, 0)], 0
    while stack:
        bound, node = stack.pop()
        if bound < best.least():
            continue
        below = tree.below[node]
        if len(below):
            bounds = scores(weights, tree.tf[below[:, None], terms], tree.m[below])
            inward = np.argsort(bounds, kind="stable")
            stack += [(int(bounds[i]), int(below[i])) for i in inward if bounds[i] >= best.least()]
        else:
            lo, hi = tree.lo[node], tree.hi[node]
            scored += hi - lo
            best.add(scores(weights, tf[lo:hi, terms], m[lo:hi]), ids[lo:hi])
    return scored


def document_m(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """10 + 90 n N div L, in whole numbers of any length."""
    if len(n) and int(n.max()) * 90 * documents >= 1 << 63:
        return np.array([10 + 90 * int(x) * documents // total for x in n], np.int64)
    return 10 + 90 * n.astype(np.int64) * documents // max(total, 1)


def _search_block(docs: DataFrame, items: list[tuple[object, str | None]], k: int) -> DataFrame:
    spark = docs.sparkSession
    merged: dict[object, set[bytes]] = {}
    for item, text in items:
        merged.setdefault(item, set()).update(_terms(text))
    vocabulary = Vocabulary(t for terms in merged.values() for t in terms)
    vectors = stored(_vectors(docs, vocabulary), "vectors")
    rows = vectors.where(~F.col("summary"))
    documents, total = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    pairs = vectors.where("summary").select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.tfs").alias("df"))
    df = np.zeros(len(vocabulary.names), np.int64)
    for term, held in pairs.collect():  # one row a term of the block's items
        df[term] = held
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    number = {t: i for i, t in enumerate(vocabulary.names)}
    wanted = []
    for item, terms in merged.items():
        own = sorted(number[t] for t in terms if df[number[t]])
        weight = [floor(1000 * log((2 * documents + 2) / (2 * int(df[i]) + 1))) for i in own]
        wanted.append((item, rank[own], np.array(weight, np.int64)))
    wanted = [x for x in wanted if len(x[1])]
    shared = spark.sparkContext.broadcast((wanted, rank))
    many = max(1, CELLS // max(1, len(df)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, rank = shared.value
        best = [Best(k) for _ in wanted]
        held, kinds = [], None

        def one_tree() -> None:
            ids = [i for b in held for i in b.column("doc_id").to_pylist()]
            n = np.concatenate([b.column("n").to_numpy(zero_copy_only=False) for b in held])
            size = np.concatenate([b.column("terms").value_lengths().to_numpy(zero_copy_only=False) for b in held])
            terms = rank[np.concatenate([b.column("terms").flatten().to_numpy() for b in held])]
            tf = np.zeros((len(ids), len(rank)), np.int32)
            tf[np.repeat(np.arange(len(ids)), size), terms] = np.concatenate([b.column("tfs").flatten().to_numpy() for b in held])
            at = np.concatenate([[0], np.cumsum(size)])
            paths = [np.sort(terms[a:b]).astype(">u4").tobytes() for a, b in zip(at[:-1], at[1:])]
            order = sorted(range(len(ids)), key=paths.__getitem__)
            tf, m, ids, paths = tf[order], document_m(n[order], documents, total), [ids[i] for i in order], [paths[i] for i in order]
            tree = grow(paths, tf, m)
            for (_, own, weights), found in zip(wanted, best):
                search_tree(tree, tf, m, ids, own, weights, found)

        for batch in batches:
            kinds = batch.column("doc_id").type
            for lo in range(0, batch.num_rows, many):
                part = batch.slice(lo, many)
                if held and sum(b.num_rows for b in held) + part.num_rows > many:
                    one_tree()
                    held = []
                held.append(part)
        if held and wanted:
            one_tree()
        out = [(item, i, s) for (item, _, _), b in zip(wanted, best) for s, i in b.rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], item_kind), pa.array([r[1] for r in out], kinds), pa.array([r[2] for r in out], pa.int64())], ["item_id", "doc_id", "score"])

    item_kind = pa.int64() if all(isinstance(x[0], (int, type(None))) for x in wanted) else None
    kind = "long" if item_kind is not None else "string"
    return rows.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs").mapInArrow(search, f"item_id {kind}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The items in order of their ids, in blocks of bounded size; equal ids stay together."""
    block, size = [], 0
    for row in items.select("item_id", "text").orderBy("item_id").toLocalIterator():
        long = len((row.text or "").encode())
        if block and row.item_id != block[-1][0] and (len(block) >= ITEMS or size + long > ITEM_BYTES):
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += long
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` highest-scoring documents with a score above 0.

    Terms are maximal matches of ``TERM`` in the whole text, A-Z lower-cased; null and empty texts have none. Equal
    scores go by ascending doc_id, null last; rows that repeat are ranked each. Items that share an item_id (null counts
    as one) are one item with the terms of all of them; an item without terms, or whose terms no document holds, gives no
    row. Empty tables give an empty result; further columns of either table are ignored. Item ids are whole numbers or
    strings. Items are the queries: they pass the driver in blocks of at most ``ITEMS``, each with one pass over the texts.
    """
    tops = [_search_block(docs, block, k) for block in _blocks(items)]
    if not tops:
        kind, own = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {own}, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = reduce(DataFrame.unionByName, tops).withColumn("_task", F.floor(F.spark_partition_id() / _TASKS))
    near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "_task").orderBy(*order))).where(F.col("rank") <= k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


ORACLE = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL
), lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths
), df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term
), item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT
         * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
  FROM item JOIN df USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id) CROSS JOIN totals GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
