"""Near-duplicate groups: b-bit MinHash with banding, links confirmed on full shingle sets.

1. Every text gets the digest of its shingle set, band keys, and the low two bits
   of each minimum, packed. Texts with equal sets are one class.
2. In each band bucket, all classes are paired with two of its members; no pairs
   within a bucket are made beyond that. Bit counts of the packed signatures
   estimate the similarity, corrected for lanes that agree by chance.
3. Pairs with an estimate that a linked pair doesn't miss are confirmed on their
   full sets, first the best of each class, then those that still join two groups.
4. Buckets whose members are still in several groups get an exact search. Members
   are described by their edits against one hub of the bucket; two members of
   which one isn't linked to the hub can only be linked if they share about half
   of the other one's edits, so a prefix of its rarest edits finds the pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.bloom import key_filter, passing
from skyledger.llm.components import connected_components
from skyledger.llm.text import minima, mix, permutations, read_words, released, shingles, signed, slices
from skyledger.session import stored

_SUM = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_LANES = 0x5555555555555555
#: Bytes of text that are in arrays at a time.
_SLICE = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Words a shingle, similarity of a link in percent, minima a band, and the chance that a link at exactly that
    similarity shares no band. More minima a band (8 to 10) suit tables of billions of rows: chance buckets get rarer
    with each, at the price of more bands."""

    size: int = 5
    percent: int = 80
    rows: int = 6
    miss: float = 2e-5

    @property
    def bands(self) -> int:
        return ceil(log(self.miss) / log(1 - (self.percent / 100) ** self.rows))

    @property
    def lanes(self) -> int:
        return self.bands * self.rows

    @property
    def most_unequal(self) -> int:
        """Unequal lanes that a linked pair exceeds with a chance under 3e-7: five standard deviations."""
        p = (1 - self.percent / 100) * 0.75
        return ceil(self.lanes * p + 5 * (self.lanes * p * (1 - p)) ** 0.5)


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    words = read_words(texts)
    values, splits = shingles(words.hash, words.splits, size)
    return [np.unique(values[a:b]) for a, b in zip(splits[:-1], splits[1:])]


def _packed(low: np.ndarray) -> np.ndarray:
    """Two low bits of each minimum, 32 to a 64-bit number."""
    wide = np.zeros((len(low), -(-low.shape[1] // 32) * 32), np.uint64)
    wide[:, : low.shape[1]] = low & 3
    shift = (np.arange(32, dtype=np.uint64) * np.uint64(2))[None, None, :]
    return (wide.reshape(len(low), -1, 32) << shift).sum(axis=2, dtype=np.uint64)


def text_key() -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, key (of id and text), n_shingles, d1, d2 (digest of the set), bands, bits."""
    rows, bands = rule.rows, rule.bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = permutations(bands * rows)
        places = permutations(rows, 41)[0]
        names = permutations(bands, 43)[1]
        for part in slices(released(batches), most=_SLICE):
            sets = _sets(part.column("text"), rule.size)
            count = np.fromiter(map(len, sets), np.int64, len(sets))
            splits = np.concatenate([[0], np.cumsum(count)])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            low = minima(flat, splits, factors)
            keys = mix((low.reshape(len(sets), bands, rows).astype(np.uint64) * places).sum(axis=2, dtype=np.uint64) + names)
            bits = _packed(low)
            ends = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat + _SUM[0]))]), np.concatenate([[np.uint64(0)], np.cumsum(mix(flat ^ _SUM[1]))])
            digests = [signed(mix(np.diff(e[splits]) + count.astype(np.uint64))) for e in ends]
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(signed(np.ascontiguousarray(x).ravel())), x.shape[1]).cast(pa.list_(pa.int64())) for x in (keys, bits)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), pa.array(count), *map(pa.array, digests), *arrays],
                ["doc_id", "key", "n_shingles", "d1", "d2", "bands", "bits"],
            )

    schema = "doc_id long, key long, n_shingles long, d1 long, d2 long, bands array<long>, bits array<long>"
    return docs.select("doc_id", "text", text_key().alias("key")).mapInArrow(run, schema)


def _unequal(a: Column, b: Column) -> Column:
    """Lanes of two packed signatures that differ."""

    def lanes(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(_LANES)))

    return F.aggregate(F.zip_with(a, b, lanes), F.lit(0), lambda x, y: x + y)


def _estimated(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """``pairs`` (u, v) that may be linked, with ``unequal`` lanes; the estimate is 1 - unequal / lanes / 0.75."""
    bits = classes.select("node", "bits")
    for side in "uv":
        pairs = pairs.join(bits.select(F.col("node").alias(side), F.col("bits").alias(f"_{side}")), side)
    return pairs.withColumn("unequal", _unequal(F.col("_u"), F.col("_v"))).where(F.col("unequal") <= rule.most_unequal).select("u", "v", "unequal")


def _confirmed(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """``pairs`` (u, v) whose full sets are similar enough."""
    for side in "uv":
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part in slices([batch], "_u", _SLICE):
                linked = []
                for k, (a, b) in enumerate(zip(*(_sets(part.column(c), rule.size) for c in ("_u", "_v")))):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if both and 100 * both >= rule.percent * (len(a) + len(b) - both):
                        linked.append(k)
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(linked, pa.int64())) for c in "uv"], ["u", "v"])

    return pairs.select("u", "v", "_u", "_v").mapInArrow(run, "u long, v long")


def _with_component(rows: DataFrame, components: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the component of ``column``; a node without links is its own."""
    own = components.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(own, column, "left").withColumn(name, F.coalesce(name, column))


def _across(pairs: DataFrame, components: DataFrame) -> DataFrame:
    return _with_component(_with_component(pairs, components, "u", "_cu"), components, "v", "_cv").where("_cu <> _cv").drop("_cu", "_cv")


def _families(crowd: DataFrame, components: DataFrame, links: DataFrame) -> DataFrame:
    """hub, node for the members of buckets that hold several components.

    A bucket's hub is the most linked node of the component with most members in
    it, or just its least node if none of them has links.
    """
    placed = _with_component(crowd.select("band", "node"), components, "node", "component")
    sizes = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("least"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("k", "component", "least")).alias("top"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    centre = degree.join(components, "node").groupBy("component").agg(F.max(F.struct("degree", "node")).alias("centre"))
    hubs = mixed.select("band", "top.component", "top.least").join(centre, "component", "left")
    hubs = hubs.select("band", F.coalesce("centre.node", "least").alias("hub"))
    return placed.select("band", "node").join(hubs, "band").select("hub", "node").distinct()


def _edits(families: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """One row per member and edit, a shingle that either the hub or the member lacks: hub, node, cost, size (of the
    hub), n (the member's edits), edit.

    With percent p and a member that lacks g shingles of the hub and has a others, ``cost`` is 100 g + p a. It is linked
    to the hub if that is at most (100 - p) size; two members are linked if both costs together are at most
    (100 - p) size + (100 + p) shared edits.
    """
    own = families.join(texts.select("node", F.col("text").alias("_own")), "node")
    both = own.join(texts.select(F.col("node").alias("hub"), F.col("text").alias("_hub")), "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, last, centre = rule.percent, None, np.zeros(0, np.uint64)
        for batch in released(batches):
            for part in slices([batch], "_own", _SLICE):
                hubs, found, head = part.column("hub").to_pylist(), [], []
                for k, own in enumerate(_sets(part.column("_own"), rule.size)):
                    if hubs[k] != last:
                        last, centre = hubs[k], _sets(part.column("_hub").slice(k, 1), rule.size)[0]
                    added, gone = np.setdiff1d(own, centre, True), np.setdiff1d(centre, own, True)
                    cost = 100 * len(gone) + p * len(added)
                    head.append((cost, len(centre), len(gone) + len(added)))
                    found.append(np.concatenate([added, gone]))
                at = np.repeat(np.arange(len(found)), [len(x) for x in found])
                numbers = [np.array(x)[at] for x in zip(*head)]
                edit = signed(np.concatenate(found)) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(at)) for c in ("hub", "node")), *(pa.array(x, pa.int64()) for x in (*numbers, edit))],
                    ["hub", "node", "cost", "size", "n", "edit"],
                )

    return both.select("hub", "node", "_own", "_hub").mapInArrow(run, "hub long, node long, cost long, size long, n long, edit long")


def _to_hub(rule: Rule) -> Column:
    return F.col("cost") <= (100 - rule.percent) * F.col("size")


def _pairs_by_edits(edits: DataFrame, components: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of one family, in different components, that may be linked though one (x) has no link to the hub.

    The other one (y) is linked to the hub or has no greater cost than x, so the
    costs say how many edits they must share at least: ``need``. In one order of
    the edits, rarest first, the first one that they share lies among the first
    n - need + 1 of y, and leaves enough edits of both after it.
    """
    p = rule.percent
    placed = _with_component(edits, components, "node", "component").withColumn("linked", _to_hub(rule))
    apart = (F.min("component") < F.max("component")).alias("apart")
    held = placed.groupBy("hub", "edit").agg(F.count(F.lit(1)).alias("held"), apart)
    rank = F.row_number().over(Window.partitionBy("hub", "node").orderBy("held", "edit"))
    # what only one component holds finds no pair, however many of its members hold it
    ranked = placed.join(held, ["hub", "edit"]).withColumn("rank", rank).where("apart")
    alone = F.ceil((2 * F.col("cost") - (100 - p) * F.col("size")) / F.lit(100 + p))
    need = F.when(F.col("linked"), F.floor(F.col("cost") / F.lit(100 + p)) + 1).otherwise(alone)
    y = ranked.where(F.col("rank") <= F.col("n") - need + 1).select(
        "hub", "edit", F.col("node").alias("u"), F.col("component").alias("_c"), F.col("linked").alias("_linked"),
        F.col("cost").alias("_cost"), (F.col("n") - F.col("rank")).alias("_after"),
    )
    x = ranked.where("NOT linked").select("hub", "edit", "node", "component", "cost", "size", (F.col("n") - F.col("rank")).alias("after"))
    met = y.join(x, ["hub", "edit"]).where(
        (F.col("_c") != F.col("component"))
        & (F.col("_linked") | (F.col("cost") >= F.col("_cost")))
        & ((100 + p) * (F.least("_after", "after") + 1) >= F.col("cost") + F.col("_cost") - (100 - p) * F.col("size"))
    )
    return met.select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct()


def _classes_and_links(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all rows, classes of equal sets, and components of the classes that have links."""
    rows = stored(sketches(docs, rule), "sketches")
    classes = rows.where("n_shingles > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("least_id"),
        F.min("key").alias("key"),
        F.first("bands").alias("bands"),
        F.first("bits").alias("bits"),
    )
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(banded.join(buckets, "band"), "members")
    pairs = members.select("node", F.explode(F.array("a", "b")).alias("hub")).where("node <> hub")
    pairs = pairs.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
    pairs = stored(_estimated(pairs, classes, rule), "pairs")

    crowd = members.where("n > 3")
    needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).unionByName(crowd.select("node")).distinct()
    keys = stored(classes.select("node", "key").join(needed, "node"), "keys")
    wanted = key_filter(keys, "key")

    @F.pandas_udf("boolean")
    def asked(key: pd.Series) -> pd.Series:
        return pd.Series(passing(wanted.value, key.to_numpy()))

    found = docs.select("text", text_key().alias("key")).where(asked("key"))
    texts = stored(found.join(keys, "key").select("node", "text").dropDuplicates(["node"]), "texts")

    both = pairs.select(F.col("u").alias("node"), "u", "v", "unequal").unionByName(pairs.select(F.col("v").alias("node"), "u", "v", "unequal"))
    best = both.groupBy("node").agg(F.min(F.struct("unequal", "u", "v")).alias("best")).select("best.u", "best.v").distinct()
    links = stored(_confirmed(best, texts, rule), "links")
    components = connected_components(links)
    more = _across(pairs.join(best, ["u", "v"], "left_anti").select("u", "v"), components)
    links = stored(links.unionByName(_confirmed(more, texts, rule)), "links")
    components = connected_components(links)

    families = _families(crowd, components, links)
    edits = stored(_edits(families, texts, rule), "edits")
    if not edits.isEmpty():
        to_hub = edits.where(_to_hub(rule)).select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
        rest = _estimated(_pairs_by_edits(edits, components, rule), classes, rule).select("u", "v")
        components = connected_components(_edges(components).unionByName(to_hub).unionByName(_confirmed(rest, texts, rule)))
    return rows, classes, components


def _edges(components: DataFrame) -> DataFrame:
    return components.select(F.col("node").alias("u"), F.col("component").alias("v"))


def _grouped(docs: DataFrame, rule: Rule) -> DataFrame:
    rows, classes, components = _classes_and_links(docs, rule)
    placed = _with_component(classes.select("d1", "d2", "node", "least_id"), components, "node", "component")
    least = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = placed.join(least, "component").select("d1", "d2", "component", "component_id")
    joined = rows.select("doc_id", "key", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    return joined.withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def near_duplicate_groups(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; a document's set
    holds its distinct runs of ``rule.size`` words, with fewer words its whole
    sequence. Two documents are linked if 100 * intersection >= percent * union.
    ``component_id`` is the least doc_id that links lead to (ids that are null
    don't count, unless there are no others); ``kept`` where it is the row's own.
    Null and empty texts have an empty set, no link and stay. Rows with one id
    and text fare alike. An empty table gives an empty result; other columns are
    ignored.
    """
    return _grouped(docs, rule).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` with one row of each group: that of the least id (null last), then of the least text key."""
    grouped = _grouped(docs, rule)
    alone = grouped.where(F.col("component").isNull()).select("key")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")
    chosen = grouped.where(F.col("component").isNotNull()).groupBy("component").agg(first).select("first.key", F.lit(True).alias("one"))
    stay = chosen.unionByName(alone.distinct().withColumn("one", F.lit(False)))
    joined = docs.select(F.struct("*").alias("doc"), "doc_id", text_key().alias("key")).join(stay, "key")
    copy = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    return joined.withColumn("copy", copy).where("copy = 1 OR NOT one").select("doc.*")
