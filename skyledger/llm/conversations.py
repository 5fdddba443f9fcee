"""The prefix trie of conversations: ternary search trees over range shards, joined at their boundaries.

1. Distinct turns (role, text) get dictionary numbers; a conversation becomes its row of numbers.
2. Equal conversations become one sequence with a count, its smallest id and the digest of its ids.
3. Sequences are dealt to shards by their order. A shard inserts the middle one first, then the middles of both halves,
   and so on, which keeps its ternary search tree balanced, and sums up members, leaves and savings in one traversal.
4. Only prefixes of a shard's first and last sequence can go on in other shards. These boundary nodes, at most two paths
   a shard, meet in one small table; every other node is done where it was made.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.mixing import word_count
from skyledger.session import stored

#: Turns a shard holds, about.
SHARD_TURNS = 1 << 18
_NOBODY = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def encoded_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, ids, words: each conversation's turns in order, as numbers of distinct (role, text) pairs and their words.

    Turns go by ``turn``, null first, equal ones by the digest of role and text. Null role or text counts as empty. Rows
    without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = stored(conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("digest"), word_count(text).alias("words")), "turns")
    distinct = turns.groupBy("digest").agg(F.any_value("words").alias("words"))
    dictionary = stored(distinct.repartitionByRange("digest").sortWithinPartitions("digest").withColumn("id", F.monotonically_increasing_id()), "dictionary")
    numbered = turns.drop("words").join(dictionary, "digest")
    ordered = numbered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("own"))
    return ordered.select("conv_id", F.col("own.id").alias("ids"), F.col("own.words").alias("words"))


def branched(sequences: DataFrame, stride: int = 20, heads: int = 4) -> DataFrame:
    """Conversations rebuilt on a shared beginning: the first h turns of conversation c - c % stride (fewer if it has fewer,
    none if it is absent), then the own turns after the first h; h is the unsigned crc32 of decimal c, modulo ``heads``.
    """
    c = F.col("conv_id")
    beginnings = sequences.where(c % stride == 0).select(
        c.alias("_base"), *(F.slice(x, 1, max(heads - 1, 1)).alias(f"_{x}") for x in ("ids", "words"))
    )
    h = (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")
    joined = sequences.withColumn("_base", c - c % stride).withColumn("_h", h).join(beginnings, "_base", "left")

    def rebuilt(name: str, kind: str):
        head = F.coalesce(F.slice(f"_{name}", F.lit(1), F.col("_h")), F.array().cast(f"array<{kind}>"))
        return F.concat(head, F.slice(name, F.col("_h") + 1, F.size(name))).alias(name)

    return joined.select("conv_id", rebuilt("ids", "long"), rebuilt("words", "long"))


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal neighbours as one row: count, smallest id, SHA-256 of the ids joined by commas. Rows come by ids, then conv_id.

    The digest is fed id by id, so a group of any size takes no memory.
    """
    names = ["ids", "words", "n", "conv_id", "ends"]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
    now, row, digest = None, None, None

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        done = []
        for conv, ids, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "words"))):
            if ids != now:
                if row:
                    done.append((*row, digest.hexdigest()))
                now, row, digest = ids, [ids, words, 1, conv], hashlib.sha256(b"%d" % conv)
            else:
                row[2] += 1
                digest.update(b",%d" % conv)
        if done:
            yield table(done)
    if row:
        yield table([(*row, digest.hexdigest())])


class TernaryTree:
    """Nodes as parallel lists; node 0 is the root. ``low`` and ``high`` lead to siblings, ``same`` to the children."""

    def __init__(self):
        self.turn, self.words, self.low, self.high, self.same = [0], [0], [-1], [-1], [-1]
        self.parent, self.depth, self.n, self.conv, self.ends = [-1], [0], [0], [None], [None]

    def insert(self, ids: list[int], words: list[int], n: int, conv: int, ends: str) -> list[int]:
        """The path of the inserted sequence."""
        path = [0]
        for turn, count in zip(ids, words):
            top, link, at = path[-1], self.same, path[-1]
            while link[at] >= 0 and self.turn[link[at]] != turn:
                at = link[at]
                link = self.low if turn < self.turn[at] else self.high
            if link[at] < 0:
                link[at] = len(self.turn)
                for column, value in ((self.turn, turn), (self.words, count), (self.low, -1), (self.high, -1), (self.same, -1),
                                      (self.parent, top), (self.depth, len(path)), (self.n, 0), (self.conv, None), (self.ends, None)):
                    column.append(value)
            path.append(link[at])
        last = path[-1]
        self.n[last], self.conv[last], self.ends[last] = n, conv, ends
        return path

    def preorder(self) -> list[int]:
        """Parents before children, children by ascending turn."""
        out, stack = [], [0]
        while stack:
            node = stack.pop()
            out.append(node)
            children, at, waiting = [], self.same[node], []
            while at >= 0 or waiting:
                while at >= 0:
                    waiting.append(at)
                    at = self.low[at]
                at = waiting.pop()
                children.append(at)
                at = self.high[at]
            stack += reversed(children)
        return out


def balanced_tree(sequences: list[tuple]) -> tuple[TernaryTree, set[int]]:
    """The tree of ordered sequences (ids, words, n, conv, ends), and its nodes on the first or the last one's path."""
    tree, edges = TernaryTree(), {0}
    halves = deque([(0, len(sequences))])
    while halves:
        lo, hi = halves.popleft()
        if lo < hi:
            middle = (lo + hi) // 2
            path = tree.insert(*sequences[middle])
            if middle in (0, len(sequences) - 1):
                edges.update(path)
            halves += [(lo, middle), (middle + 1, hi)]
    return tree, edges


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of one shard. Boundary nodes (``spine`` is their place on the paths) carry what hangs off them inside the shard."""
    sequences = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("ids", "words", "n", "conv_id", "ends")))]
    if not sequences:
        return
    shard = TaskContext.get().partitionId()
    tree, edges = balanced_tree(sequences)
    order = tree.preorder()
    spine = {node: k for k, node in enumerate(x for x in order if x in edges)}
    count = len(order)
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    for node in reversed(order):
        up = tree.parent[node]
        if node not in spine:
            leaves[node] = leaves[node] if children[node] else 1
            saved[node] += (tree.n[node] - 1) * tree.words[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
        if up >= 0:
            tree.n[up] += tree.n[node]
            tree.conv[up] = tree.conv[node] if tree.conv[up] is None else min(tree.conv[up], tree.conv[node])
    for lo in range(0, count, 1 << 16):
        part = order[lo : lo + (1 << 16)]
        up = [tree.parent[x] for x in part]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard] * len(part), pa.int32()),
                pa.array([spine.get(x) for x in part], pa.int32()),
                pa.array([spine.get(p) for p in up], pa.int32()),
                pa.array([tree.conv[p] if p >= 0 and p not in spine else None for p in up], pa.int64()),
                pa.array([tree.turn[x] for x in part], pa.int64()),
                pa.array([tree.words[x] for x in part], pa.int64()),
                pa.array([tree.conv[x] for x in part], pa.int64()),
                pa.array([tree.depth[x] for x in part], pa.int64()),
                pa.array([tree.n[x] for x in part], pa.int64()),
                pa.array([children[x] for x in part], pa.int64()),
                pa.array([leaves[x] for x in part], pa.int64()),
                pa.array([saved[x] for x in part], pa.int64()),
                pa.array([tree.ends[x] for x in part], pa.string()),
            ],
            ["shard", "spine", "parent_spine", "parent_conv_id", "turn", "words", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
        )


def _merged_boundary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundary nodes of all shards, in order; equal prefixes become one node. One row a given row: its node's row for the
    first of them (``first``), and for the others only what their children in the shard look up."""
    rows = [r for b in batches for r in b.to_pylist()]
    nodes, path, node_of = [], [], []
    for r in rows:
        depth = r["depth"]
        if depth < len(path) and nodes[path[depth]]["turn"] == r["turn"]:
            node = nodes[path[depth]]
            for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                node[c] += r[c]
            node["conv_id"] = min(node["conv_id"], r["conv_id"])
            node["ends_sha256"] = node["ends_sha256"] or r["ends_sha256"]
            node_of.append((path[depth], False))
        else:
            del path[depth:]
            nodes.append({**r, "up": path[-1] if path else None})
            path.append(len(nodes) - 1)
            node_of.append((path[-1], True))
    for node in reversed(nodes):
        node["n_leaves"] = node["n_leaves"] if node["n_children"] else 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
        if node["up"] is not None:
            up = nodes[node["up"]]
            up["n_children"] += 1
            up["n_leaves"] += node["n_leaves"]
            up["saved_tokens"] += node["saved_tokens"]
    out = []
    for r, (k, first) in zip(rows, node_of):
        node = nodes[k]
        up = None if node["up"] is None else nodes[node["up"]]["conv_id"]
        out.append({"shard": r["shard"], "spine": r["spine"], "first": first, "parent_conv_id": up} | {c: node[c] for c in (x.split()[0] for x in _NODE.split(", "))})
    if out:
        kinds = {"shard": pa.int32(), "spine": pa.int32(), "first": pa.bool_(), "parent_conv_id": pa.int64(), "ends_sha256": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds.get(c, pa.int64())) for c in out[0]], list(out[0]))


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct beginning of the ``sequences`` (conv_id, ids, words): the nodes of their prefix trie.

    ``conv_id`` is the smallest member, ``parent_conv_id`` the parent's (root: null); ``n_convs`` counts members,
    ``n_children`` children, ``n_leaves`` childless nodes in the subtree, the node itself included; ``saved_tokens`` sums
    (n_convs - 1) * words of the last turn over the subtree; ``ends_sha256`` is the digest of the ids of the members that
    end here, ascending, joined by commas. Empty sequences belong to the root; repeated conv_ids count each. No sequences
    give no nodes. A sequence is one row, so its turns must fit in a task; equal ones may be any share of all rows.
    """
    collapsed = stored(
        sequences.repartition(F.xxhash64("ids"))
        .sortWithinPartitions("ids", "conv_id")
        .mapInArrow(_collapsed, "ids array<long>, words array<long>, n long, conv_id long, ends string"),
        "sequences",
    )
    turns = collapsed.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    ranged = collapsed.repartitionByRange(max(1, -(-turns // shard_turns)), "ids").sortWithinPartitions("ids")
    schema = f"shard int, spine int, parent_spine int, parent_conv_id long, turn long, words long, {_NODE}"
    nodes = stored(ranged.mapInArrow(_shard_nodes, schema), "nodes")
    boundary = nodes.where("spine IS NOT NULL").drop("parent_spine", "parent_conv_id").repartition(1).sortWithinPartitions("shard", "spine")
    merged = stored(boundary.mapInArrow(_merged_boundary, f"shard int, spine int, first boolean, parent_conv_id long, {_NODE}"), "boundary")
    above = merged.select("shard", F.col("spine").alias("parent_spine"), F.col("conv_id").alias("_above"))
    inner = nodes.where("spine IS NULL").join(above, ["shard", "parent_spine"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOBODY)).alias("ends_sha256")]
    return inner.select(out).unionByName(merged.where("first").select(out))


ORACLE = """
WITH RECURSIVE turns AS (
  SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
         lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT h.conv_id, t.pos, t.id, t.words FROM heads h JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 20 AND t.pos <= h.h
  UNION ALL SELECT conv_id, pos, id, words FROM heads JOIN turns USING (conv_id) WHERE pos > h
), placed AS (
  SELECT conv_id, id, words, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM rebuilt
), prefixes AS (
  SELECT conv_id, 0 AS depth, '' AS node, NULL::VARCHAR AS up, 0 AS words FROM heads
  UNION ALL
  SELECT p.conv_id, r.depth + 1, sha256(r.node || p.id), r.node, p.words
  FROM prefixes r JOIN placed p ON p.conv_id = r.conv_id AND p.depth = r.depth + 1
), last AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id
), nodes AS (
  SELECT node, min(p.conv_id) AS conv_id, p.depth, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
         sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (p.depth = l.depth), '')) AS ends_sha256
  FROM prefixes p JOIN last l USING (conv_id) GROUP BY node, p.depth
), children AS (SELECT up AS node, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up
), sums AS (
  SELECT a.node, sum(n.own) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM (SELECT DISTINCT x.node, y.node AS below FROM prefixes x JOIN prefixes y ON y.conv_id = x.conv_id AND y.depth >= x.depth) a
  JOIN nodes n ON n.node = a.below LEFT JOIN children c ON c.node = a.below GROUP BY a.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
       s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN children c USING (node) LEFT JOIN nodes u ON u.node = n.up
"""
