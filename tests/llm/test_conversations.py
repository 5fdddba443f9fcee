import hashlib
import random
import re
import zlib

import pytest

from skyledger.llm import conversations


def sequences(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in own.items()}


def branched(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c / 20) * 20
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rebuilt):
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, ids in members.items():
        subtree = [x for x in members if x[: len(node)] == node]
        children = [x for x in subtree if len(x) == len(node) + 1]
        leaves = [x for x in subtree if not any(y[: len(x)] == x and len(y) > len(x) for y in subtree)]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in subtree if x)
        ends = ",".join(str(c) for c in sorted(ids) if len(rebuilt[c]) == len(node))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return frame.selectExpr("*", "'x' AS ids", "'y' AS words", "1 AS id", "2 AS n", "3 AS depth", "4 AS shard")


def run(spark, rows, **options):
    out = conversations.prefix_trie(conversations.branched(conversations.encoded_sequences(table(spark, rows))), **options)
    return sorted((tuple(r) for r in out.collect()), key=repr)


def forest(n, seed):
    rng = random.Random(seed)
    return [(c, t, rng.choice("ua"), " ".join(["w"] * rng.randint(0, 3))) for c in range(n) for t in range(rng.randint(1, 6))]


@pytest.mark.parametrize("shard_turns", [1 << 18, 7])
def test_nodes_as_brute_force(spark, shard_turns):
    rows = forest(120, 5)
    assert run(spark, rows, shard_turns=shard_turns) == brute(branched(sequences(rows)))


def test_edge_cases(spark):
    rows = [
        (0, 0, "u", "hello there"), (0, None, "s", None), (0, 1, None, "x"), (1, 3, "u", ""), (1, 2, "u", "a b\tc"),
        (-21, 0, "u", "left"), (-20, 0, "u", "base"), (-20, 1, "u", "base two"), (None, 0, "u", "nobody"), (45, 0, "ab", "c"), (46, 0, "a", "bc"),
        (60, 0, "u", "long " * 100_000), (61, 0, "u", "long " * 100_000), (47, 0, "u", "only"), (48, 0, "u", "only"), (100, None, None, None),
    ]
    assert run(spark, rows, shard_turns=3) == brute(branched(sequences(rows)))


def test_long_and_very_common_conversations(spark):
    rows = [(7, t, "u", f"turn {t}") for t in range(700)] + [(c, t, "u", f"turn {t}") for c in range(1000, 1300) for t in range(3)]
    for shard_turns in (1 << 18, 200):
        own = conversations.encoded_sequences(table(spark, rows))
        out = sorted((tuple(r) for r in conversations.prefix_trie(own, shard_turns).collect()), key=repr)
        assert len(out) == 701
        assert out == sorted(((min(7, 1000), d, 7 if d else None, 301 if d <= 3 else 1, int(d < 700), 1, 600 * max(0, min(3, 4 - max(d, 1))), hashlib.sha256(",".join(map(str, range(1000, 1300))).encode() if d == 3 else b"7" if d == 700 else b"").hexdigest()) for d in range(701)), key=repr)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_tree_is_balanced():
    rows = [([i], [1], 1, i, "") for i in range(1023)]
    tree, edges = conversations.balanced_tree(rows)
    assert tree.preorder() == [0, *sorted(range(1, 1024), key=lambda x: tree.turn[x])] and len(edges) == 3

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.low[node]), height(tree.high[node]))

    assert height(tree.same[0]) == 10
