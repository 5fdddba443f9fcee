import math
import random
import re

import numpy as np

from skyledger.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def brute(docs, items, k):
    bags = [(i, terms(t)) for i, t in docs]
    full = [len(b) for _, b in bags if b]
    total, many = sum(full), len(full)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        found = []
        for i, b in bags:
            m = 10 + 90 * len(b) * many // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * b.count(t) // (1000 * b.count(t) + 8 * m)) for t in own if t in df)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def run(spark, make, docs, items, k=10, extra=True):
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id", "'y' AS score")
    return sorted(map(tuple, lexical.search(make(docs, extra=extra), table, k).collect()), key=repr)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    return [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(1, 60)))) for i in range(n)], words


def test_ranks_as_brute_force(spark, make):
    docs, words = corpus(300)
    items = [(j, " ".join(random.Random(j).choices(words, k=8))) for j in range(12)]
    assert run(spark, make, docs, items) == brute(docs, items, 10)


def test_small_trees_and_leaves_give_the_same(spark, make, monkeypatch):
    docs, words = corpus(400, 2)
    items = [(j, " ".join(random.Random(j).choices(words, k=5))) for j in range(6)]
    monkeypatch.setattr(lexical, "CELLS", 2000)
    monkeypatch.setattr(lexical, "ITEMS", 2)
    assert run(spark, make, docs, items, 3) == brute(docs, items, 3)


def test_edge_cases(spark, make):
    docs = [(1, None), (2, ""), (3, "Alpha-beta ALPHA"), (4, "alpha"), (4, "alpha"), (None, "alpha"), (7, "É é Ébc"), (8, "x " * 200_000 + "beta"), (9, "@[`{\x7f\x00"), (10, "gamma")]
    items = [(0, "ALPHA alpha"), (1, None), (2, "--"), (3, "É beta x"), (4, "nowhere"), (None, "gamma"), (5, "gamma"), (5, "beta")]
    assert run(spark, make, docs, items) == brute(docs, items, 10)


def test_empty_tables(spark, make):
    assert run(spark, make, [], [(0, "a")]) == []
    assert run(spark, make, [(0, "a")], []) == []


def test_subtrees_are_left_out():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(40, 6, replace=False, p=np.arange(40, 0, -1) / 820)) for _ in range(2000)]
    order = sorted(range(2000), key=lambda i: rows[i].astype(">u4").tobytes())
    tf = np.zeros((2000, 40), np.int32)
    for k, i in enumerate(order):
        tf[k, rows[i]] = 1
    m = np.full(2000, 100)
    tree = lexical.grow([rows[i].astype(">u4").tobytes() for i in order], tf, m)
    leaves = sorted((a, b) for a, b, c in zip(tree.lo, tree.hi, tree.below) if not len(c))
    assert leaves[0][0] == 0 and leaves[-1][1] == 2000 and all(x[1] == y[0] for x, y in zip(leaves, leaves[1:]))
    best = lexical.Best(10)
    item, weights = np.array([0, 1, 2, 3, 4, 5]), np.array([100, 110, 120, 130, 140, 150])
    scored = lexical.search_tree(tree, tf, m, list(range(2000)), item, weights, best)
    assert scored < 1000
    assert best.rows == sorted(((int(s), i) for i, s in enumerate(lexical.scores(weights, tf[:, item], m))), key=lambda r: (-r[0], r[1]))[:10]
