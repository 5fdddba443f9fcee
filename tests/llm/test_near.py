import random
import re

import pytest

from skyledger.llm import near
from skyledger.llm.components import connected_components


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent=80):
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def edit(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**9)}"
    return out


def corpus(words, copies=60):
    """Families whose members lie on both sides of the limit, chains of edits, and strangers."""
    rng = random.Random(8)
    texts = []
    for f in range(5):
        base = words(100, f).split()
        texts += [" ".join(edit(rng, base, rng.randrange(14))) for _ in range(copies)]
        step = base
        for _ in range(8):
            step = edit(rng, step, 6)
            texts.append(" ".join(step))
    texts += [words(rng.randrange(1, 300), 100 + k) for k in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(make, words, size):
    rows = corpus(words)
    out = near.near_duplicate_groups(make(rows, extra=True), near.Rule(size=size)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_a_large_group_of_near_copies(make, words):
    rng = random.Random(3)
    base = words(130, 1).split()
    rows = [(k, " ".join(edit(rng, base, rng.randrange(28)))) for k in range(500)]
    out = near.near_duplicate_groups(make(rows), near.Rule(size=2)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute(rows, 2)


def test_two_large_families_make_few_pairs(spark, make, words):
    """Members of one family meet only where two components hold the same edit, so pairs grow with the members."""
    rng = random.Random(9)
    base = words(120, 1).split()
    other = edit(rng, base, 26)
    made = []
    for m in (60, 240):
        rows = [(k, " ".join(edit(rng, base if k % 2 else other, 1))) for k in range(2 * m)]
        rule = near.Rule(size=2)
        out = near.near_duplicate_groups(make(rows), rule).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute(rows, 2)
        nodes = list(range(2 * m))
        texts = spark.createDataFrame([(k, t) for k, t in rows], "node long, text string")
        families = spark.createDataFrame([(1, k) for k in nodes], "hub long, node long")
        components = spark.createDataFrame([(k, k % 2) for k in nodes], "node long, component long")
        made.append(near._pairs_by_edits(near._edits(families, texts, rule), components, rule).count())
    assert made[1] <= 8 * max(made[0], 60)


ODD = [(5, None), (3, ""), (4, " \n"), (9, "one"), (8, "ONE"), (7, "one two"), (6, "one  two"), (None, "one two"), (2, "one two three"), (2, "one two three"), (2, "other words"), (1, "é"), (11, "É"), (12, "w " * 200_000), (13, "w w w")]


@pytest.mark.parametrize("size", [2, 5])
def test_odd_rows(make, size):
    out = near.near_duplicate_groups(make(ODD, extra=True), near.Rule(size=size)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute(ODD, size)
    assert near.near_duplicate_groups(make([])).count() == 0
    assert near.drop_near_duplicates(make([])).count() == 0


def test_dropping_keeps_one_row_of_each_group(make, words):
    rows = corpus(words, 10) + [(i + 10_000, t) for i, t in ODD[:4]]
    docs = make(rows, extra=True)
    out = near.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert all(r.key == "x0" for r in kept)
    groups = {c for _, n, c in brute(rows, 5) if n}
    assert sorted(r.doc_id for r in kept if shingle_set(r.text, 5)) == sorted(groups)
    assert sum(not shingle_set(r.text, 5) for r in kept) == 3


def test_rules():
    for rule in (near.Rule(), near.Rule(rows=9), near.Rule(percent=60, rows=4)):
        assert (1 - (rule.percent / 100) ** rule.rows) ** rule.bands <= rule.miss
    assert near.Rule().bands == 36


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 600)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)] + [(7, 7), (8, 9), (9, 8)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    alone = {a for a, b in edges if a == b} - {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in parent if x not in alone}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
