import re

import numpy as np
import pytest

from skyledger.llm import mixing


def brute_targets(rows, share=1.5, weights=(3, 1, 2), cap=2.0):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    fixed, left = {}, set(order)
    while left:
        rate = (share * sum(sizes.values()) - sum(fixed.values())) / sum(weight[s] for s in left)
        over = {s for s in left if rate * weight[s] > cap * sizes[s]}
        if not over:
            break
        fixed |= {s: cap * sizes[s] for s in over}
        left -= over
    return {s: fixed.get(s, rate * weight[s] if s in left else 0) for s in order}, sizes


def corpus(words, n=300):
    sources = ["hot"] * 4 + ["b", "é", None, "tiny"]
    rows = [(k, words(1 + (k * 37) % 90, k), sources[k % 8] if k % 8 != 7 or k < 20 else "hot") for k in range(n)]
    return [*rows, (900, None, "b"), (901, "", "void"), (902, " \t", "void"), (5, rows[5][1], rows[5][2]), (None, "x y z", "b"), (None, "x y z", "b")]


@pytest.mark.parametrize("chunk", [4096, 16])
def test_targets_and_taken_words(make, words, chunk):
    rows = corpus(words)
    out = mixing.mix_sources(make(rows, extra=True), chunk=chunk).collect()
    targets, sizes = brute_targets(rows)
    assert len(out) == len(rows)
    texts = {}
    for i, text, source in rows:
        texts.setdefault((i, source), len(re.findall(r"[^\x20\x09-\x0D]+", text or "")))
    taken = dict.fromkeys(targets, 0)
    for r in out:
        assert r.size == texts[r.doc_id, r.source] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    largest = max(r["size"] for r in out)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    if chunk == 4096:
        for s, t in targets.items():
            own = sorted(r["size"] for r in out if r.source == s)
            assert abs(taken[s] - t) <= max(0.01 * t, own[len(own) // 2])


def test_a_long_text_settled_last_is_made_up_by_short_ones():
    size = np.array([5000.0, 90, 40, 20, 10, 5, 3])
    for last, settled in ((1.0, [1, 1, 0, 1, 0, 1]), (0.0, [0, 1, 0, 0, 1, 0])):
        fraction = np.array([last, *settled], float)
        for gap in (-170.0, -60.0, -1.0, 0.0, 2.0, 77.0, 100.0):
            now = fraction.copy()
            left = mixing.even_out(size, now, gap)
            assert abs(left) <= abs(gap) and set(now) <= {0.0, 1.0}
            assert gap - left == pytest.approx(float(size @ (now - fraction)))



def test_reruns_and_partitions_agree(make, words):
    docs = make(corpus(words))
    first = sorted(map(repr, mixing.mix_sources(docs, chunk=32).collect()))
    assert first == sorted(map(repr, mixing.mix_sources(docs.repartition(7, "text"), chunk=32).collect()))


def test_settling_keeps_words_and_is_fair():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 100, 200).astype(float)
    hits = np.zeros(200)
    for _ in range(400):
        fraction = np.full(200, 0.3)
        held = mixing.settle(size, fraction, rng.random(200))
        assert (size * fraction).sum() == pytest.approx(0.3 * size.sum())
        assert sum(0 < x < 1 for x in fraction) == (held >= 0)
        hits += fraction
    assert abs(hits.mean() / 400 - 0.3) < 0.01 and abs(hits / 400 - 0.3).max() < 0.12


def test_repeated_documents_follow_the_copies(make, words):
    rows = corpus(words)
    docs = make(rows, extra=True)
    out = mixing.repeat_documents(docs, chunk=32)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        assert r["_key"] == "x1" and r.copies == "x3"
        got[r.doc_id, r.text] = got.get((r.doc_id, r.text), 0) + 1
    want = {}
    text = {(i, s): t for i, t, s in rows}
    for r in mixing.mix_sources(docs, chunk=32).collect():
        if r.copies:
            key = r.doc_id, text[r.doc_id, r.source]
            want[key] = want.get(key, 0) + r.copies
    assert got == want


def test_edges(make):
    assert mixing.mix_sources(make([])).count() == 0
    assert mixing.repeat_documents(make([])).count() == 0
    out = mixing.mix_sources(make([(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 2
    one = mixing.mix_sources(make([(1, "w " * 100_000, "a")])).collect()[0]
    assert (one["size"], one.target) == (100_000, 150_000.0) and one.taken in (100_000, 200_000)
