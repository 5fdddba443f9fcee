import math
import re
from collections import Counter

import pytest

from skyledger.llm import language_model as lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, target):
    """Losses under models of all other texts: each model is counted again without the text that it scores."""
    size = len({w for _, t in rows for w in tokens(t)})

    def counted(t, sign, one, before, two):
        previous = None
        for w in tokens(t):
            one[w] += sign
            before[previous] += sign
            two[previous, w] += sign
            previous = w

    def losses(texts, own):
        model = Counter(), Counter(), Counter()
        for t in texts:
            counted(t, 1, *model)

        def loss(t, mine):
            if mine:
                counted(t, -1, *model)
            one, before, two = model
            total, w = sum(one.values()), tokens(t)
            out = sum(-math.log((two[p, x] + lm.PRIOR * (one[x] + 1) / (total + size + 2)) / (before[p] + lm.PRIOR)) for p, x in zip([None, *w], w))
            if mine:
                counted(t, 1, *model)
            return out / max(1, len(w))

        return [loss(t, mine) for (_, t), mine in zip(rows, own)]

    inside = [i in target for i, _ in rows]
    pairs = zip(losses([t for (_, t), own in zip(rows, inside) if own], inside), losses([t for _, t in rows], [True] * len(rows)))
    return {(i, len(tokens(t))): pair for (i, t), pair in zip(rows, pairs)}


def test_a_text_in_the_target_scores_like_one_outside(spark, make):
    import random

    rng = random.Random(5)
    good = [" ".join(rng.choice([f"g{rng.randrange(40)}", f"c{rng.randrange(40)}"]) for _ in range(80)) for _ in range(120)]
    bad = [" ".join(rng.choice([f"b{rng.randrange(40)}", f"c{rng.randrange(40)}"]) for _ in range(80)) for _ in range(120)]
    docs = make(list(enumerate(good + bad)))
    out = lm.score_against_target(docs, spark.createDataFrame([(k,) for k in range(0, 120, 2)], "doc_id long")).collect()
    mean = lambda keep: (lambda x: sum(x) / len(x))([r.difference for r in out if keep(r.doc_id)])
    inside, outside, others = mean(lambda i: i < 120 and i % 2 == 0), mean(lambda i: i < 120 and i % 2), mean(lambda i: i >= 120)
    assert abs(inside - outside) < 0.2 and others - max(inside, outside) > 0.3


def test_against_brute_force(spark, make, words):
    rows = [(k, " ".join(words(30, k % 7).split()[: 3 + k % 20]) + (" Good" if k % 2 else " bad"), "s") for k in range(60)]
    rows = [r[:2] for r in rows] + [(90, None), (91, ""), (92, "x " * 50_000), (None, "bad words")]
    ids = spark.createDataFrame([(k,) for k in range(1, 60, 2)] + [(1,), (None,)], "doc_id long")
    out = lm.score_against_target(make(rows, extra=True), ids).collect()
    want = brute(rows, set(range(1, 60, 2)))
    assert len(out) == len(rows)
    for r in out:
        a, b = want[r.doc_id, r.n_tokens]
        assert (r.target_loss, r.background_loss, r.difference) == pytest.approx((a, b, a - b), abs=1e-9)


def test_vocabulary_bound_and_edges(spark, make, words):
    rows = [(k, "common words " + words(4, k)) for k in range(50)]
    ids = spark.createDataFrame([(1,)], "doc_id long")
    out = lm.score_against_target(make([*rows, rows[0]]), ids, vocabulary=8, cells=64).collect()
    assert len(out) == 51 and all(math.isfinite(r.difference) for r in out)
    assert lm.score_against_target(make([]), ids).count() == 0
    none = spark.createDataFrame([], "doc_id long")
    assert all(math.isfinite(r.difference) for r in lm.score_against_target(make(rows), none).collect())


def test_every_pair_and_word_keeps_its_own_count(spark, make, words, monkeypatch):
    monkeypatch.setattr(lm, "_CHUNK", 1 << 16, raising=False)
    monkeypatch.setattr(lm, "_RANGE", 1 << 14, raising=False)
    rows = [(k, " ".join(f"w{(k * 997 + j * j) % 70_000}" for j in range(1_000))) for k in range(100)] + [(200, None), (201, "")]
    assert len({w for _, t in rows for w in tokens(t)}) > 1 << 15
    want = brute(rows, set(range(0, 100, 3)))
    out = lm.score_against_target(make(rows), spark.createDataFrame([(k,) for k in range(0, 100, 3)], "doc_id long")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.target_loss, r.background_loss) == pytest.approx(tuple(want[r.doc_id, r.n_tokens]), abs=1e-9)
