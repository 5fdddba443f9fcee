import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skyledger.llm import toxicity as tx

INSULTS = ["idiot", "moron", "scumbag", "loserly"]


def corpus(words, n=600):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(n):
        text, toxic = words(rng.randrange(5, 60), k).split(), rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                word = rng.choice(INSULTS) + rng.choice(["", "", "s", "ic"])
                text.insert(rng.randrange(len(text)), rng.choice([word, word.upper(), f'"{word},']))
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    return rows, labels


def out_of_fold(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def scored(spark, words):
    rows, labels = corpus(words)
    extra = [(900, None), (901, ""), (902, "!!! ..."), (903, "x" * 200_000), (904, "idiot " * 50_000), (None, "what an idiot"), (1, rows[1][1])]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows + extra], "doc_id long, text string, score string")
    table = spark.createDataFrame(labels + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    return docs, table, tx.score_documents(docs, table).collect(), dict(labels), rows + extra


def test_held_out_accuracy(scored):
    _, _, out, labels, rows = scored
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (r.doc_id is not None and out_of_fold(r.doc_id))
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [r for r in out if r.held_out and r.doc_id in labels]
    hits = [r for r in held if r.predicted]
    assert sum(labels[r.doc_id] for r in hits) >= 0.95 * len(hits)
    assert sum(labels[r.doc_id] for r in hits) >= 0.9 * sum(labels[r.doc_id] for r in held)


def test_odd_texts_and_evidence(scored):
    _, _, out, labels, _ = scored
    by = {r.doc_id: r for r in out}
    assert len({by[i].score for i in (900, 901, 902, 903)}) == 1 and by[900].evidence == [] and by[900].score < 0.1
    assert by[904].predicted == by[None].predicted == 1
    assert len({r.score for r in out if r.doc_id == 1}) == 1
    for r in out:
        for e in r.evidence:
            assert not out_of_fold(e.doc_id) and labels[e.doc_id] == e.toxic and 0 < e.cosine <= 1 + 1e-9


def test_nearest_are_exact(scored):
    docs, table, _, _, rows = scored
    index = tx.fit(docs, table)
    vectors = np.zeros((len(index.ids), len(index.known)))
    feature = np.repeat(np.arange(len(index.known)), index.begin[:, -1] - index.begin[:, 0])
    vectors[index.example, feature] = index.value
    assert np.allclose((vectors**2).sum(axis=1), 1)
    which, owner, count = tx._known(pa.array([t for _, t in rows]), index.known)
    for k in range(len(rows)):
        own = owner == k
        if own.any():
            query = np.zeros(len(index.known))
            query[which[own]] = index.vector(which[own], count[own])
            cosine = vectors @ query
            place, near = index.nearest(which[own], query[which[own]], 16)
            want = np.lexsort((np.arange(len(cosine)), -np.round(cosine, 9)))[: min(16, (cosine > 0).sum())]
            assert list(place) == list(want) and np.allclose(near, cosine[want])


def test_dropping_and_degenerate_labels(spark, scored):
    docs, table, out, _, _ = scored
    kept = tx.without_toxic(docs, table)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (r.doc_id for r in out if not r.predicted)))
    assert all(r.score == "k" for r in got)
    for labels in (table.where("false"), table.where("toxic = 0"), table.where("doc_id = 5000")):
        assert {(r.score, r.predicted) for r in tx.score_documents(docs, labels).collect()} == {(0.0, 0)}
    assert tx.score_documents(docs.where("false"), table).count() == 0


def test_an_example_has_no_vote_on_its_own_text(scored):
    docs, table, out, labels, rows = scored
    texts = dict(rows)
    for r in out:
        assert all(texts[e.doc_id] != texts[r.doc_id] for e in r.evidence)
    index = tx.fit(docs, table)
    assert len(index.texts) == len(index.ids) and len(index.own(int(index.texts[0]))) >= 1
    which = np.array([0])
    every, _ = index.nearest(which, np.ones(1), 16)
    rest, _ = index.nearest(which, np.ones(1), 16, every[:2])
    assert not set(every[:2].tolist()) & set(rest.tolist())


def test_copies_among_the_examples_count_once():
    marks = np.array([[1, 2, 3, 4], [1, 2, 3, 9], [5, 6, 7, 8], [1, 6, 0, 0]])
    assert tx._first_of_copies(np.array([10, 3, 7, 8]), marks) == {3, 7, 8}


def test_copies_are_thinned_within_each_class(spark, words):
    inside = [k for k in range(200) if not out_of_fold(k)]
    clean, toxic = inside[:40], inside[40:80]
    rows = [(k, words(60, k)) for k in clean] + [(k, f"{words(60, c)} idiot") for k, c in zip(toxic, clean)]
    rows.append((inside[80], words(60, clean[0])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k in toxic)) for k, _ in rows], "doc_id long, toxic int")
    index = tx.fit(docs, labels)
    assert index is not None and set(toxic) <= set(index.ids.tolist())
    assert inside[80] not in index.ids.tolist()
