import numpy as np
import pyarrow as pa
import pytest
import re

from skyledger.llm.text import find_words, minima, permutations, read_words, shingles, slices, utf8

TEXTS = ["", None, "one", "A b\tc  d\x0be", "  lead and trail \n", "é ü a b é ü", "x" * 3_000_000 + " y", "a b c", "  z"]


def spans(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())


def test_words_are_the_runs_between_ascii_spaces():
    data, at = utf8(pa.array(TEXTS))
    starts, ends, splits = find_words(data, at)
    found = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    for k, text in enumerate(TEXTS):
        assert found[splits[k] : splits[k + 1]] == spans(text)


def test_hashes_follow_words_and_ignore_ascii_case():
    words = read_words(pa.array(["Some words some WORDS", "words", "Ä ä"]))
    h = words.hash
    assert h[0] == h[2] and h[1] == h[3] == h[4] and h[0] != h[1] and h[5] != h[6]


def test_sliced_arrays_read_their_own_rows():
    whole = pa.array(["a", "b c", None, "d e f"])
    assert len(read_words(whole.slice(1, 3)).hash) == 5
    assert list(np.diff(read_words(whole.slice(3, 1)).splits)) == [3]


@pytest.mark.parametrize("size", [1, 2, 5])
def test_shingles(size):
    texts = ["", "a", "a b", "a b c d e f a b c d e f", "b a"]
    words = read_words(pa.array(texts))
    values, splits = shingles(words.hash, words.splits, size)
    for k, text in enumerate(texts):
        w = text.split()
        want = len(set(zip(*(w[i:] for i in range(size))))) if len(w) >= size else bool(w)
        assert len(set(values[splits[k] : splits[k + 1]])) == want
    # the same run in another text has the same hash
    assert set(values[splits[3] : splits[4]]) >= set(values[splits[2] : splits[3]]) or size > 2


def test_minima_estimate_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    other = np.concatenate([base[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    out = minima(np.concatenate([base, other]), np.array([0, 1000, 1000, 2000]), permutations(512))
    assert (out[1] == 0xFFFFFFFF).all()
    assert abs((out[0] == out[2]).mean() - 800 / 1200) < 0.08


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["x" * n for n in (10, 100, 5, 0, 7)] + [None]), "id": list(range(6))})
    parts = list(slices([batch], most=20))
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(6))
    assert len(parts) > 2
