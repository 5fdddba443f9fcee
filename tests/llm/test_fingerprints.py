import hashlib

import numpy as np
import pyarrow as pa

from skyledger.llm import fingerprints as fp


def brute(rows):
    """The next document of each row: ids descending, null last, equal ids by text, greater first; then the first again."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    return [(order[k], order[(k + 1) % len(order)]) for k in range(len(order))]


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def compared(make, rows, **options):
    return fp.compare_neighbours(make(rows, extra=True), **options).collect()


def check(out, rows):
    pairs = {}
    for own, following in brute(rows):
        a, b = own[1] or "", following[1] or ""
        pairs.setdefault((own[0], hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest()), []).append((a, b))
    assert len(out) == len(rows)
    for r in out:
        a, b = pairs[r.doc_id, r.edited_sha256].pop()
        assert r.n_chars == len(a)
        assert r.fingerprint == fp.written(fp.signatures(pa.array([a]))[0])
        changed = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        assert r.edited_fingerprint == fp.written(fp.signatures(pa.array([changed]))[0])
        assert abs(r.near_edited - jaccard(shingle_set(a), shingle_set(changed))) < 0.2
        assert abs(r.near_next - jaccard(shingle_set(a), shingle_set(b))) < 0.2


def corpus(words, n=60):
    return [(k * 7 % 101, words(3 * k, k) + " é😀", "s") for k in range(n)]


def test_against_brute_force(make, words):
    rows = corpus(words)
    check(compared(make, rows), rows)
    check(compared(make, rows, parts=1), rows)
    check(compared(make, rows, parts=50), rows)


def test_odd_rows(make, words):
    rows = [(4, None), (9, ""), (2, " "), (7, "two words"), (7, "another text"), (7, "another text"), (-3, "x" * 200_000), (12, words(900, 1)), (None, "no id")]
    check(compared(make, rows), rows)
    one = [(1, "a b c d e f g h i")]
    check(compared(make, one), one)
    assert compared(make, []) == []


def test_equal_texts_have_equal_fingerprints(make, words):
    text = words(50, 3)
    out = fp.fingerprint(make([(1, text), (2, text.upper()), (3, None), (4, "")])).collect()
    marks = {r.doc_id: r.fingerprint for r in out}
    assert marks[1] == marks[2] and marks[3] == marks[4] == "ffff" * fp.PERMUTATIONS


def test_likeness_estimates_jaccard(words):
    base = words(400, 5).split()
    for cut in (40, 100, 200):
        other = base[cut:] + words(cut, cut).split()
        a, b = " ".join(base), " ".join(other)
        one, two = fp.signatures(pa.array([a, b]))
        want = jaccard(shingle_set(a), shingle_set(b))
        assert abs(fp.likeness(one[None], two[None])[0] - want) < 0.15


def test_linked_documents(make, words):
    rows = []
    for g in range(30):
        base = words(120, g).split()
        rows.append((10 * g, " ".join(base)))
        for k in range(1, 4):
            changed = list(base)
            changed[20 * k : 20 * k + 2] = ["zzz", "yyy"]
            rows.append((10 * g + k, " ".join(changed)))
    rows += [(900, None), (901, ""), (902, "x"), (903, "x")]
    sets = {i: shingle_set(t) for i, t in rows}
    out = {(r.doc_id, r.first_id): r.jaccard for r in fp.near_pairs(make(rows, extra=True)).collect()}
    for (a, b), j in out.items():
        assert abs(j - jaccard(sets[a], sets[b])) < 1e-9 and j >= 0.8 and b < a
    assert (903, 902) in out
    want = {(a, b) for a in sets for b in sets if b < a and a // 10 == b // 10 and sets[a] and jaccard(sets[a], sets[b]) >= 0.8}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in out:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert all(root(a) == root(b) for a, b in want)
