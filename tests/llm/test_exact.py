import hashlib
import re
from collections import defaultdict

from skyledger.llm import exact


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest()


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[digest(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[digest(t)]
        out.append((i, min((x for x in ids if x is not None), default=None), len(ids), digest(t)))
    return sorted(out, key=repr)


ROWS = [(5, "a b"), (3, "a \t\n b"), (9, "a b "), (1, None), (2, ""), (7, "A b"), (8, "x" * 500_000), (6, "x" * 500_000), (None, "n"), (None, "n"), (4, "q"), (4, "q"), (11, "a b")]


def check(out, rows):
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=repr) == brute(rows)
    kept = defaultdict(list)
    for r in out:
        kept[r.text_sha256].append(r.kept)
        assert not r.kept or r.doc_id == r.keep_id
    assert all(sum(x) == 1 for x in kept.values())


def test_against_brute_force(make):
    check(exact.duplicate_groups(make(ROWS, extra=True)).collect(), ROWS)


def test_frequent_groups_take_the_broadcast_path(make):
    rows = [(i, "hot" if i % 3 == 0 else "warm  text" if i % 3 == 1 else f"t{i // 6}") for i in range(600)]
    docs = make(rows)
    assert exact.frequent(exact._digests(docs), 0.05).count() == 2
    check(exact.duplicate_groups(docs, 0.05).collect(), rows)
    assert sorted(r.doc_id for r in exact.drop_duplicates(docs, 0.05).collect()) == sorted({0, 1, *(min(j for j in range(600) if j % 3 == 2 and j // 6 == k) for k in range(100))})


def test_dropping_keeps_one_row_and_all_columns(make):
    docs = make(ROWS, extra=True)
    out = exact.drop_duplicates(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted([3, 9, 1, 7, 6, None, 4, 11], key=repr)
    assert all(r.key == "x0" and r.sha == "x7" for r in rows)


def test_no_group_meets_in_a_window(make, plan):
    rows = [(i % 50, "warm") for i in range(300)] + [(None, "none")] * 200 + [(i, f"t{i}") for i in range(100)]
    docs = make(rows)
    for df in (exact.duplicate_groups(docs, 0.5), exact.drop_duplicates(docs, 0.5), exact.drop_duplicates(docs, 0.2)):
        assert "Window" not in plan(df)
    check(exact.duplicate_groups(docs, 0.5).collect(), rows)
    for support in (0.5, 0.2):
        assert sorted((repr(r.doc_id), r.text) for r in exact.drop_duplicates(docs, support).collect()) == sorted([("0", "warm"), ("None", "none"), *((str(i), f"t{i}") for i in range(100))])


def test_empty_table(make):
    assert exact.duplicate_groups(make([])).count() == 0
    assert exact.drop_duplicates(make([])).count() == 0


def test_no_python_in_the_plan(make, plan):
    for df in (exact.duplicate_groups(make(ROWS)), exact.drop_duplicates(make(ROWS))):
        assert not any(x in plan(df) for x in ("Python", "Arrow", "Pandas"))
