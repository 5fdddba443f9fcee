import zlib
from collections import Counter, defaultdict

import pytest

from skyledger.llm import shards


def check(out, rows, many=16):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=repr) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    slots = defaultdict(list)
    for r in out:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < many
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots[s]) for s in range(many)]
    assert max(counts) - min(counts) <= 1


def spread(out, rows):
    """Shards of each group of equal texts."""
    text, where = dict(rows), defaultdict(Counter)
    for r in out:
        where[text[r.doc_id] or ""][r.shard] += 1
    return where


def test_groups_come_together(make):
    rows = [(i, f"copy {i % 150}" if i < 600 else f"own {i}") for i in range(1500)]
    out = shards.balanced_shards(make(rows, extra=True)).collect()
    check(out, rows)
    groups = [c for c in spread(out, rows).values() if sum(c.values()) > 1]
    assert len(groups) == 150
    assert sum(len(c) == 1 for c in groups) >= 140


def test_one_text_holds_a_third_of_all_rows(make):
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 2 % 300}" if i % 3 == 1 else f"own {i}") for i in range(1800)]
    out = shards.balanced_shards(make(rows)).collect()
    check(out, rows)
    where = spread(out, rows)
    assert len([n for n in where["hot"].values() if n > 5]) <= 9
    others = [c for t, c in where.items() if t.startswith("pair") and sum(c.values()) > 1]
    assert sum(len(c) == 1 for c in others) >= 0.8 * len(others)


def test_everything_is_linked(make):
    rows = [(i, f"t{i % 40}") for i in range(800)]
    out = shards.balanced_shards(make(rows)).collect()
    check(out, rows)
    assert sum(max(c.values()) for c in spread(out, rows).values()) >= 0.5 * 800


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (2, "a"), (3, "a")], [(i, "same") for i in range(100)], [(None, "n")] * 40 + [(7, "")] * 3 + [(8, None), (9, "é" * 300_000), (9, "é" * 300_000)]])
def test_edge_cases(make, rows):
    check(shards.balanced_shards(make(rows, extra=True)).collect(), rows)


def test_other_counts_of_shards(make):
    rows = [(i, f"t{i // 2}") for i in range(101)]
    check(shards.balanced_shards(make(rows), shards=3).collect(), rows, 3)


def test_quotas_keep_every_shard_within_its_rows():
    wanted = {(0, 1, 3): 50, (0, 1, 1): 50, (1, 2, 2): 10, (2, 0, 1): 40, (3, 1, 3): 30}
    held, room = [90, 95, 80, 60], [100, 100, 100, 100]
    go = shards.quotas(wanted, held, room)
    after = [h + sum(n for k, n in go.items() if k[1] == s) - sum(n for k, n in go.items() if k[0] == s) for s, h in enumerate(held)]
    assert all(x <= 100 + 1e-3 for x in after) and all(0 <= go[k] <= n for k, n in wanted.items())
    assert go[(0, 1, 1)] < 1e-6 and go[(1, 2, 2)] == 10


def test_no_python_in_the_plan(make, plan):
    text = plan(shards.balanced_shards(make([(i, f"t{i // 3}") for i in range(60)])))
    assert not any(x in text for x in ("Python", "Arrow", "Pandas"))
