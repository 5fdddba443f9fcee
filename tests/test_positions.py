import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators.positions import exclude_ranges, group_offsets, merged_ranges, with_row_numbers
from skyledger.plans.station import clean_minutes

KEYS = ["site", "year", "day", "minute"]


def table(spark, n=5000):
    # gaps in the ids, rows in no particular order
    return spark.range(0, n).where("id % 7 <> 3").repartition(5, F.hash("id")).withColumn("v", F.col("id") % 11 - 2.0)


def minutes(spark, n=5000):
    """Composite keys with nulls, text before numbers, and minutes that do not follow the row order."""
    return spark.range(0, n).repartition(5, F.hash("id")).selectExpr(
        "if(id % 5 = 0, null, concat('S', id % 4)) AS site", "cast(2000 + id % 3 AS int) AS year", "cast(id div 100 AS int) AS day",
        "cast(id * 37 % 60 AS int) AS minute", "id", "id % 11 - 2.0 AS wind_spd",
    )


def ordered(df, keys):
    return [r.id for r in sorted(df.collect(), key=lambda r: [(r[k] is not None, r[k] if r[k] is not None else 0) for k in keys])]


def distinct_keys(spark):
    return minutes(spark).groupBy(*KEYS).agg(F.min("id").alias("id"), F.min("wind_spd").alias("wind_spd"))


def test_row_numbers(spark):
    rows = with_row_numbers(table(spark), ["id"]).orderBy("id").collect()
    assert [r.row for r in rows] == list(range(1, len(rows) + 1))


def test_row_numbers_of_composite_keys(spark):
    df = distinct_keys(spark)
    numbered = {r.id: r.row for r in with_row_numbers(df, KEYS).collect()}
    assert numbered == {i: k for k, i in enumerate(ordered(df, KEYS), 1)}


def test_equal_keys_have_fixed_positions(spark):
    df = spark.range(0, 400).selectExpr("id % 3 AS k", "id AS v")
    first = {r.v: r.row for r in with_row_numbers(df, ["k"]).collect()}
    assert first == {r.v: r.row for r in with_row_numbers(df.repartition(7), ["k"]).collect()}
    assert sorted(first.values()) == list(range(1, 401))
    assert all(first[v] < first[w] for v in range(0, 400, 3) for w in range(1, 400, 3))


def test_offsets_count_all_earlier_groups(spark):
    df = spark.range(0, 40000, 1, 4).where("id % 5 <> 0").selectExpr("id div 8 - 2500 AS g", "id")
    rows = sorted((r["_group"].g, r["_rows"], r["_before"]) for r in group_offsets(df, ["g", "id"]).collect())
    before = 0
    for _, n, had in rows:
        assert had == before
        before += n
    assert before == 32000 and len(rows) == 5000


def test_merged_ranges():
    assert merged_ranges([(5, 4), (10, 12), (1, 2), (3, 3), (11, 20), (30, 30)]) == [(1, 3), (10, 20), (30, 30)]


RANGES = [
    [],
    [(1, 1)],
    [(85, 87)],
    [(1, 10), (5, 2000), (2002, 2002)],          # whole groups in between
    [(4000, 10**12)],                            # past the last row
    [(10**6, 10**7), (3, 4)],                    # entirely past it
    [(1, 10**9)],
    "random",
]


def chosen(ranges, n):
    if ranges != "random":
        return ranges
    rng = random.Random(4)
    return [(a, a + rng.choice([0, 1, 30, 300])) for a in (rng.randrange(1, n) for _ in range(25))]


@pytest.mark.parametrize("ranges", RANGES)
def test_exclude_ranges(spark, ranges):
    ids = sorted(r.id for r in table(spark).collect())
    ranges = chosen(ranges, len(ids))
    kept = sorted(r.id for r in exclude_ranges(table(spark), ranges, ["id"]).collect())
    assert kept == [v for i, v in enumerate(ids, 1) if not any(lo <= i <= hi for lo, hi in ranges)]


@pytest.mark.parametrize("ranges", [RANGES[2], RANGES[3], RANGES[4], "random"])
def test_exclude_ranges_of_composite_keys(spark, ranges):
    df = distinct_keys(spark)
    ids = ordered(df, KEYS)
    ranges = chosen(ranges, len(ids))
    kept = {r.id for r in exclude_ranges(df, ranges, KEYS).collect()}
    assert kept == {v for i, v in enumerate(ids, 1) if not any(lo <= i <= hi for lo, hi in ranges)}


def test_empty_table(spark):
    assert with_row_numbers(table(spark).limit(0), ["id"]).count() == 0
    assert exclude_ranges(table(spark).limit(0), [(1, 3)], ["id"]).count() == 0


def test_rows_stay_where_they_are_read(spark, conf, plan, tmp_path):
    minutes(spark).write.parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    conf(autoBroadcastJoinThreshold="-1")
    text = plan(exclude_ranges(stored, [(100, 2000)], KEYS))
    assert "Cartesian" not in text and "NestedLoop" not in text
    whole = text.split("Union")[1].split("Window")[0]
    assert "Exchange hashpartitioning(_group" not in whole.split("BroadcastExchange")[0]
    assert "In(year," in text.split("Window")[1] or "year" in text.split("PushedFilters")[2]


def test_a_row_makes_its_group_once(spark, plan, tmp_path):
    minutes(spark).write.parquet(str(tmp_path / "m"))
    text = plan(exclude_ranges(spark.read.parquet(str(tmp_path / "m")), [(100, 2000), (2500, 2600), (3000, 3100)], KEYS))
    whole = text.split("Union")[1].split("Window")[0]
    above, below = whole.split("BroadcastHashJoin")
    assert "exists(array(" in above and "exists(array(" not in below
    assert whole.count("struct(site, site") == 1


def test_positions_count_kept_readings(spark):
    df = distinct_keys(spark)
    kept = {r.id for r in clean_minutes(df, [(1, 3)], KEYS).collect()}
    assert kept == set(ordered(df.where("wind_spd >= 0"), KEYS)[3:])
