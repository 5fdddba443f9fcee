import os

import pytest
from pyspark.sql import functions as F

from skyledger.operators.joins import attach_summary, left_join_suffixed
from skyledger.schema import HOUR_KEYS
from skyledger.sources.bucketed import BucketedTable, join_stored, store_bucketed


def hours(spark, n=3000):
    return spark.range(0, n, 1, 3).selectExpr(
        "concat('S', id % 3) AS site", "cast(2000 + id % 4 AS int) AS year", "cast(id div 4 % 12 + 1 AS int) AS month",
        "cast(id div 48 % 28 + 1 AS int) AS day", "cast(id div 1344 AS int) AS hour", "id % 17 / 2 AS t_2m",
    ).dropDuplicates(HOUR_KEYS)


def summary(hours):
    return hours.where("day % 3 <> 1").select(*HOUR_KEYS, (F.col("t_2m") + F.col("day")).alias("wind_mean"), F.lit(60).alias("nrow"))


@pytest.fixture
def tables(spark, tmp_path):
    left = store_bucketed(hours(spark), str(tmp_path / "hours"), 4)
    right = store_bucketed(summary(hours(spark)), str(tmp_path / "summary"), 4)
    return left, right


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def files(table, year):
    folder = f"{table.path}/part_year={year}"
    return {name: os.stat(f"{folder}/{name}").st_mtime_ns for name in os.listdir(folder) if name.endswith(".parquet")}


def test_join_without_exchange(spark, tables, plan):
    left, right = (t.read(spark) for t in tables)
    joined = join_stored(left, right)
    assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
    columns = [*HOUR_KEYS, "t_2m", "wind_mean", "nrow"]
    assert rows(joined, *columns) == rows(attach_summary(hours(spark), summary(hours(spark))), *columns)


def test_clashing_columns(spark, tables, plan):
    left, right = tables
    again = store_bucketed(summary(hours(spark)).withColumnRenamed("wind_mean", "t_2m"), right.path + "-again", 4)
    joined = join_stored(left.read(spark), again.read(spark))
    assert "Exchange" not in plan(joined)
    want = left_join_suffixed(hours(spark), summary(hours(spark)).withColumnRenamed("wind_mean", "t_2m"), HOUR_KEYS)
    columns = [*HOUR_KEYS, "t_2m_x", "t_2m_y"]
    assert rows(joined, *columns) == rows(want, *columns)


def test_one_year_is_replaced_in_place(spark, tables):
    right = tables[1]
    before = {y: files(right, y) for y in range(2000, 2004)}
    right.replace_years(summary(hours(spark)).where("year = 2002").withColumn("nrow", F.lit(61)))
    after = {y: files(right, y) for y in range(2000, 2004)}
    assert {y for y in before if before[y] != after[y]} == {2002}
    assert len(after[2002]) <= 4    # one file a bucket
    counts = {r.year: r.n for r in right.read(spark).groupBy("year").agg(F.max("nrow").alias("n")).collect()}
    assert counts == {2000: 60, 2001: 60, 2002: 61, 2003: 60}


def test_years_are_pruned_and_tables_reopened(spark, tables, plan):
    left = tables[0]
    some = left.read(spark, [2001, 2003])
    assert "PartitionFilters: [part_year" in plan(some)
    assert {r.year for r in some.select("year").distinct().collect()} == {2001, 2003}
    spark.catalog.dropTempView("nothing")
    spark.sql(f"DROP TABLE {left._name(spark)}")
    again = BucketedTable(left.path, left.schema, left.buckets)
    assert again.read(spark).count() == hours(spark).count()


def test_missing_keys_match_nothing_and_empty_tables(spark, tmp_path):
    some = hours(spark, 20).withColumn("site", F.when(F.col("day") > 1, F.col("site")))
    left = store_bucketed(some, str(tmp_path / "a"), 2)
    right = store_bucketed(summary(hours(spark)).limit(0), str(tmp_path / "b"), 2)
    joined = join_stored(left.read(spark), right.read(spark)).collect()
    assert len(joined) == some.count() and all(r.nrow is None for r in joined)
