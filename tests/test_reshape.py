from pyspark.sql import functions as F

from helpers import ids
from skyledger.operators.reshape import sample_rows, stack, to_long, zero_fill
from skyledger.operators.summaries import column_intervals, correlation, count_by, means_by, overall_mean
from skyledger.plans.station import monthly_event_counts


def test_sample_is_exact_and_repeatable(spark):
    df = ids(spark, 3000)
    first = {r.id for r in sample_rows(df, 200, ["id"]).collect()}
    assert len(first) == 200 and first == {r.id for r in sample_rows(df.repartition(9), 200, ["id"]).collect()}
    by_hash = df.withColumn("h", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("0")).cast("binary")))
    assert first == {r.id for r in by_hash.orderBy("h").limit(200).collect()}
    assert first != {r.id for r in sample_rows(df, 200, ["id"], seed=5).collect()}
    assert sample_rows(df, 5000, ["id"]).count() == 3000


def test_large_samples_are_not_put_in_order(spark, plan, monkeypatch):
    monkeypatch.setattr("skyledger.operators.reshape._DIGITS", 1)
    monkeypatch.setattr("skyledger.operators.reshape._FEW", 3)
    df = ids(spark, 3000)
    by_hash = df.withColumn("h", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("0")).cast("binary")))
    order = [r.id for r in by_hash.orderBy("h").collect()]
    for n in (0, 1, 2, 17, 1500, 2999, 3000, 3001):
        drawn = sample_rows(df, n, ["id"])
        assert {r.id for r in drawn.collect()} == set(order[:n])
        assert not any(x in plan(drawn) for x in ("Exchange", "Sort", "TakeOrdered"))
    assert sample_rows(df.limit(0), 5, ["id"]).count() == 0


def test_long_form(spark):
    df = spark.createDataFrame([(1.0, 2, 3.0)], "wind_spd double, gust_time int, wind_sd double")
    rows = to_long(df, ["wind_spd"], ["gust_time", "wind_sd"]).collect()
    assert sorted(map(tuple, rows)) == [(1.0, "gust_time", 2.0), (1.0, "wind_sd", 3.0)]


def test_zero_fill(spark):
    cells = spark.createDataFrame([(1, 2000, 5, 1.5), (12, 2002, 7, 2.5)], "month int, year int, n long, other double")
    rows = {(r.month, r.year): (r.n, r.other) for r in zero_fill(cells).collect()}
    assert len(rows) == 36 and rows[1, 2000] == (5, 1.5) and rows[12, 2002] == (7, 2.5) and rows[6, 2001] == (0, None)
    wide = zero_fill(cells, years=(1999, 2001)).collect()
    assert len(wide) == 48 and sum(r.n for r in wide) == 12    # widened, never narrowed
    assert zero_fill(cells.limit(0)).collect() == []
    assert [r.n for r in zero_fill(cells.limit(0), years=(1999, 1999)).collect()] == [0] * 12


def test_event_counts_keep_empty_months(spark, plan):
    df = ids(spark, 2000).select(
        (F.col("id") % 12 + 1).cast("int").alias("month"), (1994 + F.col("id") % 5).cast("int").alias("year"), "u"
    )
    rows = monthly_event_counts(df, F.col("u") > 0.9).collect()
    assert len(rows) == 60 and sum(r.n for r in rows) == df.where("u > 0.9").count()
    assert "Join" not in plan(monthly_event_counts(df, F.col("u") > 0.9))


def test_stack_and_summaries(spark):
    a = spark.createDataFrame([(1, 2.0)], "draw int, a double")
    b = spark.createDataFrame([(1, 3.0, 4.0)], "draw int, a double, b double")
    assert sorted(map(tuple, stack(a, b).collect()), key=str) == [(1, 2.0, None), (1, 3.0, 4.0)]
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, None), (2, None, 1.0)], "k int, x double, y double")
    assert {r.k: r.n for r in count_by(df, "k").collect()} == {1: 2, 2: 1}
    assert {r.k: r.mean_x for r in means_by(df, ["k"], ["x"]).collect()} == {1: 2.0, 2: None}
    assert overall_mean(df, "x").first().mean_x == 2.0
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 1.0)], "x double, y double")
    row = correlation(pairs, "x", "y").first()
    assert abs(row.correlation - 1) < 1e-12 and row.pairs == 3


def test_column_intervals(spark):
    df = spark.range(0, 101).selectExpr("1 as row_id", "cast(id as double) as value")
    row = column_intervals(df, ["row_id"]).first()
    assert (row["mean"], round(row.lower, 9), round(row.upper, 9)) == (50.0, 5.0, 95.0)
