from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from skyledger.functions.scalars import clean_zero, hour_instant, hour_literal, interval_index, inverse_logit, month_label
from skyledger.operators import quality as Q


def values(df, name="v"):
    return sorted((r[name] for r in df.collect()), key=lambda x: (x is None, x))


@pytest.fixture
def frame(spark):
    inf, nan = float("inf"), float("nan")
    return spark.createDataFrame(
        [(1, 1.0), (2, None), (3, nan), (4, inf), (5, -inf), (6, -0.5), (7, 0.0)], "id int, v double"
    )


def test_sentinels_and_negatives(frame):
    assert values(Q.null_sentinels(frame, {"v": -0.5}))[:3] == [0.0, 1.0, float("inf")]
    kept = Q.null_negative(frame, "v").where("v is not null")
    assert values(kept, "id") == [1, 4, 7]
    assert values(Q.non_negative(frame.where("not isnan(v)"), "v"), "id") == [1, 4, 7]


def test_complete_and_finite(frame):
    assert values(Q.complete_cases(frame, ["v"]), "id") == [1, 4, 5, 6, 7]
    assert values(Q.finite_rows(frame), "id") == [1, 6, 7]


def test_bands_and_caps(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.1, 35.0), (5.0, 35.1), (None, 1.0)], "wind_sd double, wind_max double")
    assert values(Q.open_band(df), "wind_sd") == [3.1]
    assert values(Q.plausible(df), "wind_sd") == [3.0, 3.1]
    assert values(Q.above(df, "wind_sd", 3.0), "wind_sd") == [3.1, 5.0]
    assert values(Q.censor(df, {"wind_sd": (3.0, 5.0), "wind_max": None}), "wind_sd") == [3.0, 3.1, 5.0]
    assert values(Q.complete_groups(spark.createDataFrame([(60, 0), (59, 0), (60, 1)], "nrow int, na_ct int")), "nrow") == [60]


def test_calendar_filters(spark):
    df = spark.createDataFrame([(8, 1), (8, 2), (7, 1)], "month int, day int")
    assert sorted(tuple(r) for r in Q.without_day(df, 8, 1).collect()) == [(7, 1), (8, 2)]
    assert Q.month_view(df, 8).count() == 2


def test_time_slices_reach_the_scan(spark, tmp_path, plan):
    stamps = [datetime(2014, 1, 1), datetime(2016, 12, 31, 23, 59), datetime(2017, 1, 1), datetime(2013, 12, 31, 23, 59, 59)]
    df = spark.createDataFrame([(s, float(i)) for i, s in enumerate(stamps)], "date timestamp_ntz, v double")
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    years = Q.date_slice(stored, date(2014, 1, 1), date(2016, 12, 31))
    assert values(years) == [0.0, 1.0]
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date" in plan(years)
    hours = Q.hour_slice(stored, "2014-1-1 0", "2016-12-31 23", column="date", value="v", band=(0.0, 1.0))
    assert values(hours) == [0.0]
    assert "GreaterThanOrEqual(date,2014-01-01T00:00), LessThanOrEqual(date" in plan(hours)


def test_scalar_helpers(spark):
    one = spark.range(1)
    assert one.select(hour_literal("2019-8-2 14")).first()[0] == datetime(2019, 8, 2, 14)
    assert [one.select(month_label(F.lit(m))).first()[0] for m in (1, 5, 9, 12)] == ["Jan", "May", "Sep", "Dec"]
    assert str(one.select(clean_zero(F.lit(-0.0))).first()[0]) == "0.0"
    big = one.select(inverse_logit(F.lit(800.0)), inverse_logit(F.lit(-800.0)), inverse_logit(F.lit(0.0))).first()
    assert tuple(big) == (1.0, 0.0, 0.5)
    parts = spark.createDataFrame([(2020, 2, 30, 1), (2020, 2, 29, 5)], "year int, month int, day int, hour int")
    assert [r[0] for r in parts.select(hour_instant()).collect()] == [None, datetime(2020, 2, 29, 5)]


def test_interval_index_is_right_closed(spark):
    xs = [0.0, 0.1, 1.0, 1.0000001, 2.0, 9.99, 10.0, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    index = [r[0] for r in df.select(interval_index(F.col("x"), F.lit(0.0), F.lit(10.0), 10)).collect()]
    assert index == [1, 1, 1, 2, 2, 10, 10, None]
    flat = [r[0] for r in df.select(interval_index(F.lit(3.0), F.lit(3.0), F.lit(3.0), 20)).limit(1).collect()]
    assert flat == [10]


def test_interval_index_agrees_with_its_edges(spark):
    # values exactly on lo + i * width, as doubles round them
    lo, hi, count = 0.1, 0.8, 7
    edges = [lo + i * ((hi - lo) / count) for i in range(count + 1)]
    df = spark.createDataFrame([(e,) for e in edges], "x double")
    index = [r[0] for r in df.select(interval_index(F.col("x"), F.lit(lo), F.lit(hi), count)).collect()]
    assert index == [1, 1, 2, 3, 4, 5, 6, 7]
