import pytest
from pyspark.sql import functions as F

from helpers import collect_by, ids
from skyledger.operators.regression import simple_regression
from skyledger.operators.reshape import zero_fill
from skyledger.operators.summaries import count_by
from skyledger.plans.published import published_trends
from skyledger.plans.station import month_mean_trends, monthly_trends, stability, trend_figure

HOUR = "t_2m double, t_10m double, p double, wind_spd double"


def test_stability_worked_row(spark):
    row = stability(spark.createDataFrame([(-10.0, -9.0, 1000.0, 5.0)], HOUR)).first()
    assert row.t_difference == 1.0
    assert row.richardson_bulk == pytest.approx(-0.31392)
    assert row.avg_temp_K == pytest.approx(263.65)
    assert row.delta_p == pytest.approx(-9.81 * (1000 / (8.314 * 263.65)) * 8)
    assert row.p_10m == pytest.approx(1000 + row.delta_p)
    assert row.pot_temp_2m == -10.0
    assert row.pot_temp_10m == pytest.approx(-9 * (1000 / row.p_10m) ** 0.286)
    assert row.delta_theta == pytest.approx(row.pot_temp_10m + 10)
    assert row.richardson_potential == pytest.approx((9.81 / -10) * row.delta_theta * 8 / 25)


def test_stability_without_a_value(spark):
    rows = [(0.0, 1.0, 1000.0, 5.0), (1.0, 2.0, 1000.0, 0.0), (1.0, None, 1000.0, 5.0), (1.0, 2.0, None, 5.0)]
    zero, calm, no_top, no_p = stability(spark.createDataFrame(rows, HOUR)).collect()
    assert zero.richardson_bulk is None and zero.pot_temp_2m == 0.0 and calm.richardson_potential is None
    assert no_top.richardson_bulk is None and no_top.pot_temp_2m == 1.0
    assert no_p.richardson_bulk is not None and no_p.richardson_potential is None


def hours(spark):
    return ids(spark, 4000).select(
        (F.col("id") % 12 + 1).cast("int").alias("month"),
        (1994 + F.floor(F.col("u") * 9)).cast("int").alias("year"),
        (F.sin(F.col("id") * 1.1) * 20).alias("t_2m"),
        F.when(F.col("id") % 9 != 0, F.col("u") * 10).alias("wind_spd"),
        (F.abs(F.sin(F.col("id") * 2.3)) * 3).alias("wind_sd"),
        F.lit(1000.0).alias("p"),
    )


def test_trends_equal_their_parts(spark, plan):
    df = hours(spark)
    trends = collect_by(monthly_trends(df, 2.0, years=(1994, 2004)), "metric", "month")
    assert len(trends) == 60
    high = zero_fill(count_by(df.where("wind_sd > 2"), "month", "year"), years=(1994, 2004))
    warm = zero_fill(count_by(df.where("t_2m > -1.8"), "month", "year"), years=(1994, 2004))
    parts = {
        "gust_count": simple_regression(high, "year", "n", ["month"]),
        "thaw_count": simple_regression(warm, "year", "n", ["month"]),
        **{c: simple_regression(df, "year", c, ["month"]) for c in ("t_2m", "wind_spd", "wind_sd")},
    }
    for metric, part in parts.items():
        for row in part.collect():
            got = trends[metric, row.month]
            for name in ("n", "slope", "intercept", "std_error", "t_value", "r2"):
                assert got[name] == pytest.approx(row[name], rel=1e-7, abs=1e-12), (metric, name)
    assert plan(monthly_trends(df)).count("Range (0, 4000") == 1    # one pass over the hours


def test_figures(spark):
    trends = monthly_trends(hours(spark))
    rows = trend_figure(trends, "t_2m").orderBy("month").collect()
    assert [r.label for r in rows][:3] == ["Jan", "Feb", "Mar"] and all(r.lo <= r.slope <= r.hi for r in rows)
    means = month_mean_trends(hours(spark))
    assert means.count() == 48 and means.where("metric = 'mean_p' and abs(slope) > 1e-12").count() == 0


def test_published_table(spark):
    rows = collect_by(published_trends(spark), "metric", "month")
    assert len(rows) == 60 and rows["thaw_count", 10]["published_slope"] == 9.056
    assert rows["wind_sd", 1]["published_error"] == 0.0002719
