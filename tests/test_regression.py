import numpy as np
import pytest
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from helpers import collect_by, ids
from skyledger.operators.regression import (
    cell_regression,
    confidence_band,
    factorial_terms,
    linear_model,
    plain_terms,
    predict,
    simple_regression,
    sufficient_statistics,
    with_p_values,
)

# A published recount of events per year, 1994 to 2021.
RECOUNT = [1, 1, 0, 2, 0, 1, 1, 0, 0, 0, 1, 1, 2, 0, 0, 2, 1, 0, 0, 0, 3, 0, 0, 1, 5, 8, 0, 11]


def data(spark, n=800):
    return ids(spark, n).select(
        "id",
        (F.col("u") * 20).alias("wind_spd"),
        (F.sin(F.col("id") * 1.7) * 30 - 10).alias("t_2m"),
        (F.cos(F.col("id") * 0.9) * 2).alias("ri"),
        (0.5 + F.col("u") + F.sin(F.col("id") * 3.1)).alias("wind_sd"),
    )


def test_golden_recount(spark):
    df = spark.createDataFrame([(1994 + i, n) for i, n in enumerate(RECOUNT)], "year int, n int")
    fit = with_p_values(simple_regression(df, "year", "n")).first()
    assert fit.slope == pytest.approx(0.139846743, abs=1e-9)
    assert fit.intercept == pytest.approx(-279.278051, abs=1e-6)
    assert fit.r2 == pytest.approx(0.199653483, abs=1e-9)
    assert fit.std_error == pytest.approx(0.054911874, abs=1e-9)
    assert (fit.n, fit.df) == (28, 26)
    assert fit.t_value == pytest.approx(0.139846743 / 0.054911874, abs=1e-6)
    assert fit.p_value == pytest.approx(0.01711, abs=1e-4)
    assert (fit.lo, fit.hi) == pytest.approx((fit.slope - fit.std_error, fit.slope + fit.std_error))


def test_degenerate_lines(spark):
    df = spark.createDataFrame(
        [("one", 1.0, 2.0), ("two", 1.0, 2.0), ("two", 3.0, 3.0), ("flat x", 1.0, 1.0), ("flat x", 1.0, 2.0),
         ("flat x", 1.0, 5.0), ("zero", 1.0, 0.0), ("zero", 2.0, 0.0), ("zero", 3.0, 0.0), ("none", None, 1.0)],
        "g string, x double, y double",
    )
    fits = collect_by(with_p_values(simple_regression(df, "x", "y", ["g"])), "g")
    assert set(fits) == {"one", "two", "flat x", "zero"}
    assert fits["one"]["slope"] is None and fits["one"]["p_value"] is None
    assert fits["two"]["slope"] == 0.5 and fits["two"]["std_error"] is None
    assert fits["flat x"]["slope"] is None
    assert fits["zero"]["slope"] == 0 and fits["zero"]["t_value"] is None and fits["zero"]["r2"] is None


def test_cells_give_the_regression_of_the_rows(spark):
    rows = data(spark).withColumn("year", (1994 + F.col("id") % 9).cast("int")).withColumn("month", F.col("id") % 2)
    cells = rows.groupBy("month", "year").agg(
        F.count("t_2m").cast("double").alias("_w"), F.avg("t_2m").alias("_mean"),
        (F.var_pop("t_2m") * F.count("t_2m")).alias("_ssd"),
    )
    left = collect_by(cell_regression(cells, "year", ["month"]), "month")
    right = collect_by(simple_regression(rows, "year", "t_2m", ["month"]), "month")
    for month in (0, 1):
        for name, value in right[month].items():
            assert left[month][name] == pytest.approx(value, rel=1e-9)


def test_band(spark):
    df = data(spark, 40)
    band = confidence_band(simple_regression(df, "wind_spd", "wind_sd"), F.lit(0.0), F.lit(20.0), 5).orderBy("x").collect()
    pdf = df.toPandas()
    X = np.column_stack([np.ones(40), pdf.wind_spd])
    beta, rss = np.linalg.lstsq(X, pdf.wind_sd, rcond=None)[:2]
    covariance = np.linalg.inv(X.T @ X) * rss[0] / 38
    for r in band:
        at = np.array([1, r.x])
        assert r.fit == pytest.approx(at @ beta)
        assert r.se_fit == pytest.approx(np.sqrt(at @ covariance @ at))
        assert r.upper - r.fit == pytest.approx(2.024394164 * r.se_fit, rel=1e-8)


def test_multiple_regression_against_library(spark):
    df = data(spark)
    terms = plain_terms("wind_spd", "t_2m")
    fit = collect_by(linear_model(sufficient_statistics(df, "wind_sd", terms), list(terms)), "term")
    features = RFormula(formula="wind_sd ~ wind_spd + t_2m").fit(df).transform(df)
    reference = LinearRegression(solver="normal").fit(features)
    s = reference.summary
    names = ["wind_spd", "t_2m", "intercept"]
    assert [fit[t]["estimate"] for t in names] == pytest.approx([*reference.coefficients, reference.intercept], rel=1e-8)
    assert [fit[t]["std_error"] for t in names] == pytest.approx(s.coefficientStandardErrors, rel=1e-8)
    assert [fit[t]["t_value"] for t in names] == pytest.approx(s.tValues, rel=1e-8)
    assert [fit[t]["p_value"] for t in names] == pytest.approx(s.pValues, abs=1e-8)
    assert fit["t_2m"]["r2"] == pytest.approx(s.r2) and fit["t_2m"]["adj_r2"] == pytest.approx(s.r2adj)


def test_factorial_against_library(spark):
    df = data(spark)
    terms = factorial_terms("wind_spd", "t_2m", "ri")
    assert list(terms) == ["wind_spd", "t_2m", "ri", "wind_spd:t_2m", "wind_spd:ri", "t_2m:ri", "wind_spd:t_2m:ri"]
    fit = linear_model(sufficient_statistics(df, "wind_sd", terms), list(terms)).orderBy("position").collect()
    features = RFormula(formula="wind_sd ~ wind_spd * t_2m * ri").fit(df).transform(df)
    reference = LinearRegression(solver="normal").fit(features)
    assert len(reference.coefficients) == 7
    assert sorted(r.estimate for r in fit[1:]) == pytest.approx(sorted(reference.coefficients), rel=1e-6)
    predicted = predict(df, spark.createDataFrame(fit), terms)
    assert predicted.agg(F.corr("predicted", "wind_sd") ** 2).first()[0] == pytest.approx(fit[0].r2, rel=1e-8)


def test_plane_is_recovered_and_bad_rows_are_left_out(spark):
    plane = data(spark).withColumn("wind_sd", 0.5 + 0.1 * F.col("wind_spd") - 0.02 * F.col("t_2m"))
    bad = spark.createDataFrame(
        [(-1, float("inf"), 1.0, 0.0, 1.0), (-2, 1.0, float("nan"), 0.0, 1.0), (-3, None, 1.0, 0.0, 1.0), (-4, 1.0, 1.0, 0.0, None)],
        plane.schema,
    )
    terms = plain_terms("wind_spd", "t_2m")
    fit = collect_by(linear_model(sufficient_statistics(plane.unionAll(bad), "wind_sd", terms), list(terms)), "term")
    assert fit["intercept"]["n"] == 800
    assert [fit[t]["estimate"] for t in ("intercept", "wind_spd", "t_2m")] == pytest.approx([0.5, 0.1, -0.02], abs=1e-12)


def test_aliased_terms_and_groups(spark):
    df = data(spark).withColumns({"twice": F.col("wind_spd") * 2, "g": F.col("id") % 3})
    terms = plain_terms("wind_spd", "twice", "t_2m", "t_2m^2")
    fit = linear_model(sufficient_statistics(df, "wind_sd", terms, ["g"]), list(terms), ["g"])
    rows = collect_by(fit, "g", "term")
    assert len(rows) == 15
    pdf = df.where("g = 1").toPandas()
    X = np.column_stack([np.ones(len(pdf)), pdf.wind_spd, pdf.t_2m, pdf.t_2m**2])
    beta = np.linalg.lstsq(X, pdf.wind_sd, rcond=None)[0]
    assert rows[1, "twice"]["estimate"] is None and rows[1, "twice"]["p_value"] is None
    got = [rows[1, t]["estimate"] for t in ("intercept", "wind_spd", "t_2m", "t_2m^2")]
    assert got == pytest.approx(beta, rel=1e-8)
