import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import ids
from skyledger.operators.smooth import _second_derivatives, spline_smooth


def test_matches_a_dense_solution(spark):
    """Same spline fitted from the full design matrix, penalty picked by brute force."""
    df = ids(spark, 600).select((F.col("u") * 10).alias("x"), (F.sin(F.col("u") * 6) + F.sin(F.col("id") * 7.7) * 0.3).alias("y"))
    got = spline_smooth(df, "x", "y", knots=8, points=30).orderBy("point").toPandas()
    pdf = df.toPandas()
    knots = np.quantile(np.unique(pdf.x), np.linspace(0, 1, 8))
    curvature, penalty = _second_derivatives(knots)

    def design(x):
        j = np.clip(np.searchsorted(knots, x, side="left") - 1, 0, 6)
        h, l, r = knots[j + 1] - knots[j], x - knots[j], knots[j + 1] - x
        eye = np.eye(8)
        return (r / h)[:, None] * eye[j] + (l / h)[:, None] * eye[j + 1] + (
            (r**3 / h - h * r) / 6)[:, None] * curvature[j] + ((l**3 / h - h * l) / 6)[:, None] * curvature[j + 1]

    X, y = design(pdf.x.to_numpy()), pdf.y.to_numpy()

    def solve(lam):
        inverse = np.linalg.inv(X.T @ X + lam * penalty)
        beta = inverse @ X.T @ y
        edf = np.trace(inverse @ X.T @ X)
        rss = ((y - X @ beta) ** 2).sum()
        return len(y) * rss / (len(y) - edf) ** 2, beta, inverse, edf, rss

    lam = min(np.logspace(-8, 6, 4000), key=lambda v: solve(v)[0])
    _, beta, inverse, edf, rss = solve(lam)
    at = design(got.x.to_numpy())
    assert got.fit.to_numpy() == pytest.approx(at @ beta, abs=2e-4)
    assert got.edf.iloc[0] == pytest.approx(edf, abs=0.02)
    se = np.sqrt(rss / (len(y) - edf) * np.einsum("ij,jk,ik->i", at, inverse, at))
    assert got.se.to_numpy() == pytest.approx(se, rel=5e-3)
    assert (got.upper - got.fit).to_numpy() == pytest.approx(2 * se, rel=5e-3)


def test_straight_line_and_groups(spark):
    df = ids(spark, 500).select(
        (F.col("id") % 2).alias("g"), (F.col("u") * 4).alias("x"), (1 + 2 * F.col("u") * 4 + (F.col("id") % 2)).alias("y")
    )
    curves = spline_smooth(df, "x", "y", by=["g"], points=11).toPandas()
    for g, c in curves.groupby("g"):
        assert c.fit.to_numpy() == pytest.approx((1 + 2 * c.x + g).to_numpy(), abs=1e-6)
    assert len(curves) == 22


def test_few_distinct_values(spark):
    df = ids(spark, 300).select((F.col("id") % 4).cast("double").alias("x"), (F.col("id") % 4 * 2).cast("double").alias("y"))
    c = spline_smooth(df, "x", "y", points=4).orderBy("x").toPandas()
    assert c.fit.to_numpy() == pytest.approx([0, 2, 4, 6], abs=1e-6)


def test_limits_drop_rows_first(spark):
    df = ids(spark, 400).select((F.col("u") * 10).alias("x"), F.when(F.col("u") > 0.5, 100.0).otherwise(F.col("u")).alias("y"))
    c = spline_smooth(df, "x", "y", limits={"x": (0.0, 5.0)}).toPandas()
    assert c.x.max() <= 5.0 and c.fit.max() < 1.0


def test_groups_with_one_two_and_three_distinct_x(spark):
    """The mean at a lone point, the straight line through two, a curve from three on; none is left out."""
    rows = [("one", 2.0, y) for y in (1.0, 2.0, 6.0)]
    rows += [("two", x, y) for x, y in ((0.0, 1.0), (0.0, 3.0), (4.0, 10.0), (4.0, 12.0))]
    rows += [("three", float(x), 2.0 * x) for x in range(3) for _ in range(4)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    c = spline_smooth(df, "x", "y", by=["g"], points=5).toPandas().sort_values(["g", "point"])
    one, two, three = (c[c.g == g] for g in ("one", "two", "three"))
    assert len(c) == 15 and set(one.x) == {2.0}
    assert one.fit.to_numpy() == pytest.approx([3.0] * 5) and one.se.to_numpy() == pytest.approx([np.sqrt(7 / 3)] * 5)
    assert two.x.tolist() == [0, 1, 2, 3, 4] and two.fit.to_numpy() == pytest.approx([2, 4.25, 6.5, 8.75, 11], abs=1e-3)
    assert two.se.iloc[0] == pytest.approx(1.0, abs=1e-3) and two.edf.iloc[0] == pytest.approx(2.0, abs=1e-3)
    assert three.fit.to_numpy() == pytest.approx(2 * three.x.to_numpy(), abs=1e-3)
