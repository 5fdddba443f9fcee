from math import comb, exp, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import ids
from skyledger.operators.zero_inflated import zero_inflated_fit, zero_inflated_mean


def log_posterior(cells, p_zero, a, b1, b2, trials):
    value = 2 * log(p_zero) + 2 * log(1 - p_zero) - ((a - 5) / 5) ** 2 / 2 - b1**2 / 2 - b2**2 / 2
    for (x, k), w in cells.items():
        p = 1 / (1 + exp(-(a + b1 * x + b2 * x * x)))
        binomial = comb(trials, k) * p**k * (1 - p) ** (trials - k)
        value += w * log((1 - p_zero) * binomial + (p_zero if k == 0 else 0.0))
    return value


@pytest.mark.parametrize("trials", [6, 60])
def test_fit_is_the_most_probable_point(spark, trials):
    eta = -0.6 + 0.15 * F.col("x") - 0.02 * F.col("x") * F.col("x")
    df = ids(spark, 1500).select("id", "u", (F.floor(F.sin(F.col("id") * 1.1) * 40) / 10).alias("x"))
    df = df.withColumn("p", 1 / (1 + F.exp(-eta)))
    count = F.floor(trials * F.least(F.lit(1.0), F.col("p") * (0.6 + 0.8 * F.col("u"))))
    df = df.withColumn("gust_time", F.when(F.abs(F.sin(F.col("id") * 9.1)) < 0.35, 0).otherwise(count).cast("long"))
    df = df.unionAll(spark.createDataFrame([(-1, 0.1, None, 0.5, 1), (-2, 0.1, 1.0, 0.5, 999)], df.schema))
    fit = zero_inflated_fit(df, x="x", trials=trials).first()
    assert fit.converged and fit.n == 1500
    cells = {(r.x, r.gust_time): r["count"] for r in df.where("x is not null and gust_time <= 60").groupBy("x", "gust_time").count().collect()}
    best = np.array([fit.p_zero, fit.a, fit.b1, fit.b2])
    peak = log_posterior(cells, *best, trials)
    for i in range(4):
        for step in (0.02, -0.02, 0.001, -0.001):
            other = best.copy()
            other[i] += step
            assert log_posterior(cells, *other, trials) < peak
        h = 1e-5
        up, down = best.copy(), best.copy()
        up[i] += h
        down[i] -= h
        slope = (log_posterior(cells, *up, trials) - log_posterior(cells, *down, trials)) / (2 * h)
        assert abs(slope) < 0.05

    grid = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    rows = zero_inflated_mean(grid, zero_inflated_fit(df, x="x", trials=trials), "x", trials).orderBy("x").collect()
    assert rows[0].p == pytest.approx(1 / (1 + exp(-fit.a)))
    assert rows[1].expected == pytest.approx((1 - fit.p_zero) * trials * rows[1].p)


def test_no_rows(spark):
    df = spark.createDataFrame([], "t_2m double, gust_time long")
    assert zero_inflated_fit(df).collect() == []
