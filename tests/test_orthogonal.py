from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators.orthogonal import factor_of, merged, qr_factor, qr_model
from skyledger.operators.regression import factorial_terms, linear_model, plain_terms, sufficient_statistics


def fitted(df, y, terms):
    rows = qr_model(qr_factor(df, y, terms), list(terms)).orderBy("position").collect()
    return {r.term: r for r in rows}


def exact(x, y):
    """Coefficients and squared errors of least squares with an intercept, in fractions."""
    rows = [[Fraction(1), *map(Fraction, r)] for r in x]
    p = len(rows[0])
    gram = [[sum(r[i] * r[j] for r in rows) for j in range(p)] + [Fraction(int(i == j)) for j in range(p)] for i in range(p)]
    for i in range(p):
        pivot = gram[i][i]
        gram[i] = [v / pivot for v in gram[i]]
        for k in range(p):
            if k != i:
                gram[k] = [v - gram[k][i] * w for v, w in zip(gram[k], gram[i])]
    inverse = [g[p:] for g in gram]
    cross = [sum(r[i] * Fraction(t) for r, t in zip(rows, y)) for i in range(p)]
    b = [sum(inverse[i][j] * cross[j] for j in range(p)) for i in range(p)]
    rss = sum((Fraction(t) - sum(v * w for v, w in zip(b, r))) ** 2 for r, t in zip(rows, y))
    s2 = rss / (len(rows) - p)
    return [float(v) for v in b], [float(s2 * inverse[i][i]) ** 0.5 for i in range(p)]


def trending(n=60):
    """Columns that rise together over the years, like economic series: whole numbers of very different size."""
    rng = np.random.default_rng(8)
    t = np.arange(n)
    cols = [830 + 6 * t + rng.integers(0, 9, n), 234000 + 20000 * t + rng.integers(0, 5000, n), 107600 + 1500 * t + rng.integers(0, 200, n), 1947 + t]
    y = 60000 + 15 * cols[0] - cols[1] // 40 + cols[2] // 9 + rng.integers(0, 300, n)
    return np.column_stack(cols).tolist(), y.tolist()


def test_trending_columns_to_nine_digits(spark):
    x, y = trending()
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, y double").repartition(5)
    found = fitted(df, "y", plain_terms("a", "b", "c", "d"))
    b, e = exact(x, y)
    assert [found[k].estimate for k in ("intercept", "a", "b", "c", "d")] == pytest.approx(b, rel=1e-9)
    assert [found[k].std_error for k in ("intercept", "a", "b", "c", "d")] == pytest.approx(e, rel=1e-9)


def test_near_collinear_interactions_keep_their_digits(spark):
    n = 400
    x = [(1_000_000 + k, (k * k) % 97) for k in range(n)]
    rows = [(a, b, a * b) for a, b in x]
    y = [3 * a - 2 * b + (k * 7919) % 31 for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, y double").repartition(6)
    found = fitted(df, "y", factorial_terms("a", "b"))
    b, _ = exact(rows, y)
    names = ["intercept", "a", "b", "a:b"]
    assert [found[k].estimate for k in names] == pytest.approx(b, rel=1e-6)
    sums = {r.term: r.estimate for r in linear_model(sufficient_statistics(df, "y", factorial_terms("a", "b")), ["a", "b", "a:b"]).collect()}
    worst = [max(abs((v[k] if isinstance(v[k], float) else v[k].estimate or 0) / w - 1) if v[k] is not None else 1 for k, w in zip(names, b)) for v in (found, sums)]
    assert worst[0] <= worst[1]


def test_same_as_sums_where_these_are_fine(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    y = x @ [1, -2, 0.5] + rng.normal(size=500)
    df = spark.createDataFrame([(*r, t) for r, t in zip(x.tolist(), y.tolist())], "a double, b double, c double, y double").repartition(7)
    df = df.unionAll(spark.createDataFrame([(1.0, None, 2.0, 3.0), (float("nan"), 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, float("inf"))], df.schema))
    terms = factorial_terms("a", "b", "c")
    mine = fitted(df, "y", terms)
    theirs = {r.term: r for r in linear_model(sufficient_statistics(df, "y", terms), list(terms)).collect()}
    for k in theirs:
        for c in ("n", "df", "estimate", "std_error", "t_value", "p_value", "sigma", "r2", "adj_r2"):
            assert mine[k][c] == pytest.approx(theirs[k][c], rel=1e-7, abs=1e-9), (k, c)


def test_aliased_terms_and_few_rows(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i * i)) for i in range(10)], "a double, b double, y double")
    found = fitted(df, "y", plain_terms("a", "b"))
    assert found["b"].estimate is None and found["a"].estimate == pytest.approx(9) and found["a"].df == 8
    constant = fitted(df.withColumn("b", F.lit(4.0)), "y", plain_terms("b"))
    assert constant["b"].estimate is None and constant["intercept"].estimate == pytest.approx(28.5)
    one = fitted(df.limit(1), "y", plain_terms("a"))
    assert one["intercept"].estimate == 0.0 and one["intercept"].std_error is None
    assert fitted(df.limit(0), "y", plain_terms("a")) == {}


def test_merging_is_exact_and_goes_through_several_levels(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(300, 4)) * [1, 1e6, 1e-3, 50] + [1e5, 0, 7, -3]
    whole = factor_of(rows)
    parts = factor_of(rows[:1])
    for k in range(1, 300, 23):
        parts = merged(parts, factor_of(rows[k : k + 23]))
    assert parts[0] == whole[0] and parts[1] == pytest.approx(whole[1]) and parts[2] == pytest.approx(whole[2], rel=1e-8, abs=1e-8)
    monkeypatch.setattr("skyledger.operators.orthogonal.FAN", 3)
    df = spark.createDataFrame([tuple(r) for r in rows.tolist()], "a double, b double, c double, y double").repartition(20)
    found = qr_factor(df, "y", plain_terms("a", "b", "c")).collect()
    assert len(found) == 1 and found[0].n == 300 and np.array(found[0].factor).reshape(4, 4) == pytest.approx(whole[2], rel=1e-8, abs=1e-8)
