import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import collect_by, ids
from skyledger.operators import bayes
from skyledger.operators.bayes import MODELS


def frame(spark, n=300):
    base = ids(spark, n)
    return base.select(
        "id",
        (F.sin(F.col("id") * 1.3) * 25 - 8).alias("t_2m"),
        (F.col("u") * 15).alias("wind_spd"),
        (F.cos(F.col("id") * 0.7) * 3).alias("richardson_bulk"),
        (F.cos(F.col("id") * 2.1)).alias("t_difference"),
        (0.6 + F.col("u") * 0.4 + F.sin(F.col("id") * 5.3) * 0.3).alias("wind_sd"),
        F.floor(F.abs(F.sin(F.col("id") * 2.9)) * 40).alias("gust_time"),
    )


def log_posterior(model, pdf, theta):
    """Straight from the definition of the model, for plain numbers."""
    *beta, sigma = theta
    columns = [pdf[t[:-2]] ** 2 if t.endswith("^2") else pdf[t] for t in model.terms]
    y = pdf[model.response].to_numpy(float)
    mu = beta[0] + sum(b * c.to_numpy(float) for b, c in zip(beta[1:], columns))
    intercept = beta[0] + sum(b * c.mean() for b, c in zip(beta[1:], columns)) if model.centred else beta[0]
    value = -len(y) * np.log(sigma) - ((y - mu) ** 2).sum() / (2 * sigma**2) - model.sigma_rate * sigma
    for b, prior in zip([intercept, *beta[1:]], [model.intercept, *model.slopes]):
        if prior:
            value -= ((b - prior[0]) / prior[1]) ** 2 / 2
    return value


@pytest.mark.parametrize("name", sorted(MODELS))
def test_mode_is_stationary_with_that_curvature(spark, name):
    model = MODELS[name]
    df = frame(spark)
    rows = bayes.posterior_mode(bayes.model_statistics(df, model), model).orderBy("position").collect()
    pdf = df.toPandas()
    mode, sd = np.array([r["mean"] for r in rows]), np.array([r["sd"] for r in rows])
    k = len(mode)

    def f(z):
        return log_posterior(model, pdf, mode + z * sd)

    h, unit = 1e-3, np.eye(len(mode))
    gradient = np.array([(f(h * unit[i]) - f(-h * unit[i])) / (2 * h) for i in range(k)])
    assert np.abs(gradient).max() < 1e-3
    hessian = np.array(
        [[(f(h * (unit[i] + unit[j])) - f(h * (unit[i] - unit[j])) - f(h * (unit[j] - unit[i])) + f(-h * (unit[i] + unit[j])))
          / (4 * h * h) for j in range(k)] for i in range(k)]
    )
    covariance = np.linalg.inv(-hessian) * np.outer(sd, sd)
    got = np.array([r["covariance"] for r in rows])
    assert got == pytest.approx(covariance, rel=2e-2, abs=2e-3 * np.outer(sd, sd).max())
    assert np.sqrt(np.diag(covariance)) == pytest.approx(sd, rel=1e-3)


def test_summary_interval(spark):
    model = MODELS["sd_multi"]
    row = bayes.mode_summary(bayes.posterior_mode(bayes.model_statistics(frame(spark), model), model)).first()
    assert row.upper - row["mean"] == pytest.approx(1.598193 * row.sd, rel=1e-6)


def test_exact_marginals_against_a_dense_grid(spark):
    """Few rows, so that the marginals are far from normal: sigma and one slope integrated over a plain grid."""
    model = bayes.GaussianModel("wind_sd", ("t_difference",), (5.0, 5.0), ((0.0, 1.0),), 0.05)
    df = frame(spark, 9)
    sums = bayes.model_statistics(df, model)
    found = {r.parameter: r for r in bayes.marginal_summary(sums, model).collect()}
    pdf = df.toPandas()
    x, y = pdf["t_difference"].to_numpy(), pdf["wind_sd"].to_numpy()
    a = np.linspace(found["a"].mean - 9 * found["a"].sd, found["a"].mean + 9 * found["a"].sd, 161)[:, None, None]
    b = np.linspace(found["b1"].mean - 9 * found["b1"].sd, found["b1"].mean + 9 * found["b1"].sd, 161)[None, :, None]
    s = np.exp(np.linspace(np.log(found["sigma"].mean) - 2.2, np.log(found["sigma"].mean) + 4, 261))[None, None, :]
    rss = sum((yi - a - b * xi) ** 2 for xi, yi in zip(x, y))
    value = -len(y) * np.log(s) - rss / (2 * s * s) - 0.05 * s - ((a - 5) / 5) ** 2 / 2 - b * b / 2 + np.log(s)
    weight = np.exp(value - value.max())
    weight /= weight.sum()
    for k, grid, axes in (("a", a, (1, 2)), ("b1", b, (0, 2)), ("sigma", s, (0, 1))):
        own, at = weight.sum(axis=axes), grid.ravel()
        mean = own @ at
        assert found[k].mean == pytest.approx(mean, rel=2e-3, abs=2e-3) and found[k].sd == pytest.approx(np.sqrt(own @ (at - mean) ** 2), rel=2e-2)
        ends = np.interp([0.055, 0.945], np.cumsum(own) - own / 2, at)
        assert [found[k].lower, found[k].upper] == pytest.approx(ends.tolist(), abs=0.02 * found[k].sd)
    assert found["sigma"].upper - found["sigma"].mean > 1.2 * (found["sigma"].mean - found["sigma"].lower)


def test_exact_band(spark):
    model = MODELS["sd_t"]
    df = frame(spark, 12)
    sums = bayes.model_statistics(df, model)
    rows = spark.createDataFrame([(1, 0.0), (2, None), (3, 12.5)], "id int, t_2m double")
    got = collect_by(bayes.mixture_band(rows, sums, model), "id")
    normal = collect_by(bayes.normal_band(rows, bayes.posterior_mode(sums, model), model), "id")
    found = {r.parameter: r for r in bayes.marginal_summary(sums, model, 0.90).collect()}
    assert [got[1][c] for c in ("mean", "lower", "upper")] == pytest.approx([found["a"][c] for c in ("mean", "lower", "upper")])
    assert got[2]["mean"] is None and got[2]["lower"] is None
    assert got[3]["upper"] - got[3]["lower"] > normal[3]["upper"] - normal[3]["lower"]
    wide = collect_by(bayes.mixture_band(rows, sums, model, predictive=True), "id")
    assert wide[1]["lower"] < got[1]["lower"] and wide[1]["mean"] == pytest.approx(got[1]["mean"])
    assert bayes.mixture_band(rows.limit(0), sums, model).count() == 0


def below_floor(spark):
    return frame(spark, 200).withColumn("gust_time", F.sin(F.col("id") * 5.3) - 0.15 + F.col("wind_spd") * 0.01)


def test_mode_on_the_floor(spark):
    """Responses below the floor: the constrained maximum, from a direct search over the definition of the model."""
    df, model = below_floor(spark), MODELS["gust_w_formula"]
    rows = {r.parameter: r for r in bayes.bounded_mode(bayes.model_statistics(df, model), model).collect()}
    assert rows["c"].bound and rows["c"].mode == 0.0 and not rows["b1"].bound
    pdf = df.toPandas()
    means = [pdf["wind_spd"].mean(), (pdf["wind_spd"] ** 2).mean()]

    def f(c, b1, b2, sigma):
        return log_posterior(model, pdf, [c - b1 * means[0] - b2 * means[1], b1, b2, sigma])

    best = [rows[k].mode for k in ("c", "b1", "b2", "sigma")]
    for i in (1, 2, 3):
        h = 1e-4 * rows[["c", "b1", "b2", "sigma"][i]].sd
        up, down = (f(*[v + s * h * (i == j) for j, v in enumerate(best)]) for s in (1, -1))
        assert abs(up - down) / 2 < 1e-6 and f(*best) >= max(up, down)
    assert f(1e-3, *best[1:]) < f(*best)
    plain = bayes.posterior_mode(bayes.model_statistics(df, model), model).orderBy("position").collect()
    assert plain[0]["mean"] == pytest.approx(-best[1] * means[0] - best[2] * means[1]) and plain[3]["mean"] == pytest.approx(best[3])


def test_truncated_density_around_the_floor(spark):
    df, model = below_floor(spark), MODELS["gust_w_formula"]
    sums = bayes.model_statistics(df, model).first()
    mode, spread, fall = bayes._Posterior(model, sums.n, sums.means, sums.comoments).peak()
    cut = bayes.truncated(spread, fall)
    # along the floor's normal the density is exp(fall d - d^2 / 2 V) for d >= 0
    d = np.linspace(0, 12 * cut.sd, 400_001)
    weight = np.exp(-((d - spread[0, 0] * fall) ** 2) / (2 * spread[0, 0]))
    weight /= weight.sum()
    mean = float(d @ weight)
    assert cut.mean[0] == pytest.approx(mean, rel=1e-3)
    assert cut.covariance[0, 0] == pytest.approx(float((d - mean) ** 2 @ weight), rel=1e-3)
    rows = {r.parameter: r for r in bayes.bounded_mode(bayes.model_statistics(df, model), model).collect()}
    passed = np.cumsum(weight)
    assert rows["c"].lower == pytest.approx(d[np.searchsorted(passed, 0.055)], rel=1e-2)
    assert rows["c"].upper == pytest.approx(d[np.searchsorted(passed, 0.945)], rel=1e-2)
    assert rows["c"].sd == pytest.approx(np.sqrt(cut.covariance[0, 0])) and rows["c"].lower >= 0


def test_far_below_the_floor(spark):
    df = frame(spark, 200).withColumn("gust_time", F.sin(F.col("id") * 5.3) - 50.0)
    model = MODELS["gust_d_formula"]
    rows = {r.parameter: r for r in bayes.bounded_mode(bayes.model_statistics(df, model), model).collect()}
    assert rows["c"].mode == 0.0 and 0 < rows["c"].lower < rows["c"].upper < 10 and rows["sigma"].mode > 40


def test_a_floor_that_does_not_bind_changes_nothing(spark):
    model = MODELS["gust_d_formula"]
    sums = bayes.model_statistics(frame(spark), model)
    rows = {r.parameter: r for r in bayes.bounded_mode(sums, model).collect()}
    free = {r.parameter: r for r in bayes.mode_summary(bayes.posterior_mode(sums, model)).collect()}
    assert not rows["c"].bound and rows["c"].mode == rows["c"]["mean"]
    for k in ("b1", "b2", "sigma"):
        assert [rows[k][c] for c in ("mode", "sd", "lower", "upper")] == pytest.approx([free[k][c] for c in ("mean", "sd", "lower", "upper")])


@pytest.mark.parametrize("name", ["sd_multi", "sd_multi_ri"])
def test_perfect_fit_keeps_the_coefficients(spark, name):
    model = MODELS[name]
    plane = 0.4 + 0.25 * F.col("wind_spd") - 0.125 * F.col("t_2m")
    for response, want in ((plane, [0.4, 0.25, -0.125, 0.0]), (F.lit(2.5), [2.5, 0.0, 0.0, 0.0])):
        sums = bayes.model_statistics(frame(spark).withColumn("wind_sd", response), model)
        rows = {r.parameter: r for r in bayes.posterior_mode(sums, model).collect()}
        got = [rows["a"]["mean"], rows["b1"]["mean"], rows["b2"]["mean"], rows["sigma"]["mean"]]
        assert got == pytest.approx(want, abs=1e-9) and {r.sd for r in rows.values()} == {0.0}


def test_bands(spark, plan):
    """Mean and variance of the linear predictor, from the mode and covariance by numpy."""
    model = MODELS["sd_multi"]
    df = frame(spark)
    mode = bayes.posterior_mode(bayes.model_statistics(df, model), model)
    fitted = mode.orderBy("position").toPandas()
    theta, cov = fitted["mean"].to_numpy(), np.stack(fitted["covariance"].to_numpy())
    rows = spark.createDataFrame([(1, -2.0, 3.0), (2, 0.0, 0.0), (3, None, 1.0)], "id int, t_2m double, wind_spd double")
    for predictive in (False, True):
        banded = bayes.normal_band(rows, mode, model, predictive=predictive)
        assert "Join" not in plan(banded).split("Subquery")[0]
        got = collect_by(banded, "id")
        for i, t, w in ((1, -2.0, 3.0), (2, 0.0, 0.0)):
            x = np.array([1.0, w, t])
            sd = np.sqrt(x @ cov[:3, :3] @ x + (theta[3] ** 2 if predictive else 0.0))
            want = [x @ theta[:3], x @ theta[:3] - 1.644853627 * sd, x @ theta[:3] + 1.644853627 * sd]
            assert [got[i][c] for c in ("mean", "lower", "upper")] == pytest.approx(want)
        assert got[3]["mean"] is None and got[3]["upper"] is None
