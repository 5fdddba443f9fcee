import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import collect_by, ids
from skyledger.operators.density import boxplot_outliers, boxplot_stats, density_2d, equal_width_bins, kernel_density
from skyledger.plans.station import box_figure


def test_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 2.5, 5, 9.9, 10)] + [(None,)], "x double")
    rows = collect_by(equal_width_bins(df, "x", 10), "x")
    assert {x: r["bin"] for x, r in rows.items()} == {0: 1, 1: 1, 2: 2, 2.5: 3, 5: 5, 9.9: 10, 10: 10, None: None}
    assert (rows[0.0]["bin_lo"], rows[0.0]["bin_hi"]) == (-0.01, 1.0)
    assert (rows[10.0]["bin_lo"], rows[10.0]["bin_hi"]) == (9.0, 10.01)
    assert rows[None]["bin_lo"] is None


def test_bins_of_a_constant(spark):
    df = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    row = equal_width_bins(df, "x", 20).first()
    assert row.bin_lo < 4.0 <= row.bin_hi + 1e-12


def test_density_cells(spark):
    points = [(0.0, 0.0), (0.5, 0.5), (1.0, 1.0), (1.0, 1.5), (2.0, 2.0), (2.1, 1.0), (None, 1.0), (-0.1, 1.0)]
    df = spark.createDataFrame(points, "x double, y double")
    cells = collect_by(density_2d(df, "x", "y", (2, 2), (0.0, 2.0), (0.0, 2.0)), "x_bin", "y_bin")
    assert {k: v["n"] for k, v in cells.items()} == {(1, 1): 3, (1, 2): 1, (2, 2): 1}
    first = cells[1, 1]
    assert (first["x_lo"], first["x_hi"], first["density"], first["ndensity"], first["log_ndensity"]) == (0, 1, 0.6, 1, 0)
    free = density_2d(df, "x", "y", (3, 3))
    assert free.agg(F.sum("n"), F.sum("density")).first()[0] == 7


def test_boxes(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 30.0, -20.0]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, 5.0), (3, None)], "bin int, y double")
    rows = collect_by(boxplot_stats(df, "bin", "y"), "bin")
    assert set(rows) == {1, 2}
    assert rows[1] == {"bin": 1, "n": 9, "q1": 2.0, "median": 4.0, "q3": 6.0, "whisker_lo": 1.0, "whisker_hi": 7.0, "outliers": 2}
    assert rows[2]["whisker_lo"] == rows[2]["whisker_hi"] == 5.0
    assert sorted(r.y for r in boxplot_outliers(df, "bin", "y").collect()) == [-20.0, 30.0]


def test_box_figure_covers_all_rows(spark):
    df = ids(spark, 2000).select((F.col("u") * 7).alias("x"), F.exp(F.col("u") * 3 + F.col("id") % 5).alias("y"))
    rows = box_figure(df, "x", "y", 20).collect()
    assert sum(r.n for r in rows) == 2000 and len({r.bin for r in rows}) == len(rows) <= 20
    pdf = df.toPandas()
    some = rows[0]
    inside = pdf[(pdf.x > some.bin_lo) & (pdf.x <= some.bin_hi)].y
    assert [some.q1, some.median, some.q3] == pytest.approx(np.quantile(inside, [0.25, 0.5, 0.75]))


def direct_density(values, at):
    n = len(values)
    q1, q3 = np.quantile(values, [0.25, 0.75])
    bw = 0.9 * min(np.std(values, ddof=1), (q3 - q1) / 1.34) * n**-0.2
    return np.exp(-0.5 * ((at[:, None] - values[None]) / bw) ** 2).sum(axis=1) / (n * bw * np.sqrt(2 * np.pi))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_kernel_density_close_to_the_direct_sum(spark, by):
    df = ids(spark, 3000).select((F.col("id") % 2).alias("g"), (F.col("u") * F.col("u") * 10 + F.col("id") % 2).alias("v"))
    curve = kernel_density(df, "v", by).toPandas()
    data = df.toPandas()
    for g in ([0, 1] if by else [None]):
        c = (curve[curve.g == g] if by else curve).sort_values("point")
        v = (data[data.g == g] if by else data).v.to_numpy()
        assert len(c) == 512 and (c.x.iloc[0], c.x.iloc[-1]) == pytest.approx((data.v.min(), data.v.max()))
        wanted = direct_density(v, c.x.to_numpy())
        assert np.abs(c.density - wanted).max() < 2e-3 * wanted.max()


def test_kernel_density_within_limits(spark):
    df = ids(spark, 1000).select((F.col("u") * 10).alias("v"))
    curve = kernel_density(df, "v", limits=(2.0, 6.0)).toPandas()
    inside = df.where("v between 2 and 6").count()
    assert (curve.n == inside).all() and curve.x.min() == 2.0 and curve.x.max() == 6.0
