from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import collect_by, ids
from skyledger.operators import bayes
from skyledger.operators.predictive import predictive_boxes, predictive_density

ROWS = [(0.0, 1.0, 1.0), (0.5, 2.0, 0.5), (1.0, -1.0, 2.0), (1.5, 0.0, 1.0), (1.7, 4.0, 0.0), (2.0, 0.5, 0.3), (2.1, 9.0, 1.0), (None, 1.0, 1.0), (1.2, None, 1.0), (1.2, float("nan"), 1.0)]


def frame(spark):
    return spark.createDataFrame(ROWS, "x double, mean double, sd double").repartition(3)


def below(rows, y):
    return sum(NormalDist(m, s).cdf(y) if s else float(y >= m) for m, s in rows)


GROUPS = {1: [(1.0, 1.0), (2.0, 0.5), (-1.0, 2.0)], 2: [(0.0, 1.0), (4.0, 0.0), (0.5, 0.3)]}


def test_density(spark):
    cells = collect_by(predictive_density(frame(spark), "x", "mean", "sd", (2, 4), (0.0, 2.0), (-2.0, 6.0)), "x_bin", "y_bin")
    want = {(g, k): below(rows, -2 + 2 * k) - below(rows, -4 + 2 * k) for g, rows in GROUPS.items() for k in range(1, 5)}
    assert cells.keys() == want.keys()
    for key, n in want.items():
        assert cells[key]["expected"] == pytest.approx(n, abs=1e-12)
        assert cells[key]["density"] == pytest.approx(n / sum(want.values())) and cells[key]["ndensity"] == pytest.approx(n / max(want.values()))
    assert (cells[2, 3]["x_lo"], cells[2, 3]["y_lo"]) == (1.0, 2.0)


def test_boxes(spark):
    boxes = collect_by(predictive_boxes(frame(spark), "x", "mean", "sd", 2, (0.0, 2.0), (-8.0, 8.0), edges=4096), "x_bin")
    for g, rows in GROUPS.items():
        box = boxes[g]
        assert box["n"] == 3
        for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            if box[name] < 3.99:
                assert below(rows, box[name]) / 3 == pytest.approx(q, abs=1e-4)
        reach = 1.5 * (box["q3"] - box["q1"])
        assert (box["fence_lo"], box["fence_hi"]) == (box["q1"] - reach, box["q3"] + reach)
        assert box["outside"] == pytest.approx(below(rows, max(box["fence_lo"], -8)) + 3 - below(rows, min(box["fence_hi"], 8)), abs=2e-3)


def test_one_scan_and_no_draws(spark, tmp_path, plan):
    model = bayes.MODELS["sd_w"]
    ids(spark, 400).select((F.col("u") * 15).alias("wind_spd"), (1 + F.col("u")).alias("wind_sd")).write.parquet(str(tmp_path / "h"))
    hours = spark.read.parquet(str(tmp_path / "h"))
    mode = bayes.posterior_mode(bayes.model_statistics(hours, model), model)
    moments = bayes.predictive_moments(hours, mode, model)
    cells = predictive_density(moments, "wind_spd", "mean", "sd", (5, 40), (0.0, 15.0), (-20.0, 20.0))
    text = plan(cells)
    assert "Generate" not in text and "Join" not in text and text.count("MapInArrow") == 1
    rows = moments.collect()
    total = {k: sum(r.expected for r in group) for k, group in ((b, [r for r in cells.collect() if r.x_bin == b]) for b in range(1, 6))}
    assert sum(total.values()) == pytest.approx(len(rows), rel=1e-6)
    banded = collect_by(bayes.normal_band(hours, mode, model, predictive=True), "wind_spd")
    for r in rows[:20]:
        assert banded[r.wind_spd]["upper"] - r["mean"] == pytest.approx(1.6448536 * r.sd, rel=1e-6)


def test_empty(spark):
    assert predictive_density(frame(spark).limit(0), "x", "mean", "sd", (2, 2), (0, 1), (0, 1)).count() == 0
    assert predictive_boxes(frame(spark).limit(0), "x", "mean", "sd", 2, (0, 1), (0, 1)).count() == 0
    assert np.isfinite([r.q1 for r in predictive_boxes(frame(spark), "x", "mean", "sd", 1, (0, 2), (-9, 9)).collect()]).all()
