import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import ids
from skyledger.operators import quantiles
from skyledger.operators.quantiles import grouped_quantiles

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def check(df, group):
    got = grouped_quantiles(df, group, "v", PROBS).collect()
    data = df.toPandas().dropna(subset=["v"])
    wanted = {k if isinstance(k, tuple) else (k,): g["v"].to_numpy() for k, g in data.groupby(group)} if group else {(): data["v"].to_numpy()}
    assert len(got) == len(wanted)
    for row in got:
        values = wanted[tuple(row[g] for g in group)]
        assert row.n == len(values)
        assert row.quantiles == pytest.approx(np.quantile(values, PROBS), rel=1e-12, abs=1e-12)


def frame(spark, n, kind):
    base = ids(spark, n)
    v = {
        "continuous": F.exp(F.col("u") * 12),
        "ties": F.floor(F.col("u") * 20).cast("double"),
        "constant": F.lit(3.5),
        "heavy": F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("u") * 1e6),
    }[kind]
    return base.select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 != 7, v).alias("v"))


@pytest.mark.parametrize("kind", ["continuous", "ties", "constant", "heavy"])
@pytest.mark.parametrize("group", [[], ["g"]])
@pytest.mark.parametrize("accuracy", [quantiles.ACCURACY, 2000])
def test_exact_with_brackets(spark, monkeypatch, kind, group, accuracy):
    """Also with a sketch so coarse that its cuts are off by several ranks."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "_CUTS", min(quantiles._CUTS, accuracy // 50))
    check(frame(spark, 12000, kind), group)


@pytest.mark.parametrize("n", [3, 4, 9, 10, 250])
def test_small_groups(spark, n):
    check(frame(spark, n, "continuous"), ["g"])
    check(frame(spark, n, "ties"), [])


def test_no_task_orders_more_than_a_cell(spark, monkeypatch):
    """All rows in one group, continuous values: the ordered rows are those of single cells."""
    n = 200_000
    monkeypatch.setattr(quantiles, "_CELLS", 64)
    df = ids(spark, n).select(F.lit(1).alias("g"), F.col("u").alias("v"))
    out = grouped_quantiles(df, ["g"], "v", [0.25, 0.5])
    out.collect()
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text
    metrics = [m for m in _window_rows(out)]
    assert max(metrics, default=0) <= 4 * 64 + n * 5 / quantiles._CUTS / 16


def _window_rows(df):
    """Rows that reach each Window node of the plan that ran."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if name == "Sort":
            metric = node.metrics().get("numOutputRows")
            if metric.isDefined():
                found.append(metric.get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_order_of_probabilities_and_infinities(spark):
    rows = [float("-inf"), -1.0, 0.0, 2.0, 5.0, float("inf")]
    df = spark.createDataFrame([(1, x) for x in rows], "g int, v double")
    got = grouped_quantiles(df, ["g"], "v", [1.0, 0.2, 0.8, 0.0]).first().quantiles
    assert got == [float("inf"), -1.0, 5.0, float("-inf")]


def test_nan_and_empty(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, None)], "g int, v double")
    assert grouped_quantiles(df, ["g"], "v", [0.5]).collect() == []
    assert grouped_quantiles(df, [], "v", [0.5]).collect() == []
