import math

import pytest
from pyspark.sql import functions as F

from skyledger.functions.student import critical_value, two_sided_p


def p_value(spark, t, nu):
    return spark.createDataFrame([(float(t), nu)], "t double, nu long").select(two_sided_p(F.col("t"), F.col("nu"))).first()[0]


@pytest.mark.parametrize(
    ("nu", "t", "p"),
    [(1, 1, 0.5), (5, 2.015048373, 0.1), (10, 2.228138852, 0.05), (27, 2.051830516, 0.05), (1000, 1.962339081, 0.05)],
)
def test_table_values(spark, nu, t, p):
    assert p_value(spark, t, nu) == pytest.approx(p, abs=1e-8)
    assert p_value(spark, -t, nu) == pytest.approx(p, abs=1e-8)


def test_closed_forms(spark):
    for t in (0.1, 1.7, 12.0, 300.0):
        assert p_value(spark, t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-10)
        assert p_value(spark, t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-10)
    assert p_value(spark, 0, 9) == pytest.approx(1.0)


def test_many_degrees_of_freedom_approach_the_normal(spark):
    assert p_value(spark, 1.96, 10**12) == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-9)
    assert p_value(spark, 5.0, 10**9) == pytest.approx(math.erfc(5 / math.sqrt(2)), rel=1e-5)


def test_undefined(spark):
    df = spark.createDataFrame([(1.0, 0), (None, 5), (2.0, -1)], "t double, nu long")
    assert [r[0] for r in df.select(two_sided_p(F.col("t"), F.col("nu"))).collect()] == [None] * 3


def test_critical_values(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 5, 27, 211, 10**7)], "nu long")
    rows = df.select("nu", critical_value(0.95, F.col("nu")).alias("t")).collect()
    known = {1: 12.706204736, 2: 4.302652730, 5: 2.570581836, 27: 2.051830516}
    for nu, t in rows:
        if nu in known:
            assert t == pytest.approx(known[nu], rel=1e-8)
        assert p_value(spark, t, nu) == pytest.approx(0.05, abs=1e-9)
