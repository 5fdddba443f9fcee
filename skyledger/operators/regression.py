"""Linear regression from one aggregation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.student import critical_value, two_sided_p

_ALIASED = 1e-10    # a term with less variance of its own than this share is aliased


def _line_summary(line: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coefficients with errors and fit quality from ``n, _sxx, _syy, _sxy, _mx, _my``.

    Whatever a degenerate group leaves undefined is NULL.
    """
    n, sxx, syy, sxy = (F.col(c) for c in ("n", "_sxx", "_syy", "_sxy"))
    slope = F.try_divide(sxy, sxx)
    rss = F.greatest(syy - F.col("slope") * sxy, F.lit(0.0))
    sigma = F.when(F.col("df") > 0, F.sqrt(F.try_divide(rss, F.col("df").cast("double"))))
    r2 = F.try_divide(F.col("slope") * sxy, syy)
    adjusted = 1 - (1 - F.col("r2")) * F.try_divide((n - 1).cast("double"), F.col("df").cast("double"))
    return (
        line.withColumn("slope", slope)
        .withColumns({"intercept": F.col("_my") - F.col("slope") * F.col("_mx"), "df": n - 2})
        .withColumns({"sigma": sigma, "r2": r2})
        .withColumns(
            {
                "adj_r2": F.when(F.col("df") > 0, adjusted),
                "std_error": F.try_divide(F.col("sigma"), F.sqrt(sxx)),
                "intercept_error": F.col("sigma") * F.sqrt(1 / n + F.try_divide(F.col("_mx") * F.col("_mx"), sxx)),
            }
        )
        .withColumns(
            {
                "t_value": F.try_divide(F.col("slope"), F.col("std_error")),
                "lo": F.col("slope") - F.col("std_error"),
                "hi": F.col("slope") + F.col("std_error"),
            }
        )
        .select(
            *keys, "n", "df", "slope", "intercept", "std_error", "intercept_error", "t_value", "r2", "adj_r2",
            "sigma", "lo", "hi", F.col("_mx").alias("x_mean"), sxx.alias("sxx"),
        )
    )


def simple_regression(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """E9. ``y ~ x`` per group over the complete pairs; ``lo``/``hi`` are slope -/+ its error."""
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    line = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.regr_sxx(yc, xc).alias("_sxx"),
            F.regr_syy(yc, xc).alias("_syy"),
            F.regr_sxy(yc, xc).alias("_sxy"),
            F.avg(xc).alias("_mx"),
            F.avg(yc).alias("_my"),
        )
    )
    return _line_summary(line, list(by))


def cell_regression(cells: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    """E9 on pre-aggregated rows: ``_w`` rows with mean ``_mean`` and squared deviations ``_ssd`` share one ``x``.

    Gives the regression of the underlying rows, so several regressions on the
    same ``x`` need a single pass over them.
    """
    group = Window.partitionBy(*by)
    x_, w, mean = F.col(x).cast("double"), F.col("_w"), F.col("_mean")
    used = cells.where(F.col("_w") > 0)
    placed = used.withColumns(
        {
            "_n": F.sum(w).over(group),
            "_mx": F.sum(w * x_).over(group) / F.sum(w).over(group),
            "_my": F.sum(w * mean).over(group) / F.sum(w).over(group),
        }
    )
    dx, dy = x_ - F.col("_mx"), mean - F.col("_my")
    line = placed.groupBy(*by, F.col("_n").alias("n"), "_mx", "_my").agg(
        F.sum(w * dx * dx).alias("_sxx"),
        F.sum(F.col("_ssd") + w * dy * dy).alias("_syy"),
        F.sum(w * dx * dy).alias("_sxy"),
    )
    return _line_summary(line, list(by))


def with_p_values(fits: DataFrame) -> DataFrame:
    """E9. Add the two-sided p-value of ``t_value`` at ``df`` degrees of freedom."""
    return fits.withColumn("p_value", two_sided_p(F.col("t_value"), F.col("df")))


def confidence_band(
    fits: DataFrame, lo: Column, hi: Column, points: int = 80, level: float = 0.95
) -> DataFrame:
    """E9b. The line at even steps from ``lo`` to ``hi``, with its confidence band, per fit."""
    step = (hi - lo) / (points - 1)
    keyed = fits.withColumn("_critical", critical_value(level, F.col("df")))
    grid = keyed.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", lo + F.col("_i") * step
    )
    offset = F.col("x") - F.col("x_mean")
    error = F.col("sigma") * F.sqrt(1 / F.col("n") + F.try_divide(offset * offset, F.col("sxx")))
    return grid.withColumns(
        {"fit": F.col("intercept") + F.col("slope") * F.col("x"), "se_fit": error}
    ).withColumns(
        {
            "lower": F.col("fit") - F.col("_critical") * F.col("se_fit"),
            "upper": F.col("fit") + F.col("_critical") * F.col("se_fit"),
        }
    ).drop("_critical", "_i")


def plain_terms(*names: str) -> dict[str, Column]:
    """Terms named after columns; ``x^2`` stands for the square of column ``x``."""
    terms = {}
    for name in names:
        base = F.col(name.removesuffix("^2")).cast("double")
        terms[name] = base * base if name.endswith("^2") else base
    return terms


def factorial_terms(*names: str) -> dict[str, Column]:
    """E11. Main effects and interactions of every order, e.g. ``a:b`` for a times b."""
    subsets = [s for size in range(1, len(names) + 1) for s in combinations(names, size)]
    return {":".join(s): prod((F.col(c).cast("double") for c in s[1:]), start=F.col(s[0]).cast("double")) for s in subsets}


def sufficient_statistics(
    df: DataFrame, response: str, terms: Mapping[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """E12. Per group ``n``, ``means`` and ``comoments`` of the terms followed by the response.

    The co-moments are sums of products around the means, which Spark's covariance
    keeps in a numerically stable way in one pass, whatever the number of terms
    and groups. Rows lacking any value, or holding a NaN or infinity,
    are left out. All Gaussian models here need nothing else from the data.
    """
    columns = [*(f"_t{i}" for i in range(len(terms))), "_y"]
    values = df.select(
        *by, *(c.alias(a) for c, a in zip(terms.values(), columns)), F.col(response).cast("double").alias("_y")
    )
    usable = F.lit(True)
    for c in columns:
        usable = usable & F.col(c).isNotNull() & (F.abs(c) < F.lit(float("inf")))
    values = values.where(usable)
    size = range(len(columns))
    pairs = [(i, j) for i in size for j in range(i, len(columns))]
    sums = values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*(F.avg(c) for c in columns)).alias("means"),
        *((F.count(F.lit(1)) * F.covar_pop(columns[i], columns[j])).alias(f"_c{i}_{j}") for i, j in pairs),
    )
    return sums.select(
        *by,
        "n",
        "means",
        F.array(*(F.col(f"_c{min(i, j)}_{max(i, j)}") for i in size for j in size)).alias("comoments"),
    )


def statistics_long(statistics: DataFrame, response: str, terms: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """E12 as one row per pair of variables."""
    names = [*terms, response]
    size = len(names)
    entries = [
        F.struct(
            F.lit(a).alias("row"), F.lit(b).alias("col"),
            F.col("means")[i].alias("row_mean"), F.col("means")[j].alias("col_mean"),
            F.col("comoments")[i * size + j].alias("comoment"),
        )
        for i, a in enumerate(names)
        for j, b in enumerate(names)
        if i <= j
    ]
    return statistics.select(*by, "n", F.inline(F.array(*entries)))


def _solve(n: int, means: np.ndarray, comoments: np.ndarray) -> dict[str, np.ndarray | float]:
    """Least squares on centred sums; aliased terms get NaN."""
    size = len(means) - 1
    square = comoments.reshape(size + 1, size + 1)
    scale = np.sqrt(np.diag(square)[:size])
    scale[scale == 0] = 1.0
    gram = square[:size, :size] / np.outer(scale, scale)
    cross = square[:size, size] / scale

    kept: list[int] = []
    for i in range(size):    # a term stays if the ones before it do not already explain it
        own = gram[i, i]
        if kept:
            seen = gram[np.ix_(kept, kept)]
            own -= gram[i, kept] @ np.linalg.solve(seen, gram[kept, i])
        if own > _ALIASED:
            kept.append(i)

    slopes = np.full(size, np.nan)
    errors = np.full(size + 1, np.nan)
    inverse = np.linalg.inv(gram[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
    solved = inverse @ cross[kept]
    slopes[kept] = solved / scale[kept]
    centre = means[kept]
    intercept = means[size] - slopes[kept] @ centre
    total = square[size, size]
    explained = float(solved @ cross[kept])
    residual = max(total - explained, 0.0)
    df = n - len(kept) - 1
    sigma = np.sqrt(residual / df) if df > 0 else np.nan
    at_centre = centre / scale[kept]
    errors[0] = sigma * np.sqrt(1 / n + at_centre @ inverse @ at_centre)
    errors[1 + np.array(kept, dtype=int)] = sigma * np.sqrt(np.diag(inverse)) / scale[kept]
    r2 = explained / total if total > 0 else np.nan
    return {
        "estimate": np.concatenate([[intercept], slopes]),
        "std_error": errors,
        "df": df,
        "sigma": sigma,
        "r2": r2,
        "adj_r2": 1 - (1 - r2) * (n - 1) / df if df > 0 else np.nan,
    }


def linear_model(statistics: DataFrame, terms: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """E10/E11. One row per group and term: estimate, error, t and p, with the model's fit quality.

    The solver sees one row of sums per group and nothing of the data.
    """
    names = ["intercept", *terms]
    numbers = ["estimate", "std_error", "sigma", "r2", "adj_r2"]
    schema = T.StructType(
        [statistics.schema[c] for c in by]
        + [T.StructField("position", T.IntegerType()), T.StructField("term", T.StringType())]
        + [T.StructField("n", T.LongType()), T.StructField("df", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in numbers]
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.n == 0:
                    continue
                fit = _solve(row.n, np.array(row.means, dtype=float), np.array(row.comoments, dtype=float))
                out = pd.DataFrame({"position": range(len(names)), "term": names, "n": row.n, **fit})
                for c in by:
                    out[c] = getattr(row, c)
                yield out[[f.name for f in schema]]

    fits = statistics.where(F.col("n") > 0).mapInPandas(solve, schema)
    known = fits.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers})
    return with_p_values(known.withColumn("t_value", F.try_divide("estimate", "std_error")))


def predict(df: DataFrame, fit: DataFrame, terms: Mapping[str, Column], name: str = "predicted") -> DataFrame:
    """E10. Add the fitted value of a single model; aliased terms do not contribute.

    The coefficients arrive as a one-row subquery, so the rows are not moved.
    """
    coefficients = fit.agg(F.sort_array(F.collect_list(F.struct("position", F.coalesce("estimate", F.lit(0.0)).alias("b")))))
    with_b = df.withColumn("_b", coefficients.scalar())
    total = F.col("_b")[0]["b"]
    for i, term in enumerate(terms.values(), start=1):
        total = total + F.col("_b")[i]["b"] * term
    return with_b.withColumn(name, total).drop("_b")
