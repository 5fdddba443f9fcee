"""Penalised regression spline with a standard-error band."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from .joins import spread_join
from .quality import censor
from .quantiles import grouped_quantiles

# the decimal logarithm of the penalty is searched in steps of 1/4, then around the best in steps of 1/80 and 1/1600
_COARSE = np.linspace(-8.0, 12.0, 81)
_FINER = ((0.25, 41), (0.0125, 41))
_SINGULAR = 1e12


def spline_smooth(
    df: DataFrame,
    x: str,
    y: str,
    *,
    by: Sequence[str] = (),
    knots: int = 10,
    points: int = 80,
    se_multiple: float = 2.0,
    limits: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """L7. Smooth curve of ``y`` on ``x``, per group, at even steps over the range of ``x``.

    A cubic spline by its values at the knots, which sit at even quantiles of
    the distinct ``x``; the penalty on curvature is chosen by generalised
    cross-validation. Inside one knot interval the spline depends on four
    functions of ``x`` only, so the rows are reduced to the sums of products
    of those four and ``y`` per interval: all the solver ever sees. Two
    distinct ``x`` give the straight line, a single one the mean at that point.
    """
    keys = list(by)
    rows = censor(
        df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")),
        {f"_{c}": band for c, band in _renamed(limits, x, y).items()},
    ).where(F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y"))

    shares = [i / (knots - 1) for i in range(knots)]
    places = grouped_quantiles(rows.select(*keys, "_x").distinct(), keys, "_x", shares).select(
        *keys, F.array_distinct("quantiles").alias("_knots")
    )
    if keys:
        placed = spread_join(rows, places, keys)
    else:
        placed = rows.withColumns({"_w": F.lit(1), "_knots": places.select("_knots").scalar()})
    inner = sum(
        (F.when((F.col("_x") > F.get("_knots", F.lit(i))) & (F.size("_knots") > i + 1), 1).otherwise(0)
         for i in range(1, knots - 1)),
        F.lit(0),
    )
    # a lone knot gets an interval of length one, of which only the left end is used
    located = placed.withColumn("_interval", inner).withColumn("_k0", F.get("_knots", F.col("_interval"))).withColumn(
        "_k1", F.coalesce(F.get("_knots", F.col("_interval") + 1), F.col("_k0") + 1)
    )
    h, left, right = F.col("_k1") - F.col("_k0"), F.col("_x") - F.col("_k0"), F.col("_k1") - F.col("_x")
    basis = {
        "_p0": right / h,
        "_p1": left / h,
        "_p2": (right * right * right / h - h * right) / 6,
        "_p3": (left * left * left / h - h * left) / 6,
    }
    products = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = (
        located.withColumns(basis)
        .groupBy(*keys, "_knots", "_interval")
        .agg(
            F.sum("_w").alias("n"),
            F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("yy"),
            F.array(*(F.sum(F.col("_w") * F.col(f"_p{i}") * F.col(f"_p{j}")) for i, j in products)).alias("pp"),
            F.array(*(F.sum(F.col("_w") * F.col(f"_p{i}") * F.col("_y")) for i in range(4))).alias("py"),
        )
        .groupBy(*keys, "_knots")
        .agg(F.collect_list(F.struct("_interval", "n", "yy", "pp", "py")).alias("parts"))
        .withColumnsRenamed({"_knots": "knots"})
    )
    schema = T.StructType(
        [sums.schema[c] for c in keys]
        + [T.StructField("point", T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in ("x", "fit", "se", "lower", "upper", "edf")]
    )

    def curves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                out = _fit(np.array(row.knots, dtype=float), row.parts, points, se_multiple)
                for c in keys:
                    out[c] = getattr(row, c)
                yield out[[f.name for f in schema]]

    return sums.mapInPandas(curves, schema)


def _renamed(limits: dict[str, tuple[float, float]] | None, x: str, y: str) -> dict[str, tuple[float, float]]:
    names = {x: "x", y: "y"}
    return {names[c]: band for c, band in (limits or {}).items()}


def _bending(knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The natural spline with values v has curvature c at its inner knots where band @ c = differences @ v."""
    h = np.diff(knots)
    inner = len(knots) - 2
    differences = np.zeros((inner, len(knots)))
    band = np.zeros((inner, inner))
    for i in range(inner):
        differences[i, i : i + 3] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
        band[i, i] = (h[i] + h[i + 1]) / 3
        if i + 1 < inner:
            band[i, i + 1] = band[i + 1, i] = h[i + 1] / 6
    return band, differences


def _second_derivatives(knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices giving the spline's curvature at the knots, and its total squared curvature."""
    if len(knots) <= 2:
        return np.zeros((len(knots), len(knots))), np.zeros((len(knots), len(knots)))
    band, differences = _bending(knots)
    solved = np.linalg.solve(band, differences)
    curvature = np.vstack([np.zeros(len(knots)), solved, np.zeros(len(knots))])
    return curvature, differences.T @ solved


def _fit(knots: np.ndarray, parts, points: int, se_multiple: float) -> pd.DataFrame:
    size = len(knots)
    curvature, penalty = _second_derivatives(knots)
    identity = np.eye(size)
    gram, cross, total, n = np.zeros((size, size)), np.zeros(size), 0.0, 0
    upper = np.triu_indices(4)
    for part in parts:
        i = part["_interval"]
        ends = [i, min(i + 1, size - 1)]
        local = np.vstack([identity[ends], curvature[ends]])
        products = np.zeros((4, 4))
        products[upper] = part["pp"]
        products = products + products.T - np.diag(np.diag(products))
        gram += local.T @ products @ local
        cross += local.T @ np.array(part["py"], dtype=float)
        total += part["yy"]
        n += part["n"]
    weight = np.trace(gram) / np.trace(penalty) if size > 2 else 0.0
    scaled = gram / np.sqrt(np.outer(np.diag(gram), np.diag(gram))) if np.diag(gram).min() > 0 else np.zeros_like(gram)
    if size > 2 and np.linalg.cond(scaled) < _SINGULAR:
        # In terms of the curvature, every penalty is as well conditioned as the data: with a free fit b and
        # d = penalty * curvature, (band / penalty + middle) d = differences @ b.
        band, differences = _bending(knots)
        free = np.linalg.inv(gram)
        across = differences @ free
        middle = across @ differences.T
        start, wanted = free @ cross, across @ cross

        def fitted(log_penalty: float):
            bent = np.linalg.inv(band / (10.0**log_penalty * weight) + middle)
            beta = start - across.T @ (bent @ wanted)
            return beta, free - across.T @ bent @ across, size - float(np.trace(bent @ middle))
    else:    # knots between few distinct values: only with the penalty is there one solution

        def fitted(log_penalty: float):
            inverse = np.linalg.inv(gram + 10.0**log_penalty * weight * penalty)
            return inverse @ cross, inverse, float(np.trace(inverse @ gram))

    def solve(log_penalty: float):
        beta, inverse, edf = fitted(log_penalty)
        residual = max(float(total - 2 * beta @ cross + beta @ gram @ beta), 0.0)
        score = n * residual / (n - edf) ** 2 if n > edf else np.inf
        return score, beta, inverse, edf, residual

    def least(penalties: np.ndarray) -> float:
        return float(penalties[int(np.argmin([solve(p)[0] for p in penalties]))])

    chosen = least(_COARSE)
    for reach, count in _FINER:
        chosen = least(np.linspace(chosen - reach, chosen + reach, count))
    _, beta, inverse, edf, residual = solve(chosen)
    scale = residual / (n - edf) if n > edf else np.nan

    x = np.linspace(knots[0], knots[-1], points)
    i = np.clip(np.searchsorted(knots, x, side="left") - 1, 0, max(size - 2, 0))
    j = np.minimum(i + 1, size - 1)
    h = np.where(j > i, knots[j] - knots[i], 1.0)
    left, right = x - knots[i], knots[i] + h - x
    design = (
        (right / h)[:, None] * identity[i]
        + (left / h)[:, None] * identity[j]
        + ((right**3 / h - h * right) / 6)[:, None] * curvature[i]
        + ((left**3 / h - h * left) / 6)[:, None] * curvature[j]
    )
    fit = design @ beta
    se = np.sqrt(np.maximum(scale * np.einsum("ij,jk,ik->i", design, inverse, design), 0.0))
    return pd.DataFrame(
        {"point": range(points), "x": x, "fit": fit, "se": se, "lower": fit - se_multiple * se,
         "upper": fit + se_multiple * se, "edf": edf}
    )
