"""Zero-inflated binomial regression of gust minutes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import inverse_logit
from ..schema import MINUTES_PER_HOUR
from ..session import checkpointed

# Priors of the model.
INTERCEPT = (5.0, 5.0)
SLOPES = ((0.0, 1.0), (0.0, 1.0))
ZERO_SHARE = (3.0, 3.0)    # Beta prior of the share of structural zeros

_SUMS = 21


def zero_inflated_fit(
    df: DataFrame,
    x: str = "t_2m",
    count: str = "gust_time",
    trials: int = MINUTES_PER_HOUR,
    max_iterations: int = 50,
    tolerance: float = 1e-9,
) -> DataFrame:
    """Most probable parameters of: zero with probability ``p_zero``, else Binomial(trials, p).

    ``logit p = a + b1 x + b2 x^2``. Rows are first counted by (x, count), a
    table bounded by the sensor's resolution times ``trials + 1``, which is
    stored once in the shared folder. Each Newton step is one aggregation of
    that table to a few sums: log density, gradient and curvature. Returns
    one row; ``converged`` says whether the parameters settled. The ``_sd``
    columns come from the observed information at the mode, the share's by its
    slope against the log odds; they are NULL where the density is not curved
    all ways.
    """
    usable = F.col(x).isNotNull() & F.col(count).between(0, trials) & (F.abs(x) < F.lit(float("inf")))
    cells = checkpointed(
        df.where(usable)
        .groupBy(F.col(x).cast("double").alias("x"), F.col(count).cast("double").alias("k"))
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )
    spark = df.sparkSession
    seen = cells.agg(
        F.sum("w"), F.sum(F.col("w") * F.col("k")), F.avg("x"), F.stddev_pop("x")
    ).first()
    n = seen[0]
    spreads = ["p_zero_sd", "a_sd", "b1_sd", "b2_sd"]
    schema = "n long, p_zero double, a double, b1 double, b2 double, iterations int, converged boolean, " + ", ".join(f"{c} double" for c in spreads)
    if not n:
        return spark.createDataFrame([], schema)

    # work in u = (x - shift) / scale; `back` turns coefficients in u into those in x
    shift, scale = seen[2], seen[3] or 1.0
    back = np.array(
        [[1, -shift / scale, shift**2 / scale**2], [0, 1 / scale, -2 * shift / scale**2], [0, 0, scale**-2.0]]
    )
    prior_mean = np.array([INTERCEPT[0], *(m for m, _ in SLOPES)])
    precision = np.diag([INTERCEPT[1] ** -2.0, *(s**-2.0 for _, s in SLOPES)])

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log density, gradient, curvature, and the curvature the complete data would have."""
        share = 1 / (1 + np.exp(-theta[0]))
        sums = np.array(_sums(cells, theta, shift, scale, trials).first(), dtype=float)
        value, gradient = sums[0], sums[1:5].copy()
        observed, complete = np.zeros((4, 4)), np.zeros((4, 4))
        rows, columns = np.triu_indices(4)
        observed[rows, columns] = observed[columns, rows] = sums[5:15]
        rows, columns = np.triu_indices(3)
        complete[rows + 1, columns + 1] = complete[columns + 1, rows + 1] = sums[15:21]
        observed[0, 0] += n * share * (1 - share)
        complete[0, 0] = n * share * (1 - share)
        alpha, beta = ZERO_SHARE
        away = back @ theta[1:] - prior_mean
        value += (alpha - 1) * np.log(share) + (beta - 1) * np.log1p(-share) - away @ precision @ away / 2
        gradient[0] += (alpha - 1) * (1 - share) - (beta - 1) * share
        gradient[1:] -= back.T @ precision @ away
        for curvature in (observed, complete):
            curvature[0, 0] += (alpha + beta - 2) * share * (1 - share)
            curvature[1:, 1:] += back.T @ precision @ back
        return value, gradient, observed, complete

    start = min(max(seen[1] / (n * trials), 1e-6), 1 - 1e-6)
    theta = np.array([np.log(0.1 / 0.9), np.log(start / (1 - start)), 0.0, 0.0])
    value, gradient, observed, complete = evaluate(theta)
    converged, steps = False, 0
    while not converged and steps < max_iterations:
        steps += 1
        curvature = observed if np.linalg.eigvalsh(observed)[0] > 0 else complete
        move = np.linalg.solve(curvature, gradient)
        while True:    # a step that does not climb is halved
            after = evaluate(theta + move)
            converged = bool(np.abs(move).max() < tolerance)
            if after[0] >= value or converged:
                break
            move = move / 2
        theta = theta + move
        value, gradient, observed, complete = after
    a, b1, b2 = (float(v) for v in back @ theta[1:])
    p_zero = float(1 / (1 + np.exp(-theta[0])))
    sds: list[float | None] = [None] * 4
    if np.linalg.eigvalsh(observed)[0] > 0:
        out = np.zeros((4, 4))
        out[0, 0], out[1:, 1:] = p_zero * (1 - p_zero), back
        sds = [float(v) for v in np.sqrt(np.diag(out @ np.linalg.inv(observed) @ out.T))]
    return spark.createDataFrame([(int(n), p_zero, a, b1, b2, steps, converged, *sds)], schema)


def _sums(cells: DataFrame, theta: np.ndarray, shift: float, scale: float, trials: int) -> DataFrame:
    """Log likelihood, its gradient and its curvature in (logit p_zero, coefficients), from the counts.

    Every task reduces its cells to one row of sums; these are added up.
    """
    odds = float(theta[0])
    share = 1 / (1 + np.exp(-odds))
    names = [f"s{i}" for i in range(_SUMS)]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            w, k = batch["w"].to_numpy(), batch["k"].to_numpy()
            u = (batch["x"].to_numpy() - shift) / scale
            terms = [np.ones_like(u), u, u * u]
            eta = theta[1:] @ np.stack(terms)
            softplus = np.logaddexp(0.0, eta)    # -log(1 - p)
            p = np.exp(eta - softplus)
            mean, spread = trials * p, trials * p * (1 - p)
            sampled = np.log1p(-share) + k * eta - trials * softplus
            both = np.logaddexp(np.log(share), sampled)
            zero = k == 0
            # chance that a zero is structural rather than sampled
            structural = np.where(zero, np.exp(np.log(share) - both), 0.0)
            unsure = structural * (1 - structural)
            pull = np.where(zero, -(1 - structural) * mean, k - mean)
            bend = (1 - structural) * spread
            products = [terms[i] * terms[j] for i in range(3) for j in range(i, 3)]
            parts = [
                np.where(zero, both, sampled),
                structural - share,
                *(pull * t for t in terms),
                -unsure,
                *(-unsure * mean * t for t in terms),
                *((bend - unsure * mean**2) * t for t in products),
                *(bend * t for t in products),
            ]
            yield pd.DataFrame([[float(w @ part) for part in parts]], columns=names)

    return cells.mapInPandas(partial, ", ".join(f"{c} double" for c in names)).agg(*(F.sum(c) for c in names))


def zero_inflated_mean(rows: DataFrame, fit: DataFrame, x: str = "t_2m", trials: int = MINUTES_PER_HOUR) -> DataFrame:
    """Add the fitted chance ``p`` of a gust minute (B26) and the ``expected`` count at each row's ``x``; fails if the
    fit did not converge."""
    fitted = rows.withColumn("_fit", fit.select(F.struct("p_zero", "a", "b1", "b2", "converged")).scalar())
    at, f = F.col(x), F.col("_fit")
    chance = inverse_logit(f["a"] + f["b1"] * at + f["b2"] * at * at)
    unsettled = F.raise_error(F.lit("the zero-inflated fit did not converge")).cast("double")
    return (
        fitted.withColumn("p", F.when(~f["converged"], unsettled).otherwise(chance))
        .withColumn("expected", (1 - F.col("_fit.p_zero")) * trials * F.col("p"))
        .drop("_fit")
    )
