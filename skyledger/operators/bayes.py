"""Gaussian linear models with priors.

``y ~ Normal(a + b1 x1 + ..., sigma)`` with Normal priors on the coefficients
and an Exponential prior on sigma. The data enter through the sums of E12
only, so a fit is one aggregation over the rows plus work on a handful of
numbers. Posteriors are described by their mode and the curvature there; bands
follow in closed form.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.normal import mixture_quantile, truncated_moments, truncated_quantile
from .regression import plain_terms, sufficient_statistics

Normal = tuple[float, float]

_PERFECT = 1e-24    # a residual below this share of the response's variation is rounding
_TURNS = 2000
# quadrature over log sigma: its reach in standard deviations, nodes of mixtures and of sigma's own distribution
_REACH, _NODES, _DENSE = 12.0, 97, 20_001
_ROWS = 2048    # rows of a band that are in arrays at a time


@dataclass(frozen=True)
class GaussianModel:
    """Response, terms and priors; a slope prior of None is flat.

    With ``centred`` the intercept's prior is on the value at the predictors'
    means, and ``intercept_floor`` bounds that value from below.
    """

    response: str
    terms: tuple[str, ...]
    intercept: Normal
    slopes: tuple[Normal | None, ...]
    sigma_rate: float
    centred: bool = False
    intercept_floor: float | None = None

    @property
    def parameters(self) -> list[str]:
        return ["a", *(f"b{i}" for i in range(1, len(self.terms) + 1)), "sigma"]


def _quadratic(response: str, x: str, intercept: Normal, slope_sd: float, rate: float) -> GaussianModel:
    return GaussianModel(response, (x, f"{x}^2"), intercept, ((0.0, slope_sd), (0.0, slope_sd)), rate)


def _formula(response: str, x: str) -> GaussianModel:
    return GaussianModel(response, (x, f"{x}^2"), (5.0, 5.0), ((0.0, 1.0), None), 0.05, True, 0.0)


# The model structures and priors of the analysis.
MODELS = {
    "gust_t": _quadratic("gust_time", "t_2m", (5.0, 5.0), 1.0, 0.05),
    "gust_w": _quadratic("gust_time", "wind_spd", (5.0, 5.0), 1.0, 0.05),
    "gust_t_formula": _formula("gust_time", "t_2m"),
    "gust_w_formula": _formula("gust_time", "wind_spd"),
    "gust_d_formula": _formula("gust_time", "t_difference"),
    "sd_t": _quadratic("wind_sd", "t_2m", (5.0, 5.0), 1.0, 0.05),
    "sd_t_tight": GaussianModel("wind_sd", ("t_2m", "t_2m^2"), (0.5, 2.0), ((0.0, 0.1), (0.0, 0.1)), 1.0),
    "sd_t_mid": _quadratic("wind_sd", "t_2m", (1.0, 1.0), 0.3, 1.0),
    "sd_t_wide": _quadratic("wind_sd", "t_2m", (5.0, 5.0), 0.3, 1.0),
    "sd_w": _quadratic("wind_sd", "wind_spd", (5.0, 5.0), 1.0, 0.05),
    "sd_w_tight": _quadratic("wind_sd", "wind_spd", (5.0, 5.0), 0.3, 1.0),
    "sd_multi": GaussianModel("wind_sd", ("wind_spd", "t_2m"), (0.5, 0.5), ((0.0, 0.02), (0.0, 0.05)), 1.0),
    "sd_multi_ri": GaussianModel(
        "wind_sd", ("wind_spd", "t_2m", "richardson_bulk"), (0.5, 0.5), ((0.0, 0.02), (0.0, 0.05), (0.0, 0.04)), 1.0
    ),
    "sd_t_formula": _formula("wind_sd", "t_2m"),
    "sd_w_formula": _formula("wind_sd", "wind_spd"),
    "sd_d_formula": _formula("wind_sd", "t_difference"),
}


def model_statistics(df: DataFrame, model: GaussianModel, by: Sequence[str] = ()) -> DataFrame:
    """E12 for a model; feeds the fits below."""
    return sufficient_statistics(df, model.response, plain_terms(*model.terms), by)


class _Posterior:
    """Posterior given the sums, in coordinates (value at the means, slopes)."""

    def __init__(self, model: GaussianModel, n: int, means: Sequence[float], comoments: Sequence[float]):
        size = len(model.terms)
        means = np.array(means, dtype=float)
        square = np.array(comoments, dtype=float).reshape(size + 1, size + 1)
        self.model, self.n, self.size = model, float(n), size
        self.gram, self.cross, self.total = square[:size, :size], square[:size, size], square[size, size]
        self.y_mean = means[size]
        # turns (value at the means, slopes) into (intercept, slopes)
        self.to_intercept = np.eye(size + 1)
        self.to_intercept[0, 1:] = -means[:size]

        priors = [model.intercept, *model.slopes]
        precision = np.diag([0.0 if p is None else p[1] ** -2 for p in priors])
        centre = np.array([0.0 if p is None else p[0] for p in priors])
        basis = np.eye(size + 1) if model.centred else self.to_intercept
        self.prior = basis.T @ precision @ basis
        self.pull = basis.T @ precision @ centre
        self.prior_const = centre @ precision @ centre

    def coefficients(self, sigma: np.ndarray, on_floor: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Best coefficients and their precision for each sigma; ``on_floor`` holds the value at the means on its floor."""
        weight = np.atleast_1d(sigma)[:, None, None] ** -2.0
        data = np.zeros_like(self.prior)
        data[0, 0], data[1:, 1:] = self.n, self.gram
        precision = weight * data + self.prior
        target = weight[:, :, 0] * np.concatenate([[self.n * self.y_mean], self.cross]) + self.pull
        if on_floor:
            floor = self.model.intercept_floor
            slopes = np.linalg.solve(precision[:, 1:, 1:], (target[:, 1:] - precision[:, 1:, 0] * floor)[:, :, None])[:, :, 0]
            return np.column_stack([np.full(len(slopes), floor), slopes]), precision
        return np.linalg.solve(precision, target[:, :, None])[:, :, 0], precision

    def residual(self, theta: np.ndarray) -> np.ndarray:
        slopes = theta[:, 1:]
        fitted = np.einsum("ki,ij,kj->k", slopes, self.gram, slopes) - 2 * slopes @ self.cross
        return np.maximum(self.total + fitted + self.n * (self.y_mean - theta[:, 0]) ** 2, 0.0)

    def _exact(self) -> np.ndarray | None:
        """Coefficients that leave nothing of the response over, if there are any."""
        slopes = np.linalg.lstsq(self.gram, self.cross, rcond=None)[0]
        theta = np.concatenate([[self.y_mean], slopes])
        return theta if float(self.residual(theta[None])[0]) <= _PERFECT * self.total else None

    def mode(self) -> tuple[np.ndarray, float, bool]:
        """The maximum of the joint density, by turns over coefficients and sigma, and whether it lies on the floor.

        Where the terms explain every response the density has no maximum: sigma
        is 0 and the coefficients are the exact ones. A maximum below the floor
        gives way to the one on it, unless the density rises inward there.
        """
        floor = self.model.intercept_floor
        exact = self._exact()
        if exact is not None and (floor is None or exact[0] >= floor):
            return exact, 0.0, False
        theta, sigma = (exact, 0.0) if exact is not None else self._climb(False)
        if floor is None or theta[0] >= floor:
            return theta, sigma, False
        theta, sigma = self._climb(True)
        if self.inward(theta, sigma) > 0:
            raise ArithmeticError("the posterior has no single mode")
        return theta, sigma, True

    def _climb(self, on_floor: bool) -> tuple[np.ndarray, float]:
        rate, sigma = self.model.sigma_rate, float(np.sqrt(self.total / self.n))
        if on_floor and not sigma:
            sigma = abs(self.y_mean - self.model.intercept_floor)
        theta = self.coefficients(sigma, on_floor)[0]
        for _ in range(_TURNS):
            new = self._best_sigma(float(self.residual(theta)[0]), rate)
            done = abs(new - sigma) <= 1e-14 * sigma
            sigma = new
            theta = self.coefficients(sigma, on_floor)[0]
            if done:
                return theta[0], sigma
        raise ArithmeticError("the posterior mode was not reached")

    def inward(self, theta: np.ndarray, sigma: float) -> float:
        """Slope of the log density in the value at the means."""
        data = self.n * (self.y_mean - theta[0]) / sigma**2
        return float(data + self.pull[0] - self.prior[0] @ theta)

    def _best_sigma(self, residual: float, rate: float) -> float:
        sigma = np.sqrt(residual / self.n)    # the root lies at or below this; the cubic is convex there
        for _ in range(_TURNS):
            step = (rate * sigma**3 + self.n * sigma**2 - residual) / (3 * rate * sigma**2 + 2 * self.n * sigma)
            sigma -= step
            if abs(step) <= 1e-14 * sigma:
                return float(sigma)
        raise ArithmeticError("sigma was not reached")

    def peak(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Mode and inverse curvature in (value at the means, slopes, sigma), and the slope of the log density across the
        floor: 0 unless the mode lies on it."""
        theta, sigma, on_floor = self.mode()
        size = self.size + 1
        if not sigma:
            return np.append(theta, sigma), np.zeros((size + 1, size + 1)), 0.0
        precision = self.coefficients(sigma)[1][0]
        curvature = np.empty((size + 1, size + 1))
        curvature[:size, :size] = precision
        curvature[:size, size] = curvature[size, :size] = 2 * (self.prior @ theta - self.pull) / sigma
        if on_floor:    # the others' curvature is that along the floor; across it, the value at the means has its own
            curvature[0, 1:] = curvature[1:, 0] = 0.0
        curvature[size, size] = -self.n / sigma**2 + 3 * float(self.residual(theta[None])[0]) / sigma**4
        return np.append(theta, sigma), np.linalg.inv(curvature), self.inward(theta, sigma) if on_floor else 0.0

    def log_density(self, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log of sigma's own density, the coefficients integrated out, up to a constant; best coefficients and precision."""
        theta, precision = self.coefficients(sigma)
        away = np.einsum("ki,ij,kj->k", theta, self.prior, theta) - 2 * theta @ self.pull
        value = -self.n * np.log(sigma) - self.model.sigma_rate * sigma - np.linalg.slogdet(precision)[1] / 2
        return value - (self.residual(theta) / sigma**2 + away) / 2, theta, precision

    def nodes(self, count: int) -> tuple[np.ndarray, ...]:
        """Weights, sigma, (intercept, slopes) and their covariance at even steps of log sigma over all of its density that counts."""
        centre = float(np.log(self.mode()[1]))
        reach = _REACH / np.sqrt(2 * max(self.n - self.size, 1))
        sigma = np.exp(np.linspace(centre - reach, centre + reach, count))
        value, theta, precision = self.log_density(sigma)
        weight = np.exp(value + np.log(sigma) - (value + np.log(sigma)).max())
        back = self.to_intercept
        return weight / weight.sum(), sigma, theta @ back.T, back @ np.linalg.inv(precision) @ back.T

    def mode_with_covariance(self) -> tuple[np.ndarray, np.ndarray]:
        """L1. Mode and covariance in (intercept, slopes, sigma): the inverse curvature, one-sided on a floor."""
        mode, spread, fall = self.peak()
        if fall < 0:
            spread = truncated(spread, fall).covariance
        back = np.eye(self.size + 2)
        back[: self.size + 1, : self.size + 1] = self.to_intercept
        return back @ mode, back @ spread @ back.T


@dataclass(frozen=True)
class Truncated:
    """A normal distribution whose first value cannot fall below its mode: ``alpha`` is the floor in units of the first
    value's sd from the normal's own mean."""

    alpha: float
    sd: float
    mean: np.ndarray
    covariance: np.ndarray


def truncated(spread: np.ndarray, fall: float) -> Truncated:
    """The density around a mode on the floor: ``fall`` is its log slope there, ``spread`` the inverse curvature.

    Completing the square gives a normal density centred ``spread[0] * fall`` from
    the mode, cut off at the floor. ``mean`` is how far its mean lies from the mode.
    """
    shift, sd = spread[:, 0] * fall, float(np.sqrt(spread[0, 0]))
    alpha = -shift[0] / sd
    mean, variance = truncated_moments(alpha)
    along = spread[:, 0] / spread[0, 0]
    first = shift[0] + sd * mean
    rest = spread - np.outer(along, spread[:, 0])
    return Truncated(alpha, sd, shift + along * (first - shift[0]), rest + np.outer(along, along) * spread[0, 0] * variance)


def posterior_mode(statistics: DataFrame, model: GaussianModel) -> DataFrame:
    """L1/L2. One row per parameter: mode, standard deviation and its row of the covariance matrix."""
    names = model.parameters

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                mode, covariance = _Posterior(model, row.n, row.means, row.comoments).mode_with_covariance()
                yield pd.DataFrame(
                    {
                        "position": range(len(names)),
                        "parameter": names,
                        "mean": mode,
                        "sd": np.sqrt(np.diag(covariance)),
                        "covariance": list(covariance),
                    }
                )

    schema = "position int, parameter string, mean double, sd double, covariance array<double>"
    return statistics.where(F.col("n") > 0).mapInPandas(fit, schema)


def marginal_summary(statistics: DataFrame, model: GaussianModel, level: float = 0.89) -> DataFrame:
    """L5, exact. Mean, sd and central interval per parameter of its marginal distribution.

    Given sigma the coefficients are normal; sigma's own density is known up to
    a factor. One quadrature over log sigma turns the marginals of coefficients
    into mixtures of normal distributions, whose quantiles are found by Newton's
    steps; sigma's come from its distribution function on a dense grid. For
    models without a floor, and fits that leave a residual.
    """
    names, shares = model.parameters, ((1 - level) / 2, (1 + level) / 2)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                posterior = _Posterior(model, row.n, row.means, row.comoments)
                weight, _, theta, spread = posterior.nodes(_NODES)
                variance = np.einsum("kii->ki", spread)
                mean = weight @ theta
                sd = np.sqrt(weight @ (variance + (theta - mean) ** 2))
                ends = [mixture_quantile(weight, theta.T, np.sqrt(variance.T), q) for q in shares]
                dense, sigma, _, _ = posterior.nodes(_DENSE)
                passed = np.cumsum(dense) - dense / 2
                s_mean = float(dense @ sigma)
                s_ends = [float(np.exp(np.interp(q, passed, np.log(sigma)))) for q in shares]
                columns = [np.append(mean, s_mean), np.append(sd, np.sqrt(dense @ (sigma - s_mean) ** 2)), *(np.append(e, s) for e, s in zip(ends, s_ends))]
                yield pd.DataFrame({"parameter": names, **dict(zip(("mean", "sd", "lower", "upper"), columns))})

    return statistics.where(F.col("n") > 0).mapInPandas(fit, "parameter string, mean double, sd double, lower double, upper double")


def mixture_band(rows: DataFrame, statistics: DataFrame, model: GaussianModel, *, predictive: bool = False, level: float = 0.90) -> DataFrame:
    """L8/L9 with E16, exact. Mean and central interval of the model at every row, as mixtures over sigma.

    The sums of a single model, one row, are solved first; then every row is
    handled by itself, in batches. Rows lacking a term get NULL.
    """
    sums = statistics.first()
    weight, sigma, theta, spread = _Posterior(model, sums.n, sums.means, sums.comoments).nodes(_NODES)
    names = [f"_x{i}" for i in range(len(model.terms))]

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                x = np.column_stack([np.ones(part.num_rows), *(part.column(c).to_numpy(zero_copy_only=False) for c in names)])
                known = np.isfinite(x).all(axis=1)
                out = np.full((3, len(x)), np.nan)
                if known.any():
                    x = x[known]
                    means = x @ theta.T
                    variance = np.einsum("ri,kij,rj->rk", x, spread, x) + (sigma**2 if predictive else 0.0)
                    ends = [mixture_quantile(weight, means, np.sqrt(variance), q) for q in ((1 - level) / 2, (1 + level) / 2)]
                    out[:, known] = np.stack([means @ weight, *ends])
                made = [pa.array(v, mask=~known) for v in out]
                yield pa.RecordBatch.from_arrays([part.column("_row"), *made], ["_row", "mean", "lower", "upper"])

    asked = rows.select(F.struct("*").alias("_row"), *(c.alias(a) for c, a in zip(plain_terms(*model.terms).values(), names)))
    schema = T.StructType([asked.schema["_row"], *(T.StructField(c, T.DoubleType()) for c in ("mean", "lower", "upper"))])
    return asked.mapInArrow(band, schema).select("_row.*", "mean", "lower", "upper")


def bounded_mode(statistics: DataFrame, model: GaussianModel, level: float = 0.89) -> DataFrame:
    """L4. Mode, mean, sd and central interval of a centred model: ``c`` (the value at the means), slopes and sigma.

    Where the floor binds (``bound``) the mode lies on it, and around it the
    density is a normal one cut off at the floor: ``c`` gets the interval of the
    truncated normal distribution, the others that of a normal one with their
    mean and sd. Otherwise mean and mode agree.
    """
    names = ["c", *model.parameters[1:]]
    z = NormalDist().inv_cdf((1 + level) / 2)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                mode, spread, fall = _Posterior(model, row.n, row.means, row.comoments).peak()
                mean, interval = mode, None
                if fall < 0:
                    cut = truncated(spread, fall)
                    mean, spread = mode + cut.mean, cut.covariance
                    interval = [mode[0] + cut.sd * (truncated_quantile(cut.alpha, q) - cut.alpha) for q in ((1 - level) / 2, (1 + level) / 2)]
                sd = np.sqrt(np.diag(spread))
                lower, upper = mean - z * sd, mean + z * sd
                if interval:
                    lower[0], upper[0] = interval
                bound = [fall < 0] + [False] * (len(names) - 1)
                yield pd.DataFrame({"parameter": names, "mode": mode, "mean": mean, "sd": sd, "lower": lower, "upper": upper, "bound": bound})

    schema = "parameter string, mode double, mean double, sd double, lower double, upper double, bound boolean"
    return statistics.where(F.col("n") > 0).mapInPandas(fit, schema)


def mode_summary(mode: DataFrame, level: float = 0.89) -> DataFrame:
    """L5. Mean, sd and central interval per parameter of a normal approximation."""
    z = NormalDist().inv_cdf((1 + level) / 2)
    return mode.select(
        "parameter", "mean", "sd",
        (F.col("mean") - z * F.col("sd")).alias("lower"), (F.col("mean") + z * F.col("sd")).alias("upper"),
    )


def predictive_moments(rows: DataFrame, mode: DataFrame, model: GaussianModel, *, predictive: bool = True) -> DataFrame:
    """L9. ``mean`` and ``sd`` of the response at every row, by the normal approximation; of its mean if not ``predictive``.

    The mean's variance is that of the terms under the covariance of the
    coefficients; ``predictive`` adds the response's own. The parameters arrive
    as a one-row subquery, so the rows are not moved. Rows lacking a term get NULL.
    """
    entries = F.sort_array(F.collect_list(F.struct("position", "mean", "covariance")))
    fitted = rows.withColumn("_m", mode.agg(entries).scalar())
    terms = [F.lit(1.0), *plain_terms(*model.terms).values()]
    size = range(len(terms))
    mean = sum((F.col("_m")[i]["mean"] * terms[i] for i in size), F.lit(0.0))
    variance = sum((F.col("_m")[i]["covariance"][j] * terms[i] * terms[j] for i in size for j in size), F.lit(0.0))
    if predictive:
        variance = variance + F.col("_m")[len(terms)]["mean"] * F.col("_m")[len(terms)]["mean"]
    return fitted.select(*rows.columns, mean.alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("sd"))


def normal_band(
    rows: DataFrame, mode: DataFrame, model: GaussianModel, *, predictive: bool = False, level: float = 0.90
) -> DataFrame:
    """L8/L9 with E16. Mean and central interval of the model at every row, from ``predictive_moments``."""
    z = NormalDist().inv_cdf((1 + level) / 2)
    moments = predictive_moments(rows, mode, model, predictive=predictive)
    reach = z * F.col("sd")
    return moments.select(*rows.columns, "mean", (F.col("mean") - reach).alias("lower"), (F.col("mean") + reach).alias("upper"))
