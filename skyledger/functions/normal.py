"""The normal distribution: upper tails as far out as doubles reach, and its distribution function over arrays."""

from __future__ import annotations

import math

import numpy as np

_TERMS = 200
_CLOSE = 2.0    # from here on the continued fraction is quick


def tail_over_density(x: float) -> float:
    """(1 - Phi(x)) / phi(x): Mills' ratio."""
    if x < _CLOSE:
        return 0.5 * math.erfc(x / math.sqrt(2)) * math.sqrt(2 * math.pi) * math.exp(x * x / 2)
    value = x
    for k in range(_TERMS, 0, -1):
        value = x + k / value
    return 1 / value


def log_tail(x: float) -> float:
    """log(1 - Phi(x))."""
    return math.log(tail_over_density(x)) - x * x / 2 - math.log(2 * math.pi) / 2


def truncated_moments(alpha: float) -> tuple[float, float]:
    """Mean and variance of a standard normal value that is at least ``alpha``."""
    pull = 1 / tail_over_density(alpha)
    return pull, max(1 + alpha * pull - pull * pull, 0.0)


def truncated_quantile(alpha: float, share: float) -> float:
    """The value that a standard normal one of at least ``alpha`` stays below with chance ``share``."""
    target = math.log1p(-share) + log_tail(alpha)
    x = max(alpha, 0.0)    # the log tail is concave: from the right of the root Newton's steps come down to it
    while log_tail(x) > target:
        x += 1.0
    for _ in range(200):
        step = (log_tail(x) - target) * tail_over_density(x)
        x += step
        if abs(step) <= 1e-15 * max(1.0, abs(x)):
            break
    return max(x, alpha)


def distribution(x: np.ndarray) -> np.ndarray:
    """Phi(x), by the series of odd powers over odd factorials near 0 and Mills' ratio beyond."""
    x = np.asarray(x, dtype=float)
    near = np.clip(x, -5.0, 5.0)
    density = np.exp(-near * near / 2) / math.sqrt(2 * math.pi)
    total = np.ones_like(near)
    for k in range(80, 0, -1):
        total = 1 + near * near / (2 * k + 1) * total
    inside = 0.5 + density * near * total
    far = np.maximum(np.abs(x), 5.0)
    ratio = far.copy()
    for k in range(60, 0, -1):
        ratio = far + k / ratio
    tail = np.exp(-far * far / 2) / math.sqrt(2 * math.pi) / ratio
    return np.where(np.abs(x) <= 5.0, inside, np.where(x > 0, 1 - tail, tail))


def mixture_quantile(weights: np.ndarray, means: np.ndarray, sds: np.ndarray, share: float) -> np.ndarray:
    """Where a mixture of normal distributions reaches ``share``: one value a row of ``means`` and ``sds`` (columns:
    components). Newton's steps, held between bounds that close in."""
    low, high = (means - 40 * sds).min(axis=1), (means + 40 * sds).max(axis=1)
    x = means @ weights
    for _ in range(200):
        z = (x[:, None] - means) / sds
        over = distribution(z) @ weights - share
        low, high = np.where(over < 0, x, low), np.where(over < 0, high, x)
        slope = (np.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * sds)) @ weights
        with np.errstate(divide="ignore", invalid="ignore"):
            new = x - over / slope
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        done = np.abs(new - x) <= 1e-13 * (np.abs(x) + sds.min(axis=1))
        x = new
        if done.all():
            break
    return x
