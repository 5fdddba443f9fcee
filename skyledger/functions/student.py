"""Student-t probabilities as column expressions, for whole degrees of freedom.

With theta = atan(|t| / sqrt(nu)) the two-sided p-value is the share of the
integral of cos(x)^(nu - 1) over [0, pi/2] that lies beyond theta. Both parts
are integrated by Simpson's rule, so no gamma function is needed and large
``nu`` costs no more than small ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_INTERVALS = 512
_SPREAD = 12.0    # beyond this many standard deviations the integrand is negligible
_NEWTON_STEPS = 14


def _height(x: Column, nu: Column) -> Column:
    """cos(x)^(nu - 1); near 0, where the cosine is 1 to most digits, by way of the sine."""
    near = F.exp((nu - 1) / 2 * F.log1p(-F.sin(x) * F.sin(x)))
    return F.when(x < 0.5, near).otherwise(F.pow(F.greatest(F.cos(x), F.lit(0.0)), nu - 1))


def _tail(theta: Column, nu: Column) -> Column:
    width = F.least(math.pi / 2 - theta, _SPREAD / F.sqrt(nu))
    step = width / _INTERVALS

    def term(total: Column, i: Column) -> Column:
        weight = F.when((i == 0) | (i == _INTERVALS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return total + weight * _height(theta + i * step, nu)

    nodes = F.sequence(F.lit(0), F.lit(_INTERVALS))
    return F.aggregate(nodes, F.lit(0.0), term) * step / 3


def two_sided_p(t: Column, nu: Column) -> Column:
    """P(|T| > |t|); NULL where ``t`` is NULL or ``nu`` is below 1."""
    nu = nu.cast("double")
    theta = F.atan(F.abs(t) / F.sqrt(nu))
    return F.when((nu >= 1) & t.isNotNull(), _tail(theta, nu) / _tail(F.lit(0.0), nu))


def critical_value(level: float, nu: Column) -> Column:
    """The t for which P(|T| <= t) equals ``level``.

    Newton's method on theta, from 0: the tail integral is convex and falling
    there, so the steps approach the root from one side.
    """
    nu = nu.cast("double")
    whole = _tail(F.lit(0.0), nu)

    def newton(theta: Column, _: Column) -> Column:
        excess = _tail(theta, nu) - (1 - level) * whole
        return theta + excess / _height(theta, nu)

    theta = F.aggregate(F.sequence(F.lit(1), F.lit(_NEWTON_STEPS)), F.lit(0.0), newton)
    return F.when(nu >= 1, F.sqrt(nu) * F.tan(theta))
