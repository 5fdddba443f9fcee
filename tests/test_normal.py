import math
from statistics import NormalDist

import numpy as np
import pytest

from skyledger.functions.normal import distribution, log_tail, mixture_quantile, tail_over_density, truncated_moments, truncated_quantile


@pytest.mark.parametrize("x", [-6.0, -1.0, 0.0, 1.9, 2.0, 2.1, 5.0, 8.0])
def test_tails(x):
    tail = 0.5 * math.erfc(x / math.sqrt(2))
    assert math.exp(log_tail(x)) == pytest.approx(tail, rel=1e-12)
    assert tail_over_density(x) * NormalDist().pdf(x) == pytest.approx(tail, rel=1e-12)


def test_tails_far_out():
    # 1/x - 1/x^3 + 3/x^5 - ...
    assert tail_over_density(100.0) == pytest.approx(1e-2 - 1e-6 + 3e-10 - 15e-14, rel=1e-12)
    assert log_tail(1000.0) == pytest.approx(-500000 - math.log(1000 * math.sqrt(2 * math.pi)), rel=1e-9)


@pytest.mark.parametrize("alpha", [-8.0, -1.0, 0.0, 0.5, 3.0, 30.0, 300.0])
def test_truncated(alpha):
    n, reach = 200_000, 40 / max(4.0, alpha)
    lo = max(alpha, -9.0)
    step = (reach if alpha > 4 else 10 - lo) / n
    xs = [lo + (i + 0.5) * step for i in range(n)]
    w = [math.exp(-(x * x - lo * lo) / 2) for x in xs]
    total = sum(w)
    mean = sum(x * y for x, y in zip(xs, w)) / total
    var = sum((x - mean) ** 2 * y for x, y in zip(xs, w)) / total
    found = truncated_moments(alpha)
    assert found[0] == pytest.approx(mean, rel=1e-6) and found[1] == pytest.approx(var, rel=1e-3)
    for share in (0.055, 0.5, 0.945):
        x = truncated_quantile(alpha, share)
        below = sum(y for z, y in zip(xs, w) if z <= x) / total
        assert below == pytest.approx(share, abs=2e-4)


def test_distribution_over_arrays():
    x = np.array([-30.0, -8.0, -5.0, -4.999, -1.0, 0.0, 1e-9, 2.5, 5.0, 7.0])
    want = [0.5 * math.erfc(-v / math.sqrt(2)) for v in x]
    assert distribution(x) == pytest.approx(want, rel=1e-12)


def test_mixture_quantiles():
    weights, means, sds = np.array([0.2, 0.5, 0.3]), np.array([[0.0, 1.0, 9.0], [5.0, 5.0, 5.0]]), np.array([[1.0, 0.1, 2.0], [1.0, 1.0, 1.0]])
    for share in (0.01, 0.3, 0.71, 0.99):
        x = mixture_quantile(weights, means, sds, share)
        assert (distribution((x[:, None] - means) / sds) @ weights).tolist() == pytest.approx([share, share], abs=1e-12)
        assert x[1] == pytest.approx(5 + NormalDist().inv_cdf(share))
