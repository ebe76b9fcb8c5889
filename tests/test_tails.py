"""Tails over arrays against math, value by value."""

import math

import numpy as np
import pytest

from helixframe.functions import statistics


def test_erfc_and_lgamma():
    z = np.r_[np.linspace(-6, 6, 401), 1.9999999, 2.0, 2.0000001, 26.0, -30.0, 0.0]
    want = np.array([math.erfc(v) for v in z])
    assert np.allclose(statistics.erfc(z), want, rtol=1e-12, atol=0)
    x = np.r_[np.linspace(0.01, 40, 500), 1.0, 2.0, 1e-8, 1e3, 1e7]
    assert np.allclose(statistics.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    assert np.isnan(statistics.erfc(np.array([np.nan]))).all() and len(statistics.erfc(np.array([]))) == 0


@pytest.mark.parametrize("a, b", [(1, 1), (2, 5), (30, 3), (200, 300), (7, 7)])
def test_beta_cdf_of_whole_numbers(a, b):
    """For whole numbers it is a binomial tail."""
    for x in (0.0, 0.01, 0.3, 0.5, 0.77, 0.999, 1.0):
        want = math.fsum(math.comb(a + b - 1, k) * x**k * (1 - x) ** (a + b - 1 - k) for k in range(a, a + b))
        assert statistics.beta_cdf_array(a, b, x) == pytest.approx(want, rel=1e-11, abs=1e-250)
    assert len(statistics.beta_cdf_array(np.array([]), np.array([]), np.array([]))) == 0
