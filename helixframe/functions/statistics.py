"""Statistical functions that Spark lacks, over whole Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def erfc(z: np.ndarray) -> np.ndarray:
    """Complementary error function: its power series below 2, above it its continued fraction from the far end; negative z by symmetry."""
    z = np.asarray(z, float)
    x = np.abs(z)
    near = np.minimum(x, 2.0)
    term = total = near
    for n in range(1, 60):
        term = term * 2 * near * near / (2 * n + 1)
        total = total + term
    series = 1 - 2 / math.sqrt(math.pi) * np.exp(-near * near) * total
    far, tail = np.maximum(x, 2.0), np.zeros_like(x)
    for k in range(120, 0, -1):
        tail = (k / 2) / (far + tail)
    with np.errstate(under="ignore"):
        fraction = np.exp(-far * far) / math.sqrt(math.pi) / (far + tail)
    out = np.where(x < 2, series, fraction)
    return np.where(np.isnan(z), np.nan, np.where(z < 0, 2 - out, out))


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of numbers over 0: Stirling's series from 15 on, smaller ones by recurrence."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(15):
        low = x < 15
        shift = shift + np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188 - y * (691 / 360360 - y / 156)))))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz's evaluation of the incomplete beta function's continued fraction, all values side by side until the last settles."""
    held = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones_like(x), 1 / held(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / held(1 + num * d)
            c = held(1 + num / c)
            h = h * d * c
        if not (np.abs(d * c - 1) >= 1e-15).any():
            break
    return h


def beta_cdf_array(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    left = inner < (a + 1) / (a + b + 2)
    p, q, y = np.where(left, a, b), np.where(left, b, a), np.where(left, inner, 1 - inner)
    tail = front * _fraction(p, q, y) / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(left, tail, 1 - tail)))


@F.pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    """Upper tail of the standard normal distribution; null stays null."""
    return pd.Series(0.5 * erfc(z.to_numpy(float) / math.sqrt(2)), index=z.index).where(z.notna())


@F.pandas_udf(DoubleType())
def log_beta(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = a.to_numpy(float), b.to_numpy(float)
    return pd.Series(lgamma(x) + lgamma(y) - lgamma(x + y))


@F.pandas_udf(DoubleType())
def beta_cdf(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    """Regularised incomplete beta function."""
    return pd.Series(beta_cdf_array(a.to_numpy(float), b.to_numpy(float), x.to_numpy(float)))


def beta_cdf_value(a: float, b: float, x: float) -> float:
    """beta_cdf of single numbers."""
    return float(beta_cdf_array(a, b, x))
