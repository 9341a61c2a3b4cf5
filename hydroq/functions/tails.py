"""Tail probabilities as Arrow-batched functions of one statistic per series.

Each is called on a column of finished statistics (one row per series or per distinct value), never
on raw measurement rows.
"""

import math
import sys
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# ship these functions with the task, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STD = NormalDist()


def _each(f, *columns):
    """Apply a scalar function along columns; missing or failing arguments give NaN-free nulls."""
    out = []
    for args in zip(*columns):
        bad = any(a is None or a != a for a in args)
        out.append(None if bad else f(*args))
    return pd.Series(out, dtype="float64")


def beta_tail(a, b, x):
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    total = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + num * d or tiny)
            c = 1.0 + num / c or tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total


def gamma_lower(a, x):
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0.0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return front * total
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    total = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2.0
        d = 1.0 / (num * d + b or tiny)
        c = b + num / c or tiny
        total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return 1.0 - front * total


def normal_cdf(z):
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def log_normal_cdf(z):
    """Logarithm of the normal distribution function, with the asymptotic series far left."""
    if z > -30.0:
        return math.log(max(normal_cdf(z), 5e-324))
    return -0.5 * z * z - math.log(-z) - 0.5 * math.log(2 * math.pi) + math.log1p(-1.0 / (z * z))


def t_two_sided(t, df):
    return 1.0 if df <= 0 else beta_tail(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f, d1, d2):
    return 1.0 if f <= 0 else beta_tail(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_upper(x, df):
    return 1.0 - gamma_lower(df / 2.0, x / 2.0)


_S_NODES, _S_WEIGHTS = np.polynomial.legendre.leggauss(64)
_Z_NODES, _Z_WEIGHTS = np.polynomial.legendre.leggauss(96)


_GRID = np.arange(-9 * 512, 9 * 512 + 1) / 512.0
_GRID_CDF = np.array([normal_cdf(v) for v in _GRID])


def _normal_cdf_of_many(x):
    """The distribution function between -9 and 9 from the nearest grid point and three derivatives there."""
    k = np.rint((x + 9.0) * 512).astype(int)
    near = _GRID[k]
    d = x - near
    return _GRID_CDF[k] + np.exp(-near * near / 2.0) / math.sqrt(2.0 * math.pi) * d * (1.0 - near * d / 2.0 + (near * near - 1.0) * d * d / 6.0)


def studentised_range_upper(q, groups, df):
    """Chance that the range of ``groups`` normal means over an estimate of ``df`` degrees of freedom exceeds ``q``.

    The range for a known spread is integrated over the density of the estimated one, which is normalised by its own
    quadrature, so that many degrees of freedom lose no digits.
    """
    if df <= 0 or groups < 2:
        return float("nan")
    reach = 8.0 / math.sqrt(2.0 * df)
    low, high = max(1.0 - reach, 1e-9), 1.0 + reach
    s = low + (high - low) * (_S_NODES + 1.0) / 2.0
    density = (df - 1.0) * np.log(s) - df * (s * s - 1.0) / 2.0
    density = _S_WEIGHTS * np.exp(density - density.max())
    z = 8.0 * _Z_NODES
    mass = 8.0 * _Z_WEIGHTS * np.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
    below = _normal_cdf_of_many(z)
    at = z[None, :] - q * s[:, None]
    shifted = np.zeros(at.shape)  # far left there is nothing
    shifted[at > -9.0] = _normal_cdf_of_many(at[at > -9.0])
    inside = groups * (mass * (below - shifted) ** (groups - 1)).sum(1)
    return float(min(1.0, max(0.0, (density * (1.0 - inside)).sum() / density.sum())))


def kolmogorov_upper(d, n):
    """Asymptotic tail of the largest distance with the small-sample factor."""
    root = math.sqrt(n)
    x = (root + 0.12 + 0.11 / root) * d
    if x < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * x * x) for k in range(1, 101))
    return min(1.0, max(0.0, 2.0 * total))


def gamma_shape(gap):
    """Maximum-likelihood shape from log(mean) - mean(log), by Newton steps."""
    if gap <= 0:
        return float("nan")
    k = (3.0 - gap + math.sqrt((gap - 3.0) ** 2 + 24.0 * gap)) / (12.0 * gap)
    for _ in range(25):
        h = 1e-5 * k
        psi = lambda v: (math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h)
        f = math.log(k) - psi(k) - gap
        slope = 1.0 / k - (math.lgamma(k + h) - 2 * math.lgamma(k) + math.lgamma(k - h)) / (h * h)
        step = f / slope
        if not math.isfinite(step) or k - step <= 0:
            break
        k -= step
        if abs(step) < 1e-9 * k:
            break
    return k


def shapiro_tail(w, n):
    """p of Royston's approximation for W of 3 to 5,000 numbers."""
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return max(0.0, p)
    if w == 1.0:
        return 1.0
    if n <= 11:
        g = 0.459 * n - 2.273
        y = math.log1p(-w)
        if y >= g:
            return 1e-99
        y = -math.log(g - y)
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, ln = math.log1p(-w), math.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return normal_cdf(-(y - mu) / sd)


@pandas_udf(DoubleType())
def shapiro_p(w: pd.Series, n: pd.Series) -> pd.Series:
    return _each(shapiro_tail, w, n)


@pandas_udf(DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    return _each(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), z)


@pandas_udf(DoubleType())
def normal_cdf_of(z: pd.Series) -> pd.Series:
    return _each(normal_cdf, z)


@pandas_udf(DoubleType())
def log_normal_cdf_of(z: pd.Series) -> pd.Series:
    return _each(log_normal_cdf, z)


@pandas_udf(DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_two_sided, t, df)


@pandas_udf(DoubleType())
def f_upper_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(f_upper, f, d1, d2)


@pandas_udf(DoubleType())
def chi2_upper_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _each(chi2_upper, x, df)


@pandas_udf(DoubleType())
def studentised_range_p(q: pd.Series, groups: pd.Series, df: pd.Series) -> pd.Series:
    return _each(studentised_range_upper, q, groups, df)


@pandas_udf(DoubleType())
def kolmogorov_p(d: pd.Series, n: pd.Series) -> pd.Series:
    return _each(kolmogorov_upper, d, n)


@pandas_udf(DoubleType())
def gamma_shape_of(gap: pd.Series) -> pd.Series:
    return _each(gamma_shape, gap)


@pandas_udf(DoubleType())
def gamma_cdf_of(x: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    return _each(lambda v, k, s: gamma_lower(k, v / s), x, shape, scale)
