"""Distribution functions that Spark lacks, as Arrow-batched pandas UDFs; numpy and math only."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.session import reach_package


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) if v > 0 else math.nan for v in x])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated from the front by the modified Lentz rule."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    value = d.copy()
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            value = value * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return value


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function."""
    x = np.clip(x, 0.0, 1.0)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    swap = inner > (a + 1) / (a + b + 2)
    direct = front * _beta_fraction(np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - inner, inner)) / np.where(swap, b, a)
    out = np.where(swap, 1 - direct, direct)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function, by its series below a + 1 and its fraction above."""
    x = np.maximum(x, 0.0)
    small = x < a + 1
    front = np.exp(-x + a * np.log(np.maximum(x, 1e-300)) - _log_gamma(a))
    term, total, k = 1 / a, 1 / a, a.copy()
    xs = np.where(small, x, 0.0)
    for _ in range(600):
        k = k + 1
        term = term * xs / k
        total = total + term
        if np.all(term <= total * 1e-16):
            break
    xl = np.where(small, a + 2, x)
    b = xl + 1 - a
    c, d = np.full_like(xl, 1e300), 1 / b
    h = d
    for i in range(1, 600):
        an = -i * (i - a)
        b = b + 2
        d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
        c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return np.where(x <= 0, 1.0, np.where(small, 1 - front * total, front * h))


def _udf(f):
    def run(*series: pd.Series) -> pd.Series:
        columns = [s.to_numpy(float) for s in series]
        ok = ~np.any([np.isnan(c) for c in columns], axis=0)
        out = np.full(len(ok), np.nan)
        if ok.any():
            out[ok] = f(*[c[ok] for c in columns])
        return pd.Series(out).where(~np.isnan(out), None).astype(float)

    return run


def _call(f, *args: Column | str | float) -> Column:
    columns = [F.lit(float(a)) if isinstance(a, (int, float)) else (F.col(a) if isinstance(a, str) else a).cast("double") for a in args]
    reach_package()
    run = _udf(f)
    if len(columns) == 1:
        def one(x: pd.Series) -> pd.Series:
            return run(x)
        udf = F.pandas_udf(one, "double")
    elif len(columns) == 2:
        def two(x: pd.Series, y: pd.Series) -> pd.Series:
            return run(x, y)
        udf = F.pandas_udf(two, "double")
    else:
        def three(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
            return run(x, y, z)
        udf = F.pandas_udf(three, "double")
    out = udf(*columns)
    return F.when(~F.isnan(out), out)


def normal_cdf(z) -> Column:
    return _call(lambda x: np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x]), z)


def normal_two_sided(z) -> Column:
    return _call(lambda x: np.array([math.erfc(abs(v) / math.sqrt(2)) for v in x]), z)


def normal_quantile(p) -> Column:
    return _call(lambda x: np.array([NormalDist().inv_cdf(min(max(v, 1e-300), 1 - 1e-16)) for v in x]), p)


def t_two_sided(t, df) -> Column:
    return _call(lambda x, n: incomplete_beta(n / 2, np.full_like(n, 0.5), n / (n + x * x)), t, df)


def f_upper(f, df1, df2) -> Column:
    return _call(lambda x, a, b: incomplete_beta(b / 2, a / 2, b / (b + a * np.maximum(x, 0))), f, df1, df2)


def chi2_upper(x, df) -> Column:
    return _call(lambda v, n: upper_gamma(n / 2, v / 2), x, df)


def kolmogorov_upper(d, n) -> Column:
    """The asymptotic p of a Kolmogorov-Smirnov distance d with n (effective) values."""

    def p(x: np.ndarray, m: np.ndarray) -> np.ndarray:
        y = (np.sqrt(m) + 0.12 + 0.11 / np.sqrt(m)) * x
        k = np.arange(1, 101)[:, None]
        return np.clip(np.where(y < 0.2, 1.0, 2 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * y * y)).sum(0)), 0, 1)

    return _call(p, d, n)


def chi2_upper_even(x: Column, df: Column | int) -> Column:
    """The upper tail for an even number of degrees of freedom, as a closed sum: built-in functions only."""
    half = F.lit(df) / 2 if isinstance(df, int) else df / 2
    terms = F.sequence(F.lit(1), F.greatest(half.cast("int") - 1, F.lit(1)))
    total = F.aggregate(terms, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda a, i: F.when(i < half, F.struct((a["term"] * (x / 2) / i).alias("term"), (a["sum"] + a["term"] * (x / 2) / i).alias("sum"))).otherwise(a))
    return F.exp(-x / 2) * total["sum"]


def log_factorial(n: Column) -> Column:
    """ln n!: looked up below 16, else the series of Stirling, which is exact to 1e-14 from there; no work grows with n."""
    x = F.greatest(n, F.lit(16)).cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x) - 1 / (1680 * x * x * x * x * x * x * x)
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    return F.when(n < 16, F.get(small, F.greatest(n, F.lit(0)).cast("int"))).otherwise(series)


def hypergeometric_upper(n_all: Column, n_marked: Column, n_drawn: Column, n_hit: Column) -> Column:
    """P(at least n_hit marked among n_drawn of n_all, of which n_marked are marked); built-in functions only.

    The first term comes from log factorials, each further one from the one before.
    """
    big, k, n, x = (c.cast("double") for c in (n_all, n_marked, n_drawn, n_hit))
    choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    low = F.greatest(x, n + k - big, F.lit(0.0))
    top = F.least(n, k)
    first = F.exp(choose(k, low) + choose(big - k, n - low) - choose(big, n))
    steps = F.sequence(F.lit(0), F.greatest((top - low).cast("int") - 1, F.lit(0)))
    total = F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), lambda a, i: F.when(low + i < top, F.struct((a["term"] * (k - low - i) * (n - low - i) / ((low + i + 1) * (big - k - n + low + i + 1))).alias("term"), (a["sum"] + a["term"] * (k - low - i) * (n - low - i) / ((low + i + 1) * (big - k - n + low + i + 1))).alias("sum"))).otherwise(a))
    return F.when(low > top, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total["sum"]))


def _shifted(x: Column, power: int, times: int = 10) -> Column:
    """The sum of (x + i)^-power for i below times."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(times - 1)), F.lit(0.0), lambda a, i: a + 1 / F.pow(x + i, F.lit(float(power))))


def digamma(x: Column) -> Column:
    """The derivative of ln gamma for x > 0: its series at x + 10, less the steps up to there; exact to about 1e-14."""
    y = x + 10
    s = 1 / (y * y)
    return F.ln(y) - 1 / (2 * y) - s * (F.lit(1 / 12) - s * (F.lit(1 / 120) - s * (F.lit(1 / 252) - s * (F.lit(1 / 240) - s / 132)))) - _shifted(x, 1)


def trigamma(x: Column) -> Column:
    y = x + 10
    s = 1 / (y * y)
    return 1 / y + s / 2 + s / y * (F.lit(1 / 6) - s * (F.lit(1 / 30) - s * (F.lit(1 / 42) - s * (F.lit(1 / 30) - s * 5 / 66)))) + _shifted(x, 2)


def tetragamma(x: Column) -> Column:
    y = x + 10
    s = 1 / (y * y)
    return -s - s / y - s * s * (F.lit(1 / 2) - s * (F.lit(1 / 6) - s * (F.lit(1 / 6) - s * 3 / 10))) - 2 * _shifted(x, 3)


def trigamma_inverse(v: Column, rounds: int = 40) -> Column:
    """The x with trigamma(x) = v, by Newton's steps on 1 / trigamma, which is nearly linear; for one row, not for a table."""
    x = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(0.5) + 1 / v, lambda x, _: x + trigamma(x) * (1 - trigamma(x) / v) / tetragamma(x))
    return F.when(v > 1e7, 1 / F.sqrt(v)).when(v < 1e-6, 1 / v).otherwise(x)


#: The Chebyshev coefficients of ln(erfc(z) exp(z^2) / t) over t = 2 / (2 + z), from "Numerical Recipes", 3rd edition, 6.2.2.
ERFC = (-1.3026537197817094, 6.4196979235649026e-1, 1.9476473204185836e-2, -9.561514786808631e-3, -9.46595344482036e-4, 3.66839497852761e-4, 4.2523324806907e-5, -2.0278578112534e-5, -1.624290004647e-6, 1.303655835580e-6, 1.5626441722e-8, -8.5238095915e-8, 6.529054439e-9, 5.059343495e-9, -9.91364156e-10, -2.27365122e-10, 9.6467911e-11, 2.394038e-12, -6.886027e-12, 8.94487e-13, 3.13092e-13, -1.12708e-13, 3.81e-16, 7.106e-15, -1.523e-15, -9.4e-17, 1.21e-16, -2.8e-17)


def normal_upper_array(z: np.ndarray) -> np.ndarray:
    """The upper tail of the normal distribution, whole arrays at once."""
    a = np.abs(z) / math.sqrt(2)
    t = 2 / (2 + a)
    tail = 0.5 * t * np.exp(-a * a + np.polynomial.chebyshev.chebval(2 * t - 1, (ERFC[0] / 2, *ERFC[1:])))
    return np.where(z >= 0, tail, 1 - tail)
