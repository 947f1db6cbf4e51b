"""Tail probabilities.

The normal tail is a native expression, so that it also serves families of
tests that grow with the data. The others are Arrow UDFs for aggregated rows
(one per model, contrast or table row): Spark SQL has no incomplete gamma or beta.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from panelwright.functions.codes import as_col


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _scaled_erfc(x: float) -> float:
    """erfc(x) exp(x^2) without underflow (continued fraction from 4 on)."""
    if x < 4.0:
        return math.erfc(x) * math.exp(x * x)
    tail = 0.0
    for k in range(80, 0, -1):
        tail = 0.5 * k / (x + tail)
    return 1.0 / (math.sqrt(math.pi) * (x + tail))


def _erfc_pieces(pieces: int = 8, degree: int = 10) -> list[tuple[float, list[float]]]:
    """Polynomials of log(erfc(x) exp(x^2) / t) in t - middle, t = 1 / (1 + x / 2), on equal parts of [0, 1]."""
    out = []
    for i in range(pieces):
        a, b = i / pieces, (i + 1) / pieces
        nodes = 0.5 * (a + b) + 0.5 * (b - a) * np.cos(np.pi * (np.arange(2 * degree) + 0.5) / (2 * degree))
        values = [math.log(_scaled_erfc(2.0 / t - 2.0) / t) for t in nodes]
        unit = np.polynomial.Polynomial.fit(nodes, values, degree, domain=[a, b], window=[-1, 1])
        out.append((0.5 * (a + b), [float(c) * (2.0 * pieces) ** k for k, c in enumerate(unit.coef)]))
    return out


def normal_p(z: Column | str) -> Column:
    """Two-sided normal tail, to about 1e-11 of its value; NaN and NULL give NULL."""
    pieces = _erfc_pieces()

    def log_ratio(t: Column) -> Column:
        out = None
        for i, (middle, coef) in reversed(list(enumerate(pieces))):
            value = F.lit(coef[-1])
            for c in reversed(coef[:-1]):
                value = value * (t - F.lit(middle)) + F.lit(c)
            out = value if out is None else F.when(t <= F.lit((i + 1) / len(pieces)), value).otherwise(out)
        return out

    # one-element transforms name x and t, which would otherwise be written out at every step
    once = lambda value, then: F.transform(F.array(value), then)[0]
    tail = lambda x: once(1.0 / (1.0 + x / 2.0), lambda t: t * F.exp(log_ratio(t) - x * x))
    x = F.abs(as_col(z).cast("double")) / math.sqrt(2.0)
    return F.when(~F.isnan(x), F.when(x > 1e8, F.lit(0.0)).otherwise(once(x, tail)))


def chi2_upper(x: float, df: float) -> float:
    """Regularised upper incomplete gamma Q(df/2, x/2)."""
    if x <= 0:
        return 1.0
    a, x = df / 2.0, x / 2.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        step = c * d
        h *= step
        if abs(step - 1.0) < 1e-16:
            break
    return h * scale


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_regularised(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if df <= 0 or not math.isfinite(df):
        return math.nan
    if math.isinf(t):
        return 0.0
    return beta_regularised(df / 2.0, 0.5, df / (df + t * t))


def chi2_2x2(a: float, b: float, c: float, d: float, correction: bool = True) -> float:
    """Pearson test of a 2x2 table with the continuity correction."""
    n = a + b + c + d
    margins = ((a + b) * (a + c), (a + b) * (b + d), (c + d) * (a + c), (c + d) * (b + d))
    if n == 0 or min(margins) == 0:
        return math.nan
    shift = min(0.5, abs(a - margins[0] / n)) if correction else 0.0
    dev = abs(a - margins[0] / n) - shift
    stat = sum(dev * dev / (m / n) for m in margins)
    return math.erfc(math.sqrt(stat / 2.0))


def fisher_2x2(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact test: total probability of tables no likelier than this one."""
    a, b, c, d = int(a), int(b), int(c), int(d)
    row, col, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - n), min(row, col)
    if n == 0 or lo == hi:
        return 1.0

    def logc(total, k):
        return math.lgamma(total + 1) - math.lgamma(k + 1) - math.lgamma(total - k + 1)

    base = logc(n, row)

    def logp(k):
        return logc(col, k) + logc(n - col, row - k) - base

    limit = logp(a) + 1e-7
    mode = min(hi, max(lo, (row + 1) * (col + 1) // (n + 2)))

    def tail(edge, step):
        """Sum from the last table on this side of the mode that is no likelier."""
        near, far = mode, edge
        if logp(far) > limit:
            return 0.0
        while abs(far - near) > 1:
            mid = (near + far) // 2
            if logp(mid) <= limit:
                far = mid
            else:
                near = mid
        total, k = 0.0, far
        while lo <= k <= hi:
            term = math.exp(logp(k))
            total += term
            if term < total * 1e-18:
                break
            k += step
        return total

    if logp(mode) <= limit:
        return 1.0
    return min(1.0, tail(lo, -1) + tail(hi, +1))


def _mapped(fn, *series):
    out = [
        None if any(v is None or v != v for v in row) else fn(*row)
        for row in zip(*(s.astype(object).where(s.notna(), None) for s in series))
    ]
    return pd.Series(np.array([math.nan if o is None else o for o in out], dtype="float64")).replace({math.nan: None}).astype("Float64")


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _mapped(chi2_upper, x, df)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _mapped(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def two_by_two_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Exact test when the smallest cell is under 5, otherwise corrected chi-square."""

    def choose(a, b, c, d):
        return fisher_2x2(a, b, c, d) if min(a, b, c, d) < 5 else chi2_2x2(a, b, c, d)

    return _mapped(choose, a, b, c, d)
