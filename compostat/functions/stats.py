"""Scalar statistics.  Spark has no error or gamma function, so tail areas are Arrow
UDFs over whole columns; everything else stays in expressions."""

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    z = np.asarray(z, float)
    out = np.full(z.shape, np.nan)
    ok = ~np.isnan(z)
    out[ok] = _erfc(np.abs(z[ok]) / math.sqrt(2)).astype(float)
    return out


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, terms: int = 400) -> np.ndarray:
    """Regularised, by its continued fraction (modified Lentz), over arrays."""
    a, b, x = (np.atleast_1d(np.asarray(v, float)) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = (_lgamma(p + q) - _lgamma(p) - _lgamma(q)).astype(float) + p * np.log(y) + q * np.log1p(-y)
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, terms):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            f = f * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    with np.errstate(over="ignore", under="ignore"):
        part = np.where(y <= 0, 0.0, np.exp(front) * f / p)
    return np.where(swap, 1 - part, part)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    ok = ~np.isnan(t) & ~np.isnan(df) & (df > 0)
    if ok.any():
        out[ok] = incomplete_beta(df[ok] / 2, np.full(ok.sum(), 0.5), df[ok] / (df[ok] + t[ok] ** 2))
    return out


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def mann_whitney_exact(u: float, n1: int, n0: int) -> float:
    """Two-sided p without ties, by counting rank sums."""
    ways = np.zeros(n1 * n0 + 1)
    ways[0] = 1.0
    for k in range(1, n1 + 1):  # times (1 - q^(n0 + k)) over (1 - q^k)
        for j in range(n1 * n0, n0 + k - 1, -1):
            ways[j] -= ways[j - n0 - k]
        for j in range(k, n1 * n0 + 1):
            ways[j] += ways[j - k]
    high = max(u, n1 * n0 - u)
    return float(min(1.0, 2 * ways[math.ceil(high) :].sum() / ways.sum()))


def _nullable(values) -> pd.Series:
    s = pd.Series(values)
    return s.astype(object).where(s.notna(), None)


def _rank_p(u: float, n1: float, n0: float, ties: float) -> float | None:
    if u is None or math.isnan(u) or min(n1, n0) < 1:
        return None
    if ties == 0 and min(n1, n0) <= 8:
        return mann_whitney_exact(u, int(n1), int(n0))
    n = n1 + n0
    var = n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))
    if var <= 0:
        return None
    z = max(0.0, (max(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / math.sqrt(var))
    return math.erfc(z / math.sqrt(2))


@lru_cache
def _udfs():
    """Made on first use: workers import this module without a session."""

    def normal(z: pd.Series) -> pd.Series:
        return _nullable(normal_two_sided(z.to_numpy(float)))

    def student(t: pd.Series, df: pd.Series) -> pd.Series:
        return _nullable(t_two_sided(t.to_numpy(float), df.to_numpy(float)))

    def ranks(u: pd.Series, n1: pd.Series, n0: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([_rank_p(*x) for x in zip(u, n1, n0, ties, strict=True)], dtype=object)

    return {k: F.pandas_udf(f, "double") for k, f in (("normal", normal), ("student", student), ("ranks", ranks))}


def normal_p(z) -> Column:
    """Two-sided p of a normal deviate."""
    return _udfs()["normal"](z)


def t_p(t, df) -> Column:
    """Two-sided p of Student's t."""
    return _udfs()["student"](t, df)


def rank_test_p(u, n1, n0, ties) -> Column:
    """Two-sided Mann-Whitney p from U, the arm sizes and sum(t^3 - t) over ties: exact
    for small arms without ties, else normal with tie and continuity correction."""
    return _udfs()["ranks"](u, n1, n0, ties)


def r2_from_f(f: Column, n: Column, groups: Column) -> Column:
    x = f * (groups - 1) / (n - groups)
    return x / (1 + x)


def safe_div(a: Column, b: Column) -> Column:
    """Null rather than an error or infinity where the divisor is 0."""
    return a / F.nullif(b, F.lit(0.0))


def hash_order(seed: int | str, *keys: Column) -> Column:
    """A pseudo-random order that any engine can repeat: MD5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))
