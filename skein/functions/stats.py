"""Hypergeometric and binomial tails, F-beta and cutoffs.

The tails are Arrow UDFs: numpy evaluates one batch of count tuples at a time with a
ratio recurrence that stops when the remaining terms no longer matter, so neither a
log-factorial table nor the full sum over the support is needed, whatever the row count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
Z_CAP = 99.0          # significances above this are reported as this
SATURATED = 98.0      # above this, rank by overlap quality instead
PAIR_BASE = 98.0      # ... added to F1 for base-group pairs
CLIQUE_BASE = 97.9    # ... added to F1 for clique members
# ----------------------------------------------------------------------------


def log_factorial(x: np.ndarray) -> np.ndarray:
    """ln(x!) by Stirling's series after shifting small arguments up."""
    x = np.asarray(x, dtype=np.float64) + 1.0
    shift = np.zeros_like(x)
    for _ in range(15):
        small = x < 15.0
        if not small.any():
            break
        shift[small] += np.log(x[small])
        x = np.where(small, x + 1.0, x)
    inv = 1.0 / x
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def _log_choose(n, k):
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def _geometric_like_sum(ratio, steps):
    """1 + r(0) + r(0)r(1) + ... for every element, ``steps`` factors at most.

    ``ratio(idx, i)`` gives the i-th factor for the still active elements ``idx``; factors
    decrease, so an element is finished once its term is negligible.
    """
    total = np.ones(len(steps))
    term = np.ones(len(steps))
    idx = np.flatnonzero(steps > 0)
    i = 0
    while len(idx):
        term[idx] *= ratio(idx, i)
        total[idx] += term[idx]
        i += 1
        idx = idx[(steps[idx] > i) & (term[idx] > 1e-17 * total[idx])]
    return total


def _hyper_parts(k, g1, g2, n):
    """Upward and downward tail of Hyp(n, g2, g1) anchored at k, as (ln pmf(k), up, down)."""
    hi = np.minimum(g1, g2)
    lo = np.maximum(0.0, g1 + g2 - n)
    inside = (k >= lo) & (k <= hi)
    kk = np.clip(k, lo, hi)
    log_pmf = _log_choose(g2, kk) + _log_choose(n - g2, g1 - kk) - _log_choose(n, g1)
    mode = np.floor((g1 + 1) * (g2 + 1) / (n + 2))
    return hi, lo, inside, kk, log_pmf, mode


def _sum_up(kk, g1, g2, n, steps):
    return _geometric_like_sum(
        lambda x, i: (g2[x] - kk[x] - i) * (g1[x] - kk[x] - i)
        / ((kk[x] + i + 1) * (n[x] - g1[x] - g2[x] + kk[x] + i + 1)), steps)


def _sum_down(kk, g1, g2, n, steps):
    return _geometric_like_sum(
        lambda x, i: (kk[x] - i) * (n[x] - g1[x] - g2[x] + kk[x] - i)
        / ((g2[x] - kk[x] + i + 1) * (g1[x] - kk[x] + i + 1)), steps)


def upper_tail_log10(k, g1, g2, n) -> np.ndarray:
    """-log10 P(X >= k) for X ~ Hypergeometric(population n, marked g2, drawn g1)."""
    k, g1, g2, n = (np.asarray(v, dtype=np.float64) for v in (k, g1, g2, n))
    hi, lo, _, kk, log_pmf, mode = _hyper_parts(k, g1, g2, n)
    above = kk > mode
    up = log_pmf + np.log(_sum_up(kk, g1, g2, n, np.where(above, hi - kk, 0)))
    # at or below the mode: 1 - P(X <= k-1), summed downwards from k-1
    below = np.maximum(kk - 1, lo)
    _, _, _, _, log_pmf_b, _ = _hyper_parts(below, g1, g2, n)
    down = log_pmf_b + np.log(_sum_down(below, g1, g2, n, np.where(above, 0, below - lo)))
    with np.errstate(divide="ignore"):
        rest = np.log1p(-np.minimum(np.exp(np.minimum(down, 0.0)), 1.0))
    out = np.where(above, up, np.where(kk - 1 < lo, 0.0, rest)) / -np.log(10.0)
    out = np.where(k > hi, np.inf, np.where(k <= lo, 0.0, out))
    return np.maximum(out, 0.0)


def lower_tail_log10(k, g1, g2, n) -> np.ndarray:
    """-log10 P(X <= k); mirrored to an upper tail of the complement draw."""
    k, g1, g2, n = (np.asarray(v, dtype=np.float64) for v in (k, g1, g2, n))
    return upper_tail_log10(g1 - k, g1, n - g2, n)


def _capped(z):
    return np.where(np.isfinite(z) & (z <= Z_CAP), z, Z_CAP)


@F.pandas_udf(T.DoubleType())
def _upper_udf(k: pd.Series, g1: pd.Series, g2: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(_capped(upper_tail_log10(k, g1, g2, n)))


@F.pandas_udf(T.DoubleType())
def _two_sided_udf(k: pd.Series, g1: pd.Series, g2: pd.Series, n: pd.Series) -> pd.Series:
    best = np.maximum(upper_tail_log10(k, g1, g2, n), lower_tail_log10(k, g1, g2, n))
    return pd.Series(_capped(best))


def _as_double(*cols: Column) -> list[Column]:
    return [c.cast("double") for c in cols]


def positive_tail(k: Column, g1: Column, g2: Column, n: Column) -> Column:
    """-log10 of the upper hypergeometric tail, capped; 0 where k is 0."""
    return F.when(k >= 1, _upper_udf(*_as_double(k, g1, g2, n))).otherwise(F.lit(0.0))


def two_sided(k: Column, g1: Column, g2: Column, n: Column) -> Column:
    """-log10 of the smaller tail, capped; 0 where either group is empty."""
    return F.when((g1 > 0) & (g2 > 0), _two_sided_udf(*_as_double(k, g1, g2, n))).otherwise(F.lit(0.0))


def f_beta(k: Column, only_a: Column, only_b: Column, beta: float = 1.0) -> Column:
    """Overlap score of two sets with ``k`` shared and ``only_*`` private elements."""
    b2 = beta * beta
    return F.when(k > 0, (1 + beta) * k / ((1 + b2) * k + b2 * only_a + only_b)).otherwise(F.lit(0.0))


def significance(k: Column, g1: Column, g2: Column, cov: Column, size_a: Column, size_b: Column,
                 base: float = PAIR_BASE) -> Column:
    """Co-occurrence significance of two groups, with saturated values ranked by F1."""
    z = positive_tail(k, g1, g2, cov)
    return F.when(z > SATURATED, base + f_beta(k, size_a - k, size_b - k)).otherwise(z)


def significance_cutoff(width: int) -> float:
    """Threshold at which about one of ``5 * width`` groups passes by chance."""
    return float(np.log10(5.0 * width))


# --- binomial ---------------------------------------------------------------

def binomial_upper(c: np.ndarray, v: int, p: float) -> np.ndarray:
    """P(Bin(v, p) > c) for every entry of ``c``."""
    t = np.arange(v + 1, dtype=np.float64)
    pmf = np.exp(_log_choose(np.full(v + 1, float(v)), t) + t * np.log(p) + (v - t) * np.log1p(-p))
    tail = np.append(np.cumsum(pmf[::-1])[::-1], 0.0)
    return tail[np.minimum(np.asarray(c, dtype=int) + 1, v + 1)]


def expected_rows_above(n: Column, c: Column, v: Column, p: float) -> Column:
    """Expected number of ``n`` rows having more than ``c`` of ``v`` chance hits of rate ``p``."""
    @F.pandas_udf(T.DoubleType())
    def tail(cs: pd.Series, vs: pd.Series) -> pd.Series:
        tails = {b: binomial_upper(np.arange(-1, int(b) + 1), int(b), p) for b in set(vs)}  # a clique has few sizes
        return pd.Series([float(tails[b][min(max(int(a), -1), int(b)) + 1]) for a, b in zip(cs, vs)])
    return n * tail(c, v)


def best_cutoff(n_true: int, n_false: Column, v: Column, p_true: float = 0.70, p_false: float = 0.05) -> Column:
    """Cutoff c maximising expected true rows over expected false rows; lowest c wins ties."""
    @F.pandas_udf(T.IntegerType())
    def pick(rows: pd.Series, vs: pd.Series) -> pd.Series:
        memo: dict[tuple[float, int], int] = {}
        for key in set(zip(rows, vs)):
            c = np.arange(int(key[1]))
            gain = n_true * binomial_upper(c, int(key[1]), p_true)
            noise = np.maximum(key[0] * binomial_upper(c, int(key[1]), p_false), 1.0)
            memo[key] = int(np.argmax(gain / noise)) if len(c) else 0
        return pd.Series([memo[key] for key in zip(rows, vs)])
    return pick(n_false.cast("double"), v.cast("int"))
