"""Tail probabilities for test statistics (integer degrees of freedom).

Only ever applied to one row per test, in Arrow batches.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees > x), by the finite series for whole ``df``."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term = total = math.exp(-half)
        first = 1
    else:
        total = math.erfc(math.sqrt(half))
        term = math.exp(-half) / math.sqrt(math.pi * half)
        first = 0.5
    s = first
    while s < df / 2:
        term *= half / s
        total += term
        s += 1
    return min(1.0, total)


def t_tail_two_sided(t: float, df: int) -> float:
    """P(|Student t with ``df`` degrees| > |t|), by the finite series in the angle."""
    if math.isinf(t):
        return 0.0
    theta = math.atan(abs(t) / math.sqrt(df))
    c2 = math.cos(theta) ** 2
    odd = df % 2
    term = math.cos(theta) if odd else 1.0
    total, k = 0.0, 1 + odd
    while k < df:
        total += term
        term *= c2 * k / (k + 1)
        k += 2
    inside = (
        2 / math.pi * (theta + math.sin(theta) * total) if odd else math.sin(theta) * total
    )
    return max(0.0, 1.0 - inside)


def signed_rank_tail(w: float, n: int) -> float:
    """Exact two-sided p of the smaller signed-rank sum ``w`` of ``n`` untied differences."""
    ways = [1]
    for rank in range(1, n + 1):
        shifted = [0] * rank + ways
        ways = [a + b for a, b in zip(ways + [0] * rank, shifted)]
    return min(1.0, 2 * sum(ways[: int(math.floor(w)) + 1]) / 2**n)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def wilcoxon_p(w: float, n: int, tie_term: float, exact: bool) -> float:
    """Two-sided p: exact counts, or the normal approximation with tie correction."""
    if n == 0:
        return float("nan")
    if exact:
        return signed_rank_tail(w, n)
    var = (n * (n + 1) * (2 * n + 1) - tie_term / 2) / 24
    return normal_two_sided((w - n * (n + 1) / 4) / math.sqrt(var)) if var > 0 else float("nan")


def _vectorised(fn):
    @F.pandas_udf("double")
    def apply(args: pd.DataFrame) -> pd.Series:
        return pd.Series(
            [
                float("nan") if any(pd.isna(v) for v in row) else fn(*row)
                for row in args.itertuples(index=False, name=None)
            ],
            dtype="float64",
        )

    return lambda *cols: apply(F.struct(*[c.alias(f"a{i}") for i, c in enumerate(cols)]))


def chi2_p_column(x: Column, df: Column) -> Column:
    return _vectorised(lambda x, d: chi2_tail(float(x), int(d)))(x, df)


def t_p_column(t: Column, df: Column) -> Column:
    return _vectorised(lambda t, d: t_tail_two_sided(float(t), int(d)))(t, df)


def wilcoxon_p_column(w: Column, n: Column, tie_term: Column, exact: Column) -> Column:
    return _vectorised(lambda w, n, t, e: wilcoxon_p(float(w), int(n), float(t), bool(e)))(
        w, n, tie_term, exact
    )
