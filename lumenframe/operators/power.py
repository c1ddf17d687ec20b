"""Power and sample sizes of t and chi-squared tests, and Bayesian comparison of two rates. All closed or numeric on the
driver, from a handful of numbers; only the counts of ``bayes_ab`` come from rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.distributions import incomplete_beta, p_chi_squared, p_t


def _root(f: Callable[[float], float], low: float, high: float) -> float:
    """Where the rising ``f`` crosses zero; ``high`` doubles until it is beyond."""
    while f(high) < 0 and high < 1e12:
        low, high = high, 2 * high
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    tail = min(p, 1 - p)
    x = _root(lambda t: 2 * tail - p_t(t, df), 0.0, 2.0)
    return x if p >= 0.5 else -x


def chi_squared_quantile(p: float, df: float) -> float:
    return _root(lambda x: (1 - p) - p_chi_squared(x, df), 0.0, df + 1.0)


def p_above_noncentral_t(t: float, df: float, shift: float) -> float:
    """P(T > t) of a noncentral t: the normal tail averaged over the chi distribution of its divisor."""
    spread = 1 / math.sqrt(2 * df)
    s = np.linspace(max(1e-9, 1 - 12 * spread), 1 + 12 * spread, 4001)
    log = (df - 1) * np.log(s) - df * s * s / 2
    w = np.exp(log - log.max())
    w[1:-1:2] *= 4
    w[2:-1:2] *= 2
    tail = np.array([math.erfc(x / math.sqrt(2)) / 2 for x in t * s - shift])
    return float((w * tail).sum() / w.sum())


def p_above_noncentral_chi_squared(x: float, df: float, shift: float) -> float:
    """P(X > x): central tails weighted by the Poisson distribution of half the shift."""
    half, total = shift / 2, 0.0
    middle = int(half)
    reach = int(12 * math.sqrt(half + 1)) + 20
    for i in range(max(0, middle - reach), middle + reach + 1):
        w = math.exp(-half + i * math.log(half) - math.lgamma(i + 1)) if half > 0 else float(i == 0)
        if w > 0:
            total += w * p_chi_squared(x, df + 2 * i)
    return total


def t_power(n: float, d: float, a_ratio: float = 0.5, alpha: float = 0.05, alternative: str = "two.sided", paired: bool = False) -> float:
    """Power of a t test with ``n`` rows in all (pairs, if ``paired``), ``a_ratio`` of them in the first group."""
    df = n - 1 if paired else n - 2
    if df <= 0:
        return math.nan
    shift = d * math.sqrt(n if paired else n * a_ratio * (1 - a_ratio))
    if alternative == "two.sided":
        q = t_quantile(1 - alpha / 2, df)
        return p_above_noncentral_t(q, df, shift) + 1 - p_above_noncentral_t(-q, df, shift)
    return p_above_noncentral_t(t_quantile(1 - alpha, df), df, abs(shift))


def chi_squared_power(n: float, w: float, df: int, alpha: float = 0.05) -> float:
    return p_above_noncentral_chi_squared(chi_squared_quantile(1 - alpha, df), df, n * w * w)


def _curve(spark: SparkSession, power: Callable[[float], float], target: float, first: float, last: float, step: float) -> tuple[DataFrame, DataFrame]:
    sizes = [first + i * step for i in range(int((max(first, last) - first) / step + 1e-9) + 1)]
    need = _root(lambda n: (power(n) if not math.isnan(power(n)) else 0.0) - target, 2.0, 10.0)
    curve = spark.createDataFrame([(float(n), float(power(n))) for n in sizes], "n double, power double")
    return curve, spark.createDataFrame([(target, need if need < 1e12 else None)], "power double, required_n double")


def t_power_curve(spark: SparkSession, d: float = 0.2, a_ratio: float = 0.5, alpha: float = 0.05, beta: float = 0.2, alternative: str = "two.sided", paired: bool = False, first: float = 10, last: float = 1000, step: float = 10) -> tuple[DataFrame, DataFrame]:
    """((n, power), (power, required_n)); the curve starts where both groups have two rows. Without an effect the size is
    NULL."""
    first = max(first, 2 / min(a_ratio, 1 - a_ratio))
    return _curve(spark, lambda n: t_power(n, d, a_ratio, alpha, alternative, paired), 1 - beta, first, last, step)


def chi_squared_power_curve(spark: SparkSession, w: float = 0.1, rows: int = 2, cols: int = 2, alpha: float = 0.05, beta: float = 0.2, first: float = 10, last: float = 1000, step: float = 10) -> tuple[DataFrame, DataFrame]:
    """((n, power), (power, required_n)) of a test of independence."""
    return _curve(spark, lambda n: chi_squared_power(n, w, (rows - 1) * (cols - 1), alpha), 1 - beta, first, last, step)


def p_b_above_a(alpha_a: float, beta_a: float, alpha_b: float, beta_b: float, steps: int = 4000) -> float:
    """P(B > A) of two beta distributions: A's distribution function averaged over B's density around its mean."""
    mean = alpha_b / (alpha_b + beta_b)
    sd = math.sqrt(mean * (1 - mean) / (alpha_b + beta_b + 1))
    low, high = max(1e-12, mean - 10 * sd), min(1 - 1e-12, mean + 10 * sd)
    mids = [low + (i + 0.5) * (high - low) / steps for i in range(steps)]
    log = [(alpha_b - 1) * math.log(x) + (beta_b - 1) * math.log1p(-x) for x in mids]
    top = max(log)
    w = [math.exp(v - top) for v in log]
    return sum(v * incomplete_beta(alpha_a, beta_a, x) for v, x in zip(w, mids, strict=True)) / sum(w)


def bayes_ab(df: DataFrame, converted: str, group: str, a, b, prior: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(group, n, converted, alpha, beta, mean, chance_of_being_better) of two groups' rates: beta posteriors from one pass
    of counts, the chance by integration. Rows with a NULL take no part; a group without rows keeps the prior."""
    x, g = col(converted).cast("boolean"), col(group)
    s = df.agg(*[f.alias(f"{n}{i}") for i, k in enumerate((a, b)) for n, f in (("n", F.count_if((g == k) & x.isNotNull())), ("c", F.count_if((g == k) & x)))]).first()
    post = [(prior[0] + s[f"c{i}"], prior[1] + s[f"n{i}"] - s[f"c{i}"]) for i in (0, 1)]
    better = p_b_above_a(*post[0], *post[1])
    rows = [(str(k), s[f"n{i}"], s[f"c{i}"], *map(float, post[i]), float(post[i][0] / sum(post[i])), float(better if i else 1 - better)) for i, k in enumerate((a, b))]
    return df.sparkSession.createDataFrame(rows, "group string, n long, converted long, alpha double, beta double, mean double, chance_of_being_better double")
