"""Tests and effect sizes from summaries (means, standard deviations, counts) already at hand, as column expressions; matrices
in long form; functions applied group by group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col

_d = F.try_divide


def welch_from_summaries(m1: Column, m2: Column, s1: Column, s2: Column, n1: Column, n2: Column) -> tuple[Column, Column]:
    """(statistic, df) of Welch's test."""
    v1, v2 = _d(s1 * s1, n1), _d(s2 * s2, n2)
    return _d(m1 - m2, F.sqrt(v1 + v2)), _d((v1 + v2) ** 2, _d(v1 * v1, n1 - 1) + _d(v2 * v2, n2 - 1))


def common_sd_from_summaries(s1: Column, s2: Column, n1: Column, n2: Column) -> Column:
    return F.sqrt(_d((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2, n1 + n2 - 2))


def cohens_d_from_summaries(m1: Column, m2: Column, s1: Column, s2: Column, n1: Column, n2: Column) -> Column:
    return F.abs(_d(m1 - m2, common_sd_from_summaries(s1, s2, n1, n2)))


def cohens_f_squared(r_squared: Column) -> Column:
    return _d(r_squared, 1 - r_squared)


def beta_prior(mean: Column, variance: Column) -> tuple[Column, Column]:
    """(alpha, beta) of the beta distribution with the mean and variance; NULL where there is none."""
    k = _d(mean * (1 - mean), variance) - 1
    ok = (mean > 0) & (mean < 1) & (k > 0)
    return F.when(ok, mean * k), F.when(ok, (1 - mean) * k)


def chi_squared_ab(conversions_a: Column, n_a: Column, conversions_b: Column, n_b: Column) -> Column:
    """The statistic of a two by two table of conversions."""
    lost_a, lost_b, n = n_a - conversions_a, n_b - conversions_b, n_a + n_b
    cross = conversions_a * lost_b - conversions_b * lost_a
    return _d(n * cross * cross, n_a * n_b * (conversions_a + conversions_b) * (lost_a + lost_b))


def cast_matrix(df: DataFrame, row: str, column: str, value: Column, fill=None, max_columns: int = 10_000) -> DataFrame:
    """A long table as a matrix, a column for each value of ``column``."""
    from .grouping import pivot

    return pivot(df, [row], column, value, fill=fill, max_columns=max_columns)


def matrix_to_long(df: DataFrame, row: str, names_to: str = "column", values_to: str = "value", diag: bool = True, upper: bool = False) -> DataFrame:
    """The cells of a matrix; ``upper``: each pair of names once, the row's before the column's; without the diagonal if not ``diag``."""
    out = df.unpivot([col(row)], [col(c) for c in df.columns if c != row], names_to, values_to)
    a, b = col(row).cast("string"), col(names_to)
    if upper:
        out = out.where((a < b) | (a == b) if diag else a < b)
    elif not diag:
        out = out.where(a != b)
    return out


def on_each_group(df: DataFrame, keys: list[str], f: Callable, schema: str) -> DataFrame:
    """``f`` (a pandas table to a pandas table) on each group; a group must fit one task."""
    return df.groupBy(*map(col, keys)).applyInPandas(f, schema)


def on_each_part(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``f`` on Arrow batches, for functions that need no whole group."""
    return df.mapInArrow(lambda batches: (f(b) for b in batches), schema)
