"""Aggregate columns. Conditions that are NULL count as false; ratios divide by what the docstring says."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(*conditions: Column) -> Column:
    return F.coalesce(reduce(and_, conditions), F.lit(False)) if conditions else F.lit(True)


def only(x: Column, *conditions: Column) -> Column:
    return F.when(all_of(*conditions), x)


def sum_if(x: Column, *c: Column) -> Column:
    """Sum over matching rows; 0 if there is none."""
    return F.coalesce(F.sum(only(x, *c)), F.lit(0))


def mean_if(x: Column, *c: Column) -> Column:
    return F.avg(only(x, *c))


average_if = mean_if


def median_if(x: Column, *c: Column) -> Column:
    return F.median(only(x, *c))


def min_if(x: Column, *c: Column) -> Column:
    return F.min(only(x, *c))


def max_if(x: Column, *c: Column) -> Column:
    return F.max(only(x, *c))


def count_if(*c: Column) -> Column:
    return F.count_if(all_of(*c))


def count_unique_if(x: Column, *c: Column) -> Column:
    """Distinct values of matching rows, NULL counted as a value."""
    return F.count_distinct(only(x, *c)) + F.max(only(x.isNull().cast("int"), *c, x.isNull())).isNotNull().cast("long")


def count_unique(x: Column) -> Column:
    """Distinct values, NULL counted as a value."""
    return F.count_distinct(x) + F.coalesce(F.bool_or(x.isNull()), F.lit(False)).cast("long")


def _ratio(part: Column, whole: Column, factor: int = 1) -> Column:
    return F.try_divide(part.cast("double") * factor, whole.cast("double"))


def sum_if_ratio(x: Column, *c: Column, factor: int = 1) -> Column:
    return _ratio(sum_if(x, *c), F.sum(x), factor)


def mean_if_ratio(x: Column, *c: Column, factor: int = 1) -> Column:
    return _ratio(mean_if(x, *c), F.avg(x), factor)


def median_if_ratio(x: Column, *c: Column, factor: int = 1) -> Column:
    return _ratio(median_if(x, *c), F.median(x), factor)


def min_if_ratio(x: Column, *c: Column, factor: int = 1) -> Column:
    return _ratio(min_if(x, *c), F.min(x), factor)


def max_if_ratio(x: Column, *c: Column, factor: int = 1) -> Column:
    return _ratio(max_if(x, *c), F.max(x), factor)


def count_unique_if_ratio(x: Column, *c: Column, factor: int = 1) -> Column:
    return _ratio(count_unique_if(x, *c), count_unique(x), factor)


def count_if_ratio(condition: Column, *c: Column, factor: int = 1) -> Column:
    """One condition: the mean over its non-NULL rows. More: rows that match all but the first argument, over all rows."""
    if not c:
        return F.avg(condition.cast("int")) * factor
    return _ratio(F.count_if(all_of(*c)), F.count(F.lit(1)), factor)


def pct(ratio, *args: Column) -> Column:
    """A ratio aggregate as a percentage: ``pct(sum_if_ratio, x, cond)``."""
    return ratio(*args, factor=100)


def count_rows() -> Column:
    return F.count(F.lit(1))


def true_count(x: Column) -> Column:
    return F.count_if(x)


def false_count(x: Column) -> Column:
    return F.count_if(~x)


def na_count(x: Column) -> Column:
    return F.count_if(x.isNull())


def non_na_count(x: Column) -> Column:
    return F.count(x)


def true_ratio(x: Column, factor: int = 1) -> Column:
    return F.avg(x.cast("int")) * factor


def false_ratio(x: Column, factor: int = 1) -> Column:
    return F.avg((~x).cast("int")) * factor


def na_ratio(x: Column, factor: int = 1) -> Column:
    return F.avg(x.isNull().cast("int")) * factor


def non_na_ratio(x: Column, factor: int = 1) -> Column:
    return F.avg(x.isNotNull().cast("int")) * factor


def get_mode(x: Column, order: Column, na_rm: bool = False) -> Column:
    """The most frequent value; of equals the one that comes first by ``order``. NULL is a value unless ``na_rm``.

    The group's rows are sorted by value and its runs counted in one scan; a group of very many rows is better counted in
    two aggregations, by :func:`lumenframe.operators.grouping.mode_by`.
    """
    rows = F.array_sort(F.collect_list(F.struct(x.alias("v"), order.alias("o"))))
    rows = F.filter(rows, lambda r: r["v"].isNotNull()) if na_rm else rows
    first = F.get(rows, F.lit(0))
    start = F.struct(first["v"].alias("v"), first["o"].alias("o"), F.lit(1).alias("n"), first["v"].alias("bv"), first["o"].alias("bo"), F.lit(1).alias("bn"))

    def step(acc, r):
        same = r["v"].eqNullSafe(acc["v"])
        o, n = F.when(same, acc["o"]).otherwise(r["o"]), F.when(same, acc["n"] + 1).otherwise(F.lit(1))
        better = (n > acc["bn"]) | ((n == acc["bn"]) & (o < acc["bo"]))
        return F.struct(r["v"].alias("v"), o.alias("o"), n.alias("n"), F.when(better, r["v"]).otherwise(acc["bv"]).alias("bv"), F.when(better, o).otherwise(acc["bo"]).alias("bo"), F.when(better, n).otherwise(acc["bn"]).alias("bn"))

    return F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), start, step)["bv"]


def mean_square_error(actual: Column, predicted: Column) -> Column:
    return F.avg((actual - predicted) ** 2)


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(mean_square_error(actual, predicted))


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def mean_error(actual: Column, predicted: Column) -> Column:
    return F.avg(actual - predicted)


def mape(actual: Column, predicted: Column) -> Column:
    """Mean absolute error relative to the actual value; rows whose actual is 0 take no part."""
    return F.avg(F.abs(F.try_divide(actual - predicted, actual)))


def r_squared(actual: Column, predicted: Column) -> Column:
    """1 - residual / total sum of squares, from sums that combine map-side."""
    return 1 - F.try_divide(F.sum((actual - predicted) ** 2), F.var_pop(F.when(predicted.isNotNull(), actual)) * F.count(actual - predicted))


def confint_radius(x: Column, z: float = 1.959963984540054) -> Column:
    """Radius of the mean's normal confidence interval."""
    return F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x))) * z


def prop_confint_radius(x: Column, z: float = 1.959963984540054) -> Column:
    p = F.avg(x.cast("int"))
    return F.sqrt(F.try_divide(p * (1 - p), F.count(x))) * z


def merge_vars(var: Column, mean: Column, size: Column) -> Column:
    """Population variance of a union of groups from the groups' variances, means and sizes."""
    n = F.sum(size)
    m = F.try_divide(F.sum(mean * size), n)
    return F.try_divide(F.sum(var * size), n) + F.try_divide(F.sum(mean * mean * size), n) - m * m
