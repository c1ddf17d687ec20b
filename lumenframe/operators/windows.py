"""Ordered and time-series operators. Every one that depends on order takes it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import col, join_null_safe
from ..functions.dates import floor_date


def _running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _cum(x: Column, value: Column, w: WindowSpec, skip_na: bool) -> Column:
    if skip_na:
        return F.when(x.isNotNull(), value)
    return F.when(F.max(x.isNull().cast("int")).over(_running(w)) == 0, value)


def cumsum(x: Column, w: WindowSpec, skip_na: bool = True) -> Column:
    return _cum(x, F.sum(x).over(_running(w)), w, skip_na)


def cummean(x: Column, w: WindowSpec, skip_na: bool = True) -> Column:
    return _cum(x, F.avg(x).over(_running(w)), w, skip_na)


def cummin(x: Column, w: WindowSpec, skip_na: bool = True) -> Column:
    return _cum(x, F.min(x).over(_running(w)), w, skip_na)


def cummax(x: Column, w: WindowSpec, skip_na: bool = True) -> Column:
    return _cum(x, F.max(x).over(_running(w)), w, skip_na)


def cumprod(x: Column, w: WindowSpec, skip_na: bool = True) -> Column:
    return _cum(x, F.product(x).over(_running(w)), w, skip_na)


def cumall(x: Column, w: WindowSpec, skip_na: bool = True) -> Column:
    return _cum(x, F.bool_and(x).over(_running(w)), w, skip_na)


def cumany(x: Column, w: WindowSpec, skip_na: bool = True) -> Column:
    return _cum(x, F.bool_or(x).over(_running(w)), w, skip_na)


def cumsum_decayed(x: Column, w: WindowSpec, r: float) -> Column:
    """Sum of earlier values times r to the power of their distance in rows. The rows of the window so far are summed with
    weights by number; weights under 1e-300 (that many rows back) add nothing, so the frame is bounded for r under 1."""
    value = F.coalesce(x, F.lit(0.0))
    if r == 0:
        return value
    if r == 1:
        return F.sum(value).over(_running(w))
    if not 0 < r < 1:
        rows = F.collect_list(value).over(_running(w))
        return F.aggregate(rows, F.lit(0.0), lambda acc, v: acc * r + v)
    reach = int(-690 / math.log(r)) + 1
    rows = F.collect_list(value).over(w.rowsBetween(-min(reach, 1 << 20), Window.currentRow))
    return F.aggregate(rows, F.lit(0.0), lambda acc, v: acc * r + v)


def ts_lag(df: DataFrame, time: str, value: str, keys: list[str], unit: str = "year", n: int = 1) -> DataFrame:
    """``value_lag``: the value of the latest time at or before n units earlier, found by an ordered window over the
    times and the wanted times together, so nothing is paired."""
    months = {"year": 12, "quarter": 3, "month": 1}
    at = F.add_months(col(time).cast("date"), -n * months[unit]) if unit in months else F.date_sub(col(time).cast("date"), n * (7 if unit == "week" else 1))
    rows = df.select("*", col(time).cast("date").alias("__t"), F.lit(0).alias("__ask"))
    asks = df.select("*", at.alias("__t"), F.lit(1).alias("__ask"))
    w = Window.partitionBy(*map(col, keys)).orderBy("__t", "__ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(asks).withColumn("value_lag", F.last(F.when(F.col("__ask") == 0, col(value)), ignorenulls=True).over(w))
    return both.where("__ask = 1").drop("__t", "__ask")


def complete_dates(df: DataFrame, date: str, keys: list[str], unit: str = "day") -> DataFrame:
    """Every date of each key's range, other columns NULL where none was. NULL is a key like any other; rows without a
    date are left out."""
    d = df.withColumn(date, col(date).cast("date")).where(col(date).isNotNull())
    ranges = d.groupBy(*map(col, keys)).agg(F.min(col(date)).alias("__a"), F.max(col(date)).alias("__b"))
    dates = ranges.select(*map(col, keys), F.explode(F.sequence("__a", "__b", F.expr(f"interval 1 {unit}"))).alias(date))
    return join_null_safe(dates, d, [*keys, date], "left")


def fill_ts_na(x: Column, w: WindowSpec, kind: str = "previous", value=0) -> Column:
    if kind == "value":
        return F.coalesce(x, F.lit(value))
    return F.coalesce(x, F.last(x, ignorenulls=True).over(_running(w)))


def fill_between(x: Column, w: WindowSpec, value=None) -> Column:
    """NULLs between two known values, by the one before or by ``value``; ends stay NULL."""
    before = F.last(x, ignorenulls=True).over(_running(w))
    after = F.first(x, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return F.coalesce(x, F.when(before.isNotNull() & after.isNotNull(), before if value is None else F.lit(value)))


def impute_na(x: Column, w: WindowSpec, kind: str = "mean", value=None) -> Column:
    if kind == "value":
        return F.coalesce(x, F.lit(value))
    return F.coalesce(x, {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}[kind](x).over(w))


def quantiles(df: DataFrame, value: str, keys: list[str], ps: list[float]) -> DataFrame:
    """(keys, q0, q1, ...): exact quantiles, linear between neighbours. Rows are counted by value first; without keys
    running counts go over ranges of the values, with keys a group's window holds its distinct values and can spill."""
    from .ranks import running_sums

    by = df.where(col(value).isNotNull()).groupBy(*map(col, keys), col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    total = by.groupBy(*map(col, keys)).agg(F.sum("__n").alias("__t"))
    if keys:
        at = by.withColumn("__below", F.sum("__n").over(_running(Window.partitionBy(*map(col, keys)).orderBy("__v"))) - F.col("__n"))
    else:
        at = running_sums(by, "__v", {"__n": "__below"})
    at = join_null_safe(at, total, keys)

    def quantile(p: float) -> Column:
        place = F.lit(p) * (F.col("__t") - 1)
        low, high = F.floor(place), F.ceil(place)
        holds = lambda i: (F.col("__below") <= i) & (i < F.col("__below") + F.col("__n"))
        a, b = F.max(F.when(holds(low), F.col("__v"))), F.max(F.when(holds(high), F.col("__v")))
        gap = F.max(place - low)
        return F.when(gap == 0, a).otherwise((1 - gap) * a + gap * b)

    return at.groupBy(*map(col, keys)).agg(*[quantile(p).alias(f"q{i}") for i, p in enumerate(ps)])


def detect_outlier(df: DataFrame, value: str, keys: list[str], kind: str = "iqr", threshold: float | None = None) -> DataFrame:
    """``outlier``: Upper, Lower or Normal, by quartiles, percentiles or standard deviations; NULL for a NULL value. The
    bounds are a row for each group, NULL a group like any other, joined back."""
    x = col(value)
    if kind == "sd":
        k = 1.96 if threshold is None else threshold
        bounds = df.groupBy(*map(col, keys)).agg((F.avg(x) - k * F.stddev_samp(x)).alias("__low"), (F.avg(x) + k * F.stddev_samp(x)).alias("__high"))
    elif kind == "percentile":
        p = 0.95 if threshold is None else threshold
        bounds = quantiles(df, value, keys, [round(1 - p, 12), p]).withColumnsRenamed({"q0": "__low", "q1": "__high"})
    else:
        k = 1.5 if threshold is None else threshold
        a, b = F.col("q0"), F.col("q1")
        bounds = quantiles(df, value, keys, [0.25, 0.75]).select(*map(col, keys), (a - k * (b - a)).alias("__low"), (b + k * (b - a)).alias("__high"))
    out = join_null_safe(df, bounds, keys, "left")
    return out.withColumn("outlier", F.when(x > F.col("__high"), "Upper").when(x < F.col("__low"), "Lower").when(x.isNotNull(), "Normal")).drop("__low", "__high")


def normalize(df: DataFrame, value: str, keys: list[str], center: bool = True, scale: bool = True, to: str = "normalized") -> DataFrame:
    """Less the group's mean, over its standard deviation (NULL if that is 0); NULL is a group like any other."""
    x = col(value)
    m = df.groupBy(*map(col, keys)).agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
    out = join_null_safe(df, m, keys, "left")
    y = x - F.col("__m") if center else x
    return out.withColumn(to, F.try_divide(y, F.col("__s")) if scale else y).drop("__m", "__s")


def cut_by_step(x: Column, step: float, low: float, high: float) -> Column:
    """Right-closed bins of equal step from ``low`` to ``high``, as text; values outside give open bins."""
    k = F.ceil((x - low) / step)
    k = F.when(x == low, 1).otherwise(k)
    a, b = low + (k - 1) * step, low + k * step
    return F.when(x.isNull(), None).when(x < low, F.lit(f"-Inf - {low:g}")).when(x > high, F.lit(f"{high:g} - Inf")).otherwise(F.concat(a.cast("double").cast("string"), F.lit(" - "), b.cast("double").cast("string")))


def sample_rows(df: DataFrame, size: int, key: Column, seed: int = 1) -> DataFrame:
    """``size`` rows, the same for any partitioning: the least hashes of ``key``."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(size)


def anomaly_baseline(df: DataFrame, time: str, value: str, keys: list[str], unit: str = "day") -> DataFrame:
    """Values summed by time unit on a dense calendar, zero where none was."""
    daily = df.groupBy(*map(col, keys), floor_date(col(time), unit).alias(time)).agg(F.sum(col(value)).alias(value))
    return complete_dates(daily, time, keys, unit).fillna(0, subset=[value])
