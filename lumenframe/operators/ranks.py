"""Tests on ranks. Rows are first counted by value; running counts then go over ranges of the distinct values, whose
totals are few, so neither a sort of all rows nor one task for all values is needed.

NULL values and groups take no part; ties get their mean rank.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import p_chi_squared, p_normal, p_t


def running_sums(by: DataFrame, order: str, sums: dict[str, str], descending: bool = False, ranges: int | None = None) -> DataFrame:
    """``by`` (one row for each value of the numeric column ``order``) with, for each item (column, name) of ``sums``,
    the sum of the column over the rows that come before. ``ranges``: into how many ranges the values are cut, as many
    as there are shuffle partitions if not given."""
    from pyspark.ml.feature import Bucketizer

    n = ranges or int(by.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = by.withColumn("__x", F.col(order).cast("double") * (-1 if descending else 1))
    cuts = sorted(set(by.approxQuantile("__x", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    cuts = [c for c in cuts if math.isfinite(c)] or [0.0]
    ranged = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__x", outputCol="__b", handleInvalid="keep").transform(by)
    totals = ranged.groupBy("__b").agg(*[F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums)])
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select("__b", *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__o{i}") for i in range(len(sums))])
    inside = Window.partitionBy("__b").orderBy("__x", F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, -1)
    new = {name: F.col(f"__o{i}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for i, (c, name) in enumerate(sums.items())}
    return ranged.join(F.broadcast(offsets), "__b").withColumns(new).drop("__b", "__x", *[f"__o{i}" for i in range(len(sums))])


def value_ranks(df: DataFrame, value: str, **counts: Column) -> DataFrame:
    """(value, n, ``counts``, n_below, rank) for each distinct value."""
    by = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()])
    sums = {"n": "n_below"} | {k: f"{k}_below" for k in counts}
    return running_sums(by, value, sums).withColumn("rank", F.col("n_below") + (F.col("n") + 1) / 2)


def _table(like: DataFrame, /, **values) -> DataFrame:
    kinds = {int: "long", float: "double", str: "string"}
    return like.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


def wilcoxon(df: DataFrame, value: str, group: str, a, b, correct: bool = True) -> DataFrame:
    """Rank-sum test of two groups: (statistic, z, p_value, n_a, n_b), by the normal approximation with ties, and a
    continuity correction if ``correct``. Without rows of both groups, or with one distinct value, z and p_value are NaN."""
    g = F.col(group)
    r = value_ranks(df.where(g.isin(a, b)), value, a=F.count_if(g == a))
    s = r.agg(F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum("a").alias("a"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("t")).first()
    n, na = s["n"] or 0, s["a"] or 0
    nb = n - na
    w = float(s["r"] or 0) - na * (na + 1) / 2
    var = na * nb / 12 * (n + 1 - s["t"] / (n * (n - 1))) if na and nb and n > 1 else 0.0
    gap = w - na * nb / 2
    z = (gap - (math.copysign(0.5, gap) if correct and gap else 0)) / math.sqrt(var) if var > 0 else math.nan
    return _table(df, statistic=w, z=z, p_value=p_normal(z), n_a=na, n_b=nb)


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Kruskal and Wallis' test of several groups: (statistic, df, p_value), with ties. NaN if all values are equal."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(value).alias("v"), F.col(group).alias("g"))
    r = value_ranks(d, "v")
    t = r.agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("t")).first()
    cells = d.groupBy("g", "v").agg(F.count(F.lit(1)).alias("m")).join(r.select("v", "rank"), "v")
    s = cells.groupBy("g").agg(F.sum(F.col("m") * F.col("rank")).alias("r"), F.sum("m").alias("m")).agg(F.sum(F.col("r") ** 2 / F.col("m")).alias("s"), F.count(F.lit(1)).alias("k")).first()
    n = t["n"] or 0
    ties = 1 - t["t"] / (float(n) ** 3 - n) if n > 1 else 0.0
    h = (12 / (n * (n + 1)) * s["s"] - 3 * (n + 1)) / ties if ties > 0 else math.nan
    k = max(0, s["k"] - 1)
    return _table(df, statistic=h, df=k, p_value=p_chi_squared(h, k) if k and h == h else math.nan)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(correlation, n, p_value) of the ranks of two columns over the rows that have both."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("m"))

    def side(c: str) -> DataFrame:
        by = running_sums(d.groupBy(c).agg(F.sum("m").alias("n")), c, {"n": "below"})
        return by.select(c, (F.col("below") + (F.col("n") + 1) / 2).alias(f"r{c}"))

    w, a, b = F.col("m"), F.col("rx"), F.col("ry")
    s = d.join(side("x"), "x").join(side("y"), "y").agg(*[F.sum(w * v).alias(k) for k, v in {"n": F.lit(1), "a": a, "b": b}.items()], F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab")).first()
    n = s["n"] or 0
    if n < 2:
        return _table(df, correlation=math.nan, n=n, p_value=math.nan)
    va, vb = s["aa"] - s["a"] ** 2 / n, s["bb"] - s["b"] ** 2 / n
    r = (s["ab"] - s["a"] * s["b"] / n) / math.sqrt(va * vb) if va > 0 and vb > 0 else math.nan
    p = 0.0 if abs(r) >= 1 else p_t(r * math.sqrt((n - 2) / (1 - r * r)), n - 2) if n > 2 and r == r else math.nan
    return _table(df, correlation=float(r), n=n, p_value=p)


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(auc, n_positive, n_negative): the share of pairs of a positive and a negative row that the score orders right,
    ties half. NaN without rows of both kinds."""
    p = F.col(positive)
    r = value_ranks(df.where(p.isNotNull()), score, p=F.count_if(p))
    s = r.agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    a, n = s["p"] or 0, s["n"] or 0
    return _table(df, auc=(float(s["r"]) - a * (a + 1) / 2) / (a * (n - a)) if a and n > a else math.nan, n_positive=a, n_negative=n - a)


def kolmogorov_smirnov(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """(statistic, n_a, n_b): the largest gap between the two groups' distribution functions."""
    g = F.col(group)
    r = value_ranks(df.where(g.isin(a, b)), value, a=F.count_if(g == a))
    s = r.agg(F.sum("a").alias("n_a"), (F.sum("n") - F.sum("a")).alias("n_b"))
    at_a, at_b = F.col("a_below") + F.col("a"), F.col("n_below") + F.col("n") - F.col("a_below") - F.col("a")
    return r.crossJoin(F.broadcast(s)).agg(F.max(F.abs(F.try_divide(at_a, "n_a") - F.try_divide(at_b, "n_b"))).alias("statistic"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
