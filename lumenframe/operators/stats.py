"""Correlation, distance, tests and binary evaluation from sufficient statistics; only small tables reach the driver."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from .pairs import group_pairs
from .ranks import running_sums


def do_cor_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    """(var1, var2, correlation) for each pair of columns, rows with both values; one pass."""
    pairs = list(combinations(sorted(cols), 2))
    one = df.agg(*[F.corr(F.when(col(b).isNotNull(), col(a)), F.when(col(a).isNotNull(), col(b))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def _chi_squared(df: DataFrame, a: str, b: str) -> DataFrame:
    """(statistic, r, c, n): the sum over cells that hold rows; cells without any add their expectation, which is what the
    total lacks, so the table of all pairs of values is never made."""
    cells = df.where(col(a).isNotNull() & col(b).isNotNull()).groupBy(col(a).alias("a"), col(b).alias("b")).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy("a").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("c"))
    n = cells.agg(F.sum("o").alias("n"))
    sizes = rows.agg(F.count(F.lit(1)).alias("ra")).crossJoin(F.broadcast(cols.agg(F.count(F.lit(1)).alias("cb")))).crossJoin(F.broadcast(n))
    e = F.col("r") * F.col("c") / F.col("n")
    seen = cells.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(n)).agg(F.sum((F.col("o") - e) ** 2 / e).alias("s"), F.sum(e).alias("e"))
    return seen.crossJoin(F.broadcast(sizes)).select((F.col("s") + F.col("n") - F.col("e")).alias("statistic"), F.col("ra").alias("r"), F.col("cb").alias("c"), "n")


def chi_squared(df: DataFrame, a: str, b: str) -> DataFrame:
    """(statistic, df, n) of independence of two columns. NULLs take no part; of an empty table all but df are NULL."""
    return _chi_squared(df, a, b).select("statistic", ((F.col("r") - 1) * (F.col("c") - 1)).alias("df"), "n")


def welch_t(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """(statistic, df, mean_a, mean_b) of Welch's test. Without variance in either group statistic and df are NULL."""
    x, g = col(value), col(group)
    s = df.agg(*[f(F.when(g == k, x)).alias(f"{n}{i}") for i, k in enumerate((a, b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    va, vb = F.try_divide(F.col("v0"), F.col("n0")), F.try_divide(F.col("v1"), F.col("n1"))
    freedom = F.try_divide((va + vb) ** 2, F.try_divide(va**2, F.col("n0") - 1) + F.try_divide(vb**2, F.col("n1") - 1))
    return s.select(F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(va + vb)).alias("statistic"), freedom.alias("df"), F.col("m0").alias("mean_a"), F.col("m1").alias("mean_b"))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way: (statistic, df_between, df_within), from deviations of the groups' means from the grand mean. With one
    group, or no variance within, the statistic is NULL."""
    rows = df.where(col(value).isNotNull() & col(group).isNotNull())
    g = rows.groupBy(col(group)).agg(F.avg(col(value)).alias("m"), F.var_pop(col(value)).alias("v"), F.count(F.lit(1)).alias("n"))
    mean = rows.agg(F.avg(col(value)).alias("grand"))
    s = g.crossJoin(F.broadcast(mean)).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between"))
    a, b = F.col("k") - 1, F.col("n") - F.col("k")
    return s.select(F.try_divide(F.try_divide(F.col("between"), a), F.try_divide(F.col("within"), b)).alias("statistic"), a.alias("df_between"), b.alias("df_within"))


def p_values(tests: DataFrame, kind: str) -> DataFrame:
    """``tests`` (a row for each test, as the functions of this module return) with ``p_value``. ``kind``: chi_squared, t
    (two-sided) or f. NULL where a statistic or its degrees of freedom are NULL, NaN or not positive."""
    from ..functions import distributions as P

    cols, f = {"chi_squared": (("df",), P.p_chi_squared), "t": (("df",), P.p_t), "f": (("df_between", "df_within"), P.p_f)}[kind]

    @F.arrow_udf("double")
    def p(statistic, *df):
        import pyarrow as pa

        rows = zip(statistic.to_pylist(), *[d.to_pylist() for d in df], strict=True)
        return pa.array([None if x is None or x != x or any(d is None or not d > 0 for d in ds) else float(f(x, *ds)) for x, *ds in rows], pa.float64())

    return tests.withColumn("p_value", p("statistic", *cols))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """(cramers_v, statistic, n) of two columns' association; NULL if either has one value."""
    least = F.least("r", "c") - 1
    return _chi_squared(df, a, b).select(F.sqrt(F.try_divide(F.col("statistic"), F.col("n") * least)).alias("cramers_v"), "statistic", "n")


def roc_points(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(score, tp, fp) at each distinct numeric score: counts by score, then running sums over ranges of the scores."""
    p = F.col(positive).cast("int")
    by = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.coalesce(F.sum(p), F.lit(0)).alias("p"), F.coalesce(F.sum(1 - p), F.lit(0)).alias("q"))
    at = running_sums(by, score, {"p": "p_above", "q": "q_above"}, descending=True)
    return at.select(score, (F.col("p_above") + F.col("p")).alias("tp"), (F.col("q_above") + F.col("q")).alias("fp"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(tp, fp, fn, tn, precision, recall, f1, accuracy)."""
    a, p = F.col(actual), F.col(predicted)
    c = df.agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    pr, re = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", pr.alias("precision"), re.alias("recall"), F.try_divide(2 * pr * re, pr + re).alias("f1"), F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"))


def kaplan_meier(df: DataFrame, time: str, event: str, keys: list[str]) -> DataFrame:
    """(keys, time, n_risk, n_event, estimate). Rows are first counted by time. Without keys, numbers at risk and the
    estimate's logarithm run over ranges of the times; with keys a group's window holds its distinct times."""
    by = df.where(col(time).isNotNull()).groupBy(*map(col, keys), col(time)).agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum(col(event).cast("int")), F.lit(0)).alias("n_event"))
    if not keys:
        numeric = by.withColumn("__time", col(time).cast("double"))
        risk = running_sums(numeric, "__time", {"m": "__later"}, descending=True).withColumn("n_risk", F.col("m") + F.col("__later"))
        step = F.when(F.col("n_event") < F.col("n_risk"), F.log1p(-F.col("n_event") / F.col("n_risk"))).otherwise(0.0)
        logs = running_sums(risk.withColumn("__log", step).withColumn("__end", (F.col("n_event") >= F.col("n_risk")).cast("int")), "__time", {"__log": "__sum", "__end": "__ended"})
        ended = F.col("__ended") + F.col("__end") > 0
        return logs.select(col(time), "n_risk", "n_event", F.when(ended, 0.0).otherwise(F.exp(F.col("__sum") + F.col("__log"))).alias("estimate"))
    w = Window.partitionBy(*map(col, keys)).orderBy(col(time))
    r = by.withColumn("n_risk", F.sum("m").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    return r.select(*map(col, keys), col(time), "n_risk", "n_event", F.product(1 - F.col("n_event") / F.col("n_risk")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("estimate"))


def association_rules(df: DataFrame, basket: str, item: str, min_support: float = 0.01, min_confidence: float = 0.1) -> DataFrame:
    """Rules of one item to one item: (lhs, rhs, support, confidence, lift), by pair counts of baskets."""
    from .text import pair_count

    rows = df.select(basket, item).distinct()
    total = rows.agg(F.count_distinct(basket).alias("t"))
    one = rows.groupBy(item).agg(F.count(F.lit(1)).alias("c"))
    two = pair_count(rows, basket, item, distinct=False)
    return (
        two.join(one.select(F.col(item).alias("value_x"), F.col("c").alias("cx")), "value_x").join(one.select(F.col(item).alias("value_y"), F.col("c").alias("cy")), "value_y").crossJoin(F.broadcast(total))
        .select(F.col("value_x").alias("lhs"), F.col("value_y").alias("rhs"), (F.col("n") / F.col("t")).alias("support"), (F.col("n") / F.col("cx")).alias("confidence"), (F.col("n") * F.col("t") / F.col("cx") / F.col("cy")).alias("lift"))
        .where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))
    )


def cohens_d(m1: float, m2: float, s1: float, s2: float, n1: int, n2: int) -> float:
    return (m1 - m2) / math.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2))


def cosine_similarity(df: DataFrame, subject: str, key: str, value: str, block: int = 2048) -> DataFrame:
    """(x, y, similarity) of subjects that share a key (NULL with a subject of only zeros), each pair once. A key of over
    ``block`` subjects is paired block by block."""
    v = df.groupBy(col(subject).alias("s"), col(key).alias("k")).agg(F.sum(col(value)).alias("v"))
    norm = v.groupBy("s").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("norm"))
    unit = v.join(norm, "s").select("s", "k", F.try_divide(F.col("v"), F.col("norm")).alias("u"))
    pairs = group_pairs(unit, F.col("k"), F.struct("s", "u"), block).where("x.s < y.s")
    return pairs.groupBy(F.col("x.s").alias("x"), F.col("y.s").alias("y")).agg(F.sum(F.col("x.u") * F.col("y.u")).alias("similarity"))
