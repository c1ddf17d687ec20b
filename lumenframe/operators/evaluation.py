"""Evaluation of predictions, key-value correlation and distance, and closed-form tests from one aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as P
from ..functions.columns import col
from .ranks import running_sums

_d = F.try_divide


def _metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision, recall = _d(tp, tp + fp), _d(tp, tp + fn)
    return {"f_score": _d(2 * tp, 2 * tp + fp + fn), "accuracy": _d(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall, "specificity": _d(tn, tn + fp)}


def evaluate_binary(df: DataFrame, probability: str, actual: str, threshold: float | str = "f_score") -> DataFrame:
    """(threshold, f_score, accuracy, ..., positives, negatives, tp, fp, fn, tn) at a threshold, or at the first of 0, 0.01,
    ..., 1 with the best of a metric. Rows are counted by the number of thresholds that they reach, so one pass serves all."""
    d = df.where(col(probability).isNotNull() & col(actual).isNotNull()).select(col(probability).cast("double").alias("p"), col(actual).cast("boolean").alias("a"))
    steps = [i / 100 for i in range(101)] if isinstance(threshold, str) else [float(threshold)]
    # for each number of thresholds reached: positives and negatives
    reach = sum((F.col("p") >= t).cast("int") for t in steps)
    by = d.groupBy(reach.alias("k")).agg(F.count_if("a").alias("p"), F.count_if(~F.col("a")).alias("q")).collect()
    pos, neg = sum(r["p"] for r in by), sum(r["q"] for r in by)
    rows = []
    for i, t in enumerate(steps):
        tp, fp = (sum(r[c] for r in by if r["k"] > i) for c in ("p", "q"))
        rows.append((i, t, tp, fp, pos - tp, neg - fp))
    out = df.sparkSession.createDataFrame(rows, "i int, threshold double, tp long, fp long, fn long, tn long")
    out = out.withColumns(_metrics(*map(F.col, ("tp", "fp", "fn", "tn")))).withColumn("positives", F.lit(pos)).withColumn("negatives", F.lit(neg))
    return out.orderBy(F.desc_nulls_last(threshold) if isinstance(threshold, str) else "i", "i").limit(1).drop("i")


def evaluate_multi(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """(micro_f_score, macro_f_score, accuracy, misclassification, n): over all labels predicted or actual."""
    c = df.where(col(predicted).isNotNull() & col(actual).isNotNull()).groupBy(col(predicted).cast("string").alias("p"), col(actual).cast("string").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    each = c.select(F.explode(F.array(F.struct(F.col("p").alias("l"), F.col("n").alias("np"), F.lit(0).cast("long").alias("na"), F.when(F.col("p") == F.col("a"), F.col("n")).otherwise(0).alias("tp")),
                                      F.struct(F.col("a").alias("l"), F.lit(0).cast("long").alias("np"), F.col("n").alias("na"), F.lit(0).cast("long").alias("tp")))).alias("x")).select("x.*")
    by = each.groupBy("l").agg(F.sum("np").alias("np"), F.sum("na").alias("na"), F.sum("tp").alias("tp"))
    f = F.coalesce(_d(2 * F.col("tp"), F.col("np") + F.col("na")), F.lit(0.0))
    s = by.agg(F.sum("tp").alias("tp"), F.sum("na").alias("n"), F.avg(f).alias("macro_f_score"))
    acc = _d(F.col("tp"), F.col("n"))
    return s.select(acc.alias("micro_f_score"), "macro_f_score", acc.alias("accuracy"), (1 - acc).alias("misclassification"), "n")


def evaluate_regression(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """(r_squared, explained_variance, mse, rmse, mae, mape) over the rows that have both; mape in per cent."""
    p, a = col(predicted).cast("double"), col(actual).cast("double")
    e = a - p
    d = df.where(p.isNotNull() & a.isNotNull())
    mse = F.avg(e * e)
    return d.agg((1 - _d(mse, F.var_pop(a))).alias("r_squared"), (1 - _d(F.var_pop(e), F.var_pop(a))).alias("explained_variance"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
                 F.avg(F.abs(e)).alias("mae"), (100 * F.avg(F.abs(_d(e, a)))).alias("mape"))


def aupr(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(aupr): area under precision by recall, trapezoids from the highest score down; NULL if one class lacks."""
    p = col(positive).cast("int")
    by = df.where(col(score).isNotNull() & p.isNotNull()).groupBy(col(score).cast("double").alias("s")).agg(F.sum(p).alias("p"), F.sum(1 - p).alias("q"))
    at = running_sums(by, "s", {"p": "above_p", "q": "above_q"}, descending=True)
    total = by.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    now = (F.col("above_p") + F.col("p")) / (F.col("above_p") + F.col("p") + F.col("above_q") + F.col("q"))
    before = F.coalesce(_d(F.col("above_p"), F.col("above_p") + F.col("above_q")), now)
    area = F.sum(F.col("p") / F.col("tp") * (now + before) / 2)
    return at.crossJoin(F.broadcast(total)).where("tp > 0 and tq > 0").agg(area.alias("aupr"))


def mase(actual: Column, predicted: Column, naive_error: Column, is_test: Column) -> Column:
    """Mean absolute error of the test rows over that of the naive forecast on the training rows."""
    return _d(F.avg(F.when(is_test, F.abs(actual - predicted))), F.avg(F.when(~is_test, F.abs(naive_error))))


def adjusted_r_squared(r2: Column, n: Column, df_residual: Column) -> Column:
    return 1 - _d((1 - r2) * (n - 1), df_residual)


def intra_group_variance(variances: Column, sizes: Column) -> Column:
    return _d(F.sum(variances * sizes), F.sum(sizes))


def inter_group_variance(means: Column, sizes: Column) -> Column:
    """Variance of group means by size about the mean of all, not from a difference of large squares only."""
    total = _d(F.sum(means * sizes), F.sum(sizes))
    return _d(F.sum(means * means * sizes), F.sum(sizes)) - total * total


def cor_kv(df: DataFrame, subject: str, key: str, value: str) -> DataFrame:
    """(x, y, correlation, n) for each pair of subjects x < y over the keys that both have. Values are summed by subject and
    key first; pairs are made per key by an equi-join whose hot keys Spark splits, and reduced map-side."""
    v = df.groupBy(col(subject).alias("s"), col(key).alias("k")).agg(F.sum(col(value)).cast("double").alias("v")).where("v is not null")
    both = v.toDF("x", "k", "a").join(v.toDF("y", "k", "b"), "k").where("x < y")
    return both.groupBy("x", "y").agg(F.corr("a", "b").alias("correlation"), F.count(F.lit(1)).alias("n"))


def dist_kv(df: DataFrame, subject: str, key: str, value: str, method: str = "euclidean") -> DataFrame:
    """(x, y, value) for each pair of subjects x < y; a key that a subject lacks counts 0. Sums over common keys and each
    subject's own totals give the distance, so lacking keys are never filled in."""
    v = df.groupBy(col(subject).alias("s"), col(key).alias("k")).agg(F.coalesce(F.sum(col(value)).cast("double"), F.lit(0.0)).alias("v"))
    power = {"euclidean": 2, "manhattan": 1}[method]
    own = v.groupBy("s").agg(F.sum(F.abs("v") ** power).alias("t"))
    a, b = F.col("a"), F.col("b")
    both = v.toDF("x", "k", "a").join(v.toDF("y", "k", "b"), "k").where("x < y").groupBy("x", "y").agg(F.sum(F.abs(a - b) ** power - F.abs(a) ** power - F.abs(b) ** power).alias("c"))
    pairs = own.toDF("x", "tx").join(own.toDF("y", "ty"), F.col("x") < F.col("y")).join(both, ["x", "y"], "left")
    total = F.greatest(F.col("tx") + F.col("ty") + F.coalesce("c", F.lit(0.0)), F.lit(0.0))
    return pairs.select("x", "y", (F.sqrt(total) if power == 2 else total).alias("value"))


def _one_row(df: DataFrame, /, **values) -> DataFrame:
    kinds = {int: "long", float: "double", str: "string"}
    return df.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds.get(type(v), 'double')}" for k, v in values.items()))


def one_sample_t(df: DataFrame, value: str, mu: float = 0.0) -> DataFrame:
    """(statistic, df, p_value, mean, n), two-sided; NULL without variance."""
    x = col(value).cast("double")
    s = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.count(x).alias("n")).first()
    t = (s["m"] - mu) / (s["s"] / s["n"] ** 0.5) if s["s"] else None
    return _one_row(df, statistic=t, df=max(0, s["n"] - 1), p_value=None if t is None else float(P.p_t(t, s["n"] - 1)), mean=s["m"], n=s["n"])


def prop_test(df: DataFrame, value: str, p: float = 0.5) -> DataFrame:
    """One proportion against ``p`` by the normal approximation: (statistic, p_value, proportion, n)."""
    s = df.agg(F.avg(col(value).cast("int")).alias("m"), F.count(col(value)).alias("n")).first()
    z = (s["m"] - p) / (p * (1 - p) / s["n"]) ** 0.5 if s["n"] else None
    return _one_row(df, statistic=z, p_value=None if z is None else float(P.p_normal(z)), proportion=s["m"], n=s["n"])


def two_prop_test(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """Two proportions by the pooled normal approximation: (statistic, p_value, proportion_a, proportion_b, odds_ratio)."""
    x, g = col(value).cast("int"), col(group)
    s = df.agg(*[f(F.when(g == k, x)).alias(f"{n}{i}") for i, k in enumerate((a, b)) for n, f in (("s", F.sum), ("n", F.count))]).first()
    if not s["n0"] or not s["n1"]:
        return _one_row(df, statistic=None, p_value=None, proportion_a=None, proportion_b=None, odds_ratio=None)
    pa, pb, pool = s["s0"] / s["n0"], s["s1"] / s["n1"], (s["s0"] + s["s1"]) / (s["n0"] + s["n1"])
    spread = (pool * (1 - pool) * (1 / s["n0"] + 1 / s["n1"])) ** 0.5
    z = (pa - pb) / spread if spread else None
    odds = pa * (1 - pb) / ((1 - pa) * pb) if pb and pa < 1 else None
    return _one_row(df, statistic=z, p_value=None if z is None else float(P.p_normal(z)), proportion_a=pa, proportion_b=pb, odds_ratio=odds)


def variance_test(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """F test of two variances: (statistic, df_a, df_b, p_value), two-sided."""
    x, g = col(value).cast("double"), col(group)
    s = df.agg(*[f(F.when(g == k, x)).alias(f"{n}{i}") for i, k in enumerate((a, b)) for n, f in (("v", F.var_samp), ("n", F.count))]).first()
    f = s["v0"] / s["v1"] if s["v0"] is not None and s["v1"] else None
    up = None if f is None else float(P.p_f(f, s["n0"] - 1, s["n1"] - 1))
    return _one_row(df, statistic=f, df_a=max(0, s["n0"] - 1), df_b=max(0, s["n1"] - 1), p_value=None if up is None else 2 * min(up, 1 - up))


def effect_sizes(df: DataFrame, value: str, group: str) -> DataFrame:
    """(common_sd, cohens_f): pooled standard deviation of the groups, and the square root of between over within."""
    d = df.where(col(value).isNotNull() & col(group).isNotNull())
    g = d.groupBy(col(group)).agg(F.avg(col(value)).alias("m"), F.var_samp(col(value)).alias("v"), F.var_pop(col(value)).alias("w"), F.count(F.lit(1)).alias("n"))
    s = g.crossJoin(F.broadcast(d.agg(F.avg(col(value)).alias("grand")))).agg(
        F.sqrt(_d(F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))), F.sum(F.col("n") - 1))).alias("common_sd"),
        F.sqrt(_d(F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2), F.sum(F.col("n") * F.col("w")))).alias("cohens_f"),
    )
    return s


def cohens_w(chi_squared: Column, n: Column) -> Column:
    return F.sqrt(_d(chi_squared, n))


def epsilon_squared(h: Column, n: Column) -> Column:
    return _d(h, n - 1)


def survival_roc(df: DataFrame, score: str, time: str, event: str, at: float) -> DataFrame:
    """(score, tp, fp) of those dead by the time ``at`` (an event at ``at`` counts); rows censored before it take no part."""
    from .stats import roc_points

    t, dead = col(time), col(event).cast("boolean")
    rows = df.where(~((t < at) & ~dead)).select(col(score).alias("score"), ((t < at) | ((t == at) & dead)).alias("dead"))
    return roc_points(rows.where("dead is not null"), "score", "dead")


def binned_actual(df: DataFrame, target: str, variable: str, bins: int = 20, level: float = 1.959963984540054) -> DataFrame:
    """(x, actual, conf_low, conf_high, n): mean of a numeric or boolean target in ``bins`` equal-width bins of a numeric
    variable, or by the values of any other, with normal confidence limits (NULL for a mean of one row). Two passes."""
    types = dict(df.dtypes)
    y, v = col(target), col(variable)
    flag = types[target] == "boolean"
    d = df.where(y.isNotNull() & v.isNotNull()).select(y.cast("double").alias("y"), v.alias("v"))
    if types[variable] in ("string", "boolean"):
        d = d.select("y", F.col("v").cast("string").alias("g"), F.col("v").cast("string").alias("v"))
        x = F.first("v")
    else:
        d = d.withColumn("v", F.col("v").cast("double"))
        s = d.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
        width = ((s["b"] - s["a"]) / bins if s["a"] is not None else 0) or 1.0
        # bins are closed above, as cuts are; the least value is in the first
        d = d.withColumn("g", F.greatest(F.ceil((F.col("v") - F.lit(s["a"] or 0.0)) / width).cast("int"), F.lit(1)))
        x = F.avg("v")
    n, m = F.count(F.lit(1)), F.avg("y")
    radius = level * (F.sqrt(m * (1 - m) / n) if flag else _d(F.stddev_samp("y"), F.sqrt(n)))
    return d.groupBy("g").agg(x.alias("x"), m.alias("actual"), (m - radius).alias("conf_low"), (m + radius).alias("conf_high"), n.alias("n")).drop("g")


def firm_importance(curves: DataFrame, variable: str, prediction: str, weight: str, numeric: str) -> DataFrame:
    """(variable, importance) of partial dependence curves: the standard deviation of predictions, each counted ``weight``
    times, for a numeric variable, a quarter of their range for another."""
    w, p = col(weight), col(prediction)
    w = F.when(p.isNotNull(), w)
    n, mean = F.sum(w), F.sum(w * p) / F.sum(w)
    sd = F.sqrt(F.greatest(_d(F.sum(w * p * p) - n * mean * mean, n - 1), F.lit(0.0)))
    return curves.groupBy(col(variable).alias("variable")).agg(F.when(F.bool_and(col(numeric)), sd).otherwise((F.max(p) - F.min(p)) / 4).alias("importance"))
