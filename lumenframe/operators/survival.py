"""Comparison of survival curves and proportional hazards, from sums by distinct time."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import p_chi_squared, p_normal
from .ranks import running_sums


def log_rank(df: DataFrame, time: str, event: str, group: str, max_groups: int = 50) -> tuple[DataFrame, DataFrame]:
    """((statistic, df, p_value), (group, n, observed, expected)). Rows with a NULL take no part; over ``max_groups`` groups
    are an error."""
    d = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(group).cast("string").alias("g")).dropna()
    levels = [r[0] for r in d.select("g").distinct().orderBy("g").limit(max_groups + 1).collect()]
    if len(levels) > max_groups:
        raise ValueError(f"over {max_groups} groups")
    k = len(levels)
    by = d.groupBy("t").agg(F.sum("e").alias("d"), F.count(F.lit(1)).alias("m"), *[f(F.col("g") == v, w).alias(f"{n}{i}") for i, v in enumerate(levels) for n, f, w in (("m", lambda c, _: F.count_if(c), 0), ("d", lambda c, _: F.count_if(c & (F.col("e") == 1)), 0))])
    later = running_sums(by, "t", {"m": "l"} | {f"m{i}": f"l{i}" for i in range(k)}, descending=True)
    n = F.col("l") + F.col("m")
    share = [(F.col(f"l{i}") + F.col(f"m{i}")) / n for i in range(k)]
    dead = F.col("d")
    spread = F.when(n > 1, dead * (n - dead) / (n - 1)).otherwise(0.0)
    s = later.agg(*[F.sum(f"d{i}").alias(f"o{i}") for i in range(k)], *[F.sum(dead * share[i]).alias(f"e{i}") for i in range(k)], *[F.sum(f"m{i}").alias(f"n{i}") for i in range(k)],
                  *[F.sum(spread * share[i] * ((1.0 if i == j else 0.0) - share[j])).alias(f"v{i}_{j}") for i in range(k) for j in range(i, k)], F.lit(1)).first()
    o, e = np.array([float(s[f"o{i}"] or 0) for i in range(k)]), np.array([float(s[f"e{i}"] or 0) for i in range(k)])
    v = np.array([[float(s[f"v{min(i, j)}_{max(i, j)}"] or 0) for j in range(k)] for i in range(k)]).reshape(k, k)
    gap = (o - e)[: k - 1] if k > 1 else np.zeros(0)
    stat = float(gap @ np.linalg.pinv(v[: k - 1, : k - 1]) @ gap) if k > 1 else math.nan
    spark = df.sparkSession
    test = spark.createDataFrame([(stat, k - 1, p_chi_squared(stat, k - 1) if k > 1 else math.nan)], "statistic double, df int, p_value double")
    return test, spark.createDataFrame([(g, int(s[f"n{i}"]), int(o[i]), float(e[i])) for i, g in enumerate(levels)], "group string, n long, observed long, expected double")


def cox(df: DataFrame, time: str, event: str, predictors: list[str], rounds: int = 25, max_predictors: int = 30) -> DataFrame:
    """(term, estimate, hazard_ratio, std_error, z, p_value) of proportional hazards over numeric or boolean predictors, ties
    by Efron's weights. Newton's steps on the partial likelihood: each is one aggregate by distinct time, sums over the
    later times, and one row of sums to the driver. Rows with a NULL take no part; predictors are centred for the steps."""
    p = len(predictors)
    if not 0 < p <= max_predictors:
        raise ValueError(f"1 to {max_predictors} predictors")
    d = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(predictors)]).dropna()
    first = d.agg(F.sum("e").alias("e"), *[f(f"x{i}") for i in range(p) for f in (F.avg, F.stddev_samp)]).first()
    if not first["e"]:
        raise ValueError("no event")
    mean, sd = np.array(first[1::2], float), np.array([v if v else 1.0 for v in first[2::2]], float)
    d = d.select("t", "e", *[((F.col(f"x{i}") - float(mean[i])) / float(sd[i])).alias(f"x{i}") for i in range(p)])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    names = ["0", *[f"1_{i}" for i in range(p)], *[f"2_{i}_{j}" for i, j in pairs]]

    def sums(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        w = F.exp(sum((F.col(f"x{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0)))
        terms = [w, *[w * F.col(f"x{i}") for i in range(p)], *[w * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs]]
        dead = F.col("e") == 1
        by = d.groupBy("t").agg(F.count_if(dead).alias("d"), *[F.sum(c).alias(f"m{n}") for n, c in zip(names, terms, strict=True)], *[F.coalesce(F.sum(F.when(dead, c)), F.lit(0.0)).alias(f"e{n}") for n, c in zip(names, terms, strict=True)],
                                *[F.coalesce(F.sum(F.when(dead, F.col(f"x{i}"))), F.lit(0.0)).alias(f"y{i}") for i in range(p)])
        at = running_sums(by, "t", {f"m{n}": f"l{n}" for n in names}, descending=True).where("d > 0")
        at = at.withColumns({f"s{n}": F.col(f"l{n}") + F.col(f"m{n}") for n in names})
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("g", "c0", "c1", "q0", "q1", "q2")])

        def add(acc, i):
            a = i / F.col("d")
            f = F.col("s0") - a * F.col("e0")
            return F.struct((acc["g"] + F.log(f)).alias("g"), (acc["c0"] + 1 / f).alias("c0"), (acc["c1"] + a / f).alias("c1"), (acc["q0"] + 1 / f**2).alias("q0"), (acc["q1"] + a / f**2).alias("q1"), (acc["q2"] + a**2 / f**2).alias("q2"))

        at = at.withColumn("k", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("d") - 1), zero, add))
        s, e = (lambda n: F.col(f"s{n}")), (lambda n: F.col(f"e{n}"))
        k = lambda n: F.col(f"k.{n}")
        gain = sum((F.col(f"y{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0)) - k("g")
        slope = [F.col(f"y{i}") - s(f"1_{i}") * k("c0") + e(f"1_{i}") * k("c1") for i in range(p)]
        bend = [s(f"2_{i}_{j}") * k("c0") - e(f"2_{i}_{j}") * k("c1") - s(f"1_{i}") * s(f"1_{j}") * k("q0") + (s(f"1_{i}") * e(f"1_{j}") + e(f"1_{i}") * s(f"1_{j}")) * k("q1") - e(f"1_{i}") * e(f"1_{j}") * k("q2") for i, j in pairs]
        got = at.agg(F.sum(gain), *map(F.sum, slope), *map(F.sum, bend)).first()
        h = np.zeros((p, p))
        for (i, j), v in zip(pairs, got[1 + p :], strict=True):
            h[i, j] = h[j, i] = v
        return float(got[0]), np.array(got[1 : 1 + p], float), h

    beta = np.zeros(p)
    now, g, h = sums(beta)
    for _ in range(rounds):
        step = np.linalg.pinv(h) @ g
        for _ in range(12):  # half steps while the likelihood falls
            new, ng, nh = sums(beta + step)
            if new >= now - 1e-9 * abs(now):
                break
            step /= 2
        beta, done, now, g, h = beta + step, abs(new - now) <= 1e-9 * (abs(now) + 1e-9), new, ng, nh
        if done:
            break
    error = np.sqrt(np.maximum(0, np.diag(np.linalg.pinv(h)))) / sd
    beta = beta / sd
    rows = [(c, float(b), float(math.exp(b)), float(s), float(b / s) if s else math.nan, p_normal(b / s) if s else math.nan) for c, b, s in zip(predictors, beta, error, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, hazard_ratio double, std_error double, z double, p_value double")
