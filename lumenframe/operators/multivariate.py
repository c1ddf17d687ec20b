"""Reliability, correspondence, singular values, scaling and divergence. Matrices of columns or levels reach the driver,
their size checked; rows never do."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col


def _moments(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, covariances) of the complete rows, in one pass."""
    x = [col(c).cast("double") for c in cols]
    complete = F.lit(True)
    for c in x:
        complete = complete & c.isNotNull()
    rows, p = df.where(complete), len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = rows.agg(F.count(F.lit(1)), *map(F.avg, x), *[F.covar_samp(x[i], x[j]) for i, j in pairs]).first()
    m = np.full((p, p), np.nan)
    for (i, j), v in zip(pairs, got[1 + p :], strict=True):
        m[i, j] = m[j, i] = np.nan if v is None else v
    return got[0], np.array([np.nan if v is None else v for v in got[1 : 1 + p]], float), m


def _number(x) -> float | None:
    x = float(x)
    return x if math.isfinite(x) else None


def cronbach_alpha(df: DataFrame, items: Sequence[str], max_items: int = 200) -> tuple[DataFrame, DataFrame]:
    """((raw_alpha, standardized_alpha, items, n), (item, mean, sd, item_rest_correlation, alpha_if_dropped)) of the complete
    rows. NULL where there is no variance or too few rows; more than ``max_items`` items are an error."""
    k = len(items)
    if not 2 <= k <= max_items:
        raise ValueError(f"2 to {max_items} items")
    n, mean, v = _moments(df, items)

    def raw(at: list[int]) -> float:
        part = v[np.ix_(at, at)]
        return len(at) / (len(at) - 1) * (1 - np.trace(part) / part.sum()) if len(at) > 1 and part.sum() else math.nan

    with np.errstate(invalid="ignore", divide="ignore"):
        sd = np.sqrt(np.diag(v))
        r = (v / np.outer(sd, sd))[np.triu_indices(k, 1)].mean()
        rows = []
        for i, c in enumerate(items):
            rest = [j for j in range(k) if j != i]
            own = v[i, rest].sum() / (sd[i] * np.sqrt(v[np.ix_(rest, rest)].sum()))
            rows.append((c, _number(mean[i]), _number(sd[i]), _number(own), _number(raw(rest))))
        total = (_number(raw(list(range(k)))), _number(k * r / (1 + (k - 1) * r)), k, n)
    spark = df.sparkSession
    return spark.createDataFrame([total], "raw_alpha double, standardized_alpha double, items int, n long"), spark.createDataFrame(rows, "item string, mean double, sd double, item_rest_correlation double, alpha_if_dropped double")


def correspondence(df: DataFrame, a: str, b: str, max_levels: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Correspondence analysis of two columns: ((dimension, eigenvalue, percent, cumulative_percent), (variable, level, n,
    dimension, coordinate, contribution, cos2)). Rows with a NULL take no part; a coordinate's sign is such that the
    largest of its dimension among ``a``'s levels is positive. More than ``max_levels`` levels of a column are an error."""
    cells = df.where(col(a).isNotNull() & col(b).isNotNull()).groupBy(col(a).cast("string").alias("a"), col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.agg(F.count_distinct("a"), F.count_distinct("b")).first()
    if max(sizes) > max_levels:
        raise ValueError(f"over {max_levels} levels")
    spark, got = df.sparkSession, cells.collect()
    left, right = sorted({r["a"] for r in got}), sorted({r["b"] for r in got})
    n = np.zeros((len(left), len(right)))
    for r in got:
        n[left.index(r["a"]), right.index(r["b"])] = r["n"]
    k = max(0, min(n.shape) - 1)
    values, points = [], []
    if k:
        p = n / n.sum()
        pr, pc = p.sum(1), p.sum(0)
        u, s, vt = np.linalg.svd((p - np.outer(pr, pc)) / np.sqrt(np.outer(pr, pc)), full_matrices=False)
        u, s, v = u[:, :k], s[:k], vt[:k].T
        sign = np.where(u[np.abs(u).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
        e = s**2
        share = 100 * e / e.sum() if e.sum() else np.zeros(k)
        values = [(i + 1, float(e[i]), float(share[i]), float(share[: i + 1].sum())) for i in range(k)]
        for name, levels, w, mass in ((a, left, u * sign, pr), (b, right, v * sign, pc)):
            at = w * s / np.sqrt(mass)[:, None]
            square = (at**2).sum(1)
            points += [(name, x, int(round(mass[i] * n.sum())), d + 1, float(at[i, d]), float(100 * w[i, d] ** 2), _number(at[i, d] ** 2 / square[i]) if square[i] else None) for i, x in enumerate(levels) for d in range(k)]
    return spark.createDataFrame(values, "dimension int, eigenvalue double, percent double, cumulative_percent double"), spark.createDataFrame(points, "variable string, level string, n long, dimension int, coordinate double, contribution double, cos2 double")


def svd_cols(df: DataFrame, cols: Sequence[str], n: int = 2, centering: bool = True, max_columns: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Singular value decomposition of the complete rows' ``cols``: (rows with ``axis1``, ... of the left vectors, (component,
    variable, value) of the right ones, (component, value) of the singular values). From the matrix of products of one
    pass; a right vector's largest entry is positive. More than ``max_columns`` columns are an error."""
    p = len(cols)
    if not 0 < p <= max_columns:
        raise ValueError(f"1 to {max_columns} columns")
    count, mean, v = _moments(df, cols)
    n = min(n, p)
    empty = count < 1
    gram = np.zeros((p, p)) if empty else np.nan_to_num(v) * max(0, count - 1) + (0 if centering else count * np.outer(mean, mean))
    centre = np.nan_to_num(mean) if centering else np.zeros(p)
    e, w = np.linalg.eigh(gram)
    s, w = np.sqrt(np.maximum(e[::-1][:n], 0)), w[:, ::-1][:, :n]
    w = w * np.where(w[np.abs(w).argmax(0), np.arange(n)] < 0, -1.0, 1.0)
    x = [col(c).cast("double") - F.lit(float(m)) for c, m in zip(cols, centre, strict=True)]
    axes = [F.try_divide(sum((v * F.lit(float(c)) for v, c in zip(x, w[:, k], strict=True)), F.lit(0.0)), F.lit(float(s[k]))).alias(f"axis{k + 1}") for k in range(n)]
    spark = df.sparkSession
    loadings = [(k + 1, c, float(w[i, k])) for k in range(n) for i, c in enumerate(cols)]
    return df.dropna(subset=list(cols)).select("*", *axes), spark.createDataFrame(loadings, "component int, variable string, value double"), spark.createDataFrame([(k + 1, float(s[k])) for k in range(n)], "component int, value double")


def cmdscale(distances: DataFrame, x: str, y: str, value: str, k: int = 2, max_points: int = 2000) -> DataFrame:
    """(name, V1, ..., Vk): places in ``k`` dimensions whose distances are those of the table (classical scaling), up to
    rotation. Repeated pairs count with their mean, lacking ones as 0. More than ``max_points`` points are an error."""
    d = distances.select(col(x).cast("string").alias("x"), col(y).cast("string").alias("y"), col(value).cast("double").alias("v")).where("x is not null and y is not null")
    names = sorted(r[0] for r in d.select("x").union(d.select("y")).distinct().limit(max_points + 1).collect())
    if len(names) > max_points:
        raise ValueError(f"over {max_points} points")
    at, n = {c: i for i, c in enumerate(names)}, len(names)
    m = np.zeros((n, n))
    pair = F.array_sort(F.array("x", "y"))
    for r in d.where("x <> y").groupBy(pair.alias("p")).agg(F.avg("v").alias("v")).collect():
        i, j = at[r["p"][0]], at[r["p"][1]]
        m[i, j] = m[j, i] = r["v"] or 0.0
    places = np.zeros((n, k))
    if n:
        c = np.eye(n) - 1 / n
        e, w = np.linalg.eigh(-c @ (m**2) @ c / 2)
        e, w = e[::-1][:k], w[:, ::-1][:, :k]
        places[:, : len(e)] = w * np.where(w[np.abs(w).argmax(0), np.arange(len(e))] < 0, -1.0, 1.0) * np.sqrt(np.maximum(e, 0))
    rows = [(c, *map(float, places[i])) for i, c in enumerate(names)]
    return distances.sparkSession.createDataFrame(rows, "name string" + "".join(f", V{i + 1} double" for i in range(k)))


def js_divergence_kv(df: DataFrame, subject: str, key: str, value: str) -> DataFrame:
    """(x, y, value) of each pair of subjects x < y: the Jensen-Shannon sum of their values by key as they stand (make them
    shares for a divergence of distributions), natural logarithms, a zero or lacking value adding nothing for itself.
    Values must not be negative (NULL results). Common keys and the subjects' totals give it, so lacking keys are never
    filled in."""
    v = df.groupBy(col(subject).alias("s"), col(key).alias("k")).agg(F.avg(col(value).cast("double")).alias("v")).where("s is not null and v <> 0")
    own = v.groupBy("s").agg(F.when(F.min("v") >= 0, F.sum("v")).alias("t"))
    p, q = F.col("p"), F.col("q")
    ln2 = math.log(2)
    gain = F.when((p > 0) & (q > 0), p * F.ln(2 * p / (p + q)) + q * F.ln(2 * q / (p + q)) - ln2 * (p + q))
    both = v.toDF("x", "k", "p").join(v.toDF("y", "k", "q"), "k").where("x < y").groupBy("x", "y").agg(F.sum(gain).alias("c"))
    pairs = own.toDF("x", "tx").join(own.toDF("y", "ty"), F.col("x") < F.col("y")).join(both, ["x", "y"], "left")
    return pairs.select("x", "y", (0.5 * (ln2 * (F.col("tx") + F.col("ty")) + F.coalesce("c", F.lit(0.0)))).alias("value"))


def silhouette_curve(df: DataFrame, cols: Sequence[str], max_centers: int = 10, normalize: bool = True, seed: int = 1) -> DataFrame:
    """(centers, within_ss, silhouette) of k-means with 1 to ``max_centers`` centres over the complete rows; the silhouette is
    that of squared distances to clusters, over all rows, and NULL for one centre or fewer distinct rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    from .models import Design

    _, mean, v = _moments(df, cols)
    sd = np.where(np.nan_to_num(np.diag(v)) > 0, np.sqrt(np.nan_to_num(np.diag(v))), 1.0) if normalize else np.ones(len(cols))
    scaled = [(col(c).cast("double") - F.lit(float(m))) / F.lit(float(d)) for c, m, d in zip(cols, np.nan_to_num(mean), sd, strict=True)]
    data = Design(list(cols), list(cols), scaled).rows(df).select("features")
    rows = []
    for k in range(1, max_centers + 1):
        model = KMeans(k=max(2, k), seed=seed).fit(data) if k > 1 else None
        if model is None:
            total = float(np.nan_to_num(np.diag(v) / sd**2).sum() * max(0, data.count() - 1))
            rows.append((1, total, None))
        else:
            several = sum(s > 0 for s in model.summary.clusterSizes) > 1
            rows.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(model.transform(data))) if several else None))
    return df.sparkSession.createDataFrame(rows, "centers int, within_ss double, silhouette double")
