"""Models with tidy results: linear and generalized linear regression, trees and forests, survival regression, k-means,
principal components, frequent itemsets.

Fits run on the cluster with Spark ML or from sufficient statistics of one pass; only results whose size is that of the
model (coefficients, importances, centres, a matrix of columns) reach the driver. Rows with a null in the target or a
predictor take no part. A string or boolean predictor becomes indicators of its levels, the most frequent being the base
(of equally frequent ones the least); levels beyond ``max_levels`` count as "Other".
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "Other"


@dataclass
class Design:
    """The numeric columns that stand for the predictors."""

    predictors: list[str]
    terms: list[str]
    columns: list[Column]

    @classmethod
    def of(cls, df: DataFrame, predictors: Sequence[str], max_levels: int = 20) -> Design:
        types = dict(df.dtypes)
        terms, columns = [], []
        for p in predictors:
            if types[p] not in ("string", "boolean"):
                terms.append(p)
                columns.append(F.col(p).cast("double"))
                continue
            level = F.col(p).cast("string")
            top = df.where(level.isNotNull()).groupBy(level.alias("v")).count().orderBy(F.desc("count"), "v").limit(max_levels + 1).collect()
            kept = [r["v"] for r in top[:max_levels]]
            for v in kept[1:]:
                terms.append(f"{p}{v}")
                columns.append((level == v).cast("double"))
            if len(top) > max_levels:
                terms.append(f"{p}{OTHER}")
                columns.append((~level.isin(kept)).cast("double"))
        return cls(list(predictors), terms, columns)

    def rows(self, df: DataFrame, *also: Column) -> DataFrame:
        """``df`` with ``features``, less the rows with a null in a predictor or in ``also``."""
        complete = F.lit(True)
        for c in [*map(F.col, self.predictors), *also]:
            complete = complete & c.isNotNull()
        return df.where(complete).withColumn("features", array_to_vector(F.array(*self.columns)))


@dataclass
class Regression:
    """A fitted generalized linear model."""

    design: Design
    target: str
    model: object

    def tidy(self, spark) -> DataFrame:
        """(term, estimate, std_error, t_ratio, p_value), the intercept first."""
        s = self.model.summary
        estimates = [*map(float, self.model.coefficients), float(self.model.intercept)]
        rows = list(zip([*self.design.terms, "(Intercept)"], estimates, s.coefficientStandardErrors, s.tValues, s.pValues, strict=True))
        rows = [rows[-1], *rows[:-1]]
        return spark.createDataFrame([(t, *map(float, r)) for t, *r in rows], "term string, estimate double, std_error double, t_ratio double, p_value double")

    def glance(self, spark) -> DataFrame:
        """(n, df_residual, null_deviance, deviance, dispersion, aic, r_squared): r_squared is 1 - deviance / null deviance."""
        s = self.model.summary
        r2 = 1 - s.deviance / s.nullDeviance if s.nullDeviance else None
        row = (int(s.numInstances), int(s.residualDegreeOfFreedom), float(s.nullDeviance), float(s.deviance), float(s.dispersion), float(s.aic), r2)
        return spark.createDataFrame([row], "n long, df_residual long, null_deviance double, deviance double, dispersion double, aic double, r_squared double")

    def augment(self, df: DataFrame) -> DataFrame:
        """``df``'s complete rows with ``predicted_value`` and ``residual``."""
        out = self.model.setPredictionCol("predicted_value").transform(self.design.rows(df))
        return out.withColumn("residual", F.col(self.target).cast("double") - F.col("predicted_value")).drop("features")


def glm(df: DataFrame, target: str, predictors: Sequence[str], family: str = "gaussian", link: str | None = None, max_levels: int = 20, reg: float = 0.0) -> Regression:
    """Families gaussian, binomial, poisson, gamma; a boolean target counts as 0 and 1."""
    from pyspark.ml.regression import GeneralizedLinearRegression

    design = Design.of(df.where(F.col(target).isNotNull()), predictors, max_levels)
    label = F.col(target).cast("double")
    data = design.rows(df, label).select("features", label.alias("label"))
    est = GeneralizedLinearRegression(family=family, featuresCol="features", labelCol="label", regParam=reg, maxIter=50, tol=1e-10)
    if link:
        est = est.setLink(link)
    return Regression(design, target, est.fit(data))


def lm(df: DataFrame, target: str, predictors: Sequence[str], **options) -> Regression:
    """Ordinary least squares."""
    return glm(df, target, predictors, "gaussian", **options)


def lm_by(df: DataFrame, keys: Sequence[str], target: str, predictor: str) -> DataFrame:
    """(keys, intercept, slope, r_squared, n) of a line in each group, by one grouped aggregation."""
    y, x = F.col(target), F.col(predictor)
    return df.groupBy(*keys).agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r_squared"), F.regr_count(y, x).alias("n"))


@dataclass
class Tree:
    """A fitted tree or forest; ``labels`` are a classifier's classes by index, most frequent first."""

    design: Design
    model: object
    labels: list[str] | None

    def importance(self, spark) -> DataFrame:
        """(variable, importance), summed over a predictor's indicators."""
        total = dict.fromkeys(self.design.predictors, 0.0)
        for term, v in zip(self.design.terms, self.model.featureImportances.toArray(), strict=True):
            owner = max((p for p in total if term.startswith(p)), key=len)
            total[owner] += float(v)
        return spark.createDataFrame(list(total.items()), "variable string, importance double")

    def augment(self, df: DataFrame) -> DataFrame:
        """``df``'s complete rows with ``predicted_value`` and, for classes, ``predicted_label``."""
        out = self.model.setPredictionCol("predicted_value").transform(self.design.rows(df))
        if self.labels is not None:
            out = out.withColumn("predicted_label", F.array(*map(F.lit, self.labels))[F.col("predicted_value").cast("int")])
        return out.drop("features", "rawPrediction", "probability")


def tree(df: DataFrame, target: str, predictors: Sequence[str], trees: int = 1, max_depth: int = 5, max_levels: int = 20, max_classes: int = 100, seed: int = 1) -> Tree:
    """A decision tree, or a forest of ``trees``; string and boolean targets are classes, of which more than
    ``max_classes`` are an error."""
    from pyspark.ml import classification as c
    from pyspark.ml import regression as r

    design = Design.of(df.where(F.col(target).isNotNull()), predictors, max_levels)
    labels, label = None, F.col(target).cast("double")
    if dict(df.dtypes)[target] in ("string", "boolean"):
        name = F.col(target).cast("string")
        top = df.where(name.isNotNull()).groupBy(name.alias("v")).count().orderBy(F.desc("count"), "v").limit(max_classes + 1).collect()
        if len(top) > max_classes:
            raise ValueError(f"over {max_classes} classes")
        labels = [x["v"] for x in top]
        label = F.array_position(F.array(*map(F.lit, labels)), name).cast("double") - 1
    options = dict(featuresCol="features", labelCol="label", maxDepth=max_depth, seed=seed)
    if trees > 1:
        est = (r.RandomForestRegressor if labels is None else c.RandomForestClassifier)(numTrees=trees, **options)
    else:
        est = (r.DecisionTreeRegressor if labels is None else c.DecisionTreeClassifier)(**options)
    return Tree(design, est.fit(design.rows(df, F.col(target)).select("features", label.alias("label"))), labels)


def multinomial(df: DataFrame, target: str, predictors: Sequence[str], max_levels: int = 20, max_classes: int = 100) -> DataFrame:
    """(class, term, estimate, odds_ratio) of a multinomial logit, each class against the least one."""
    from pyspark.ml.classification import LogisticRegression

    name = F.col(target).cast("string")
    classes = [r[0] for r in df.where(name.isNotNull()).select(name).distinct().orderBy(name).limit(max_classes + 1).collect()]
    if not 2 <= len(classes) <= max_classes:
        raise ValueError(f"2 to {max_classes} classes")
    design = Design.of(df.where(name.isNotNull()), predictors, max_levels)
    label = F.array_position(F.array(*map(F.lit, classes)), name).cast("double") - 1
    m = LogisticRegression(family="multinomial", standardization=True, tol=1e-12, maxIter=500).fit(design.rows(df, F.col(target)).select("features", label.alias("label")))
    c = np.column_stack([m.interceptVector.toArray(), m.coefficientMatrix.toArray()])
    rows = [(k, t, float(v), float(np.exp(v))) for k, own in zip(classes[1:], c[1:] - c[0], strict=True) for t, v in zip(["(Intercept)", *design.terms], own, strict=True)]
    return df.sparkSession.createDataFrame(rows, "class string, term string, estimate double, odds_ratio double")


def boosted(df: DataFrame, target: str, predictors: Sequence[str], rounds: int = 10, max_depth: int = 5, step: float = 0.3, max_levels: int = 20, seed: int = 1) -> Tree:
    """Boosted trees for a numeric target or one of two classes; three or more classes are an error."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    design = Design.of(df.where(F.col(target).isNotNull()), predictors, max_levels)
    labels, label = None, F.col(target).cast("double")
    if dict(df.dtypes)[target] in ("string", "boolean"):
        name = F.col(target).cast("string")
        labels = [r[0] for r in df.where(name.isNotNull()).select(name).distinct().orderBy(name).limit(3).collect()]
        if len(labels) != 2:
            raise ValueError("not two classes")
        label = (name == labels[1]).cast("double")
    est = (GBTRegressor if labels is None else GBTClassifier)(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=max_depth, stepSize=step, seed=seed)
    return Tree(design, est.fit(design.rows(df, F.col(target)).select("features", label.alias("label"))), labels)


def ordinal(df: DataFrame, target: str, order: Sequence[str], predictors: Sequence[str], max_levels: int = 20, rounds: int = 50) -> DataFrame:
    """(term, estimate, odds_ratio, std_error, z) of a proportional-odds model of the ordered classes ``order``: thresholds
    ("a|b") and slopes by Fisher scoring, each step one pass that adds a small matrix for each batch. Classes without
    rows are left out; fewer than two are an error. Rows of other classes take no part."""
    name = F.col(target).cast("string")
    sizes = {r["k"]: r["n"] for r in df.where(name.isin(list(order))).groupBy(name.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = [c for c in order if c in sizes]
    if len(classes) < 2:
        raise ValueError("fewer than two classes with rows")
    design = Design.of(df.where(name.isin(classes)), predictors, max_levels)
    y = F.array_position(F.array(*map(F.lit, classes)), name).cast("int") - 1
    complete = F.lit(True)
    for p in design.predictors:
        complete = complete & F.col(p).isNotNull()
    x = F.array(*design.columns) if design.columns else F.array().cast("array<double>")
    data = df.where(name.isin(classes) & complete).select(y.alias("y"), x.alias("x"))
    k, p = len(classes) - 1, len(design.terms)
    below = np.cumsum([sizes[c] for c in classes])[:-1] / sum(sizes.values())
    scale = np.ones(p)
    if p:
        s = data.select(*[F.col("x")[i].alias(f"x{i}") for i in range(p)]).agg(*[F.stddev_samp(f"x{i}") for i in range(p)]).first()
        scale = np.array([v if v else 1.0 for v in s], float)

    def sums(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches):
            import pyarrow as pa

            for b in batches:
                n = len(b)
                yy, xx = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, p) / scale
                eta = xx @ theta[k:]
                f = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-np.clip(theta[:k] - eta[:, None], -500, 500))), np.ones((n, 1))], 1)
                slope = f * (1 - f)
                prob = np.maximum(np.diff(f, axis=1), 1e-300)
                info, grad, like = np.zeros((k + p, k + p)), np.zeros(k + p), float(np.log(prob[np.arange(n), yy]).sum())
                for c in range(k + 1):
                    d = np.zeros((n, k + p))
                    if c < k:
                        d[:, c] += slope[:, c + 1]
                    if c:
                        d[:, c - 1] -= slope[:, c]
                    d[:, k:] = -(slope[:, c + 1] - slope[:, c])[:, None] * xx
                    grad += (d[yy == c] / prob[yy == c, c][:, None]).sum(0)
                    info += (d / prob[:, c][:, None]).T @ d
                yield pa.RecordBatch.from_arrays([pa.array([[like, *grad, *info.ravel()]], pa.list_(pa.float64()))], names=["v"])

        got = data.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        v = np.array([r["v"] for r in sorted(got, key=lambda r: r["i"])])
        return v[0], v[1 : 1 + k + p], v[1 + k + p :].reshape(k + p, k + p)

    theta = np.concatenate([np.log(below / (1 - below)), np.zeros(p)])
    now, g, h = sums(theta)
    for _ in range(rounds):
        step = np.linalg.pinv(h) @ g
        for _ in range(20):  # half steps while the likelihood falls or thresholds cross
            new = theta + step
            if (np.diff(new[:k]) > 0).all():
                value, ng, nh = sums(new)
                if value >= now - 1e-9 * abs(now):
                    break
            step = step / 2
        else:
            break
        done = np.abs(step).max() < 1e-8
        theta, now, g, h = new, value, ng, nh
        if done:
            break
    unit = np.concatenate([np.ones(k), scale])
    error = np.sqrt(np.maximum(np.diag(np.linalg.pinv(h)), 0)) / unit
    theta = theta / unit
    terms = [f"{a}|{b}" for a, b in zip(classes, classes[1:], strict=False)] + design.terms
    rows = [(t, float(v), float(np.exp(v)) if i >= k else None, float(e), float(v / e) if e else None) for i, (t, v, e) in enumerate(zip(terms, theta, error, strict=True))]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, odds_ratio double, std_error double, z double")


def survival_regression(df: DataFrame, time: str, event: str, predictors: Sequence[str], max_levels: int = 20) -> DataFrame:
    """(term, estimate) of a Weibull accelerated failure time model; ``event`` is true where the end was seen."""
    from pyspark.ml.regression import AFTSurvivalRegression

    design = Design.of(df, predictors, max_levels)
    t, e = F.col(time).cast("double"), F.col(event).cast("double")
    data = design.rows(df, t, e).where(t > 0).select("features", t.alias("label"), e.alias("censor"))
    m = AFTSurvivalRegression(featuresCol="features", labelCol="label", censorCol="censor").fit(data)
    rows = [("(Intercept)", float(m.intercept)), *zip(design.terms, map(float, m.coefficients), strict=True), ("(Scale)", float(m.scale))]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double")


def kmeans(df: DataFrame, cols: Sequence[str], centers: int = 3, normalize: bool = False, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(``df``'s complete rows with ``cluster`` from 1, centres as (cluster, variable, value, size)); clusters are numbered by
    size, then by centre. ``normalize`` works on standard scores; centres are in the columns' own units."""
    from pyspark.ml.clustering import KMeans

    mean, sd = np.zeros(len(cols)), np.ones(len(cols))
    if normalize:
        s = df.dropna(subset=list(cols)).agg(*[f(F.col(c).cast("double")) for c in cols for f in (F.avg, F.stddev_samp)]).first()
        mean, sd = np.array(s[::2], float), np.array([v if v else 1.0 for v in s[1::2]], float)
    scaled = [(F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(d)) for c, m, d in zip(cols, mean, sd, strict=True)]
    data = Design(list(cols), list(cols), scaled).rows(df)
    model = KMeans(k=centers, seed=seed, featuresCol="features", predictionCol="cluster").fit(data)
    at, sizes = [c * sd + mean for c in model.clusterCenters()], model.summary.clusterSizes
    order = sorted(range(len(at)), key=lambda i: (-sizes[i], tuple(at[i])))
    number = F.array(*[F.lit(order.index(i) + 1) for i in range(len(at))])
    rows = [(n + 1, c, float(v), int(sizes[i])) for n, i in enumerate(order) for c, v in zip(cols, at[i], strict=True)]
    out = model.transform(data).withColumn("cluster", number[F.col("cluster")]).drop("features")
    return out, df.sparkSession.createDataFrame(rows, "cluster int, variable string, value double, size long")


@dataclass
class Components:
    cols: list[str]
    mean: np.ndarray
    scale: np.ndarray
    variances: np.ndarray
    loadings: np.ndarray

    def variance(self, spark) -> DataFrame:
        """(component, standard_deviation, proportion, cumulative)."""
        share = self.variances / self.variances.sum()
        rows = [(i + 1, float(np.sqrt(v)), float(s), float(c)) for i, (v, s, c) in enumerate(zip(self.variances, share, np.cumsum(share), strict=True))]
        return spark.createDataFrame(rows, "component int, standard_deviation double, proportion double, cumulative double")

    def scores(self, df: DataFrame, n: int | None = None) -> DataFrame:
        """``df``'s complete rows with PC1, PC2, ..."""
        x = [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(self.cols, self.mean, self.scale, strict=True)]
        rows = df.dropna(subset=self.cols)
        return rows.select("*", *[sum((v * F.lit(float(w)) for v, w in zip(x, self.loadings[:, k], strict=True)), F.lit(0.0)).alias(f"PC{k + 1}") for k in range(n or len(self.cols))])


def prcomp(df: DataFrame, cols: Sequence[str], scale: bool = True, max_columns: int = 200) -> Components:
    """Principal components from the matrix of covariances of the complete rows, computed in one pass; a component's
    largest loading is positive. More than ``max_columns`` columns are an error."""
    if len(cols) > max_columns:
        raise ValueError(f"over {max_columns} columns")
    rows, p = df.dropna(subset=list(cols)), len(cols)
    pairs = list(combinations(range(p), 2))
    got = rows.agg(*[f(c) for c in cols for f in (F.avg, F.var_samp)], *[F.covar_samp(cols[i], cols[j]) for i, j in pairs]).first()
    mean, var = np.array(got[: 2 * p : 2], float), np.array(got[1 : 2 * p : 2], float)
    m = np.diag(var)
    for (i, j), v in zip(pairs, got[2 * p :], strict=True):
        m[i, j] = m[j, i] = v
    sd = np.where(var > 0, np.sqrt(var), 1.0) if scale else np.ones(p)
    values, vectors = np.linalg.eigh(m / np.outer(sd, sd))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(p)])
    return Components(list(cols), mean, sd, values, vectors)


def dist_cols(df: DataFrame, cols: Sequence[str], method: str = "euclidean") -> DataFrame:
    """(pair_name_x, pair_name_y, value) between columns over the rows that have both, in one pass. Methods: euclidean,
    manhattan, maximum."""
    pairs = list(combinations(sorted(cols), 2))
    gap = [F.abs(F.col(a) - F.col(b)) for a, b in pairs]
    each = {"euclidean": lambda g: F.sqrt(F.sum(g * g)), "manhattan": F.sum, "maximum": F.max}[method]
    one = df.agg(*[each(g).alias(f"d{i}") for i, g in enumerate(gap)])
    rows = F.array(*[F.struct(F.lit(a).alias("pair_name_x"), F.lit(b).alias("pair_name_y"), F.col(f"d{i}").cast("double").alias("value")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def _baskets(df: DataFrame, basket: str, item: str) -> DataFrame:
    return df.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).groupBy(basket).agg(F.collect_set(F.col(item).cast("string")).alias("items"))


def apriori(df: DataFrame, basket: str, item: str, min_support: float = 0.1, min_confidence: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(frequent itemsets as (items, freq), rules as (lhs, rhs, support, confidence, lift)); sets are sorted and joined by
    ", ". Rules have one item on the right. By parallel FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    m = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(_baskets(df, basket, item))
    text = lambda c: F.array_join(F.array_sort(c), ", ")
    rules = m.associationRules.select(text("antecedent").alias("lhs"), text("consequent").alias("rhs"), "support", "confidence", "lift")
    return m.freqItemsets.select(text("items").alias("items"), "freq"), rules
