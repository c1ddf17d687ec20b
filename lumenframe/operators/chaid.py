"""CHAID trees: multiway splits by chi-squared tests of merged categories.

A depth of the tree takes one pass: counts by node, predictor, category and class, whose number does not grow with the
rows, reach the driver, which merges categories and picks splits. Numeric predictors are cut at quantiles (approximate, to
a thousandth of the rows) or into equal widths, and only neighbouring bins merge; a missing value is a category of its own,
the last one. Categories beyond the ``max_categories`` most frequent (ties by name) count as "Other"; a class column of more
than ``max_classes`` values is an error. Rows without a class take no part in the fit. A row whose category a split has not
seen stays at the node.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.distributions import p_chi_squared

MISSING, OTHER = "(Missing)", "Other"


def chi_squared_test(counts: np.ndarray, method: str = "pearson") -> tuple[float, int, float]:
    """(statistic, df, p) of independence, by Pearson's sum or the likelihood ratio; empty rows and columns do not count. With
    one row or column left, (0, 0, 1)."""
    n = counts[counts.sum(1) > 0][:, counts.sum(0) > 0].astype(float)
    df = max(0, n.shape[0] - 1) * max(0, n.shape[1] - 1)
    if not df:
        return 0.0, 0, 1.0
    e = np.outer(n.sum(1), n.sum(0)) / n.sum()
    if method == "pearson":
        x = float(((n - e) ** 2 / e).sum())
    else:
        x = float(2 * (n * np.log(np.where(n > 0, n, 1) / e)).sum())
    return x, df, float(p_chi_squared(x, df))


def bonferroni(p: float, tests: int, on: bool = True) -> float:
    return min(1.0, p * max(1, tests)) if on else p


def merge_categories(names: list[str], counts: np.ndarray, ordered: bool, alpha: float = 0.05, adjust: bool = True, method: str = "pearson") -> tuple[list[list[int]], list[tuple[list[str], float, float]]]:
    """(groups of categories, merges as (names, p, adjusted p)): the two groups that differ least are merged while their
    adjusted p is above ``alpha``. ``counts``: a column for each category, a row for each class."""
    groups, history = [[i] for i in range(len(names))], []
    tested: dict = {}
    while len(groups) > 1:
        pairs = [(i, i + 1) for i in range(len(groups) - 1)] if ordered else [(i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))]
        best, p = pairs[0], -1.0
        for i, j in pairs:
            key = (tuple(groups[i]), tuple(groups[j]))
            if key not in tested:
                tested[key] = chi_squared_test(np.column_stack([counts[:, groups[i]].sum(1), counts[:, groups[j]].sum(1)]), method)[2]
            if tested[key] > p:
                best, p = (i, j), tested[key]
        adjusted = bonferroni(p, len(pairs), adjust)
        if adjusted <= alpha:
            break
        i, j = best
        groups[i] = groups[i] + groups[j]
        history.append(([names[k] for k in groups[i]], p, adjusted))
        del groups[j]
    return groups, history


@dataclass
class Node:
    id: int
    parent: int | None
    depth: int
    rule: str
    counts: np.ndarray
    predictor: int | None = None
    statistic: float | None = None
    df: int | None = None
    p: float | None = None
    adjusted: float | None = None
    children: list[tuple[int, list[str]]] = field(default_factory=list)


@dataclass
class Chaid:
    """A fitted tree. ``levels``: each predictor's category as a column; ``merges``: (node, predictor, group, p, adjusted p)."""

    target: str
    predictors: list[str]
    classes: list[str]
    levels: list[Column]
    nodes: list[Node]
    merges: list[tuple[int, str, str, float, float]]

    def _placed(self, df: DataFrame, *columns: Column) -> DataFrame:
        """``columns`` with each predictor's category ``__l0``, ... and the row's ``__node``."""
        out = df.select(*columns, *[c.alias(f"__l{i}") for i, c in enumerate(self.levels)], F.lit(1).alias("__node"))
        for depth in sorted({n.depth for n in self.nodes if n.children}):
            at = F.col("__node")
            step = F
            for n in self.nodes:
                if n.depth == depth:
                    for child, names in n.children:
                        step = step.when((at == n.id) & F.col(f"__l{n.predictor}").isin(names), child)
            out = out.withColumn("__node", step.otherwise(at))
        return out

    def augment(self, df: DataFrame) -> DataFrame:
        """``df`` with ``node``, ``predicted_label`` (the node's most frequent class, the first by name of equals) and
        ``predicted_probability`` (that class's share)."""
        placed = self._placed(df, F.struct(*map(col, df.columns)).alias("__row"))
        best = {n.id: int(n.counts.argmax()) for n in self.nodes}
        labels = F.array(*[F.lit(self.classes[best[n.id]]) for n in self.nodes])
        shares = F.array(*[F.lit(float(n.counts[best[n.id]] / n.counts.sum())) for n in self.nodes])
        at = F.col("__node") - 1
        return placed.select("__row.*", F.col("__node").alias("node"), labels[at].alias("predicted_label"), shares[at].alias("predicted_probability"))

    def probabilities(self, df: DataFrame) -> DataFrame:
        """``df`` with ``node`` and ``probabilities``, a map of classes."""
        placed = self._placed(df, F.struct(*map(col, df.columns)).alias("__row"))
        each = F.array(*[F.create_map(*[v for c, k in zip(self.classes, n.counts / n.counts.sum(), strict=True) for v in (F.lit(c), F.lit(float(k)))]) for n in self.nodes])
        return placed.select("__row.*", F.col("__node").alias("node"), each[F.col("__node") - 1].alias("probabilities"))

    def node_summary(self, spark) -> DataFrame:
        """(node, parent, depth, n, predicted_label, probability, leaf, rule)."""
        rows = [(n.id, n.parent, n.depth, int(n.counts.sum()), self.classes[int(n.counts.argmax())], float(n.counts.max() / n.counts.sum()), not n.children, n.rule) for n in self.nodes]
        return spark.createDataFrame(rows, "node int, parent int, depth int, n long, predicted_label string, probability double, leaf boolean, rule string")

    def rule_table(self, spark) -> DataFrame:
        """(node, rule, n, predicted_label, probability) of the leaves."""
        return self.node_summary(spark).where("leaf").select("node", "rule", "n", "predicted_label", "probability")

    def split_summary(self, spark) -> DataFrame:
        """(node, predictor, groups, statistic, df, p_value, adjusted_p_value) of the split nodes."""
        rows = [(n.id, self.predictors[n.predictor], len(n.children), n.statistic, n.df, n.p, n.adjusted) for n in self.nodes if n.children]
        return spark.createDataFrame(rows, "node int, predictor string, groups int, statistic double, df int, p_value double, adjusted_p_value double")

    def merge_table(self, spark) -> DataFrame:
        """(node, predictor, categories, p_value, adjusted_p_value) of the merges of all predictors tried."""
        return spark.createDataFrame(self.merges, "node int, predictor string, categories string, p_value double, adjusted_p_value double")

    def errors(self, df: DataFrame) -> DataFrame:
        """(node, n, errors, error_rate) of the rows that have a class."""
        out = self.augment(df.where(col(self.target).isNotNull())).withColumn("__wrong", (col(self.target).cast("string") != F.col("predicted_label")).cast("int"))
        return out.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("__wrong").alias("errors"), F.avg("__wrong").alias("error_rate"))


def _categories(df: DataFrame, predictors: Sequence[str], bins: int, binning: str, max_categories: int) -> tuple[list[Column], list[list[str]], list[bool]]:
    """(each predictor's category as a column, the categories in order, whether their order counts)."""
    types = dict(df.dtypes)
    columns, names, ordered = [], [], []
    for p in predictors:
        x = col(p)
        if types[p] in ("string", "boolean") or binning == "none":
            x = x.cast("string")
            top = [r["v"] for r in df.where(x.isNotNull()).groupBy(x.alias("v")).count().orderBy(F.desc("count"), "v").limit(max_categories + 1).collect()]
            kept = top[:max_categories]
            known = F.when(x.isin(kept), x).otherwise(OTHER) if len(top) > max_categories else x
            columns.append(F.coalesce(known, F.lit(MISSING)))
            names.append(sorted(kept) + [OTHER] * (len(top) > max_categories) + [MISSING])
            ordered.append(False)
            continue
        x = x.cast("double")
        if binning == "quantile":
            cuts = df.select(x.alias("x")).where("x is not null and not isnan(x)").approxQuantile("x", [i / bins for i in range(1, bins)], 1e-3)
        else:
            s = df.where(~F.isnan(x)).agg(F.min(x), F.max(x)).first()
            cuts = [] if s[0] is None else [s[0] + (s[1] - s[0]) * i / bins for i in range(1, bins)]
        cuts = sorted(set(cuts))
        labels = [f"<= {cuts[0]:g}", *[f"({a:g}, {b:g}]" for a, b in zip(cuts, cuts[1:], strict=False)], f"> {cuts[-1]:g}"] if cuts else ["all"]
        labels = [v if labels.count(v) == 1 else f"{v} #{i}" for i, v in enumerate(labels)]
        case = F.when(x.isNull() | F.isnan(x), MISSING)
        for c, v in zip(cuts, labels, strict=False):
            case = case.when(x <= c, v)
        columns.append(case.otherwise(labels[-1]))
        names.append([*labels, MISSING])
        ordered.append(True)
    return columns, names, ordered


def chaid(df: DataFrame, target: str, predictors: Sequence[str], alpha_split: float = 0.05, alpha_merge: float = 0.05, max_depth: int = 3, min_split: int = 50, min_bucket: int = 20, binning: str = "quantile", bins: int = 10, adjust: bool = True, method: str = "pearson", max_categories: int = 50, max_classes: int = 100) -> Chaid:
    """Grow a tree. A node of ``min_split`` rows is split by the predictor with the least p (adjusted by the number tried;
    the first of equals), if it is at most ``alpha_split`` and each group has ``min_bucket`` rows. No row: an error."""
    predictors = list(predictors)
    y = col(target).cast("string")
    rows = df.where(y.isNotNull())
    classes = [r[0] for r in rows.select(y).distinct().orderBy(y).limit(max_classes + 1).collect()]
    if not 0 < len(classes) <= max_classes:
        raise ValueError(f"1 to {max_classes} classes")
    columns, names, ordered = _categories(rows, predictors, bins, binning, max_categories)
    tree = Chaid(target, predictors, classes, columns, [], [])
    number = {c: i for i, c in enumerate(classes)}
    open_nodes: list[int] = [1]
    for depth in range(max_depth + 1):
        placed = tree._placed(rows, y.alias("__y")).where(F.col("__node").isin(open_nodes))
        long = placed.select("__node", "__y", F.explode(F.array(F.struct(F.lit(-1).alias("p"), F.lit("").alias("v")), *[F.struct(F.lit(i).alias("p"), F.col(f"__l{i}").alias("v")) for i in range(len(predictors))])).alias("x"))
        tables: dict = {}
        for r in long.groupBy("__node", "x.p", "x.v", "__y").agg(F.count(F.lit(1)).alias("n")).collect():
            tables.setdefault((r["__node"], r["p"]), {}).setdefault(r["v"], np.zeros(len(classes), np.int64))[number[r["__y"]]] = r["n"]
        if not depth:
            tree.nodes.append(Node(1, None, 0, "", tables[1, -1][""]))
        grown = []
        for node in [n for n in tree.nodes if n.id in open_nodes]:
            if depth == max_depth or node.counts.sum() < min_split or (node.counts > 0).sum() < 2:
                continue
            tried = []
            for i, p in enumerate(predictors):
                seen = [v for v in names[i] if v in tables.get((node.id, i), {})]
                counts = np.column_stack([tables[node.id, i][v] for v in seen])
                groups, history = merge_categories(seen, counts, ordered[i], alpha_merge, adjust, method)
                tree.merges += [(node.id, p, " + ".join(g), a, b) for g, a, b in history]
                sums = np.column_stack([counts[:, g].sum(1) for g in groups])
                if len(groups) > 1 and sums.sum(0).min() >= min_bucket:
                    tried.append((*chi_squared_test(sums, method), i, [[seen[k] for k in g] for g in groups], sums))
            if not tried:
                continue
            x, d, p, i, groups, sums = min(tried, key=lambda t: (t[2], -t[0], t[3]))
            adjusted = bonferroni(p, len(tried), adjust)
            if adjusted > alpha_split:
                continue
            node.predictor, node.statistic, node.df, node.p, node.adjusted = i, x, d, p, adjusted
            for k, g in enumerate(groups):
                rule = f"{predictors[i]} in ({', '.join(g)})"
                child = Node(len(tree.nodes) + 1, node.id, depth + 1, f"{node.rule} and {rule}" if node.rule else rule, sums[:, k])
                tree.nodes.append(child)
                node.children.append((child.id, g))
                grown.append(child.id)
        open_nodes = grown
        if not grown:
            break
    return tree
