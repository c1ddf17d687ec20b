"""Pairs of hot groups, scaling, singular vectors, power, ordinal and boosted models, beside plain versions."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lumenframe.operators import evaluation, models, multivariate, pairs, power, stats, text


def test_pairs_by_blocks_equal_those_of_one_list(spark):
    rows = [(g, v) for g, n in (("hot", 60), ("one", 1), ("few", 7), (None, 12)) for v in range(n)]
    df = spark.createDataFrame([*rows, *rows[:9], ("few", None)], "g string, v int")
    got = {(r["value_x"], r["value_y"]): r["n"] for r in text.pair_count(df, "g", "v", block=8).collect()}
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    assert got == Counter(p for vs in by.values() for p in combinations(sorted(vs), 2))
    both = text.pair_count(df, "g", "v", distinct=False, diag=True, block=8)
    assert both.count() == 60 * 60
    assert pairs.group_pairs(df.limit(0), df["g"], df["v"]).count() == 0


def test_cosine_of_a_hot_key(spark):
    rnd = random.Random(3)
    rows = [(s, k, rnd.random()) for s in range(25) for k in ("a", "b", "c") if k == "a" or rnd.random() < 0.4]
    df = spark.createDataFrame(rows, "s int, `k.x` string, v double")
    got = {(r["x"], r["y"]): r["similarity"] for r in stats.cosine_similarity(df, "s", "k.x", "v", block=4).collect()}
    v = np.zeros((25, 3))
    for s, k, x in rows:
        v[s, "abc".index(k)] = x
    v /= np.linalg.norm(v, axis=1)[:, None]
    assert len(got) == 300 and all(got[a, b] == pytest.approx(v[a] @ v[b]) for a, b in got)


def test_scaling_keeps_distances(spark):
    p = np.random.default_rng(1).normal(size=(7, 2))
    rows = [(str(i), str(j), float(np.linalg.norm(p[i] - p[j]))) for i in range(7) for j in range(i)]
    got = {r["name"]: np.array([r["V1"], r["V2"]]) for r in multivariate.cmdscale(spark.createDataFrame(rows, "x string, y string, d double"), "x", "y", "d").collect()}
    assert all(np.linalg.norm(got[a] - got[b]) == pytest.approx(d) for a, b, d in rows)
    assert multivariate.cmdscale(spark.createDataFrame([], "x string, y string, d double"), "x", "y", "d").count() == 0


def test_svd_equals_numpy(spark):
    x = np.random.default_rng(2).normal(size=(40, 3)) @ np.diag([5, 2, 1])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(99, None, 1.0, 1.0)], "i int, a double, b double, c double")
    scores, right, values = multivariate.svd_cols(df, ["a", "b", "c"], 3)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert [r["value"] for r in values.orderBy("component").collect()] == pytest.approx(s)
    got = np.array([[r["axis1"], r["axis2"], r["axis3"]] for r in scores.orderBy("i").collect()])
    assert np.abs(got) == pytest.approx(np.abs(u)) and right.count() == 9
    assert multivariate.svd_cols(df.limit(0), ["a", "b"])[0].count() == 0


def test_reliability_and_correspondence_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 3.0, 1.0), (4.0, 3.0, 1.0), (None, 1.0, 1.0)], "a double, b double, c double")
    total, items = multivariate.cronbach_alpha(df, ["a", "b"])
    x = np.array([[1, 2], [2, 3], [4, 3]])
    assert total.first()["raw_alpha"] == pytest.approx(2 * (1 - x.var(0, ddof=1).sum() / x.sum(1).var(ddof=1))) and total.first()["n"] == 3
    assert items.count() == 2 and multivariate.cronbach_alpha(df.limit(0), ["a", "b"])[0].first()["raw_alpha"] is None
    rows = [("p", "x")] * 5 + [("p", "y")] * 2 + [("q", "y")] * 6 + [("r", "x")] * 3 + [("r", "z")] * 4 + [(None, "x")]
    values, points = multivariate.correspondence(spark.createDataFrame(rows, "a string, b string"), "a", "b")
    n = np.array([[5, 2, 0], [0, 6, 0], [3, 0, 4]])
    e = np.outer(n.sum(1), n.sum(0)) / n.sum()
    assert sum(r["eigenvalue"] for r in values.collect()) == pytest.approx(((n - e) ** 2 / e).sum() / n.sum())
    assert points.count() == 12 and multivariate.correspondence(df.limit(0), "a", "b")[0].count() == 0


def test_power(spark):
    # two.sided, two groups of 64 at d = 0.5 have a power of about 0.8015; a paired test of 34 pairs 0.8078
    assert power.t_power(128, 0.5) == pytest.approx(0.80146, abs=2e-4)
    assert power.t_power(34, 0.5, paired=True) == pytest.approx(0.8078, abs=5e-4)
    assert power.t_power(50, 0.0) == pytest.approx(0.05, abs=1e-6)
    assert power.t_quantile(0.975, 10) == pytest.approx(2.2281389, abs=1e-6) and power.chi_squared_quantile(0.95, 1) == pytest.approx(3.8414588, abs=1e-6)
    z = 1.959963984540054
    exact = sum(math.erfc((z + s * math.sqrt(785) * 0.1) / math.sqrt(2)) / 2 for s in (-1, 1))
    assert power.chi_squared_power(785, 0.1, 1) == pytest.approx(exact, abs=1e-9)
    curve, need = power.chi_squared_power_curve(spark, 0.1)
    assert curve.count() == 100 and need.first()["required_n"] == pytest.approx(784.886, abs=0.01)
    assert power.t_power_curve(spark, 0.5, last=30)[1].first()["required_n"] == pytest.approx(127.53, abs=0.05)


def test_bayes_ab(spark):
    rows = [("a", i < 20) for i in range(100)] + [("b", i < 30) for i in range(110)] + [("b", None), (None, True)]
    a, b = power.bayes_ab(spark.createDataFrame(rows, "g string, x boolean"), "x", "g", "a", "b").collect()
    g = np.random.default_rng(5)
    draws = (g.beta(31, 81, 400_000) > g.beta(21, 81, 400_000)).mean()
    assert b["chance_of_being_better"] == pytest.approx(draws, abs=4e-3) and a["chance_of_being_better"] + b["chance_of_being_better"] == pytest.approx(1)
    assert (a["n"], b["n"], b["converted"]) == (100, 110, 30)


def test_ordinal_is_the_likelihoods_top(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(300, 2)) * [1, 30]
    y = np.digitize(1.2 * x[:, 0] - 0.03 * x[:, 1] + g.logistic(size=300), [-1, 0.5])
    df = spark.createDataFrame([("lmh"[k], *map(float, r)) for k, r in zip(y, x, strict=True)] + [("l", None, 1.0), ("odd", 1.0, 1.0)], "y string, u double, v double")
    got = {r["term"]: r["estimate"] for r in models.ordinal(df, "y", ["l", "m", "none", "h"], ["u", "v"]).collect()}
    assert set(got) == {"l|m", "m|h", "u", "v"}

    def like(t):
        f = 1 / (1 + np.exp(-(np.array(t[:2]) - (x @ t[2:])[:, None])))
        return np.log(np.diff(np.column_stack([np.zeros(300), f, np.ones(300)]))[np.arange(300), y]).sum()

    best = [got["l|m"], got["m|h"], got["u"], got["v"]]
    for i in range(4):
        for h in (1e-3, -1e-3):
            near = list(best)
            near[i] += h * (0.05 if i == 3 else 1)
            assert like(near) < like(best)


def test_boosted_learns_and_refuses_three_classes(spark):
    rows = [(float(i % 17), "yes" if i % 17 > 8 else "no", float((i % 17) ** 2)) for i in range(170)]
    df = spark.createDataFrame(rows, "x double, c string, y double")
    got = models.boosted(df, "c", ["x"], rounds=3).augment(df)
    assert got.where("c = predicted_label").count() == 170
    assert models.boosted(df, "y", ["x"], rounds=5).augment(df).where("abs(y - predicted_value) > 60").count() == 0
    with pytest.raises(ValueError):
        models.boosted(spark.createDataFrame([(1.0, c) for c in "abc"], "x double, c string"), "c", ["x"])


def test_silhouette_curve_and_bins(spark):
    df = spark.createDataFrame([(float(c * 100 + i % 5), i % 2 == 0, "ab"[i % 2]) for c in range(3) for i in range(20)], "x double, t boolean, s string")
    got = multivariate.silhouette_curve(df, ["x"], 4).orderBy("centers").collect()
    assert max(got[1:], key=lambda r: r["silhouette"])["centers"] == 3 and got[0]["silhouette"] is None
    assert all(a["within_ss"] >= b["within_ss"] - 1e-9 for a, b in zip(got, got[1:], strict=False))
    assert {(r["x"], r["actual"], r["n"]) for r in evaluation.binned_actual(df, "t", "s").collect()} == {("a", 1.0, 30), ("b", 0.0, 30)}
    assert sum(r["n"] for r in evaluation.binned_actual(df, "t", "x").collect()) == 60 and evaluation.binned_actual(df.limit(0), "t", "x").count() == 0
