"""CHAID trees on planted structure, and their edges."""

import random

import numpy as np
import pytest

from lumenframe.operators import chaid


def test_finds_planted_groups(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(1200):
        c, x, noise = rnd.choice("abcd"), rnd.random() * 10, rnd.choice("uvw")
        p = 0.9 if c in "ab" else (0.8 if x > 5 else 0.1)
        rows.append((c if i % 50 else None, x, noise, "yes" if rnd.random() < p else "no", i))
    df = spark.createDataFrame([*rows, ("a", 1.0, "u", None, -1)], "`c.x` string, x double, noise string, y string, node int")
    t = chaid.chaid(df, "y", ["c.x", "x", "noise"])
    root = t.nodes[0]
    assert t.predictors[root.predictor] == "c.x" and root.counts.sum() == 1200
    assert ["a", "b"] in [sorted(g) for _, g in root.children if "(Missing)" not in g] or any({"a", "b"} <= set(g) for _, g in root.children)
    assert any({"c", "d"} <= set(g) for _, g in root.children)
    below = next(n for n in t.nodes if n.parent == 1 and "c, d" in n.rule)
    assert t.predictors[below.predictor] == "x"
    out = t.augment(df.withColumnRenamed("node", "id"))
    assert out.count() == 1201
    leaves = {r["node"]: r["n"] for r in t.rule_table(spark).collect()}
    got = {r["node"]: (r["n"], r["errors"]) for r in t.errors(df.drop("node")).collect()}
    assert {k: v[0] for k, v in got.items()} == leaves and sum(e for _, e in got.values()) < 250
    assert t.split_summary(spark).count() == sum(bool(n.children) for n in t.nodes) and t.merge_table(spark).count() > 0
    probs = t.probabilities(df.drop("node")).first()["probabilities"]
    assert sum(probs.values()) == pytest.approx(1)


def test_new_levels_stay_and_noise_is_not_split(spark):
    rows = [("a", "p")] * 60 + [("b", "q")] * 60
    df = spark.createDataFrame(rows, "c string, y string")
    t = chaid.chaid(df, "y", ["c"])
    assert len(t.nodes) == 3
    assert chaid.chaid(df, "y", ["c"], min_split=500).nodes[0].children == []
    assert t.augment(spark.createDataFrame([("new", None)], "c string, y string")).first()["node"] == 1
    same = spark.createDataFrame([(c, y) for c in "ab" for y in "pq"] * 40, "c string, y string")
    assert len(chaid.chaid(same, "y", ["c"]).nodes) == 1 and chaid.chaid(same, "y", []).nodes[0].counts.tolist() == [80, 80]
    with pytest.raises(ValueError):
        chaid.chaid(df.limit(0), "y", ["c"])


def test_merging_and_tests():
    n = np.array([[30, 10], [10, 30]])
    assert chaid.chi_squared_test(n)[:2] == (pytest.approx(20.0), 1)
    assert chaid.chi_squared_test(n, "likelihood")[0] == pytest.approx(2 * sum(o * np.log(o / 20) for o in n.ravel()))
    assert chaid.chi_squared_test(np.array([[3, 4]])) == (0.0, 0, 1.0)
    counts = np.array([[30, 31, 2, 30], [10, 9, 40, 10]])
    groups, history = chaid.merge_categories(list("abcd"), counts, ordered=True)
    assert groups == [[0, 1], [2], [3]] and len(history) == 1
    assert sorted(map(sorted, chaid.merge_categories(list("abcd"), counts, ordered=False)[0])) == [[0, 1, 3], [2]]
