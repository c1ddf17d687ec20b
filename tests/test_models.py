"""Models against planted structure and numpy."""

import numpy as np
import pytest

from lumenframe.operators import models as M


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        g = "abc"[i % 3] if i % 6 else "a"
        x, z = float(rng.normal()), float(rng.normal())
        rows.append((i, x, z, g, 2 + 3 * x - z + {"a": 0.0, "b": 5.0, "c": -4.0}[g] + 0.1 * float(rng.normal())))
    rows += [(900, None, 1.0, "a", 1.0), (901, 1.0, 1.0, None, 1.0), (902, 1.0, 1.0, "a", None)]
    return spark.createDataFrame(rows, "id long, x double, z double, g string, y double").cache()


def test_lm_equals_least_squares(spark, points):
    m = M.lm(points, "y", ["x", "z", "g"])
    got = {r["term"]: r for r in m.tidy(spark).collect()}
    rows = points.dropna().collect()
    a = np.array([[1, r["x"], r["z"], r["g"] == "b", r["g"] == "c"] for r in rows], float)
    y = np.array([r["y"] for r in rows])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * ((y - a @ b) ** 2).sum() / (len(y) - 5))
    for k, term in enumerate(["(Intercept)", "x", "z", "gb", "gc"]):
        assert got[term]["estimate"] == pytest.approx(b[k], abs=1e-7)
        assert got[term]["std_error"] == pytest.approx(se[k], rel=1e-6)
    assert got["x"]["p_value"] < 1e-9
    out = m.augment(points).collect()
    assert len(out) == 241 and sum(r["residual"] is None for r in out) == 1  # the row without a target is predicted


def test_other_level(spark, points):
    terms = [r["term"] for r in M.lm(points, "y", ["g"], max_levels=1).tidy(spark).collect()]
    assert terms == ["(Intercept)", "gOther"]


def test_tree_and_forest(spark, points):
    t = M.tree(points, "g", ["y", "x", "z"], max_depth=6)
    got = t.augment(points.dropna()).collect()
    assert sum(r["predicted_label"] == r["g"] for r in got) > 0.8 * len(got)
    forest = M.tree(points, "y", ["x", "g"], trees=10).importance(spark).collect()
    assert {r["variable"] for r in forest} == {"x", "g"} and sum(r["importance"] for r in forest) == pytest.approx(1)


def test_kmeans_finds_separate_groups(spark):
    rows = [(i, 100.0 * (i % 5 == 0) + i % 7, 1000.0 * (i % 5 == 0)) for i in range(100)] + [(100, None, 1.0)]
    out, centres = M.kmeans(spark.createDataFrame(rows, "id int, a double, b double"), ["a", "b"], 2, normalize=True)
    got = out.collect()
    assert len(got) == 100 and all((r["cluster"] == 2) == (r["id"] % 5 == 0) for r in got)
    c = {(r["cluster"], r["variable"]): r for r in centres.collect()}
    assert c[2, "b"]["value"] == pytest.approx(1000) and c[1, "b"]["size"] == 80


def test_prcomp_equals_numpy(spark, points):
    pc = M.prcomp(points, ["x", "z", "y"])
    x = np.array([[r["x"], r["z"], r["y"]] for r in points.dropna(subset=["x", "z", "y"]).collect()])
    want = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert np.allclose(pc.variances, want)
    s = np.array([[r["PC1"], r["PC2"], r["PC3"]] for r in pc.scores(points).collect()])
    assert np.allclose(np.cov(s.T), np.diag(want), atol=1e-9)


def test_survival_regression(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        t = float(np.exp(2 + 1.5 * (i % 2)) * rng.exponential())
        rows.append((min(t, 60.0), t < 60.0, i % 2))
    got = {r["term"]: r["estimate"] for r in M.survival_regression(spark.createDataFrame(rows, "t double, e boolean, k int"), "t", "e", ["k"]).collect()}
    assert got["k"] == pytest.approx(1.5, abs=0.4) and got["(Scale)"] == pytest.approx(1, abs=0.2)
