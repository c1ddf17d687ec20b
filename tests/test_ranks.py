import math

import numpy as np
import pytest

from lumenframe.functions import distributions as P
from lumenframe.operators import ranks as R
from lumenframe.operators import stats as S
from lumenframe.operators import survival as V


def test_tail_probabilities():
    assert P.p_normal(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert P.p_t(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert P.p_chi_squared(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert P.p_chi_squared(2.0, 2) == pytest.approx(math.exp(-1), abs=1e-14)
    assert P.p_f(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert P.p_f(2.0, 2, 2) == pytest.approx(1 / 3, abs=1e-12)
    assert P.p_chi_squared(0, 3) == P.p_f(0, 1, 1) == 1


def test_running_sums_over_ranges(spark):
    values = [(float(v), v % 7 + 1) for v in range(-500, 500)]
    df = spark.createDataFrame([*values, (math.inf, 3), (-math.inf, 2)], "x double, n int").repartition(5)
    for down in (False, True):
        for ranges in (1, 13):
            got = sorted((r.x, r.before) for r in R.running_sums(df, "x", {"n": "before"}, down, ranges).collect())
            rows = sorted([*values, (math.inf, 3), (-math.inf, 2)], reverse=down)
            want, total = [], 0
            for x, n in rows:
                want.append((x, total))
                total += n
            assert got == sorted(want)


def test_rank_tests_edges(spark):
    df = spark.createDataFrame([(1.0, "a", True), (2.0, "a", None), (2.0, "b", True), (None, "b", False), (4.0, None, False), (5.0, "b", False)], "x double, g string, p boolean")
    r = R.wilcoxon(df, "x", "g", "a", "b").first()
    assert (r.statistic, r.n_a, r.n_b) == (0.5, 2, 2)
    assert R.auc(df, "x", "p").first().auc == 0.0
    assert R.kruskal(df, "x", "g").first().df == 1
    assert R.kolmogorov_smirnov(df, "x", "g", "a", "b").first().statistic == 0.5
    none = df.limit(0)
    assert math.isnan(R.wilcoxon(none, "x", "g", "a", "b").first().z) and math.isnan(R.kruskal(none, "x", "g").first().statistic)
    assert math.isnan(R.auc(none, "x", "p").first().auc) and math.isnan(R.spearman(none.selectExpr("x", "x y"), "x", "y").first().correlation)
    assert R.kolmogorov_smirnov(none, "x", "g", "a", "b").first().statistic is None
    assert R.spearman(df.selectExpr("x", "-x y"), "x", "y").first().correlation == pytest.approx(-1)


def efron(t, e, x, rounds=30):
    """Partial likelihood by rows."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        g, h = np.zeros(len(b)), np.zeros((len(b), len(b)))
        w = np.exp(x @ b)
        for at in np.unique(t[e == 1]):
            risk, dead = t >= at, (t == at) & (e == 1)
            d = dead.sum()
            g += x[dead].sum(0)
            for k in range(d):
                u = w * risk - k / d * w * dead
                m = u @ x / u.sum()
                g -= m
                h += (x.T * u) @ x / u.sum() - np.outer(m, m)
        b = b + np.linalg.solve(h, g)
    return b, np.sqrt(np.diag(np.linalg.inv(h)))


def test_cox_equals_the_sum_over_rows(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(5, 2, 300), rng.integers(0, 2, 300)])
    t = np.ceil(10 * rng.exponential(1 / np.exp(0.3 * (x[:, 0] - 5) - 0.8 * x[:, 1])))
    e = (rng.random(300) < 0.7).astype(int)
    df = spark.createDataFrame([*((float(a), bool(b), float(c), float(d)) for a, b, (c, d) in zip(t, e, x)), (3.0, None, 1.0, 1.0)], "t double, e boolean, `a b` double, k double")
    got = V.cox(df.withColumnRenamed("a b", "a"), "t", "e", ["a", "k"]).collect()
    b, s = efron(t, e, x)
    assert [r.estimate for r in got] == pytest.approx(list(b), abs=1e-5)
    assert [r.std_error for r in got] == pytest.approx(list(s), rel=1e-4)
    with pytest.raises(ValueError):
        V.cox(df.limit(0), "t", "e", ["k"])


def test_log_rank_groups(spark):
    rows = [(float(i % 9 + 1), i % 3 > 0, "abc"[i % 3 if i < 40 else 0]) for i in range(60)]
    test, groups = V.log_rank(spark.createDataFrame([*rows, (None, True, "d")], "t double, e boolean, g string"), "t", "e", "g")
    g = groups.collect()
    assert [r.group for r in g] == ["a", "b", "c"] and sum(r.n for r in g) == 60
    assert sum(r.observed for r in g) == pytest.approx(sum(r.expected for r in g)) and test.first().df == 2
    assert math.isnan(V.log_rank(spark.createDataFrame(rows[:1], "t double, e boolean, g string"), "t", "e", "g")[0].first().statistic)


def test_p_values(spark):
    t = spark.createDataFrame([(3.841458820694124, 1.0, 1.0), (None, 1.0, 1.0), (float("nan"), 1.0, 1.0), (2.0, 0.0, 0.0)], "statistic double, df double, df_between double")
    assert [r.p_value for r in S.p_values(t, "chi_squared").collect()] == [pytest.approx(0.05, abs=1e-9), None, None, None]
    f = spark.createDataFrame([(4.964602743730711, 1, 10)], "statistic double, df_between long, df_within long")
    assert S.p_values(f, "f").first().p_value == pytest.approx(0.05, abs=1e-9)
    assert S.p_values(spark.createDataFrame([(-2.2281388519649385, 10.0)], "statistic double, df double"), "t").first().p_value == pytest.approx(0.05, abs=1e-9)
