"""Edge cases of the table verbs and tests: NULLs, empty tables, odd names, single values."""

import math

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import evaluation as E
from lumenframe.operators import verbs as X

C = F.col


def test_names():
    assert X.unique_names(["a", "a", "a_1", "a"]) == ["a", "a_2", "a_1", "a_3"]
    assert X.avoid_conflict(["a", "a.new"], ["a", "b"]) == ["a.new.new", "b"]


def test_odd_headers(spark):
    d = spark.createDataFrame([(1, "x", 2.0)], "`a b` int, `k.x` string, `製品` double")
    assert X.move_col(d, "製品", 1).columns == ["製品", "a b", "k.x"] and X.reorder_cols(d, "k.x", "zz").columns == ["k.x", "a b", "製品"]
    assert X.select_columns(d, "k.x", exclude=True).columns == ["a b", "製品"]
    with pytest.raises(ValueError):
        X.move_col(d, "none", 1)
    assert X.unnest(X.nest(d, ["k.x"]), "data").columns == ["k.x", "a b", "製品"]


def test_row_as_header_from_the_end_and_of_nothing(spark):
    d = spark.createDataFrame([(1, "a", "p"), (2, "b", None), (3, "n", "m")], "i int, x string, y string")
    got = X.row_as_header(d, C("i"), -1)
    assert got.columns == ["3", "n", "m"] and got.count() == 2
    assert X.row_as_header(d, C("i"), 2).columns == ["2", "b", "y"]
    assert X.row_as_header(d.limit(0), C("i")).columns == ["i", "x", "y"]


def test_summaries_of_rows_with_nulls(spark):
    d = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (2.0, 2.0, 2.0)], "a double, b double, c double")
    cols = [C("a"), C("b"), C("c")]
    got = d.select(*[X.summarize_row(cols, f, True).alias(f) for f in ("mean", "sum", "min", "sd", "count")], X.summarize_row(cols).alias("strict")).collect()
    assert tuple(got[0])[:3] == (2.0, 4.0, 1.0) and got[0]["sd"] == pytest.approx(math.sqrt(2)) and got[0]["strict"] is None
    assert tuple(got[1]) == (None, 0.0, None, None, 0.0, None) and got[2]["sd"] == 0.0 and got[2]["strict"] == 2.0


def test_cuts(spark):
    d = spark.createDataFrame([(v,) for v in (-4.0, 0.0, 3.0, None, math.inf, math.nan, 10.0)], "x double")
    assert [r[0] for r in X.cut(d, "x", 2, zero_to_center=True).select("bin").collect()] == ["(-10, 0]", "(-10, 0]", "(0, 10]", None, "10 - Inf", None, "(0, 10]"]
    assert [r[0] for r in X.cut(d, "x", [0, 3, 10], right=False).select("bin").collect()] == ["-Inf - 0", "[0, 3)", "[3, 10)", None, "10 - Inf", None, "[3, 10)"]
    assert X.cut(d.limit(0), "x", 3).count() == 0


def test_likert_scores_sum_to_zero(spark):
    d = spark.createDataFrame([(v,) for v in [1] * 5 + [2] * 10 + [3] * 20 + [5] * 2] + [(None,)], "x int")
    got = X.likert_sigma(d, "x").collect()
    assert len(got) == 38 and sum(r["sigma"] or 0 for r in got) == pytest.approx(0, abs=1e-9)
    assert [r["sigma"] for r in got if r["x"] == 1][0] < [r["sigma"] for r in got if r["x"] == 5][0]


def test_samples_do_not_depend_on_partitions(spark):
    d = spark.range(2000).withColumn("g", C("id") % 3)
    a, b = ({r["id"] for r in X.sample_fraction(x, 0.2, C("id")).collect()} for x in (d, d.repartition(7)))
    assert a == b and 300 < len(a) < 500
    assert X.sample_by_group(d, 5, ["g"], C("id")).groupBy("g").count().where("count = 5").count() == 3


def test_emoji_and_parameters(spark):
    d = spark.createDataFrame([("a\U0001f469‍\U0001f4bb1#*b", "http://a/b?x=1&y=2#f"), (None, None)], "x string, u string")
    assert d.select(X.str_remove_emoji(C("x")).alias("x")).collect()[0][0] == "a1#*b"
    got = d.select(*[X.url_param_remove(C("u"), k).alias(k) for k in ("x", "y", "z")]).first()
    assert list(got) == ["http://a/b?y=2#f", "http://a/b?x=1#f", "http://a/b?x=1&y=2#f"]


def test_tests_of_nothing_and_known_p_values(spark):
    d = spark.createDataFrame([(g, float(v), v > 2) for g, v in zip("aaabbb", (1, 2, 4, 2, 8, 9), strict=True)], "g string, x double, b boolean")
    none = d.limit(0)
    assert E.one_sample_t(none, "x").first()["statistic"] is None and E.prop_test(none, "b").first()["p_value"] is None
    assert E.two_prop_test(none, "b", "g", "a", "b").first()["statistic"] is None and E.variance_test(none, "x", "g", "a", "b").first()["statistic"] is None
    assert E.evaluate_binary(none, "x", "b").first()["f_score"] is None and E.evaluate_multi(none, "g", "g").first()["accuracy"] is None
    assert E.evaluate_regression(none, "x", "x").first()["rmse"] is None and E.aupr(none, "x", "b").first()["aupr"] is None
    t = E.one_sample_t(spark.createDataFrame([(float(v),) for v in range(1, 11)], "x double"), "x", 3.0).first()
    assert t["statistic"] == pytest.approx(2.6111648) and t["p_value"] == pytest.approx(0.0282, abs=2e-4)
    assert E.evaluate_binary(d.withColumn("p", C("x") / 10), "p", "b", 0.3).first()["accuracy"] == 1.0
    assert E.aupr(d, "x", "b").first()["aupr"] == pytest.approx(1.0)


def test_distances_with_lacking_keys(spark):
    d = spark.createDataFrame([("x", 1, 3.0), ("x", 2, 4.0), ("y", 3, 12.0), ("z", 1, 3.0)], "s string, k int, v double")
    got = {(r.x, r.y): r.value for r in E.dist_kv(d, "s", "k", "v").collect()}
    assert got == {("x", "y"): pytest.approx(13.0), ("x", "z"): pytest.approx(4.0), ("y", "z"): pytest.approx(math.sqrt(153))}
    assert E.cor_kv(d, "s", "k", "v").collect()[0]["n"] == 1
