"""NULL keys, constants, empty tables, zeros and odd headers of the core operators."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import aggregates as A
from lumenframe.functions import strings as S
from lumenframe.operators import grouping, stats, windows
from lumenframe.sources import files

C = F.col


@pytest.fixture(scope="module")
def keyed(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", 100.0), (None, 5.0), (None, 7.0), (None, None), ("b", 2.0)]
    return spark.createDataFrame(rows, "`k.x` string, `v al` double")


@pytest.mark.parametrize("kind", ["iqr", "percentile", "sd"])
def test_null_groups_keep_their_rows(keyed, kind):
    got = windows.detect_outlier(keyed, "v al", ["k.x"], kind).collect()
    assert len(got) == 7 and sum(r["k.x"] is None for r in got) == 3 and sum(r["outlier"] is None for r in got) == 1
    assert len(windows.detect_outlier(keyed, "v al", [], kind).collect()) == 7


def test_normalize_null_groups(keyed):
    got = windows.normalize(keyed, "v al", ["k.x"]).collect()
    assert len(got) == 7
    assert sorted(r["normalized"] for r in got if r["k.x"] is None and r["v al"]) == pytest.approx([-math.sqrt(0.5), math.sqrt(0.5)])
    assert [r["normalized"] for r in got if r["k.x"] == "b"] == [None]


def test_exact_quantiles(spark):
    xs = [float(i * 37 % 101) / 7 for i in range(500)]
    df = spark.createDataFrame([(x, None if i % 3 else "g") for i, x in enumerate(xs)], "x double, g string")
    a, b = sorted(xs), sorted(x for i, x in enumerate(xs) if i % 3)

    def plain(v, p):
        at = p * (len(v) - 1)
        lo, hi = math.floor(at), math.ceil(at)
        return v[lo] if lo == hi else (hi - at) * v[lo] + (at - lo) * v[hi]

    for ps in ([0.25, 0.75], [0.1, 0.5]):
        assert list(windows.quantiles(df, "x", [], ps).first()) == pytest.approx([plain(a, p) for p in ps])
        got = {r["g"]: list(r)[1:] for r in windows.quantiles(df, "x", ["g"], ps).collect()}
        assert got[None] == pytest.approx([plain(b, p) for p in ps])


def test_complete_dates_null_key(spark):
    df = spark.sql("SELECT * FROM VALUES (null, date'2024-01-01', 1), (null, date'2024-01-03', 3), ('a', date'2024-01-02', 2), ('a', null, 9) AS t(`k.x`, d, v)")
    got = {(r["k.x"], str(r["d"])): r["v"] for r in windows.complete_dates(df, "d", ["k.x"]).collect()}
    assert got == {(None, "2024-01-01"): 1, (None, "2024-01-02"): None, (None, "2024-01-03"): 3, ("a", "2024-01-02"): 2}


def test_zero_and_constant_values(spark):
    d = spark.createDataFrame([("a", 1.0, 0.0, 2.0), ("a", 1.0, 4.0, 2.0), ("b", 1.0, 2.0, 1.0)], "g string, c double, actual double, predicted double")
    assert d.agg(A.mape(C("actual"), C("predicted")).alias("m")).first()[0] == pytest.approx(0.5)
    assert d.limit(0).agg(A.mape(C("actual"), C("predicted")).alias("m"), A.confint_radius(C("c")).alias("r")).first()[0] is None
    assert list(stats.welch_t(d, "c", "g", "a", "b").first())[:2] == [None, None]
    assert stats.anova(d, "c", "g").first()[0] is None and stats.anova(d.where("g = 'a'"), "actual", "g").first()[0] is None
    assert stats.confusion(d.limit(0).select((C("c") > 0).alias("a"), (C("c") > 0).alias("p")), "a", "p").first()["accuracy"] is None
    v = spark.createDataFrame([("x", 1, 0.0), ("y", 1, 2.0), ("z", 1, 1.0)], "s string, k int, v double")
    got = {(r.x, r.y): r.similarity for r in stats.cosine_similarity(v, "s", "k", "v").collect()}
    assert got == {("x", "y"): None, ("x", "z"): None, ("y", "z"): pytest.approx(1.0)}


def test_anova_of_large_values(spark):
    rows = [(g, 1e9 + x) for g, x in zip("aabbcc", (0.1, 0.4, 0.2, 0.5, 0.3, 0.2), strict=True)]
    groups = [[x for h, x in rows if h == g] for g in "abc"]
    grand = statistics.mean(x for _, x in rows)
    between = sum(len(g) * (statistics.mean(g) - grand) ** 2 for g in groups) / 2
    within = sum((x - statistics.mean(g)) ** 2 for g in groups for x in g) / 3
    assert stats.anova(spark.createDataFrame(rows, "g string, x double"), "x", "g").first()[0] == pytest.approx(between / within, rel=1e-5)


def test_chi_squared_without_all_cells(spark):
    rows = [("a", "x")] * 5 + [("a", "y")] * 3 + [("b", "z")] * 4 + [("c", "x")] * 2 + [(None, "x"), ("a", None)]
    n, r, c = 14, {"a": 8, "b": 4, "c": 2}, {"x": 7, "y": 3, "z": 4}
    o = {k: rows.count(k) for k in ((i, j) for i in r for j in c)}
    want = sum((o[i, j] - r[i] * c[j] / n) ** 2 / (r[i] * c[j] / n) for i, j in o)
    got = stats.chi_squared(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert list(got) == [pytest.approx(want), 4, 14]


def test_replacements_stand_for_themselves(spark):
    d = spark.createDataFrame([("see https://a.b/c, now",)], "x string")
    got = d.select(S.str_replace_url(C("x"), "$5\\1").alias("a"), S.str_replace_before(C("x"), ",", "$9", False).alias("b"), S.str_replace_after(C("x"), ",", "\\$", True).alias("c")).first()
    assert list(got) == ["see $5\\1 now", "$9, now", "see https://a.b/c\\$"]


def test_pivot_fill_with_dotted_values(spark):
    d = spark.createDataFrame([("a", "x.y", 1), ("b", "z", 2)], "r string, c string, v int")
    got = {r["r"]: (r["x.y"], r["z"]) for r in grouping.pivot(d, ["r"], "c", F.sum("v"), fill=0).collect()}
    assert got == {"a": (1, 0), "b": (0, 2)}


def test_delimited_text_with_a_preamble_and_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("made by\nsomeone\nname,n,when\ncafé,1,2024-01-02\n\"a, b\",2.5,\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("made by\nsomeone else\nname,n,when\nthé,3,2024-02-02".encode("latin-1"))
    got = files.read_delimited(spark, str(tmp_path / "*.csv"), skip=2, encoding="ISO-8859-1")
    assert dict(got.dtypes) == {"name": "string", "n": "double", "when": "date"}
    assert sorted((r["name"], r["n"]) for r in got.collect()) == [("a, b", 2.5), ("café", 1.0), ("thé", 3.0)]


def test_glob_alternatives():
    import re

    r = re.compile(files.glob_to_regex("*.csv|data_?.tsv"))
    assert r.match("a.csv") and r.match("data_1.tsv") and not r.match("data_12.tsv") and not r.match("a.csvx")


def test_log_lines(spark, tmp_path):
    (tmp_path / "l.log").write_text("10.0.0.1 GET /a\nbroken\n")
    got = files.read_log(spark, str(tmp_path / "l.log"), r"^(\S+) (GET|POST) (\S+)$", ["ip", "verb", "path"]).collect()
    assert sorted(map(tuple, got), key=str) == [("10.0.0.1", "GET", "/a"), (None, None, None)]


def test_mode_scans_runs(spark):
    rows = [(v, i) for i, v in enumerate(["b", "a", None, "a", "b", "c", None])]
    d = spark.createDataFrame(rows, "x string, o int")
    assert d.agg(A.get_mode(C("x"), C("o")).alias("m")).first()[0] == "b"
    assert d.where("o > 1").agg(A.get_mode(C("x"), C("o")).alias("m")).first()[0] is None
    assert d.limit(0).agg(A.get_mode(C("x"), C("o")).alias("m")).first()[0] is None


def test_decayed_sum(spark):
    from pyspark.sql import Window

    d = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "i int, x double")
    w = Window.orderBy("i")
    got = [r[0] for r in d.select(windows.cumsum_decayed(C("x"), w, 0.5).alias("s"), "i").orderBy("i").collect()]
    want, acc = [], 0.0
    for i in range(50):
        acc = acc * 0.5 + i % 5
        want.append(acc)
    assert got == pytest.approx(want)
