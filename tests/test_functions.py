"""NULLs, ties and edges that the driver's tables do not hold."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import aggregates as A
from lumenframe.functions import dates as D
from lumenframe.functions import numeric as N
from lumenframe.functions import strings as S
from lumenframe.functions import urls as U
from lumenframe.operators import grouping as G
from lumenframe.operators import joins as J
from lumenframe.operators import windows as X
from lumenframe.sources import files
from lumenframe.streaming.windows import windowed_counts

C = F.col


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(C("x"))).first()[0]


def test_conditional_aggregates_of_nothing(spark):
    r = spark.createDataFrame([(None, 1.0), (False, 2.0)], "c boolean, x double").agg(A.sum_if(C("x"), C("c")), A.mean_if(C("x"), C("c")), A.count_if(C("c")), A.count_if_ratio(C("c"))).first()
    assert tuple(r) == (0.0, None, 0, 0.0)


def test_mode_ties_and_nulls(spark):
    d = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, None), (5, "a"), (6, "b")], "o int, x string")
    assert d.agg(A.get_mode(C("x"), C("o")).alias("m")).first()[0] == "b"
    assert d.where("o < 5").agg(A.get_mode(C("x"), C("o")).alias("m")).first()[0] is None
    assert d.agg(A.get_mode(C("x"), C("o"), na_rm=True).alias("m")).first()[0] == "b"


def test_null_keys_in_joins(spark):
    x = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    y = spark.createDataFrame([(1, "c"), (None, "d")], "k int, w string")
    assert J.join(x, y, ["k"]).count() == 1
    assert J.join(x, y, ["k"], "semi").count() == 2
    assert J.join(x, y, ["k"], "anti").count() == 0
    assert J.join(x, y, ["k"], "full").count() == 3


def test_set_operations_align_by_name(spark):
    x, y = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([("a", 1)], "v string, k int")
    assert J.union(x, y).count() == 1 and J.intersect(x, y).count() == 1 and J.setdiff(x, y).count() == 0


def test_months_between_uses_month_lengths(spark):
    d = spark.createDataFrame([(dt.date(2024, 2, 29), dt.date(2024, 3, 15))], "a date, b date")
    assert abs(d.select(D.time_between(C("a"), C("b"), "months")).first()[0] - 15 / 29) < 1e-9
    assert d.select(D.time_between(C("b"), C("a"), "years")).first()[0] < 0


def test_strings(spark):
    assert one(spark, S.str_extract_before, None) is None
    assert one(spark, lambda x: S.str_extract_before(x, "-"), "abc") is None
    assert one(spark, lambda x: S.str_extract_inside(x, "[", "]", all=True), "a[b]c[d]") == ["[b]", "[d]"]
    assert one(spark, S.parse_number, "x -1,234.5y") == -1234.5 and one(spark, S.parse_number, "none") is None
    assert one(spark, S.str_normalize, "ｱ１") == "ア1"
    assert one(spark, lambda x: S.str_detect(x, "[[:digit:]]+"), "a1") is True


def test_urls(spark):
    assert one(spark, U.url_domain, "https://u@Example.com:80/a?b#c") == "example.com"
    assert one(spark, U.url_port, "https://example.com:80/a") == "80"
    assert one(spark, U.url_path, "https://example.com") is None
    assert one(spark, U.url_subdomain, None) is None


def test_numbers_and_lists(spark):
    assert one(spark, lambda x: N.floor(x, -1), 19.0, "double") == 10.0
    assert one(spark, N.list_to_text, [None, "a"], "array<string>") == "NA, a"
    assert one(spark, N.list_to_text, [], "array<string>") == ""
    assert one(spark, lambda x: N.list_extract(x, 3), ["a"], "array<string>") is None


def test_cumulative_products_and_decay(spark):
    d = spark.createDataFrame([(1, 2.0), (2, None), (3, 3.0)], "o int, x double")
    w = Window.orderBy("o")
    assert [r[0] for r in d.select("o", X.cumprod(C("x"), w).alias("p")).orderBy("o").select("p").collect()] == [2.0, None, 6.0]
    assert [r[0] for r in d.select("o", X.cumsum_decayed(C("x"), w, 0.5).alias("p")).orderBy("o").select("p").collect()] == [2.0, 1.0, 3.5]


def test_pivot_leaves_null_keys_out(spark):
    d = spark.createDataFrame([("a", "x", 1), ("a", None, 5), (None, "x", 7), ("b", "y", 2)], "r string, c string, v int")
    assert sorted(map(tuple, G.pivot(d, ["r"], "c", F.sum("v"), fill=0).collect())) == [("a", 1, 0), ("b", 0, 2)]


def test_sampling_is_the_same_for_any_partitioning(spark):
    d = spark.range(1000)
    assert sorted(r[0] for r in X.sample_rows(d, 10, C("id")).collect()) == sorted(r[0] for r in X.sample_rows(d.repartition(7), 10, C("id")).collect())


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("note\nx,y\n1,a\n2,\n")
    r = files.read_delimited(spark, str(tmp_path / "a.csv"), skip=1).collect()
    assert [tuple(x) for x in r] == [(1, "a"), (2, None)]
    (tmp_path / "a.json").write_text('{"a": {"b": {"c": 1}}, "d": 2}\n')
    assert files.read_json(spark, str(tmp_path / "a.json")).columns == ["a.b.c", "d"]
    assert files.render_sql("x IN (@{v}) AND y = @{w}", {"v": ["a'b", 1], "w": None}) == "x IN ('a''b', 1) AND y = NULL"
    assert files.split_statements("select ';' ; -- a;b\nselect 2;/* ; */") == ["select ';'", "select 2"]


def test_stream_of_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(dt.datetime(2024, 1, 1, 1), "a", 1.0), (dt.datetime(2024, 1, 1, 2), "a", 2.0), (dt.datetime(2024, 1, 2, 1), "b", 3.0)], "ts timestamp, k string, v double").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(src)
    q = windowed_counts(stream, "ts", ["k"], value="v").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted((r.k, r.n, r.total) for r in spark.table("w").collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]
