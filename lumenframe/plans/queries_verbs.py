"""Table verbs, evaluation and closed-form tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import dates as D
from ..functions import strings as S
from ..operators import evaluation as E
from ..operators import verbs as X
from ..operators import windows as W
from .registry import query

C = F.col


@query("select_columns", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    return X.select_columns(t.nation, "n_name", "n_nationkey", "nothing")


@query("select_columns_exclude", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    return X.select_columns(t.nation, "n_regionkey", "nothing", exclude=True)


@query("reorder_cols", "SELECT n_regionkey, n_nationkey, n_name FROM nation")
def _(t):
    return X.reorder_cols(t.nation, "n_regionkey", "nothing")


@query("move_col", "SELECT n_name, n_nationkey, n_regionkey FROM nation")
def _(t):
    return X.move_col(t.nation, "n_name", 1)


@query("rename_with", "SELECT n_nationkey AS \"NATIONKEY\", n_name AS \"NAME\", n_regionkey FROM nation")
def _(t):
    return X.rename_with(t.nation, lambda n: n[2:].upper(), ["n_nationkey", "n_name"])


@query("clean_names", "SELECT c_custkey AS customer_key, c_acctbal AS x2_acct_bal, c_name AS customer_key_1 FROM customer")
def _(t):
    return X.clean_names(t.customer.select(C("c_custkey").alias("Customer Key"), C("c_acctbal").alias("2 AcctBal"), C("c_name").alias("customer-key")))


@query("clean_data_frame", "SELECT c_custkey AS k, c_name AS \"s.name\", c_acctbal AS \"s.bal\" FROM customer")
def _(t):
    return X.clean_data_frame(t.customer.select(C("c_custkey").alias("k\n"), F.struct(C("c_name").alias("name"), C("c_acctbal").alias("bal")).alias("s")))


@query("row_as_header", "SELECT n_nationkey::VARCHAR AS \"0\", n_name AS \"head\" FROM nation WHERE n_nationkey > 0")
def _(t):
    d = t.nation.select(C("n_nationkey").cast("string").alias("a"), F.when(C("n_nationkey") == 0, F.lit(" head ")).otherwise(C("n_name")).alias("b"))
    return X.row_as_header(d, C("a").cast("int"), 1)


@query("slice_rows", "SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r IN (1, 3)")
def _(t):
    return X.slice_rows(t.customer.select("c_custkey", "c_nationkey"), C("c_custkey"), [1, 3], ["c_nationkey"])


@query("slice_head", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r IN (2, 5)")
def _(t):
    return X.slice_rows(t.orders.select("o_orderkey"), C("o_orderkey"), [2, 5])


@query("nest", "SELECT n_regionkey, count(*) AS n, sum(n_nationkey) AS keys FROM nation GROUP BY n_regionkey")
def _(t):
    return X.nest(t.nation, ["n_regionkey"]).select("n_regionkey", F.size("data").cast("long").alias("n"), F.aggregate("data", F.lit(0).cast("long"), lambda a, x: a + x["n_nationkey"]).alias("keys"))


@query("unnest", "SELECT n_regionkey, n_name, n_nationkey FROM nation")
def _(t):
    return X.unnest(X.nest(t.nation, ["n_regionkey"]), "data")


@query("unnest_clash", "SELECT r_regionkey, r_name, r_name AS \"r_name.new\" FROM region WHERE r_regionkey > 1")
def _(t):
    d = t.region.select("r_regionkey", "r_name", F.when(C("r_regionkey") > 1, F.array(F.struct("r_name"))).otherwise(F.array().cast("array<struct<r_name:string>>")).alias("l"), F.array(F.lit(1)).alias("other"))
    return X.unnest(d, "l", drop_lists=True)


@query("unnest_keep_empty", "SELECT r_regionkey, CASE WHEN r_regionkey > 1 THEN r_name END AS l FROM region")
def _(t):
    return X.unnest(t.region.select("r_regionkey", F.when(C("r_regionkey") > 1, F.array("r_name")).alias("l")), "l", keep_empty=True)


@query("add_row", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT NULL, 'NOWHERE'")
def _(t):
    return X.add_row(t.region, r_name="NOWHERE")


_T = "list_filter([nullif(l_quantity, 5), l_discount * 100, l_tax * 100], lambda x: x IS NOT NULL)"


@query("summarize_row", f"""SELECT l_orderkey, l_linenumber, round((l_quantity + l_discount * 100 + l_tax * 100) / 3, 6) AS mean, round(list_sum({_T}), 6) AS sum, list_min({_T}) AS min, list_max({_T}) AS max, len({_T})::DOUBLE AS count,
round(CASE WHEN l_quantity <> 5 THEN list_stddev_samp({_T}) END, 6) AS sd FROM lineitem""")
def _(t):
    v = [F.nullif(C("l_quantity"), F.lit(5)), C("l_discount") * 100, C("l_tax") * 100]
    whole = [C("l_quantity"), *v[1:]]
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(X.summarize_row(whole), 6).alias("mean"), F.round(X.summarize_row(v, "sum", True), 6).alias("sum"), X.summarize_row(v, "min", True).alias("min"), X.summarize_row(v, "max", True).alias("max"), X.summarize_row(v, "count").alias("count"), F.round(X.summarize_row(v, "sd"), 6).alias("sd"))


_DAILY = "SELECT event_type, ts::DATE AS d, sum(value) AS v FROM events GROUP BY ALL"


def _daily(t):
    return t.events.groupBy("event_type", C("ts").cast("date").alias("d")).agg(F.sum("value").alias("v"))


for _r, _n in ((False, "ts_diff"), (True, "ts_diff_ratio")):

    @query(_n, f"WITH e AS ({_DAILY}) SELECT a.event_type, a.d, a.v, round({'(a.v - b.v) / b.v' if _r else 'a.v - b.v'}, 6) AS diff FROM e a ASOF LEFT JOIN e b ON a.event_type = b.event_type AND a.d - INTERVAL 1 WEEK >= b.d")
    def _(t, ratio=_r):
        return X.ts_diff(_daily(t), "d", "v", ["event_type"], "week", ratio=ratio).withColumn("diff", F.round("diff", 6))


@query("average_moving_range", f"WITH e AS ({_DAILY}), l AS (SELECT event_type, abs(v - lag(v) OVER (PARTITION BY event_type ORDER BY d)) AS m FROM e) SELECT event_type, round(avg(m), 6) AS average_moving_range FROM l GROUP BY 1")
def _(t):
    return X.average_moving_range(_daily(t), "v", C("d"), ["event_type"]).withColumn("average_moving_range", F.round("average_moving_range", 6))


@query("restore_na", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal * 2 END AS p FROM customer")
def _(t):
    return X.restore_na(t.customer.where("c_acctbal > 0").select("c_custkey", (C("c_acctbal") * 2).alias("p")), t.customer, "c_custkey")


@query("cut_breaks", "SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN '-Inf - 1000' WHEN o_totalprice <= 50000 THEN 'low' WHEN o_totalprice <= 200000 THEN 'mid' ELSE '2e+05 - Inf' END AS bin FROM orders")
def _(t):
    return X.cut(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", [1000, 50000, 200000], labels=["low", "mid"]).drop("o_totalprice")


@query("cut_equal", "WITH r AS (SELECT min(p_size) AS a, max(p_size) AS b FROM part) SELECT p_partkey, 'b' || greatest(1, CASE WHEN p_size = a THEN 1 ELSE ceil((p_size - a) / ((b - a) / 4.0)) END)::INT AS bin FROM part, r")
def _(t):
    return X.cut(t.part.select("p_partkey", "p_size"), "p_size", 4, labels=["b1", "b2", "b3", "b4"]).drop("p_size")


@query("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' ELSE p_brand END AS k FROM part")
def _(t):
    return t.part.select("p_partkey", X.case_when((C("p_size") < 10, "S"), (C("p_size") < 30, "M"), default=C("p_brand")).alias("k"))


@query("is_integer", "SELECT bool_and(l_quantity = floor(l_quantity)) AS q, bool_and(l_discount = floor(l_discount)) AS d FROM lineitem")
def _(t):
    return t.lineitem.agg(X.is_integer(C("l_quantity")).alias("q"), X.is_integer(C("l_discount")).alias("d"))


@query("parse_logical", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS b FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", X.parse_logical(F.translate("l_returnflag", "ANR", "TF?")).alias("b"))


@query("remove_emoji", "SELECT r_regionkey, r_name || ' 12#' AS x FROM region")
def _(t):
    return t.region.select("r_regionkey", X.str_remove_emoji(F.concat("r_name", F.lit(" \U0001f600❤️\U0001f1eb\U0001f1f712\U0001f44d\U0001f3fd#"))).alias("x"))


@query("to_json", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def _(t):
    return X.to_json(t.region)


@query("url_param_remove", "SELECT page_id, regexp_replace(url, '[?]utm_source=[^&#]*', '') AS url FROM pages")
def _(t):
    return t.pages.select("page_id", X.url_param_remove(C("url"), "utm_source").alias("url"))


@query("url_codec", "SELECT page_id, url_encode(url) AS e, url AS d FROM pages")
def _(t):
    e = F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20"))
    return t.pages.select("page_id", e.alias("e"), F.try_url_decode(F.url_encode("url")).alias("d"))


@query("logistic", "SELECT p_partkey, round(1 / (1 + exp(-p_size / 10.0)), 8) AS p FROM part")
def _(t):
    return t.part.select("p_partkey", F.round(X.logistic(C("p_size") / 10), 8).alias("p"))


@query("evaluate_regression", """WITH d AS (SELECT l_extendedprice AS a, l_quantity * 1500 AS p FROM lineitem) SELECT round(1 - avg((a - p) ** 2) / var_pop(a), 6) AS r_squared, round(1 - var_pop(a - p) / var_pop(a), 6) AS explained_variance, round(avg((a - p) ** 2), 2) AS mse,
round(sqrt(avg((a - p) ** 2)), 4) AS rmse, round(avg(abs(a - p)), 4) AS mae, round(100 * avg(abs((a - p) / a)), 6) AS mape FROM d""")
def _(t):
    e = E.evaluate_regression(t.lineitem.select(C("l_extendedprice").alias("a"), (C("l_quantity") * 1500).alias("p")), "p", "a")
    return e.select(*[F.round(c, n).alias(c) for c, n in (("r_squared", 6), ("explained_variance", 6), ("mse", 2), ("rmse", 4), ("mae", 4), ("mape", 6))])


_PROB = "SELECT quality = 1 AS a, least(1, n_chars / 3000.0) AS p FROM labels JOIN documents USING (doc_id)"


def _scored(t):
    return t.labels.join(t.documents, "doc_id").select((C("quality") == 1).alias("a"), F.least(F.lit(1.0), C("n_chars") / 3000.0).alias("p"))


@query("evaluate_binary", f"""WITH d AS ({_PROB}), h AS (SELECT i, i / 100.0::DOUBLE AS threshold FROM range(0, 101) r(i)), c AS (SELECT i, threshold, count(*) FILTER (a AND p >= threshold) AS tp, count(*) FILTER (NOT a AND p >= threshold) AS fp, count(*) FILTER (a AND p < threshold) AS fn, count(*) FILTER (NOT a AND p < threshold) AS tn FROM d, h GROUP BY ALL)
SELECT threshold, tp, fp, fn, tn, round(2 * tp / (2 * tp + fp + fn), 8) AS f_score, round((tp + tn) / (tp + fp + fn + tn), 8) AS accuracy, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(tn / (tn + fp), 8) AS specificity, tp + fn AS positives, fp + tn AS negatives FROM c ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, i LIMIT 1""")
def _(t):
    e = E.evaluate_binary(_scored(t), "p", "a")
    return e.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 8).alias(c) for c in ("f_score", "accuracy", "precision", "recall", "specificity")], C("positives").cast("long").alias("positives"), C("negatives").cast("long").alias("negatives"))


@query("evaluate_multi", """WITH d AS (SELECT o_orderstatus AS a, CASE WHEN o_orderdate < DATE '1998-01-01' THEN 'F' WHEN o_totalprice < 100000 THEN 'P' ELSE 'O' END AS p FROM orders), l AS (SELECT DISTINCT a AS l FROM d UNION SELECT DISTINCT p FROM d),
f AS (SELECT l, 2 * count(*) FILTER (a = l AND p = l) / (count(*) FILTER (a = l) + count(*) FILTER (p = l)) AS f FROM l, d GROUP BY l), s AS (SELECT count(*) FILTER (a = p) AS k, count(*) AS n FROM d)
SELECT round(k / n, 8) AS micro_f_score, round((SELECT avg(f) FROM f), 8) AS macro_f_score, round(k / n, 8) AS accuracy, round(1 - k / n, 8) AS misclassification, n FROM s""")
def _(t):
    p = X.case_when((C("o_orderdate") < F.lit("1998-01-01").cast("date"), "F"), (C("o_totalprice") < 100000, "P"), default="O")
    e = E.evaluate_multi(t.orders.select(C("o_orderstatus").alias("a"), p.alias("p")), "p", "a")
    return e.select(*[F.round(c, 8).alias(c) for c in ("micro_f_score", "macro_f_score", "accuracy", "misclassification")], "n")


@query("aupr", f"""WITH d AS ({_PROB}), g AS (SELECT p, count(*) FILTER (a) AS tp, count(*) FILTER (NOT a) AS fp FROM d GROUP BY p), c AS (SELECT tp, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM g WINDOW w AS (ORDER BY p DESC)), b AS (SELECT tp, ct / (ct + cf) AS now, (ct - tp) AS bt, lag(ct / (ct + cf)) OVER (ORDER BY ct + cf) AS before FROM c)
SELECT round(sum(tp / (SELECT count(*) FILTER (a) FROM d) * (now + CASE WHEN before IS NULL THEN now ELSE before END) / 2), 8) AS aupr FROM b""")
def _(t):
    return E.aupr(_scored(t), "p", "a").select(F.round("aupr", 8).alias("aupr"))


@query("cor_kv", """WITH v AS (SELECT event_type AS s, ts::DATE AS k, sum(value) AS v FROM events GROUP BY ALL) SELECT x.s AS x, y.s AS y, round(corr(x.v, y.v), 6) AS correlation, count(*) AS n FROM v x JOIN v y ON x.k = y.k AND x.s < y.s GROUP BY ALL""")
def _(t):
    return E.cor_kv(t.events.withColumn("k", C("ts").cast("date")), "event_type", "k", "value").withColumn("correlation", F.round("correlation", 6))


for _m, _e in (("euclidean", "sqrt(sum((a - b) ** 2))"), ("manhattan", "sum(abs(a - b))")):

    @query(f"dist_kv_{_m}", f"""WITH v AS (SELECT event_type AS s, user_id AS k, sum(value) AS v FROM events GROUP BY ALL), s AS (SELECT DISTINCT s FROM v), k AS (SELECT DISTINCT k FROM v), f AS (SELECT s.s, k.k, coalesce(v, 0) AS v FROM s CROSS JOIN k LEFT JOIN v ON v.s = s.s AND v.k = k.k)
SELECT x, y, round({_e}, 4) AS value FROM (SELECT x.s AS x, y.s AS y, x.v AS a, y.v AS b FROM f x JOIN f y ON x.k = y.k AND x.s < y.s) GROUP BY x, y""")
    def _(t, method=_m):
        return E.dist_kv(t.events, "event_type", "user_id", "value", method).withColumn("value", F.round("value", 4))


@query("one_sample_t", "SELECT round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 6) AS statistic, count(*) - 1 AS df, round(avg(l_quantity), 6) AS mean, count(*) AS n FROM lineitem")
def _(t):
    return E.one_sample_t(t.lineitem, "l_quantity", 25).select(F.round("statistic", 6).alias("statistic"), "df", F.round("mean", 6).alias("mean"), "n")


@query("prop_test", "SELECT round((avg((o_orderstatus = 'F')::INT) - 0.4) / sqrt(0.4 * 0.6 / count(*)), 6) AS statistic, round(avg((o_orderstatus = 'F')::INT), 8) AS proportion, count(*) AS n FROM orders")
def _(t):
    return E.prop_test(t.orders.select((C("o_orderstatus") == "F").alias("f")), "f", 0.4).select(F.round("statistic", 6).alias("statistic"), F.round("proportion", 8).alias("proportion"), "n")


@query("two_prop_test", """WITH s AS (SELECT avg(x::INT) FILTER (g = 'A') AS pa, avg(x::INT) FILTER (g = 'R') AS pb, count(*) FILTER (g = 'A') AS na, count(*) FILTER (g = 'R') AS nb, avg(x::INT) FILTER (g IN ('A', 'R')) AS p FROM (SELECT l_returnflag AS g, l_quantity > 25 AS x FROM lineitem))
SELECT round((pa - pb) / sqrt(p * (1 - p) * (1 / na + 1 / nb)), 6) AS statistic, round(pa, 8) AS proportion_a, round(pb, 8) AS proportion_b, round(pa * (1 - pb) / ((1 - pa) * pb), 6) AS odds_ratio FROM s""")
def _(t):
    e = E.two_prop_test(t.lineitem.select("l_returnflag", (C("l_quantity") > 25).alias("x")), "x", "l_returnflag", "A", "R")
    return e.select(F.round("statistic", 6).alias("statistic"), F.round("proportion_a", 8).alias("proportion_a"), F.round("proportion_b", 8).alias("proportion_b"), F.round("odds_ratio", 6).alias("odds_ratio"))


@query("variance_test", "SELECT round(var_samp(l_quantity) FILTER (l_returnflag = 'A') / var_samp(l_quantity) FILTER (l_returnflag = 'R'), 8) AS statistic, count(*) FILTER (l_returnflag = 'A') - 1 AS df_a, count(*) FILTER (l_returnflag = 'R') - 1 AS df_b FROM lineitem")
def _(t):
    return E.variance_test(t.lineitem, "l_quantity", "l_returnflag", "A", "R").select(F.round("statistic", 8).alias("statistic"), "df_a", "df_b")


@query("effect_sizes", """WITH g AS (SELECT c_mktsegment, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v, count(*) AS n FROM customer GROUP BY 1) SELECT round(sqrt(sum((n - 1) * v) / sum(n - 1)), 6) AS common_sd, round(sqrt(sum(n * (m - (SELECT avg(c_acctbal) FROM customer)) ** 2) / sum((n - 1) * v)), 8) AS cohens_f FROM g""")
def _(t):
    return E.effect_sizes(t.customer, "c_acctbal", "c_mktsegment").select(F.round("common_sd", 6).alias("common_sd"), F.round("cohens_f", 8).alias("cohens_f"))


@query("group_variances", """WITH g AS (SELECT avg(c_acctbal) AS m, var_pop(c_acctbal) AS v, count(*) AS n FROM customer GROUP BY c_mktsegment) SELECT round(sum(v * n) / sum(n), 4) AS intra, round(sum(n * (m - (SELECT avg(c_acctbal) FROM customer)) ** 2) / sum(n), 4) AS inter, round((SELECT var_pop(c_acctbal) FROM customer), 4) AS merged FROM g""")
def _(t):
    g = t.customer.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m"), F.var_pop("c_acctbal").alias("v"), F.count(F.lit(1)).alias("n"))
    return g.agg(F.round(E.intra_group_variance(C("v"), C("n")), 4).alias("intra"), F.round(E.inter_group_variance(C("m"), C("n")), 4).alias("inter"), F.round(A.merge_vars(C("v"), C("m"), C("n")), 4).alias("merged"))


@query("mase", f"""WITH e AS (SELECT ts::DATE AS d, sum(value) AS v FROM events GROUP BY 1), l AS (SELECT *, v - lag(v) OVER (ORDER BY d) AS e1, d >= DATE '2024-01-20' AS test FROM e) SELECT round(avg(abs(v - 1000)) FILTER (test) / avg(abs(e1)) FILTER (NOT test), 8) AS mase FROM l""")
def _(t):
    d = t.events.groupBy(C("ts").cast("date").alias("d")).agg(F.sum("value").alias("v"))
    d = d.withColumn("naive", C("v") - F.lag("v").over(Window.orderBy("d")))
    return d.agg(F.round(E.mase(C("v"), F.lit(1000.0), C("naive"), C("d") >= F.lit("2024-01-20").cast("date")), 8).alias("mase"))


@query("cumprod_and_decay", """WITH e AS (SELECT event_type, ts::DATE AS d, count(*) AS v FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d) AS r FROM e)
SELECT a.event_type, a.d, round(sum(b.v * 0.5 ** (a.r - b.r)), 6) AS decayed, round(product(1 + b.v / 1000.0), 8) AS product FROM n a JOIN n b ON a.event_type = b.event_type AND b.r <= a.r GROUP BY 1, 2""")
def _(t):
    d = t.events.groupBy("event_type", C("ts").cast("date").alias("d")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    w = Window.partitionBy("event_type").orderBy("d")
    return d.select("event_type", "d", F.round(W.cumsum_decayed(C("v"), w, 0.5), 6).alias("decayed"), F.round(W.cumprod(1 + C("v") / 1000, w), 8).alias("product"))


@query("count_unique_if", "SELECT c_mktsegment, count(DISTINCT c_nationkey) FILTER (c_acctbal > 0) AS n, round(count(DISTINCT c_nationkey) FILTER (c_acctbal > 9000) / count(DISTINCT c_nationkey), 8) AS r FROM customer GROUP BY 1")
def _(t):
    return t.customer.groupBy("c_mktsegment").agg(A.count_unique_if(C("c_nationkey"), C("c_acctbal") > 0).alias("n"), F.round(A.count_unique_if_ratio(C("c_nationkey"), C("c_acctbal") > 9000), 8).alias("r"))


@query("percentages", """SELECT c_mktsegment, round(100 * count(*) FILTER (c_acctbal > 0) / count(*), 6) AS c, round(100 * avg((c_acctbal > 0)::INT), 6) AS t, round(100 * avg((c_acctbal <= 0)::INT), 6) AS f, round(100 * (avg(c_acctbal) FILTER (c_nationkey < 5)) / avg(c_acctbal), 6) AS m, round(100 * min(c_acctbal) FILTER (c_nationkey < 5) / min(c_acctbal), 6) AS lo, round(100 * max(c_acctbal) FILTER (c_nationkey < 5) / max(c_acctbal), 6) AS hi, 100.0::DOUBLE AS k, 0.0::DOUBLE AS u FROM customer GROUP BY 1""")
def _(t):
    x, c = C("c_acctbal"), C("c_nationkey") < 5
    p = {"c": A.count_if_ratio(x, x > 0, factor=100), "t": A.true_ratio(x > 0, 100), "f": A.false_ratio(x > 0, 100), "m": A.pct(A.mean_if_ratio, x, c), "lo": A.pct(A.min_if_ratio, x, c), "hi": A.pct(A.max_if_ratio, x, c), "k": A.non_na_ratio(x, 100), "u": A.na_ratio(x, 100)}
    return t.customer.groupBy("c_mktsegment").agg(*[F.round(v, 6).alias(k) for k, v in p.items()])


@query("dates_between", "SELECT o_orderkey, datesub('month', o_orderdate, TIMESTAMP '2005-03-15') AS m, datesub('year', o_orderdate, TIMESTAMP '2005-03-15') AS y FROM orders")
def _(t):
    end = F.lit("2005-03-15").cast("timestamp_ntz")
    months = F.floor(F.months_between(end, "o_orderdate")).cast("long")
    return t.orders.select("o_orderkey", months.alias("m"), F.floor(months / 12).alias("y"))


@query("unix_and_excel_dates", "SELECT o_orderkey, (DATE '1970-01-01' + (o_orderkey % 20000)::INT)::DATE AS u, (DATE '1899-12-30' + (o_orderkey % 20000 + 100)::INT)::DATE AS e FROM orders")
def _(t):
    k = C("o_orderkey") % 20000
    return t.orders.select("o_orderkey", D.unixtime_to_datetime(k * 86400).cast("date").alias("u"), D.excel_numeric_to_date(k + 100).cast("date").alias("e"))


@query("str_replacements", "SELECT p_partkey, regexp_replace(p_name, '^[^ ]* ', '$1 ') AS b, '<' || p_brand || '>' AS i, split_part(p_name, ' ', 1) || '!' AS a FROM part")
def _(t):
    x = F.concat(F.lit("<"), C("p_brand"), F.lit(">"))
    return t.part.select("p_partkey", S.str_replace_before(C("p_name"), " ", "$1 ").alias("b"), S.str_replace_inside(x, "<", ">", "", include_special_chars=True).alias("z"), x.alias("i"), S.str_replace_after(C("p_name"), " ", "!").alias("a")).drop("z")


@query("str_count_all", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]+'))::INT AS digits, len(regexp_extract_all(text, 'the'))::INT AS the FROM documents")
def _(t):
    m = S.str_count_all(C("text"), {"digits": "[0-9]+", "the": "the"})
    return t.documents.select("doc_id", m["digits"].alias("digits"), m["the"].alias("the"))


@query("extract_numeric", "SELECT p_partkey, try_cast(regexp_replace(p_brand, '[^0-9.-]', '', 'g') AS DOUBLE) AS x FROM part")
def _(t):
    return t.part.select("p_partkey", S.extract_numeric(C("p_brand")).alias("x"))


@query("is_digit", "SELECT p_partkey, regexp_full_match(right(p_brand, 2), '[0-9]+') AS d FROM part")
def _(t):
    return t.part.select("p_partkey", S.is_digit(F.expr("right(p_brand, 2)")).alias("d"))
