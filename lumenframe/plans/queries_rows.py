"""Joins, set operations, aggregation, reshaping and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import dates as D
from ..functions import numeric as N
from ..operators import grouping as G
from ..operators import joins as J
from ..operators import stats as S
from ..operators import windows as X
from .registry import query

C = F.col


def _nat(t):
    return t.nation.select("n_nationkey", "n_name", "n_regionkey")


@query("summarize_group_quarter", """SELECT date_trunc('quarter', o_orderdate)::DATE AS o_orderdate_rtoq, c_mktsegment, sum(o_totalprice) AS revenue, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f,
coalesce(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 0) / sum(o_totalprice) AS urgent_ratio FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def _(t):
    d = t.orders.join(t.customer, C("o_custkey") == C("c_custkey"))
    return G.summarize_group(d, ["o_orderdate", "c_mktsegment"], ["rtoq", None], revenue=F.sum("o_totalprice"), n_f=A.count_if(C("o_orderstatus") == "F"), urgent_ratio=A.sum_if_ratio(C("o_totalprice"), C("o_orderpriority") == "1-URGENT"))


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):

    @query(f"join_{_how}", f"SELECT coalesce(n_nationkey, k) AS n_nationkey, n_name, n_regionkey, c_custkey FROM (SELECT * FROM nation WHERE n_nationkey < 12) n {_sql} (SELECT c_custkey, c_nationkey + 5 AS k FROM customer) c ON n_nationkey = k")
    def _(t, how=_how):
        return J.join(_nat(t).where("n_nationkey < 12"), t.customer.select("c_custkey", (C("c_nationkey") + 5).alias("k")), {"n_nationkey": "k"}, how)


@query("join_semi_null", "SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE nullif(c_nationkey, 3) IS NOT DISTINCT FROM nullif(n_nationkey, 3) AND c_acctbal > 9000)")
def _(t):
    k = F.nullif(C("n_nationkey"), F.lit(3))
    x = t.nation.select("n_nationkey", "n_name", k.alias("k"))
    return J.join(x, t.customer.where("c_acctbal > 9000").select(F.nullif(C("c_nationkey"), F.lit(3)).alias("k")), ["k"], "semi").drop("k")


@query("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return J.join(t.customer.select("c_custkey"), t.orders.select("o_custkey"), {"c_custkey": "o_custkey"}, "anti")


@query("join_ignore_case", "SELECT n_name, c_custkey FROM nation JOIN (SELECT c_custkey, n_name AS k FROM customer JOIN nation ON c_nationkey = n_nationkey) ON lower(n_name) = lower(k)")
def _(t):
    y = t.customer.join(t.nation, C("c_nationkey") == C("n_nationkey")).select("c_custkey", F.upper("n_name").alias("k"))
    return J.join(t.nation.select("n_name"), y, {"n_name": "k"}, "inner", ignore_case=True)


@query("join_suffix", "SELECT a.n_nationkey, a.n_name AS \"n_name.x\", b.n_name AS \"n_name.y\" FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey")
def _(t):
    return J.join(t.nation.select("n_nationkey", "n_name"), t.nation.select("n_nationkey", "n_name"), ["n_nationkey"])


@query("cross_join", "SELECT n_name, r_name FROM nation, region")
def _(t):
    return J.cross_join(t.nation.select("n_name"), t.region.select("r_name"))


for _op, _sql in (("union", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("setdiff", "EXCEPT")):

    @query(f"set_{_op}", f"SELECT k FROM (SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 15) {_sql} SELECT s_nationkey FROM supplier WHERE s_nationkey > 5")
    def _(t, op=_op):
        return getattr(J, op)(t.customer.where("c_nationkey < 15").select(C("c_nationkey").alias("k")), t.supplier.where("s_nationkey > 5").select(C("s_nationkey").alias("k")))


@query("bind_rows", "SELECT 'a' AS src, n_nationkey AS k, n_name AS name, NULL::DOUBLE AS bal FROM nation UNION ALL SELECT 'b', s_suppkey, NULL, s_acctbal FROM supplier")
def _(t):
    return J.bind_rows({"a": t.nation.select(C("n_nationkey").cast("long").alias("k"), C("n_name").alias("name")), "b": t.supplier.select(C("s_suppkey").alias("k"), C("s_acctbal").alias("bal"))}, "src")


@query("aggregate_if", """SELECT l_returnflag, coalesce(sum(l_quantity) FILTER (l_discount > 0.05), 0) AS s, avg(l_quantity) FILTER (l_discount > 0.05) AS m, median(l_quantity) FILTER (l_discount > 0.05) AS md,
min(l_quantity) FILTER (l_discount > 0.05) AS lo, max(l_quantity) FILTER (l_discount > 0.05) AS hi, count(*) FILTER (l_discount > 0.05) AS n, count(DISTINCT l_suppkey) FILTER (l_discount > 0.05) AS u FROM lineitem GROUP BY 1""")
def _(t):
    c, x = C("l_discount") > 0.05, C("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(A.sum_if(x, c).alias("s"), A.mean_if(x, c).alias("m"), A.median_if(x, c).alias("md"), A.min_if(x, c).alias("lo"), A.max_if(x, c).alias("hi"), A.count_if(c).alias("n"), F.count_distinct(A.only(C("l_suppkey"), c)).alias("u"))


@query("aggregate_if_ratio", """SELECT l_returnflag, sum(l_quantity) FILTER (l_discount > 0.05) / sum(l_quantity) AS s, avg(l_quantity) FILTER (l_discount > 0.05) / avg(l_quantity) AS m, median(l_quantity) FILTER (l_discount > 0.05) / median(l_quantity) AS md,
min(l_quantity) FILTER (l_discount > 0.05) / min(l_quantity) AS lo, max(l_quantity) FILTER (l_discount > 0.05) / max(l_quantity) AS hi, avg((l_discount > 0.05)::INT) AS n, 100 * sum(l_tax) FILTER (l_discount > 0.05) / sum(l_tax) AS p FROM lineitem GROUP BY 1""")
def _(t):
    c, x = C("l_discount") > 0.05, C("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(A.sum_if_ratio(x, c).alias("s"), A.mean_if_ratio(x, c).alias("m"), A.median_if_ratio(x, c).alias("md"), A.min_if_ratio(x, c).alias("lo"), A.max_if_ratio(x, c).alias("hi"), A.count_if_ratio(c).alias("n"), A.pct(A.sum_if_ratio, C("l_tax"), c).alias("p"))


@query("count_values", """SELECT event_type, count(*) AS n, count(*) FILTER (b) AS t, count(*) FILTER (NOT b) AS f, count(*) FILTER (b IS NULL) AS na, count(b) AS nn, avg(b::INT) AS tr, avg((NOT b)::INT) AS fr, avg((b IS NULL)::INT) AS nr, count(DISTINCT user_id) AS u
FROM (SELECT *, CASE WHEN value > 20 THEN value > 50 END AS b FROM events) GROUP BY 1""")
def _(t):
    b = F.when(C("value") > 20, C("value") > 50)
    return t.events.groupBy("event_type").agg(A.count_rows().alias("n"), A.true_count(b).alias("t"), A.false_count(b).alias("f"), A.na_count(b).alias("na"), A.non_na_count(b).alias("nn"), A.true_ratio(b).alias("tr"), A.false_ratio(b).alias("fr"), A.na_ratio(b).alias("nr"), A.count_unique(C("user_id")).alias("u"))


@query("mode_by", "SELECT l_suppkey, arg_min(k, (-n, o)) AS mode FROM (SELECT l_suppkey, l_returnflag AS k, count(*) AS n, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return G.mode_by(t.lineitem, ["l_suppkey"], "l_returnflag", "l_orderkey")


@query("metrics", """SELECT l_returnflag, sqrt(avg((a - p) ** 2)) AS rmse, avg(abs(a - p)) AS mae, avg(a - p) AS me, avg(abs((a - p) / a)) AS mape, 1 - sum((a - p) ** 2) / (var_pop(a) * count(a)) AS r2
FROM (SELECT l_returnflag, l_extendedprice AS a, l_quantity * 1000 AS p FROM lineitem) GROUP BY 1""")
def _(t):
    a, p = C("l_extendedprice"), C("l_quantity") * 1000
    return t.lineitem.groupBy("l_returnflag").agg(A.rmse(a, p).alias("rmse"), A.mae(a, p).alias("mae"), A.mean_error(a, p).alias("me"), A.mape(a, p).alias("mape"), A.r_squared(a, p).alias("r2"))


@query("confidence", "SELECT c_mktsegment, stddev_samp(c_acctbal) / sqrt(count(*)) * 1.959963984540054 AS r, sqrt(avg((c_acctbal > 0)::INT) * (1 - avg((c_acctbal > 0)::INT)) / count(*)) * 1.959963984540054 AS p FROM customer GROUP BY 1")
def _(t):
    return t.customer.groupBy("c_mktsegment").agg(A.confint_radius(C("c_acctbal")).alias("r"), A.prop_confint_radius(C("c_acctbal") > 0).alias("p"))


@query("pivot_wide", "SELECT event_type, sum(value) FILTER (dayofweek(ts) = 0) AS \"1\", sum(value) FILTER (dayofweek(ts) = 3) AS \"4\" FROM events GROUP BY 1")
def _(t):
    return G.pivot(t.events, ["event_type"], "ts", F.sum("value"), values=[1, 4], col_fun="wday").withColumnRenamed("event_type", "event_type")


@query("pivot_longer", "SELECT l_orderkey, l_linenumber, u.name, u.value FROM lineitem, LATERAL (VALUES ('l_discount', l_discount), ('l_quantity', l_quantity)) u(name, value)")
def _(t):
    return G.pivot_longer(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"])


@query("one_hot", "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS \"o_orderstatus_F\", (o_orderstatus = 'O')::INT AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INT AS \"o_orderstatus_P\" FROM orders")
def _(t):
    return G.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("multiple_answers", "SELECT DISTINCT p_partkey, 'a' AS \"Question\", trim(unnest(string_split(p_brand || ', ' || p_type || ',' || p_brand, ','))) AS \"Answer\" FROM part")
def _(t):
    return G.multiple_answers_to_longer(t.part.select("p_partkey", F.concat("p_brand", F.lit(", "), "p_type", F.lit(","), "p_brand").alias("a")), ["a"])


@query("filter_cascade", "SELECT o_orderkey FROM (SELECT *, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS m FROM orders WHERE o_orderstatus = 'F') WHERE o_totalprice > m")
def _(t):
    return G.filter_cascade(t.orders, C("o_orderstatus") == "F", lambda d: C("o_totalprice") > 0).withColumn("m", F.avg("o_totalprice").over(Window.partitionBy("o_orderpriority"))).where("o_totalprice > m").select("o_orderkey")


@query("cohort", """SELECT date_trunc('month', f)::DATE AS cohort, (year(o_orderdate) - year(f)) * 12 + month(o_orderdate) - month(f) AS period, count(DISTINCT o_custkey) AS value
FROM (SELECT *, min(o_orderdate) OVER (PARTITION BY o_custkey) AS f FROM orders) GROUP BY 1, 2""")
def _(t):
    return G.do_cohort(t.orders.withColumn("f", F.min("o_orderdate").over(Window.partitionBy("o_custkey"))), "o_orderdate", "o_custkey", "f")


def _events(t):
    return t.events.withColumn("v", F.when(C("event_id") % 5 != 0, C("value"))), Window.partitionBy("user_id").orderBy("ts", "event_id")


_EV = "(SELECT *, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events)"
_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query("cumulative", f"""SELECT event_id, CASE WHEN v IS NOT NULL THEN sum(round(v * 100)::BIGINT) {_W}::BIGINT END AS s, CASE WHEN v IS NOT NULL THEN avg(round(v * 100)::BIGINT) {_W} END AS m, CASE WHEN v IS NOT NULL THEN min(v) {_W} END AS lo, CASE WHEN v IS NOT NULL THEN max(v) {_W} END AS hi,
CASE WHEN v IS NOT NULL THEN bool_and(v > 1) {_W} END AS al, CASE WHEN v IS NOT NULL THEN bool_or(v > 90) {_W} END AS an FROM {_EV}""")
def _(t):
    d, w = _events(t)
    v = C("v")
    return d.select("event_id", X.cumsum(F.round(v * 100).cast("long"), w).alias("s"), X.cummean(F.round(v * 100).cast("long"), w).alias("m"), X.cummin(v, w).alias("lo"), X.cummax(v, w).alias("hi"), X.cumall(v > 1, w).alias("al"), X.cumany(v > 90, w).alias("an"))


@query("cumsum_until_na", f"SELECT event_id, CASE WHEN max((v IS NULL)::INT) {_W} = 0 THEN round(sum(v) {_W}, 6) END AS s FROM {_EV}")
def _(t):
    d, w = _events(t)
    return d.select("event_id", F.round(X.cumsum(C("v"), w, skip_na=False), 6).alias("s"))


@query("fill", f"""SELECT event_id, coalesce(v, last_value(v IGNORE NULLS) {_W}) AS prev, CASE WHEN v IS NOT NULL THEN v WHEN first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) IS NOT NULL THEN last_value(v IGNORE NULLS) {_W} END AS btw,
coalesce(v, avg(v) OVER (PARTITION BY user_id)) AS imp FROM {_EV}""")
def _(t):
    d, w = _events(t)
    v = C("v")
    return d.select("event_id", X.fill_ts_na(v, w).alias("prev"), X.fill_between(v, w).alias("btw"), X.impute_na(v, Window.partitionBy("user_id")).alias("imp"))


@query("complete_dates", """WITH d AS (SELECT user_id, ts::DATE AS ts, sum(value) AS value FROM events GROUP BY 1, 2), r AS (SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY))::DATE AS ts FROM d GROUP BY 1)
SELECT user_id, ts, round(coalesce(value, 0), 6) AS value FROM r LEFT JOIN d USING (user_id, ts)""")
def _(t):
    return X.anomaly_baseline(t.events, "ts", "value", ["user_id"]).withColumn("value", F.round("value", 6))


@query("ts_lag", """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)
SELECT a.month, a.o_orderpriority, a.value, (SELECT arg_max(b.value, b.month) FROM m b WHERE b.o_orderpriority = a.o_orderpriority AND b.month <= a.month - INTERVAL 1 YEAR) AS value_lag FROM m a""")
def _(t):
    m = t.orders.groupBy(D.floor_date(C("o_orderdate"), "month").alias("month"), "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return X.ts_lag(m, "month", "value", ["o_orderpriority"], "year", 1)


for _k, _lo, _hi in (("iqr", "quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))", "quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))"), ("percentile", "quantile_cont(value, 0.05)", "quantile_cont(value, 0.95)"), ("sd", "avg(value) - 1.96 * stddev_samp(value)", "avg(value) + 1.96 * stddev_samp(value)")):

    @query(f"outlier_{_k}", f"SELECT event_id, CASE WHEN value > hi THEN 'Upper' WHEN value < lo THEN 'Lower' ELSE 'Normal' END AS outlier FROM events JOIN (SELECT event_type, {_lo} AS lo, {_hi} AS hi FROM events GROUP BY 1) USING (event_type)")
    def _(t, k=_k):
        return X.detect_outlier(t.events, "value", ["event_type"], k).select("event_id", "outlier")


@query("normalize", "SELECT event_id, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS normalized FROM events WINDOW w AS (PARTITION BY event_type)")
def _(t):
    return X.normalize(t.events, "value", ["event_type"]).select("event_id", F.round("normalized", 6).alias("normalized"))


@query("cut_by_step", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN '-Inf - 10' WHEN l_quantity > 40 THEN '40 - Inf' ELSE (10 + (greatest(ceil((l_quantity - 10) / 10), 1) - 1) * 10)::DOUBLE || ' - ' || (10 + greatest(ceil((l_quantity - 10) / 10), 1) * 10)::DOUBLE END AS bin FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", X.cut_by_step(C("l_quantity"), 10.0, 10.0, 40.0).alias("bin"))


@query("predicates", "SELECT p_partkey, p_size BETWEEN 5 AND 20 AS b, p_brand IN ('Brand#11', 'Brand#12') AS i, true AS e, p_size >= 10 AS g FROM part")
def _(t):
    return t.part.select("p_partkey", N.between(C("p_size"), 5, 20).alias("b"), N.in_or_all(C("p_brand"), ["Brand#11", "Brand#12"]).alias("i"), N.in_or_all(C("p_brand"), []).alias("e"), N.compare_or_all(C("p_size"), ">=", 10).alias("g"))


@query("mutate_group", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS total FROM orders")
def _(t):
    return G.mutate_group(t.orders, ["o_custkey"], [C("o_orderdate"), C("o_orderkey")], n=lambda w: F.row_number().over(w), total=F.sum("o_totalprice")).select("o_orderkey", C("n").cast("long").alias("n"), F.round("total", 4).alias("total"))


@query("cor_cols", "SELECT 'l_discount' AS var1, 'l_quantity' AS var2, round(corr(l_discount, l_quantity), 9) AS correlation FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 9) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 9) FROM lineitem")
def _(t):
    return S.do_cor_cols(t.lineitem, ["l_quantity", "l_discount", "l_tax"]).withColumn("correlation", F.round("correlation", 9))


@query("chi_squared", """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2), x AS (SELECT a, b, coalesce(o, 0) AS o, (SELECT sum(o) FROM c d WHERE d.a = r.a) * (SELECT sum(o) FROM c d WHERE d.b = k.b) / (SELECT sum(o) FROM c) AS e FROM (SELECT DISTINCT a FROM c) r CROSS JOIN (SELECT DISTINCT b FROM c) k LEFT JOIN c USING (a, b))
SELECT round(sum((o - e) ** 2 / e), 6) AS statistic, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df, (SELECT sum(o)::BIGINT FROM c) AS n FROM x""")
def _(t):
    return S.chi_squared(t.lineitem, "l_returnflag", "l_linestatus").withColumn("statistic", F.round("statistic", 6))


@query("welch_t", """WITH s AS (SELECT avg(l_quantity) FILTER (l_returnflag = 'A') AS ma, avg(l_quantity) FILTER (l_returnflag = 'R') AS mb, var_samp(l_quantity) FILTER (l_returnflag = 'A') / count(*) FILTER (l_returnflag = 'A') AS va, var_samp(l_quantity) FILTER (l_returnflag = 'R') / count(*) FILTER (l_returnflag = 'R') AS vb,
count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nb FROM lineitem) SELECT round((ma - mb) / sqrt(va + vb), 6) AS statistic, round((va + vb) ** 2 / (va ** 2 / (na - 1) + vb ** 2 / (nb - 1)), 4) AS df, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b FROM s""")
def _(t):
    return S.welch_t(t.lineitem, "l_quantity", "l_returnflag", "A", "R").select(F.round("statistic", 6).alias("statistic"), F.round("df", 4).alias("df"), F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"))


@query("anova", """WITH g AS (SELECT avg(l_quantity) AS m, var_pop(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY l_returnflag), s AS (SELECT sum(n) AS n, count(*) AS k, sum(n * v) AS w, sum(n * (m - (SELECT avg(l_quantity) FROM lineitem)) ** 2) AS b FROM g)
SELECT round(b / (k - 1) / (w / (n - k)), 5) AS statistic, k - 1 AS df_between, (n - k)::BIGINT AS df_within FROM s""")
def _(t):
    return S.anova(t.lineitem, "l_quantity", "l_returnflag").withColumn("statistic", F.round("statistic", 5))


@query("confusion", """WITH c AS (SELECT count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (NOT a AND NOT p) AS tn FROM (SELECT quality = 1 AS a, n_chars > 500 AS p FROM labels JOIN documents USING (doc_id)))
SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c""")
def _(t):
    return S.confusion(t.labels.join(t.documents, "doc_id").select((C("quality") == 1).alias("a"), (C("n_chars") > 500).alias("p")), "a", "p")


@query("roc_points", "SELECT s AS score, sum(p) OVER (ORDER BY s DESC)::BIGINT AS tp, sum(q) OVER (ORDER BY s DESC)::BIGINT AS fp FROM (SELECT n_chars // 100 AS s, sum(quality) AS p, sum(1 - quality) AS q FROM labels JOIN documents USING (doc_id) GROUP BY 1)")
def _(t):
    d = t.labels.join(t.documents, "doc_id").select(F.expr("n_chars div 100").alias("score"), (C("quality") == 1).alias("y"))
    return S.roc_points(d, "score", "y")


@query("kaplan_meier", """WITH b AS (SELECT o_orderpriority, datediff('day', DATE '1995-01-01', o_orderdate::DATE) // 30 AS t, count(*) AS m, sum((o_orderstatus = 'F')::INT) AS e FROM orders GROUP BY 1, 2), r AS (SELECT *, sum(m) OVER (PARTITION BY o_orderpriority ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM b)
SELECT o_orderpriority, t, n::BIGINT AS n_risk, e::BIGINT AS n_event, round(product(1 - e / n) OVER (PARTITION BY o_orderpriority ORDER BY t ROWS UNBOUNDED PRECEDING), 9) AS estimate FROM r""")
def _(t):
    d = t.orders.select("o_orderpriority", F.expr("cast(datediff(o_orderdate, date '1995-01-01') div 30 as bigint)").alias("t"), (C("o_orderstatus") == "F").alias("e"))
    return S.kaplan_meier(d, "t", "e", ["o_orderpriority"]).withColumn("estimate", F.round("estimate", 9))


@query("association_rules", """WITH r AS (SELECT DISTINCT l_orderkey AS b, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey), o AS (SELECT i, count(*) AS c FROM r GROUP BY 1), n AS (SELECT count(DISTINCT b) AS t FROM r),
p AS (SELECT x.i AS lhs, y.i AS rhs, count(*) AS n FROM r x JOIN r y ON x.b = y.b AND x.i <> y.i GROUP BY 1, 2)
SELECT lhs, rhs, p.n / t AS support, p.n / a.c AS confidence, p.n * t / a.c / z.c AS lift FROM p JOIN o a ON lhs = a.i JOIN o z ON rhs = z.i, n WHERE p.n / t >= 0.01 AND p.n / a.c >= 0.1""")
def _(t):
    return S.association_rules(t.lineitem.join(t.part, C("l_partkey") == C("p_partkey")), "l_orderkey", "p_brand")


@query("cosine_similarity", """WITH v AS (SELECT c_nationkey AS s, c_mktsegment AS k, sum(c_acctbal) AS v FROM customer GROUP BY 1, 2), u AS (SELECT s, k, v / sqrt(sum(v * v) OVER (PARTITION BY s)) AS u FROM v)
SELECT a.s AS x, b.s AS y, round(sum(a.u * b.u), 9) AS similarity FROM u a JOIN u b ON a.k = b.k AND a.s < b.s GROUP BY 1, 2""")
def _(t):
    return S.cosine_similarity(t.customer, "c_nationkey", "c_mktsegment", "c_acctbal").withColumn("similarity", F.round("similarity", 9))
