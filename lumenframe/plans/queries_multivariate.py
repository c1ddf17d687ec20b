"""Reliability, correspondence, singular values, divergence, multinomial and ordinal models, p-values in closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chaid as H
from ..operators import evaluation as E
from ..operators import models as M
from ..operators import multivariate as V
from ..operators import power as W
from ..operators import stats as S
from .registry import query

C = F.col


def _rounded(df, digits: int, *cols: str):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("cronbach_alpha", """WITH s AS (SELECT var_samp(l_quantity) AS a, var_samp(l_extendedprice / 1000) AS b, var_samp(l_partkey / 10) AS c, var_samp(l_quantity + l_extendedprice / 1000 + l_partkey / 10) AS t, count(*) AS n FROM lineitem)
SELECT round(1.5 * (1 - (a + b + c) / t), 8) AS raw_alpha, 3 AS items, n FROM s""")
def _(t):
    d = t.lineitem.select(C("l_quantity").alias("a"), (C("l_extendedprice") / 1000).alias("b"), (C("l_partkey") / 10).alias("c"))
    return _rounded(V.cronbach_alpha(d, ["a", "b", "c"])[0].drop("standardized_alpha"), 8, "raw_alpha")


_CHI = """c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS kb FROM c GROUP BY 1), n AS (SELECT sum(o) AS n FROM c),
x AS (SELECT sum((coalesce(o, 0) - ra * kb / n) ** 2 / (ra * kb / n)) AS chi, max(n) AS n FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c ON c.a = r.a AND c.b = k.b)"""


@query("correspondence", f"WITH {_CHI} SELECT 1 AS dimension, round(chi / n, 8) AS eigenvalue, 100.0::DOUBLE AS percent FROM x")
def _(t):
    out = V.correspondence(t.lineitem, "l_returnflag", "l_linestatus")[0].drop("cumulative_percent")
    return _rounded(out, 8, "eigenvalue", "percent")


@query("svd_cols", """WITH s AS (SELECT regr_sxx(l_quantity, l_partkey) AS b, regr_syy(l_quantity, l_partkey) AS a, regr_sxy(l_quantity, l_partkey) AS c FROM lineitem)
SELECT 1 AS component, round(sqrt((a + b + sqrt((a - b) ** 2 + 4 * c * c)) / 2), 4) AS value FROM s UNION ALL SELECT 2, round(sqrt((a + b - sqrt((a - b) ** 2 + 4 * c * c)) / 2), 4) FROM s""")
def _(t):
    return _rounded(V.svd_cols(t.lineitem.select("l_quantity", "l_partkey"), ["l_quantity", "l_partkey"])[2], 4, "value")


@query("js_divergence", """WITH v AS (SELECT c_nationkey AS s, c_mktsegment AS k, count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey) AS v FROM customer GROUP BY 1, 2),
k AS (SELECT DISTINCT k FROM v), s AS (SELECT DISTINCT s FROM v), g AS (SELECT s.s, k.k, coalesce(v, 0) AS v FROM s CROSS JOIN k LEFT JOIN v ON v.s = s.s AND v.k = k.k)
SELECT a.s AS x, b.s AS y, round(0.5 * sum(CASE WHEN a.v > 0 THEN a.v * ln(2 * a.v / (a.v + b.v)) ELSE 0 END + CASE WHEN b.v > 0 THEN b.v * ln(2 * b.v / (a.v + b.v)) ELSE 0 END), 8) + 0 AS value FROM g a JOIN g b ON a.k = b.k AND a.s < b.s GROUP BY 1, 2""")
def _(t):
    n = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("c_nationkey").agg(F.sum("n").alias("t"))
    shares = n.join(total, "c_nationkey").withColumn("v", C("n") / C("t"))
    return V.js_divergence_kv(shares, "c_nationkey", "c_mktsegment", "v").withColumn("value", F.round("value", 8) + 0.0)


@query("multinomial", """WITH c AS (SELECT l_returnflag AS k, l_quantity > 25 AS x, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT min(l_returnflag) AS b FROM lineitem),
o AS (SELECT c.k, c.x, ln(c.n / d.n) AS v FROM c JOIN c d ON c.x = d.x JOIN m ON d.k = m.b WHERE c.k <> m.b)
SELECT k AS class, '(Intercept)' AS term, round(v, 3) AS estimate FROM o WHERE NOT x UNION ALL SELECT p.k, 'large', round(p.v - q.v, 3) FROM o p JOIN o q ON p.k = q.k WHERE p.x AND NOT q.x""")
def _(t):
    d = t.lineitem.select("l_returnflag", (C("l_quantity") > 25).cast("int").alias("large"))
    return _rounded(M.multinomial(d, "l_returnflag", ["large"]).drop("odds_ratio"), 3, "estimate")


@query("ordinal_thresholds", """WITH o AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT p, lead(p) OVER (ORDER BY p) AS q, sum(n) OVER (ORDER BY p) / sum(n) OVER () AS f FROM o)
SELECT p || '|' || q AS term, round(ln(f / (1 - f)), 6) AS estimate FROM c WHERE q IS NOT NULL""")
def _(t):
    order = [r[0] for r in t.orders.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    return _rounded(M.ordinal(t.orders, "o_orderpriority", order, []).select("term", "estimate"), 6, "estimate")


@query("survival_roc", """WITH d AS (SELECT l_discount AS score, (q < 25 OR (q = 25 AND e))::INT AS dead FROM (SELECT l_discount, l_quantity AS q, l_returnflag <> 'N' AS e FROM lineitem) WHERE NOT (q < 25 AND NOT e)),
s AS (SELECT score, sum(dead) AS p, sum(1 - dead) AS n FROM d GROUP BY 1) SELECT score, (sum(p) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS fp FROM s WINDOW w AS (ORDER BY score DESC)""")
def _(t):
    d = t.lineitem.select("l_discount", "l_quantity", (C("l_returnflag") != "N").alias("e"))
    return E.survival_roc(d, "l_discount", "l_quantity", "e", 25)


@query("binned_actual", """WITH d AS (SELECT l_extendedprice AS y, l_quantity::DOUBLE AS v FROM lineitem), s AS (SELECT min(v) AS a, (max(v) - min(v)) / 20 AS w FROM d), g AS (SELECT y, v, greatest(ceil((v - a) / w)::INT, 1) AS g FROM d, s)
SELECT round(avg(v), 6) AS x, round(avg(y), 4) AS actual, round(avg(y) - 1.959963984540054 * stddev_samp(y) / sqrt(count(*)), 4) AS conf_low, round(avg(y) + 1.959963984540054 * stddev_samp(y) / sqrt(count(*)), 4) AS conf_high, count(*) AS n FROM g GROUP BY g""")
def _(t):
    return _rounded(_rounded(E.binned_actual(t.lineitem, "l_extendedprice", "l_quantity"), 4, "actual", "conf_low", "conf_high"), 6, "x")


@query("firm_importance", """WITH p AS (SELECT l_returnflag AS v, l_linenumber, avg(l_quantity) AS y, count(*) AS w FROM lineitem GROUP BY 1, 2), m AS (SELECT v, sum(w * y) / sum(w) AS m, sum(w) AS n FROM p GROUP BY 1)
SELECT v AS variable, round(sqrt(sum(w * (y - m) ** 2) / (max(n) - 1)), 6) AS importance FROM p JOIN m USING (v) GROUP BY 1""")
def _(t):
    curves = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_quantity").alias("y"), F.count(F.lit(1)).alias("w"), F.lit(True).alias("numeric"))
    return _rounded(E.firm_importance(curves, "l_returnflag", "y", "w", "numeric"), 6, "importance")


@query("bayes_ab_posteriors", """SELECT l_returnflag AS "group", count(*) AS n, count(*) FILTER (l_quantity > 20) AS converted, round((1 + count(*) FILTER (l_quantity > 20)) / (2 + count(*)), 8) AS mean FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1""")
def _(t):
    d = t.lineitem.select("l_returnflag", (C("l_quantity") > 20).alias("x"))
    return _rounded(W.bayes_ab(d, "x", "l_returnflag", "A", "R").select("group", "n", "converted", "mean"), 8, "mean")


@query("p_value_chi_squared", f"WITH {_CHI.replace('l_linestatus', 'l_linenumber % 2')} SELECT round(chi, 6) AS statistic, round(exp(-chi / 2), 8) AS p_value FROM x")
def _(t):
    d = t.lineitem.select("l_returnflag", (C("l_linenumber") % 2).alias("odd"))
    return _rounded(_rounded(S.p_values(S.chi_squared(d, "l_returnflag", "odd"), "chi_squared").select("statistic", "p_value"), 6, "statistic"), 8, "p_value")


@query("p_value_f", """WITH g AS (SELECT l_returnflag, avg(l_quantity) AS m, var_pop(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT avg(l_quantity) AS grand FROM lineitem),
f AS (SELECT sum(n * (m - grand) ** 2) / 2 / (sum(n * v) / (sum(n) - 3)) AS f, sum(n) - 3 AS d FROM g, t) SELECT round(f, 6) AS statistic, round((1 + 2 * f / d) ** (-d / 2), 8) AS p_value FROM f""")
def _(t):
    return _rounded(_rounded(S.p_values(S.anova(t.lineitem, "l_quantity", "l_returnflag"), "f").select("statistic", "p_value"), 6, "statistic"), 8, "p_value")


_SIZES = "c AS (SELECT CASE WHEN l_quantity > 25 THEN 'true' ELSE 'false' END AS s, CASE WHEN l_quantity > 20 THEN 'high' ELSE 'low' END AS f, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def _amounts(t):
    return t.lineitem.select((C("l_quantity") > 25).alias("large"), F.when(C("l_quantity") > 20, "high").otherwise("low").alias("amount"))


def _tree(t):
    return H.chaid(_amounts(t), "amount", ["large"], max_depth=1)


@query("chaid_split", f"""WITH {_SIZES}, m AS (SELECT *, sum(n) OVER (PARTITION BY s) * sum(n) OVER (PARTITION BY f) / sum(n) OVER () AS e FROM c), t AS (SELECT sum(n) AS n, sum(e) AS e, sum((n - e) ** 2 / e) AS x FROM m)
SELECT 1 AS node, 'large' AS predictor, 2 AS groups, round(x + n - e, 4) AS statistic, 1 AS df FROM t""")
def _(t):
    return _rounded(_tree(t).split_summary(t.spark).drop("p_value", "adjusted_p_value"), 4, "statistic")


@query("chaid_rules", f"""WITH {_SIZES}, k AS (SELECT *, sum(n) OVER (PARTITION BY s) AS t, row_number() OVER (PARTITION BY s ORDER BY n DESC, f) AS i FROM c)
SELECT 'large in (' || s || ')' AS rule, t::BIGINT AS n, f AS predicted_label, round(n / t, 8) AS probability FROM k WHERE i = 1""")
def _(t):
    return _rounded(_tree(t).rule_table(t.spark).drop("node"), 8, "probability")


@query("chaid_errors", f"WITH {_SIZES}, k AS (SELECT s, sum(n) AS t, sum(n) - max(n) AS e FROM c GROUP BY 1) SELECT t::BIGINT AS n, e::BIGINT AS errors, round(e / t, 8) AS error_rate FROM k")
def _(t):
    return _rounded(_tree(t).errors(_amounts(t)).drop("node"), 8, "error_rate")
