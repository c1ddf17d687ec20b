"""Models whose results SQL has in closed form: a line, models of one indicator, two components, itemsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from .registry import query

C = F.col


def _rounded(df, digits: int, *cols: str):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("lm_tidy", """WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2, regr_sxx(l_extendedprice, l_quantity) AS sxx,
regr_syy(l_extendedprice, l_quantity) AS syy, count(*) AS n, avg(l_quantity) AS m FROM lineitem), v AS (SELECT *, (1 - r2) * syy / (n - 2) AS s2 FROM s)
SELECT '(Intercept)' AS term, round(a, 4) AS estimate, round(sqrt(s2 * (1.0 / n + m * m / sxx)), 4) AS std_error, round(a / sqrt(s2 * (1.0 / n + m * m / sxx)), 4) AS t_ratio FROM v
UNION ALL SELECT 'l_quantity', round(b, 4), round(sqrt(s2 / sxx), 4), round(b / sqrt(s2 / sxx), 4) FROM v""")
def _(t):
    out = M.lm(t.lineitem, "l_extendedprice", ["l_quantity"]).tidy(t.spark).drop("p_value")
    return _rounded(out, 4, "estimate", "std_error", "t_ratio")


@query("lm_glance", """SELECT count(*) AS n, count(*) - 2 AS df_residual, round(regr_r2(l_extendedprice, l_quantity), 8) AS r_squared FROM lineitem""")
def _(t):
    out = M.lm(t.lineitem, "l_extendedprice", ["l_quantity"]).glance(t.spark).select("n", "df_residual", "r_squared")
    return _rounded(out, 8, "r_squared")


@query("lm_levels", """WITH g AS (SELECT l_returnflag AS g, avg(l_quantity) AS m, row_number() OVER (ORDER BY count(*) DESC, l_returnflag) AS k FROM lineitem GROUP BY 1)
SELECT CASE WHEN k = 1 THEN '(Intercept)' ELSE 'l_returnflag' || g END AS term, round(CASE WHEN k = 1 THEN m ELSE m - (SELECT m FROM g WHERE k = 1) END, 6) AS estimate FROM g""")
def _(t):
    return _rounded(M.lm(t.lineitem, "l_quantity", ["l_returnflag"]).tidy(t.spark).select("term", "estimate"), 6, "estimate")


@query("lm_augment", """WITH s AS (SELECT regr_slope(o_totalprice, k) AS b, regr_intercept(o_totalprice, k) AS a FROM (SELECT o_totalprice, (o_orderstatus = 'F')::INT AS k FROM orders))
SELECT o_orderkey, round(a + b * (o_orderstatus = 'F')::INT, 3) AS predicted_value, round(o_totalprice - a - b * (o_orderstatus = 'F')::INT, 3) AS residual FROM orders, s""")
def _(t):
    d = t.orders.select("o_orderkey", "o_totalprice", (C("o_orderstatus") == "F").cast("int").alias("k"))
    return _rounded(M.lm(d, "o_totalprice", ["k"]).augment(d).select("o_orderkey", "predicted_value", "residual"), 3, "predicted_value", "residual")


@query("lm_by", """SELECT l_returnflag, l_linestatus, round(regr_intercept(l_extendedprice, l_quantity), 5) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope,
round(regr_r2(l_extendedprice, l_quantity), 8) AS r_squared, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(t):
    out = M.lm_by(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity")
    return _rounded(_rounded(out, 5, "intercept", "slope"), 8, "r_squared")


@query("glm_binomial", """WITH g AS (SELECT l_quantity > 25 AS x, avg((l_returnflag = 'N')::INT) AS p, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT x, ln(p / (1 - p)) AS z, 1 / (n * p * (1 - p)) AS v FROM g),
a AS (SELECT z AS z0, v AS v0 FROM w WHERE NOT x), b AS (SELECT z AS z1, v AS v1 FROM w WHERE x)
SELECT '(Intercept)' AS term, round(z0, 5) AS estimate, round(sqrt(v0), 5) AS std_error FROM a UNION ALL SELECT 'large', round(z1 - z0, 5), round(sqrt(v0 + v1), 5) FROM a, b""")
def _(t):
    d = t.lineitem.select((C("l_returnflag") == "N").alias("y"), (C("l_quantity") > 25).cast("int").alias("large"))
    return _rounded(M.glm(d, "y", ["large"], "binomial").tidy(t.spark).select("term", "estimate", "std_error"), 5, "estimate", "std_error")


@query("glm_poisson", """WITH g AS (SELECT l_linestatus = 'F' AS x, avg(l_linenumber) AS m FROM lineitem GROUP BY 1), a AS (SELECT ln(m) AS z0 FROM g WHERE NOT x), b AS (SELECT ln(m) AS z1 FROM g WHERE x)
SELECT '(Intercept)' AS term, round(z0, 5) AS estimate FROM a UNION ALL SELECT 'f', round(z1 - z0, 5) FROM a, b""")
def _(t):
    d = t.lineitem.select("l_linenumber", (C("l_linestatus") == "F").cast("int").alias("f"))
    return _rounded(M.glm(d, "l_linenumber", ["f"], "poisson").tidy(t.spark).select("term", "estimate"), 5, "estimate")


@query("prcomp", """WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
SELECT 1 AS component, round(sqrt(1 + r), 8) AS standard_deviation, round((1 + r) / 2, 8) AS proportion, round((1 + r) / 2, 8) AS cumulative FROM r
UNION ALL SELECT 2, round(sqrt(1 - r), 8), round((1 - r) / 2, 8), 1 FROM r""")
def _(t):
    return _rounded(M.prcomp(t.lineitem, ["l_quantity", "l_extendedprice"]).variance(t.spark), 8, "standard_deviation", "proportion", "cumulative")


for _m, _sql in (("euclidean", "sqrt(sum((x - y) ** 2))"), ("manhattan", "sum(abs(x - y))"), ("maximum", "max(abs(x - y))")):

    @query(f"dist_cols_{_m}", f"""SELECT a AS pair_name_x, b AS pair_name_y, round({_sql}, 6) AS value FROM lineitem, LATERAL (VALUES ('l_discount', 'l_quantity', l_discount, l_quantity),
('l_discount', 'l_tax', l_discount, l_tax), ('l_quantity', 'l_tax', l_quantity, l_tax)) u(a, b, x, y) GROUP BY 1, 2""")
    def _(t, method=_m):
        return _rounded(M.dist_cols(t.lineitem, ["l_quantity", "l_discount", "l_tax"], method), 6, "value")


_B = "WITH i AS MATERIALIZED (SELECT DISTINCT l_orderkey AS b, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey), n AS MATERIALIZED (SELECT count(DISTINCT b) AS n FROM i)"


def _brands(t):
    return t.lineitem.join(t.part, C("l_partkey") == C("p_partkey")).select("l_orderkey", "p_brand")


_SETS = """a AS MATERIALIZED (SELECT i, count(*) AS freq FROM i GROUP BY i HAVING count(*) >= (SELECT ceil(0.01 * n) FROM n)),
j AS MATERIALIZED (SELECT b, i.i FROM i JOIN a ON i.i = a.i), two AS MATERIALIZED (SELECT x.i AS p, y.i AS q, count(*) AS freq FROM j x JOIN j y ON x.b = y.b AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= (SELECT ceil(0.01 * n) FROM n)),
pb AS MATERIALIZED (SELECT x.b, p, q FROM j x JOIN two ON x.i = p JOIN j y ON y.b = x.b AND y.i = q),
three AS MATERIALIZED (SELECT p, q, j.i AS r, count(*) AS freq FROM pb JOIN j ON pb.b = j.b AND j.i > q GROUP BY 1, 2, 3 HAVING count(*) >= (SELECT ceil(0.01 * n) FROM n)),
s AS MATERIALIZED (SELECT i AS items, freq FROM a UNION ALL SELECT p || ', ' || q, freq FROM two UNION ALL SELECT p || ', ' || q || ', ' || r, freq FROM three)"""


@query("apriori_itemsets", f"{_B}, {_SETS} SELECT items, freq FROM s")
def _(t):
    return M.apriori(_brands(t), "l_orderkey", "p_brand", 0.01, 0.1)[0]


@query("apriori_rules", f"""{_B}, {_SETS}, p AS (SELECT p AS lhs, q AS rhs, freq AS f FROM two UNION ALL SELECT q, p, freq FROM two UNION ALL SELECT p || ', ' || q, r, freq FROM three UNION ALL SELECT p || ', ' || r, q, freq FROM three UNION ALL SELECT q || ', ' || r, p, freq FROM three)
SELECT lhs, rhs, round(f / n, 8) AS support, round(f / l.freq, 8) AS confidence, round(f * n / (l.freq * r.freq), 8) AS lift FROM p JOIN s l ON lhs = l.items JOIN s r ON rhs = r.items, n WHERE f / l.freq >= 0.1""")
def _(t):
    return _rounded(M.apriori(_brands(t), "l_orderkey", "p_brand", 0.01, 0.1)[1], 8, "support", "confidence", "lift")
