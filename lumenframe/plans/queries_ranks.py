"""Rank tests and the log-rank test, whose statistics SQL has by window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranks as R
from ..operators import stats as S
from ..operators import survival as V
from .registry import query

C = F.col
_RANKS = """r AS (SELECT v, g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY v) AS t, count(*) OVER () AS n FROM d)"""


def _rounded(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("wilcoxon", f"""WITH d AS (SELECT l_quantity AS v, l_returnflag AS g FROM lineitem WHERE l_returnflag IN ('A', 'R')), {_RANKS},
s AS (SELECT sum(rk) FILTER (WHERE g = 'A') AS r, count(*) FILTER (WHERE g = 'A') AS a, count(*) FILTER (WHERE g = 'R') AS b, sum(t * t - 1) AS ties, count(*) AS n FROM r),
w AS (SELECT *, r - a * (a + 1) / 2 AS w, sqrt(a::DOUBLE * b / 12 * (n + 1 - ties / (n::DOUBLE * (n - 1)))) AS sd, r - a * (a + 1) / 2 - a::DOUBLE * b / 2 AS gap FROM s)
SELECT round(w, 3) AS statistic, round((gap - 0.5 * sign(gap)) / sd, 8) AS z, a AS n_a, b AS n_b FROM w""")
def _(t):
    return _rounded(R.wilcoxon(t.lineitem, "l_quantity", "l_returnflag", "A", "R").drop("p_value"), statistic=3, z=8)


@query("kruskal", f"""WITH d AS (SELECT l_quantity AS v, l_returnflag AS g FROM lineitem), {_RANKS}, s AS (SELECT sum(rk) AS r, count(*) AS m, any_value(n) AS n FROM r GROUP BY g), c AS (SELECT 1 - sum(t::DOUBLE * t - 1) / (count(*)::DOUBLE ** 3 - count(*)) AS c FROM r)
SELECT round((12 / (any_value(n)::DOUBLE * (any_value(n) + 1)) * sum(r * r / m) - 3 * (any_value(n) + 1)) / (SELECT c FROM c), 6) AS statistic, count(*) - 1 AS df FROM s""")
def _(t):
    return _rounded(R.kruskal(t.lineitem, "l_quantity", "l_returnflag").drop("p_value"), statistic=6)


@query("spearman", """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT round(corr(a, b), 8) AS correlation, count(*) AS n FROM r""")
def _(t):
    return _rounded(R.spearman(t.lineitem, "l_quantity", "l_extendedprice").drop("p_value"), correlation=8)


@query("auc", f"""WITH d AS (SELECT o_totalprice AS v, o_orderstatus = 'F' AS g FROM orders), {_RANKS}, s AS (SELECT sum(rk) FILTER (WHERE g) AS r, count(*) FILTER (WHERE g) AS p, count(*) FILTER (WHERE NOT g) AS q FROM r)
SELECT round((r - p * (p + 1) / 2) / (p::DOUBLE * q), 9) AS auc, p AS n_positive, q AS n_negative FROM s""")
def _(t):
    d = t.orders.select("o_totalprice", (C("o_orderstatus") == "F").alias("f"))
    return _rounded(R.auc(d, "o_totalprice", "f"), auc=9)


@query("kolmogorov_smirnov", """WITH d AS (SELECT l_extendedprice AS v, (l_linestatus = 'F')::INT AS g FROM lineitem), n AS (SELECT sum(g) AS a, count(*) - sum(g) AS b FROM d),
c AS (SELECT sum(g) OVER (ORDER BY v) AS x, count(*) OVER (ORDER BY v) - sum(g) OVER (ORDER BY v) AS y FROM d) SELECT round(max(abs(x / a - y / b)), 9) AS statistic, any_value(a)::BIGINT AS n_a, any_value(b)::BIGINT AS n_b FROM c, n""")
def _(t):
    return _rounded(R.kolmogorov_smirnov(t.lineitem, "l_extendedprice", "l_linestatus", "F", "O"), statistic=9)


@query("log_rank", """WITH d AS (SELECT date_diff('day', DATE '1995-01-01', o_orderdate::DATE) + 1 AS t, (o_orderstatus = 'F')::INT AS e, o_orderpriority AS g FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')),
b AS (SELECT t, sum(e) AS d, count(*) AS m, count(*) FILTER (WHERE g = '1-URGENT') AS m1 FROM d GROUP BY t),
k AS (SELECT d, sum(m) OVER (ORDER BY t DESC) AS n, sum(m1) OVER (ORDER BY t DESC) AS n1 FROM b), x AS (SELECT sum(d * n1 / n) AS e1, sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * n1 / n * (1 - n1 / n) ELSE 0 END) AS v FROM k)
SELECT round(((SELECT sum(e) FROM d WHERE g = '1-URGENT') - e1) ** 2 / v, 7) AS statistic, 1 AS df FROM x""")
def _(t):
    day = F.datediff(C("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) + 1
    d = t.orders.where(C("o_orderpriority").isin("1-URGENT", "5-LOW")).select(day.alias("t"), (C("o_orderstatus") == "F").alias("e"), "o_orderpriority")
    return _rounded(V.log_rank(d, "t", "e", "o_orderpriority")[0].drop("p_value"), statistic=7)


@query("cramers_v", """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY ALL), e AS (SELECT x.a, y.b, x.s::DOUBLE * y.s / (SELECT count(*) FROM lineitem) AS e
FROM (SELECT a, sum(o) AS s FROM c GROUP BY a) x, (SELECT b, sum(o) AS s FROM c GROUP BY b) y), s AS (SELECT sum((coalesce(o, 0) - e) ** 2 / e) AS s FROM e LEFT JOIN c USING (a, b))
SELECT round(sqrt(s / (n * least(ka - 1, kb - 1))), 8) AS cramers_v, round(s, 5) AS statistic, n FROM s, (SELECT count(*) AS n, count(DISTINCT l_returnflag) AS ka, count(DISTINCT l_linestatus) AS kb FROM lineitem)""")
def _(t):
    return _rounded(S.cramers_v(t.lineitem, "l_returnflag", "l_linestatus"), cramers_v=8, statistic=5)
