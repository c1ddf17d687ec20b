"""Tests from summaries, matrices in long form, functions by group."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries as U
from .registry import query

C = F.col
_G = "SELECT {} FROM (SELECT l_returnflag AS g, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1) a JOIN (SELECT l_returnflag AS g, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1) b ON a.g < b.g"


def _pairs(t):
    g = t.lineitem.groupBy(C("l_returnflag").alias("g")).agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s"), F.count(F.lit(1)).alias("n"))
    return g.toDF("a", "m1", "s1", "n1").join(g.toDF("b", "m2", "s2", "n2"), C("a") < C("b"))


@query("welch_from_summaries", _G.format("a.g AS a, b.g AS b, round((a.m - b.m) / sqrt(a.s ** 2 / a.n + b.s ** 2 / b.n), 6) AS statistic, round((a.s ** 2 / a.n + b.s ** 2 / b.n) ** 2 / ((a.s ** 2 / a.n) ** 2 / (a.n - 1) + (b.s ** 2 / b.n) ** 2 / (b.n - 1)), 3) AS df"))
def _(t):
    s, d = U.welch_from_summaries(*map(C, ("m1", "m2", "s1", "s2", "n1", "n2")))
    return _pairs(t).select("a", "b", F.round(s, 6).alias("statistic"), F.round(d, 3).alias("df"))


@query("cohens_d_from_summaries", _G.format("a.g AS a, b.g AS b, round(abs(a.m - b.m) / sqrt(((a.n - 1) * a.s ** 2 + (b.n - 1) * b.s ** 2) / (a.n + b.n - 2)), 8) AS d"))
def _(t):
    return _pairs(t).select("a", "b", F.round(U.cohens_d_from_summaries(*map(C, ("m1", "m2", "s1", "s2", "n1", "n2"))), 8).alias("d"))


@query("beta_prior", "WITH s AS (SELECT c_mktsegment, avg((c_acctbal > 0)::INT) AS m FROM customer GROUP BY 1) SELECT c_mktsegment, round(m * (m * (1 - m) / 0.01 - 1), 6) AS alpha, round((1 - m) * (m * (1 - m) / 0.01 - 1), 6) AS beta FROM s")
def _(t):
    a, b = U.beta_prior(C("m"), F.lit(0.01))
    return t.customer.groupBy("c_mktsegment").agg(F.avg((C("c_acctbal") > 0).cast("int")).alias("m")).select("c_mktsegment", F.round(a, 6).alias("alpha"), F.round(b, 6).alias("beta"))


@query("chi_squared_ab", """WITH s AS (SELECT count(*) FILTER (g = 'A' AND x)::DOUBLE AS a, count(*) FILTER (g = 'A')::DOUBLE AS na, count(*) FILTER (g = 'R' AND x)::DOUBLE AS b, count(*) FILTER (g = 'R')::DOUBLE AS nb FROM (SELECT l_returnflag AS g, l_quantity > 20 AS x FROM lineitem)),
e AS (SELECT *, (a + b) / (na + nb) AS p FROM s) SELECT round((a - na * p) ** 2 / (na * p) + (na - a - na * (1 - p)) ** 2 / (na * (1 - p)) + (b - nb * p) ** 2 / (nb * p) + (nb - b - nb * (1 - p)) ** 2 / (nb * (1 - p)), 6) AS statistic FROM e""")
def _(t):
    g, x = C("l_returnflag"), C("l_quantity") > 20
    s = t.lineitem.agg(*[F.count_if(c).cast("double").alias(k) for k, c in (("a", (g == "A") & x), ("na", g == "A"), ("b", (g == "R") & x), ("nb", g == "R"))])
    return s.select(F.round(U.chi_squared_ab(C("a"), C("na"), C("b"), C("nb")), 6).alias("statistic"))


@query("cast_matrix", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS \"1-URGENT\", count(*) FILTER (o_orderpriority = '2-HIGH') AS \"2-HIGH\" FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def _(t):
    return U.cast_matrix(t.orders.where(C("o_orderpriority").isin("1-URGENT", "2-HIGH")), "o_orderstatus", "o_orderpriority", F.count(F.lit(1)), fill=0)


@query("matrix_to_long", "SELECT a.r_name AS k, b.r_name AS \"column\", (a.r_regionkey * b.r_regionkey)::BIGINT AS value FROM region a JOIN region b ON a.r_name < b.r_name")
def _(t):
    names = [r["r_name"] for r in t.region.orderBy("r_name").collect()]
    one = t.region.select("r_name", "r_regionkey")
    m = one.crossJoin(F.broadcast(one.toDF("other", "ok"))).groupBy(C("r_name").alias("k")).pivot("other", names).agg(F.sum((C("r_regionkey") * C("ok")).cast("long")))
    return U.matrix_to_long(m, "k", diag=False, upper=True)


@query("on_each_group", "SELECT n_regionkey, count(*) AS n, max(n_name) AS last FROM nation GROUP BY n_regionkey")
def _(t):
    def last(d):
        import pandas as pd

        return pd.DataFrame({"n_regionkey": [d["n_regionkey"].iloc[0]], "n": [len(d)], "last": [d["n_name"].max()]})

    return U.on_each_group(t.nation, ["n_regionkey"], last, "n_regionkey int, n long, last string")
