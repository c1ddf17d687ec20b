"""Date, string, URL, list and numeric functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numeric as N
from ..functions import strings as S
from ..functions import urls as U
from .registry import query

C = F.col

_DATE_PARTS = {
    "fltoyear": "date_trunc('year', d)::DATE", "rtoq": "date_trunc('quarter', d)::DATE", "rtomon": "date_trunc('month', d)::DATE", "rtoweek": "(d::DATE - dayofweek(d)::INT)::DATE", "rtoday": "d::DATE",
    "year": "year(d)", "month": "month(d)", "quarter": "quarter(d)", "day": "day(d)", "yday": "dayofyear(d)", "wday": "dayofweek(d) + 1", "hour": "hour(d)",
    "halfyear": "(month(d) - 1) // 6 + 1", "week": "(dayofyear(d) - 1) // 7 + 1", "week_of_month": "(day(d) + dayofweek(date_trunc('month', d)) - 1) // 7 + 1",
    "weekend": "CASE WHEN dayofweek(d) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END", "wname": "strftime(d, '%a')", "wnamelong": "strftime(d, '%A')", "monname": "strftime(d, '%b')", "monnamelong": "strftime(d, '%B')",
    "yearmonth": "strftime(d, '%Y-%m')",
}
for _k, _s in _DATE_PARTS.items():

    @query(f"date_{_k}", f"SELECT event_id, {_s} AS v FROM (SELECT event_id, ts AS d FROM events)")
    def _(t, k=_k):
        return t.events.select("event_id", D.extract_from_date(C("ts"), k).alias("v"))


for _u, _s in (("days", "86400.0"), ("hours", "3600.0"), ("weeks", "604800.0"), ("minutes", "60.0"), ("seconds", "1.0")):

    @query(f"{_u}_between", f"SELECT event_id, round((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(ts)) / 1e6 / {_s}, 6) AS v FROM events")
    def _(t, u=_u):
        return t.events.select("event_id", F.round(D.time_between(C("ts"), F.lit("2024-03-01").cast("timestamp_ntz"), u), 6).alias("v"))


@query("last_date", "SELECT o_orderkey, last_day(o_orderdate::DATE) AS m, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS q, (date_trunc('month', o_orderdate) - INTERVAL 1 DAY)::DATE AS p, (date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE AS y FROM orders")
def _(t):
    d = C("o_orderdate")
    return t.orders.select("o_orderkey", D.last_date(d).alias("m"), D.last_date(d, "quarter").alias("q"), D.last_date(d, "month", previous=True).alias("p"), D.last_date(d, "year").alias("y"))


@query("within_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1998-05-01' AND o_orderdate < DATE '1998-06-01' OR (o_orderdate::DATE > DATE '1998-06-08' AND o_orderdate::DATE <= DATE '1998-06-15')")
def _(t):
    today = F.lit("1998-06-15").cast("date")
    return t.orders.where(D.within_date_range(C("o_orderdate"), "last_month", today) | D.within_date_range(C("o_orderdate"), "last_n_days:7", today)).select("o_orderkey")


_STRINGS = {
    "before": (lambda x: S.str_extract_before(x, " "), "CASE WHEN strpos(x, ' ') > 0 THEN split_part(x, ' ', 1) END"),
    "after": (lambda x: S.str_extract_after(x, " "), "CASE WHEN strpos(x, ' ') > 0 THEN substr(x, strpos(x, ' ') + 1) END"),
    "remove_before": (lambda x: S.str_remove_before(x, " "), "CASE WHEN strpos(x, ' ') > 0 THEN substr(x, strpos(x, ' ') + 1) ELSE x END"),
    "remove_after": (lambda x: S.str_remove_after(x, " "), "split_part(x, ' ', 1)"),
    "replace_range": (lambda x: S.str_replace_range(x, 2, 4, "--"), "substr(x, 1, 1) || '--' || substr(x, 5)"),
    "remove_range_end": (lambda x: S.str_remove_range(x, -3, -2), "CASE WHEN length(x) >= 3 THEN substr(x, 1, length(x) - 3) || right(x, 1) ELSE x END"),
    "word": (lambda x: S.str_extract_word(x, 1), "split_part(x, ' ', 1)"),
    "last_word": (lambda x: S.str_extract_word(x, -1), "split_part(x, ' ', -1)"),
    "remove_word": (lambda x: S.str_remove_word(x, 1), "substr(x, length(split_part(x, ' ', 1)) + 2)"),
    "clean": (lambda x: S.str_clean(F.concat(F.lit("  "), x, F.lit("\t a "))), "trim(regexp_replace('  ' || x || chr(9) || ' a ', '\\s+', ' ', 'g'))"),
    "remove": (lambda x: S.str_remove(x, "[aeiou]"), "regexp_replace(x, '[aeiou]', '')"),
    "remove_all": (lambda x: S.str_remove_all(x, "[aeiou]"), "regexp_replace(x, '[aeiou]', '', 'g')"),
    "detect": (lambda x: S.str_detect(x, "AN", ignore_case=True), "regexp_matches(x, '(?i)an')"),
    "inside": (lambda x: S.str_extract_inside(F.concat(x, F.lit("(b c)(d)")), include_special_chars=False), "'b c'"),
    "remove_inside": (lambda x: S.str_remove_inside(F.concat(F.lit("q(b)"), x, F.lit("(d)")), all=True), "'q' || x"),
    "is_alphabet": (S.is_alphabet, "regexp_matches(x, '^[A-Za-z]+$')"),
    "is_empty": (S.is_empty, "trim(x) = ''"),
    "recode": (lambda x: S.recode(F.substring(x, 1, 1), {"A": "first", "B": "second"}), "CASE left(x, 1) WHEN 'A' THEN 'first' WHEN 'B' THEN 'second' ELSE left(x, 1) END"),
    "anonymize": (lambda x: S.anonymize(x), "sha256('1:' || x)"),
    "parse_number": (lambda x: S.parse_number(F.concat(F.lit("$1,23"), F.length(x).cast("string"), F.lit(".5 x"))), "('123' || length(x) || '.5')::DOUBLE"),
    "logical": (lambda x: S.str_logical(F.when(F.length(x) % 2 == 0, "Yes").otherwise("no")), "length(x) % 2 = 0"),
}
for _k, (_f, _s) in _STRINGS.items():

    @query(f"str_{_k}", f"SELECT p_partkey, {_s} AS v FROM (SELECT p_partkey, p_name AS x FROM part)")
    def _(t, f=_f):
        return t.part.select("p_partkey", f(C("p_name")).alias("v"))


_URLS = {
    "scheme": (U.url_scheme, "nullif(regexp_extract(x, '^([a-z]+)://', 1), '')"),
    "domain": (U.url_domain, "nullif(regexp_extract(x, '^[a-z]+://([^/?#:]+)', 1), '')"),
    "path": (U.url_path, "nullif(regexp_extract(x, '^[a-z]+://[^/?#]*/([^?#]+)', 1), '')"),
    "parameters": (U.url_parameters, "nullif(regexp_extract(x, '\\?([^#]+)', 1), '')"),
    "fragment": (U.url_fragment, "nullif(regexp_extract(x, '#(.+)$', 1), '')"),
    "param": (lambda x: U.url_param(x, "page"), "nullif(regexp_extract(x, '[?&]page=([^&#]*)', 1), '')"),
    "suffix": (U.url_suffix, "split_part(regexp_extract(x, '^[a-z]+://([^/?#:]+)', 1), '.', -1)"),
    "subdomain": (U.url_subdomain, "nullif(regexp_extract(x, '^[a-z]+://([^/?#:]+)\\.[^./?#:]+\\.[^./?#:]+', 1), '')"),
    "port": (U.url_port, "nullif(regexp_extract(x, '^[a-z]+://[^:/?#]+:([0-9]+)', 1), '')"),
}
for _k, (_f, _s) in _URLS.items():

    @query(f"url_{_k}", f"SELECT page_id, {_s} AS v FROM (SELECT page_id, url AS x FROM pages)")
    def _(t, f=_f):
        return t.pages.select("page_id", f(C("url")).alias("v"))


@query("round_digits", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * 0.01) / 0.01 AS f, ceil(l_extendedprice * 10) / 10 AS c FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", N.floor(C("l_extendedprice"), -2).alias("f"), N.ceiling(C("l_extendedprice"), 1).alias("c"))


@query("lists", "SELECT vec_id, len(embedding) AS n, embedding[1]::DOUBLE AS a, embedding[64]::DOUBLE AS z FROM embeddings")
def _(t):
    e = C("embedding")
    return t.embeddings.select("vec_id", N.list_n(e).alias("n"), N.list_extract(e, 1).cast("double").alias("a"), N.list_extract(e, -1).cast("double").alias("z"))


@query("list_to_text", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: coalesce(nullif(x, 'a'), 'NA')), ', ') AS v FROM part")
def _(t):
    return t.part.select("p_partkey", N.list_to_text(F.transform(F.split("p_name", " "), lambda x: F.nullif(x, F.lit("a")))).alias("v"))


@query("json_extract", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
