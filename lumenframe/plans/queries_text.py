"""Text analytics over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as T
from .registry import query

C = F.col
_TOKENS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')) AS token FROM documents"


@query("term_counts", f"SELECT doc_id, token, count(*) AS n FROM ({_TOKENS}) GROUP BY 1, 2")
def _(t):
    return T.term_counts(T.do_tokenize(t.documents, "text", "doc_id"), "doc_id")


@query("tfidf", f"""WITH n AS (SELECT doc_id, token, count(*) AS n FROM ({_TOKENS}) GROUP BY 1, 2), d AS (SELECT token, count(*) AS df FROM n GROUP BY 1)
SELECT doc_id, token, n, df, round((1 + log10(n)) * log10((SELECT count(DISTINCT doc_id) FROM n) / df), 6) AS tfidf FROM n JOIN d USING (token)""")
def _(t):
    return T.do_tfidf(T.do_tokenize(t.documents, "text", "doc_id"), "doc_id").withColumn("tfidf", F.round("tfidf", 6))


@query("ngram", "SELECT conv_id, token, count(*) AS n FROM (SELECT conv_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS token FROM (SELECT conv_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+') AS w FROM conversations)) GROUP BY 1, 2")
def _(t):
    return T.do_ngram(t.conversations, "text", "conv_id").groupBy("conv_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query("pair_count", "SELECT x.e AS value_x, y.e AS value_y, count(*) AS n FROM (SELECT DISTINCT user_id, event_type AS e FROM events) x JOIN (SELECT DISTINCT user_id, event_type AS e FROM events) y ON x.user_id = y.user_id AND x.e < y.e GROUP BY 1, 2")
def _(t):
    return T.pair_count(t.events, "user_id", "event_type")


@query("top_terms", f"SELECT doc_id, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS rank FROM (SELECT doc_id, token, count(*) AS n FROM ({_TOKENS}) GROUP BY 1, 2)) WHERE rank <= 5")
def _(t):
    return T.top_terms(T.term_counts(T.do_tokenize(t.documents, "text", "doc_id"), "doc_id"), "doc_id", 5).withColumn("rank", C("rank").cast("long"))
