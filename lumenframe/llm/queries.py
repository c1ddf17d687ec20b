"""The registered queries opN_<name> of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, licenses, mixing, ordinal, quality_rules, sharding, simhash, token_files, url_filter
from .common import FOLDED_WORD_REGEX, bounded_batches

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_quality_classifier(spark, sf_dir):
    """Grades: 0 poor, 1 good but toxic, 2 good."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return ordinal.score(docs, ordinal.fit(docs, labels, grade, tail_level=2.0))


def op3_html_extraction(spark, sf_dir):
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op4_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    return decontaminate.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_token_files(spark, sf_dir):
    import public_tokenizers

    path = token_files.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path)


def op7_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_sharding(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 24)


def op9_mixing(spark, sf_dir):
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_url_filter(spark, sf_dir):
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_html_extraction, op4_simhash_dedup, op5_decontamination, op6_token_files, op7_license_scan, op8_sharding, op9_mixing, op10_url_filter, pipeline)}


_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP5 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, {_ABC}), '{FOLDED_WORD_REGEX}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, {_ABC}), '{FOLDED_WORD_REGEX}') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, s FROM (SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM d JOIN sizes ON len(w) >= k)),
bs AS (SELECT DISTINCT item_id, k, s FROM (SELECT item_id, least(len(w), 5) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i+least(len(w), 5)-1], ' '))) AS s FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles, count(*) / any_value(item_shingles)::DOUBLE AS containment
FROM ds JOIN bs USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(item_shingles) - 1e-9
"""


def _canonical_sql(text: str) -> str:
    out = f"translate({text}, {_ABC})"
    for line in licenses.DROPPED_LINES:
        out = f"regexp_replace({out}, '{line}', '', 'g')"
    out = f"regexp_replace({out}, '{licenses.NOT_WORD}', ' ', 'g')"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def _one_line_sql(lines: str) -> str:
    return rf"regexp_replace(trim(regexp_replace({lines}, '[\n ]+', ' ', 'g')), '{licenses.HOLDER}', '{licenses.ANY_HOLDER}', 'g')"


def _op7() -> str:
    """The known texts are brought into canonical form by SQL too."""
    known = ", ".join("('{}', '{}', '{}')".format(i, k, t.replace("'", "''")) for i, k, t in licenses.known_rows())
    return rf"""
WITH known(license_id, kind, text) AS (VALUES {known}),
k AS (SELECT license_id, kind, {_one_line_sql(_canonical_sql('text'))} AS form FROM known),
t AS (SELECT sha256(form) AS digest, min(license_id) AS license_id FROM k WHERE kind = 'text' GROUP BY 1),
notice AS (SELECT form AS piece, min(license_id) AS id FROM k WHERE kind = 'notice' GROUP BY 1),
d AS (SELECT doc_id, {_canonical_sql('text')} AS lines FROM documents),
f AS (SELECT doc_id, lines, {_one_line_sql('lines')} AS form FROM d),
p AS (SELECT doc_id, unnest(list_concat(string_split(lines, chr(10)), string_split_regex(lines, '{licenses.PARAGRAPH}'))) AS piece FROM d),
l AS (SELECT doc_id, string_agg(id, ',' ORDER BY id) AS notices FROM (SELECT DISTINCT doc_id, id FROM (SELECT doc_id, {_one_line_sql('piece')} AS piece FROM p) JOIN notice USING (piece)) GROUP BY doc_id)
SELECT f.doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest, t.license_id, coalesce(l.notices, '') AS notices
FROM f LEFT JOIN t ON t.digest = CASE WHEN form <> '' THEN sha256(form) END LEFT JOIN l ON l.doc_id = f.doc_id
"""


_OP10 = rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), {_ABC}) AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
m AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(r.p) DESC) AS k
      FROM pages JOIN p USING (page_id) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": _OP5, "op7_license_scan": _op7(), "op10_url_filter": _OP10}
