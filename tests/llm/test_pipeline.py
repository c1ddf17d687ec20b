"""Each stage of the pipeline against a plain reading of its decision, on whole tables of the smallest folder."""

import re

import corpus_pipeline
from lumenframe.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, start = docs.columns, docs
    good = {r.doc_id for r in queries.op1_quality_rules(spark, SF).where("kept").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def shingles(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    items = [s for s in (shingles(t or "") for _, t in bench) if s]
    for name, stage in corpus_pipeline.STAGES:
        before = start.collect()
        out = stage(spark, start, SF).cache()
        rows = out.collect()
        if name == "quality_rules":
            assert {r.doc_id for r in rows} == good
        elif name == "near_duplicates":
            assert len({r.doc_id for r in rows}) == len(rows) and len({r.text for r in rows}) == len(rows) and {r.text for r in rows} <= {r.text for r in before}
        elif name == "decontamination":
            dirty = {r.doc_id for r in before if any(len(s & shingles(r.text)) >= 0.8 * len(s) for s in items)}
            assert {r.doc_id for r in rows} == {r.doc_id for r in before} - dirty
        elif name == "mixing":
            words = sum(len(WORD.findall(r.text)) for r in rows)
            assert abs(words / sum(len(WORD.findall(r.text)) for r in before) - 1.5) < 0.03
        else:
            assert len(rows) == len(before)
        if name != "sharding":
            assert out.columns == columns
        start = out
