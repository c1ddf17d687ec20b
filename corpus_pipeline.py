"""A corpus pipeline of five stages: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage works on all rows that the stage before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate, mixing, near_copies, quality_rules, sharding, simhash
from lumenframe.llm.common import bounded_batches, new_path, q, release_path

#: SQL cannot express the forest, the classes of near copies or the dual; the stages are tested against brute force.
ORACLE_SQL = None


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    bounded_batches(spark)
    model = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_rules.verdicts(F.col("text"), model)["kept"]).select(*[q(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, Jaccard similarity of at least 0.8."""
    bounded_batches(spark)
    return simhash.one_of_each(docs, near_copies.near_copies(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item of the benchmark."""
    bounded_batches(spark)
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    bounded_batches(spark)
    return mixing.repeated(mixing.mix(docs), docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row."""
    bounded_batches(spark)
    return sharding.shard_documents(docs, 24)


STAGES = [
    ("quality_rules", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again; a stage's input is
    deleted when its output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            release_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
