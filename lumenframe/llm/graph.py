"""Connected components of an edge table by alternating star contraction (Kiveris et al. 2014), as DataFrame steps.

Every round is written to the shared folder, so no round's lineage holds an earlier one. A node with many neighbours
is never gathered: its minimum is a partial aggregate, and the join that spreads it is one Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import files_for, release, written

ROWS_PER_FILE = 250_000


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of the component. ``edges`` has columns (u, v); self-loops, repeats and
    nulls are ignored; nodes without an edge do not appear."""
    spark = edges.sparkSession
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    mark = _mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        files = files_for(spark, mark[0], ROWS_PER_FILE)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        large = written(large, "cc-large", files)
        hop = large.join(_least(large), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        small = written(hop.select("p.u", "p.v").where("u <> v").distinct(), "cc-small", files)
        release(large)
        release(e)
        e, before = small, mark
        mark = _mark(e)
        if mark == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    if mark[0]:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
