"""Ordered pairs of the items of a group, however large the group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_pairs(rows: DataFrame, group: Column, item: Column, block: int = 2048) -> DataFrame:
    """(x, y) for each two rows of a group, a row with itself included. ``item`` tells a group's rows apart; NULL is a
    group like any other.

    A group of up to ``block`` rows is paired in its own row. A larger one is dealt by hash into blocks of about that
    many, and each two blocks meet in a task of their own, so no task holds more than two blocks."""
    one_group = Window.partitionBy("__g")
    dealt = rows.select(group.alias("__g"), item.alias("__v")).withColumn("__b", F.ceil(F.count(F.lit(1)).over(one_group) / block).cast("long"))
    blocks = dealt.withColumn("__i", F.pmod(F.xxhash64("__v"), F.col("__b"))).groupBy("__g", "__b", "__i").agg(F.collect_list("__v").alias("__l"))
    small = blocks.where("__b = 1").select("__l", F.explode("__l").alias("x")).select("x", F.explode("__l").alias("y"))
    large = blocks.where("__b > 1")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__b") - 1))
    left = large.select("__g", "__i", others.alias("__j"), F.col("__l").alias("__x"))
    right = large.select(F.col("__g").alias("__h"), others.alias("__p"), F.col("__i").alias("__q"), F.col("__l").alias("__y"))
    met = left.join(right, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__i") == F.col("__p")) & (F.col("__j") == F.col("__q")))
    return small.unionByName(met.select("__y", F.explode("__x").alias("x")).select("x", F.explode("__y").alias("y")))
