"""Tokens, n-grams, term weights, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from .pairs import group_pairs


def do_tokenize(df: DataFrame, text: str, doc: str, to_lower: bool = True, pattern: str = r"[\p{L}\p{Nd}]+") -> DataFrame:
    """(doc, position, token)."""
    x = F.col(text)
    words = F.regexp_extract_all(F.lower(x) if to_lower else x, F.lit(pattern), 0)
    return df.select(doc, F.posexplode(words).alias("position", "token"))


def do_ngram(df: DataFrame, text: str, doc: str, n: int = 2, sep: str = "_", pattern: str = r"[\p{L}\p{Nd}]+") -> DataFrame:
    """(doc, token): runs of n words within a text, made in its row without a window."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), 0)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice(F.col("w"), i, n), sep))
    return df.select(doc, words.alias("w")).where(F.size("w") >= n).select(doc, F.explode(grams).alias("token"))


def term_counts(tokens: DataFrame, doc: str, term: str = "token") -> DataFrame:
    return tokens.groupBy(col(doc), col(term)).agg(F.count(F.lit(1)).alias("n"))


def do_tfidf(tokens: DataFrame, doc: str, term: str = "token") -> DataFrame:
    """(doc, term, n, df, tfidf): (1 + log10 n) * log10(documents / df). Document frequencies and the number of documents
    are taken of the term counts with n in use, so all three read one shuffle of them and texts are tokenized once."""
    tf = term_counts(tokens, doc, term)
    held = F.col("n") > 0
    idf = tf.groupBy(col(term)).agg(F.count_if(held).alias("df"))
    docs = tf.agg(F.count_distinct(F.when(held, col(doc))).alias("__docs"))
    return tf.join(idf, term).crossJoin(F.broadcast(docs)).select(col(doc), col(term), "n", "df", ((1 + F.log10("n")) * F.log10(F.col("__docs") / F.col("df"))).alias("tfidf"))


def pair_count(df: DataFrame, group: str, value: str, distinct: bool = True, diag: bool = False, block: int = 2048) -> DataFrame:
    """(value.x, value.y, n): groups that hold both. A group of over ``block`` distinct values is paired block by block."""
    rows = df.where(col(value).isNotNull()).select(col(group).alias("g"), col(value).alias("v")).distinct()
    pairs = group_pairs(rows, F.col("g"), F.col("v"), block)
    pairs = pairs.where("x < y" if distinct and not diag else "x <= y" if distinct else "x <> y" if not diag else "true")
    return pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).select(F.col("x").alias("value_x"), F.col("y").alias("value_y"), "n")


def is_stopword(x: Column, words: list[str]) -> Column:
    return F.lower(x).isin(words)


def top_terms(counts: DataFrame, doc: str, n: int) -> DataFrame:
    """The n most frequent terms of each document; ties by term."""
    w = Window.partitionBy(doc).orderBy(F.desc("n"), "token")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
