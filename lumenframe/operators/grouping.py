"""Grouped verbs: summaries, grouped mutation, pivots, mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.dates import extract_from_date


def _key(name: str, fun: str | None) -> Column:
    """A group key: the column, or a date token of it, named ``<name>_<token>``."""
    if not fun or fun == "none":
        return col(name)
    return extract_from_date(col(name), fun).alias(f"{name}_{fun}")


def summarize_group(df: DataFrame, group_cols: list[str] = (), group_funs: list[str | None] = (), **aggregates: Column) -> DataFrame:
    keys = [_key(c, f) for c, f in zip(group_cols, list(group_funs) or [None] * len(group_cols), strict=True)]
    cols = [a.alias(n) for n, a in aggregates.items()]
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def mutate_group(df: DataFrame, group_cols: list[str], order_by: list[Column], group_funs: list[str | None] = (), **columns) -> DataFrame:
    """Window columns; each is a function of the ordered window or a column over the whole group."""
    keys = [_key(c, f) for c, f in zip(group_cols, list(group_funs) or [None] * len(group_cols), strict=True)]
    whole = Window.partitionBy(*keys)
    return df.withColumns({n: c(whole.orderBy(*order_by)) if callable(c) and not isinstance(c, Column) else c.over(whole) for n, c in columns.items()})


def pivot(df: DataFrame, row_cols: list[str], col_col: str, aggregate: Column, values: list | None = None, row_funs=(), col_fun: str | None = None, fill=None, max_columns: int = 10_000) -> DataFrame:
    """Cross table; rows and columns whose key is NULL are left out, columns sorted by key."""
    rows = [_key(c, f) for c, f in zip(row_cols, list(row_funs) or [None] * len(row_cols), strict=True)]
    base = df.withColumn("__col", _key(col_col, col_fun).cast("string")).where(F.col("__col").isNotNull())
    for c in row_cols:
        base = base.where(F.col(f"`{c}`").isNotNull())
    if values is None:
        found = base.select("__col").distinct().orderBy("__col").limit(max_columns + 1).collect()
        if len(found) > max_columns:
            raise ValueError(f"over {max_columns} columns")
        values = [r[0] for r in found]
    named = [str(v) for v in values]
    out = base.groupBy(*rows).pivot("__col", named).agg(aggregate)
    return out if fill is None else out.select(*[F.coalesce(col(c), F.lit(fill)).alias(c) if c in named else col(c) for c in out.columns])


def one_hot(df: DataFrame, key: str, values: list | None = None, max_columns: int = 10_000) -> DataFrame:
    """A 0/1 column for each value of ``key``; NULL has zeros."""
    if values is None:
        found = df.select(F.col(f"`{key}`").alias("k")).where("k is not null").distinct().orderBy("k").limit(max_columns + 1).collect()
        if len(found) > max_columns:
            raise ValueError(f"over {max_columns} values")
        values = [r[0] for r in found]
    return df.select(*[c for c in df.columns if c != key], *[F.coalesce((F.col(f"`{key}`") == v).cast("int"), F.lit(0)).alias(f"{key}_{v}") for v in values])


def pivot_longer(df: DataFrame, cols: list[str], names_to: str = "name", values_to: str = "value") -> DataFrame:
    return df.unpivot([c for c in df.columns if c not in cols], cols, names_to, values_to)


def multiple_answers_to_longer(df: DataFrame, cols: list[str], sep: str = ",", question: str = "Question", answer: str = "Answer") -> DataFrame:
    """One row for each distinct trimmed answer of each of ``cols``."""
    rest = [c for c in df.columns if c not in cols]

    def answers(c: str):
        texts = F.coalesce(F.split(F.col(f"`{c}`"), "\\Q" + sep + "\\E"), F.array().cast("array<string>"))
        own = F.array_distinct(F.filter(F.transform(texts, lambda a: F.trim(a)), lambda a: a != ""))
        return F.transform(own, lambda a: F.struct(F.lit(c).alias("q"), a.alias("a")))

    pairs = F.flatten(F.array(*[answers(c) for c in cols]))
    return df.withColumn("__p", F.explode(pairs)).select(*[F.col(f"`{c}`") for c in rest], F.col("__p.q").alias(question), F.col("__p.a").alias(answer))


def mode_by(df: DataFrame, keys: list[str], value: str, order: str, na_rm: bool = False) -> DataFrame:
    """The most frequent value of each group in two partial aggregations; of equals the first by ``order``."""
    base = df.where(col(value).isNotNull()) if na_rm else df
    counts = base.groupBy(*map(col, keys), col(value)).agg(F.count(F.lit(1)).alias("__n"), F.min(col(order)).alias("__o"))
    return counts.groupBy(*map(col, keys)).agg(F.min_by(col(value), F.struct(-F.col("__n"), F.col("__o"))).alias("mode"))


def filter_cascade(df: DataFrame, *conditions) -> DataFrame:
    """Conditions one after another; a function gets the rows left and returns the condition (for aggregates, as windows)."""
    for c in conditions:
        df = df.where(c(df) if callable(c) and not isinstance(c, Column) else c)
    return df


def do_cohort(df: DataFrame, time: str, value: str, cohort: str, unit: str = "month") -> DataFrame:
    """(cohort, period, distinct values): periods counted from the cohort's own unit."""
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    a, b = F.date_trunc(unit, F.col(cohort)), F.date_trunc(unit, F.col(time))
    period = (((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)) / months).cast("long")
    return df.groupBy(a.cast("date").alias("cohort"), period.alias("period")).agg(F.count_distinct(value).alias("value"))
