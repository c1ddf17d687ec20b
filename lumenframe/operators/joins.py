"""Joins and set operations of tables, with the key and suffix rules of the verbs they offer."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _q(df: DataFrame, name: str):
    return df["`" + name.replace("`", "``") + "`"]


def join(x: DataFrame, y: DataFrame, by: dict[str, str] | list[str], how: str = "inner", suffix: tuple[str, str] = (".x", ".y"), ignore_case: bool = False,
         target_columns: list[str] | None = None, exclude_target_columns: bool = False) -> DataFrame:
    """Equi-join. NULL keys never match, but in semi and anti joins, where they match each other. Other columns that
    both sides have get the suffixes. ``ignore_case`` compares lower-cased text keys and keeps the left spelling."""
    by = {k: k for k in by} if isinstance(by, list) else by
    if target_columns is not None:
        wanted = [c for c in y.columns if (c in target_columns) != exclude_target_columns or c in by.values()]
        y = y.select(*[_q(y, c) for c in wanted])
    null_safe = how in ("semi", "anti")

    def key(df, c):
        out = _q(df, c)
        return F.lower(out) if ignore_case and dict(df.dtypes)[c] == "string" else out

    both = {c for c in x.columns if c not in by} & {c for c in y.columns if c not in by.values()}
    right = y.select(*[_q(y, c).alias(f"__r_{i}") for i, c in enumerate(y.columns)])
    place = {c: f"__r_{i}" for i, c in enumerate(y.columns)}
    pairs = []
    for a, b in by.items():
        r = right[place[b]]
        r = F.lower(r) if ignore_case and dict(y.dtypes)[b] == "string" else r
        pairs.append(key(x, a).eqNullSafe(r) if null_safe else key(x, a) == r)
    kind = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}[how]
    out = x.join(right, reduce(and_, pairs), kind)
    if null_safe:
        return out
    merged = {}
    for a, b in by.items():
        merged[a] = F.coalesce(_q(x, a), right[place[b]]) if how in ("right", "full") and not ignore_case else _q(x, a)
    left = [(merged[c] if c in by else _q(x, c)).alias(c + suffix[0] if c in both else c) for c in x.columns]
    rest = [right[place[c]].alias(c + suffix[1] if c in both else c) for c in y.columns if c not in by.values()]
    return out.select(*left, *rest)


def cross_join(x: DataFrame, y: DataFrame, suffix: tuple[str, str] = (".x", ".y"), max_rows: int = 1_000_000) -> DataFrame:
    """Every pair, for a right side of at most ``max_rows`` rows (more is an error)."""
    if y.limit(max_rows + 1).count() > max_rows:
        raise ValueError("the right side of a cross join is too large")
    both = set(x.columns) & set(y.columns)
    left = x.select(*[_q(x, c).alias(c + suffix[0] if c in both else c) for c in x.columns])
    return left.crossJoin(y.select(*[_q(y, c).alias(c + suffix[1] if c in both else c) for c in y.columns]))


def _aligned(x: DataFrame, y: DataFrame, force_string: bool) -> tuple[DataFrame, DataFrame]:
    y = y.select(*[_q(y, c) for c in x.columns])
    if force_string:
        differ = {c for (c, a), (_, b) in zip(x.dtypes, y.dtypes, strict=True) if a != b}
        x, y = (d.select(*[_q(d, c).cast("string").alias(c) if c in differ else _q(d, c) for c in d.columns]) for d in (x, y))
    return x, y


def union(x, y, force_data_type=False):
    a, b = _aligned(x, y, force_data_type)
    return a.union(b).distinct()


def union_all(x, y, force_data_type=False):
    a, b = _aligned(x, y, force_data_type)
    return a.union(b)


def intersect(x, y, force_data_type=False):
    a, b = _aligned(x, y, force_data_type)
    return a.intersect(b)


def setdiff(x, y, force_data_type=False):
    a, b = _aligned(x, y, force_data_type)
    return a.subtract(b)


def bind_rows(tables: dict[str, DataFrame], id_column: str | None = None, force_data_type: bool = False) -> DataFrame:
    """Rows of all tables, columns by name, missing ones NULL; with the table's name in ``id_column``."""
    named = [d.withColumn(id_column, F.lit(k)).select(id_column, *[c for c in d.columns]) if id_column else d for k, d in tables.items()]
    if force_data_type:
        kinds: dict[str, set] = {}
        for d in named:
            for c, t in d.dtypes:
                kinds.setdefault(c, set()).add(t)
        named = [d.select(*[_q(d, c).cast("string").alias(c) if len(kinds[c]) > 1 else _q(d, c) for c in d.columns]) for d in named]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
