"""Columns by their literal name, and joins that treat NULL keys as equal."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its literal name, dots, spaces and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def quoted_replacement(text: str) -> str:
    """A regular expression's replacement that stands for ``text`` itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where all ``keys`` are equal, NULL equal to NULL; all rows if no key."""
    if not keys:
        return left.crossJoin(F.broadcast(right)) if how == "inner" else left.join(F.broadcast(right), how=how)
    names = {k: f"__key{i}" for i, k in enumerate(keys)}
    right = right.select(*[col(c).alias(names.get(c, c)) for c in right.columns])
    on = reduce(and_, [col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(right, on, how).drop(*names.values())
