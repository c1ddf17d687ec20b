"""Numeric and list expressions, and filters that pass all for an empty argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor(x: Column, digits: int = 0) -> Column:
    """Rounded down to ``digits`` decimals (negative: tens, hundreds, ...), as double."""
    return F.floor(x * 10.0**digits) / 10.0**digits


def ceiling(x: Column, digits: int = 0) -> Column:
    return F.ceil(x * 10.0**digits) / 10.0**digits


def list_n(x: Column) -> Column:
    return F.when(x.isNotNull(), F.size(x))


def list_extract(x: Column, position: int = 1) -> Column:
    """Element by position from 1, or from the end if negative; NULL beyond."""
    return F.try_element_at(x, F.lit(position))


def list_to_text(x: Column, sep: str = ", ") -> Column:
    """Elements joined; NULL elements read NA; an empty list is an empty text."""
    return F.coalesce(F.array_join(x.cast("array<string>"), sep, "NA"), F.lit(""))


def list_concat(*x: Column) -> Column:
    return F.concat(*x)


def _empty(v) -> bool:
    return v is None or v == "" or (isinstance(v, (list, tuple, set)) and not v)


def in_or_all(x: Column, values) -> Column:
    return F.lit(True) if _empty(values) else x.isin(list(values))


def not_in(x: Column, values) -> Column:
    return ~F.coalesce(x.isin(list(values)), F.lit(False))


def compare_or_all(x: Column, op: str, value) -> Column:
    """``op``: == != > >= < <=; an empty value passes every row."""
    if _empty(value):
        return F.lit(True)
    v = F.lit(value)
    return {"==": x == v, "!=": x != v, ">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v}[op]


def between(x: Column, left=None, right=None) -> Column:
    """Inclusive; an open side passes."""
    return compare_or_all(x, ">=", left) & compare_or_all(x, "<=", right)
