"""Everyday table verbs: choosing, naming and nesting columns, rows by number, row-wise summaries, differences, bins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from .windows import ts_lag


def select_columns(df: DataFrame, *names: str, exclude: bool = False) -> DataFrame:
    """The named columns in the table's order, or all but them; unknown names are ignored."""
    return df.select(*[col(c) for c in df.columns if (c in names) != exclude])


def reorder_cols(df: DataFrame, *names: str) -> DataFrame:
    """The named columns first, the rest after; unknown names are ignored."""
    first = [n for n in dict.fromkeys(names) if n in df.columns]
    return df.select(*map(col, [*first, *[c for c in df.columns if c not in first]]))


def move_col(df: DataFrame, name: str, position: int) -> DataFrame:
    """One column moved to a place counted from 1."""
    if df.columns.count(name) != 1:
        raise ValueError(f"{name}: no such column, or several")
    if not 1 <= position <= len(df.columns):
        raise ValueError(f"no place {position}")
    rest = [c for c in df.columns if c != name]
    return df.select(*map(col, [*rest[: position - 1], name, *rest[position - 1 :]]))


def unique_names(names: list[str]) -> list[str]:
    """Later duplicates with _1, _2, ... so that all differ."""
    out: list[str] = []
    for n in names:
        k, new = 0, n
        while new in out or (k and new in names):
            k += 1
            new = f"{n}_{k}"
        out.append(new)
    return out


def avoid_conflict(taken: list[str], new: list[str], suffix: str = ".new") -> list[str]:
    """The new names, each with the suffix as often as it takes to differ from those taken."""
    out = []
    for n in new:
        while n in taken:
            n += suffix
        out.append(n)
    return out


def rename_with(df: DataFrame, f: Callable[[str], str], names: list[str] | None = None) -> DataFrame:
    return df.toDF(*unique_names([f(c) if names is None or c in names else c for c in df.columns]))


def clean_names(df: DataFrame, kind: str = "snake") -> DataFrame:
    """``trim_space``, ``remove_space``, or lower case with runs of other characters as one underscore."""

    def snake(name: str) -> str:
        name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.replace("%", "_percent_").replace("#", "_number_").replace("'", ""))
        name = re.sub(r"\W+", "_", name).strip("_").lower()
        return f"x{name}" if not name or name[0].isdigit() else name

    return rename_with(df, {"trim_space": str.strip, "remove_space": lambda n: re.sub(r"\s", "", n), "snake": snake}[kind])


def clean_data_frame(df: DataFrame) -> DataFrame:
    """Structs flattened to ``outer.inner``, control characters and backslashes out of the names, names made unique."""
    from ..sources.files import flatten_structs

    return rename_with(flatten_structs(df), lambda n: re.sub(r"[\r\n\t\\]", "", n))


def row_as_header(df: DataFrame, order: Column, row: int = 1, prefix: str = "", clean: bool = True) -> DataFrame:
    """The row of that number (from the end if negative) as the names, and out of the table. Ties of ``order`` are not
    defined; only the row itself reaches the driver."""
    ordered = df.orderBy(order if row > 0 else order.desc())
    head = ordered.limit(abs(row)).withColumn("__at", order)
    pick = head.orderBy(F.desc("__at") if row > 0 else F.asc("__at")).first()
    if pick is None:
        return df
    names = unique_names([prefix + ("" if v is None else str(v)) or c for c, v in zip(df.columns, pick, strict=False)])
    out = df.where(~order.eqNullSafe(F.lit(pick["__at"]))).toDF(*names)
    return clean_names(out, "trim_space") if clean else out


def slice_rows(df: DataFrame, order: Column, rows: list[int] | None, keys: list[str] = (), remove: bool = False) -> DataFrame:
    """Rows by number within their group (all of the table without keys, then in one task for the kept head only)."""
    if rows is None:
        return df
    if not keys and not remove and rows and min(rows) > 0:  # only the head is numbered
        head = df.orderBy(order).limit(max(rows)).coalesce(1).sortWithinPartitions(order)
        return head.withColumn("__r", F.monotonically_increasing_id() + 1).where(F.col("__r").isin(rows)).drop("__r")
    numbered = df.withColumn("__r", F.row_number().over(Window.partitionBy(*map(col, keys)).orderBy(order)))
    hit = F.col("__r").isin(rows)
    return numbered.where(~hit if remove else hit).drop("__r")


def nest(df: DataFrame, keys: list[str], name: str = "data") -> DataFrame:
    """A row for each group with its other columns as a list of structs."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*map(col, keys)).agg(F.collect_list(F.struct(*map(col, rest))).alias(name))


def unnest(df: DataFrame, name: str, keep_empty: bool = False, drop_lists: bool = False) -> DataFrame:
    """A row for each element of a list column, structs as columns; names that clash get ``.new``."""
    lists = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    rest = [c for c in df.columns if c != name and not (drop_lists and c in lists)]
    element = df.schema[name].dataType.elementType
    out = df.select(*map(col, rest), (F.explode_outer if keep_empty else F.explode)(col(name)).alias("__e"))
    if element.typeName() != "struct":
        return out.withColumnRenamed("__e", name)
    inner = [f.name for f in element.fields]
    return out.select(*map(col, rest), *[F.col("__e")[n].alias(new) for n, new in zip(inner, avoid_conflict(rest, inner), strict=True)])


def add_row(df: DataFrame, **values) -> DataFrame:
    """One more row; columns not named are NULL."""
    one = df.sparkSession.createDataFrame([tuple(values.get(c) for c in df.columns)], df.schema)
    return df.unionByName(one)


def summarize_row(cols: list[Column], f: str = "mean", na_rm: bool = False) -> Column:
    """mean, sum, min, max, sd or count over the columns of a row. A NULL makes the result NULL, or is left out with ``na_rm``."""
    values = F.array(*[c.cast("double") for c in cols])
    known = F.filter(values, lambda x: x.isNotNull())
    n = F.size(known)
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total, n)
    out = {
        "sum": total, "mean": mean, "count": n.cast("double"), "min": F.array_min(known), "max": F.array_max(known),
        "sd": F.sqrt(F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + (x - mean) ** 2), F.nullif(n - 1, F.lit(-1)))),
    }[f]
    return out if na_rm or f == "count" else F.when(n == len(cols), out)


def ts_diff(df: DataFrame, time: str, value: str, keys: list[str], unit: str = "year", n: int = 1, ratio: bool = False, to: str = "diff") -> DataFrame:
    """The value less that of n units earlier, or that over the earlier value."""
    gap = col(value) - F.col("value_lag")
    return ts_lag(df, time, value, keys, unit, n).withColumn(to, F.try_divide(gap, F.col("value_lag")) if ratio else gap).drop("value_lag")


def average_moving_range(df: DataFrame, value: str, order: Column, keys: list[str]) -> DataFrame:
    """(keys, average_moving_range): mean distance of neighbouring known values; NULL of fewer than two."""
    x = col(value)
    w = Window.partitionBy(*map(col, keys)).orderBy(order)
    d = df.where(x.isNotNull()).withColumn("__d", F.abs(x - F.lag(x).over(w)))
    return d.groupBy(*map(col, keys)).agg(F.avg("__d").alias("average_moving_range"))


def restore_na(results: DataFrame, rows: DataFrame, row_id: str) -> DataFrame:
    """Results for all of ``rows``, NULL for those that were left out before modelling."""
    return rows.select(col(row_id)).join(results, row_id, "left")


def sample_fraction(df: DataFrame, fraction: float, key: Column, seed: int = 1) -> DataFrame:
    """About the fraction of the rows, the same for any partitioning: those whose hash of ``key`` is below it."""
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(fraction * (1 << 30)))


def sample_by_group(df: DataFrame, size: int, keys: list[str], key: Column, seed: int = 1) -> DataFrame:
    """``size`` rows of each group: the least hashes of ``key``."""
    w = Window.partitionBy(*map(col, keys)).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= size).drop("__r")


def equal_breaks(low: float, high: float, breaks: int, zero_to_center: bool = False) -> list[float]:
    if zero_to_center:
        high = max(abs(low), abs(high))
        low = -high
    if low == high:
        return [low - 0.5, high + 0.5]
    return [low + (high - low) * i / breaks for i in range(breaks + 1)]


def cut(df: DataFrame, value: str, breaks: int | list[float] = 5, to: str = "bin", zero_to_center: bool = False, right: bool = True, labels: list[str] | None = None,
        low: float | None = None, high: float | None = None) -> DataFrame:
    """Bins of equal width over the finite range of the values (or between given breaks) as ``(a, b]`` or labels. Values
    outside given ``low`` and ``high`` are in open bins; NULL and NaN have none. One aggregate finds the range."""
    x = col(value).cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    if isinstance(breaks, int):
        found = df.agg(F.min(finite).alias("a"), F.max(finite).alias("b")).first()
        if found["a"] is None:
            return df.withColumn(to, F.lit(None).cast("string"))
        edges = equal_breaks(found["a"] if low is None else low, found["b"] if high is None else high, breaks, zero_to_center)
    else:
        edges = sorted(breaks)
    text = lambda v: f"{v:.4g}"
    names = labels or [f"({text(a)}, {text(b)}]" if right else f"[{text(a)}, {text(b)})" for a, b in zip(edges, edges[1:], strict=False)]
    out = F.when(x.isNull() | F.isnan(x), F.lit(None))
    out = out.when(x < edges[0], F.lit(f"-Inf - {text(edges[0])}")).when(x > edges[-1], F.lit(f"{text(edges[-1])} - Inf"))
    last = len(names) - 1
    for i, name in enumerate(names):
        inside = (x <= edges[i + 1]) if right else (x < edges[i + 1]) if i < last else (x <= edges[-1])
        out = out.when(inside, F.lit(name))
    return df.withColumn(to, out)


def likert_sigma(df: DataFrame, value: str, to: str = "sigma") -> DataFrame:
    """A score for each answer: the mean of its slice of a normal distribution, from the answers' shares. The driver sees
    one row for each distinct answer (at most 1,000)."""
    from statistics import NormalDist

    by = df.where(col(value).isNotNull()).groupBy(col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy("v").limit(1001).collect()
    if len(by) > 1000:
        raise ValueError("over 1000 answers")
    total, below, rows, normal = sum(r["n"] for r in by), 0, [], NormalDist()
    height = lambda p: 0.0 if p <= 0 or p >= 1 else normal.pdf(normal.inv_cdf(p))
    for r in by:
        a, b = below / total, (below + r["n"]) / total
        rows.append((r["v"], (height(a) - height(b)) / (b - a)))
        below += r["n"]
    table = df.sparkSession.createDataFrame(rows, f"__v {df.schema[value].dataType.simpleString()}, `{to}` double")
    return df.join(F.broadcast(table), col(value) == F.col("__v"), "left").drop("__v")


def case_when(*pairs: tuple[Column, object], default=None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for c, v in pairs:
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(c, v) if out is None else out.when(c, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def is_integer(x: Column) -> Column:
    """Whether all known values of a group are whole numbers."""
    return F.bool_and(F.when(x.isNotNull(), x == F.floor(x)))


def parse_logical(x: Column) -> Column:
    """T, F, true, false, 1, 0 in their usual cases; anything else is NULL."""
    t = F.trim(x)
    return F.when(t.isin("T", "t", "TRUE", "true", "True", "1"), True).when(t.isin("F", "f", "FALSE", "false", "False", "0"), False)


def str_remove_emoji(x: Column) -> Column:
    """Pictographs, their modifiers, joiners, flags and keycap marks taken out; digits stay."""
    marks = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{2300}-\x{23FF}\x{1F1E6}-\x{1F1FF}\x{FE0F}\x{200D}\x{20E3}\x{E0020}-\x{E007F}]"
    return F.regexp_replace(x, marks, "")


def unique_values(df: DataFrame, name: str, limit: int = 100) -> list:
    """The sorted distinct values, at most ``limit``."""
    return [r[0] for r in df.where(col(name).isNotNull()).select(col(name)).distinct().orderBy(col(name)).limit(limit).collect()]


def to_same_type(x: Column, df: DataFrame, like: str) -> Column:
    return x.try_cast(df.schema[like].dataType)


def to_json(df: DataFrame, to: str = "json") -> DataFrame:
    """A row's columns as JSON text, NULLs left out."""
    return df.select(F.to_json(F.struct(*map(col, df.columns))).alias(to))


def url_param_remove(url: Column, name: str) -> Column:
    """The url without the parameter."""
    n = re.escape(name)
    out = F.regexp_replace(url, rf"([?&]){n}=[^&#]*(&|(?=#)|$)", "$1")
    return F.regexp_replace(out, r"[?&](?=#|$)", "")


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
