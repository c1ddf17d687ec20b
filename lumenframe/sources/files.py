"""File sources and templated SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = ",", header: bool = True, skip: int = 0, encoding: str = "UTF-8", na: str = "", quote: str = '"') -> DataFrame:
    """Delimited text; ``skip`` leading lines of each file are left out before the header is read. With ``skip`` a file is
    one row's text while it is parsed (files with such preambles are small), whatever the encoding."""
    if not skip:
        return spark.read.csv(path, sep=sep, header=header, inferSchema=True, encoding=encoding, nullValue=na, quote=quote, multiLine=False)
    text = F.decode("content", encoding)
    lines = F.filter(F.split(text, r"\r?\n"), lambda x, i: (i >= skip) & (x != ""))
    files = spark.read.format("binaryFile").load(path).select(lines.alias("lines"))
    heads = files.select(F.get("lines", F.lit(0)).alias("h")).where("h is not null").limit(1).collect()
    if not heads:
        return spark.createDataFrame([], "")
    options = {"sep": sep, "quote": quote, "nullValue": na}
    first = spark.read.csv(spark.sparkContext.parallelize([heads[0]["h"]], 1), **{k: v for k, v in options.items() if k != "nullValue"}).first()
    names = [str(v) for v in first] if header else [f"_c{i}" for i in range(len(first))]
    body = files.select(F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))) if header else F.col("lines")).alias("line"))
    parsed = body.select(F.from_csv("line", _ddl(names), options).alias("r")).select("r.*")
    return typed(parsed)


def _ddl(names: list[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "` string" for n in names)


def typed(df: DataFrame) -> DataFrame:
    """Text columns by what all their values are: long, double, boolean, date or timestamp, else text. One aggregate."""
    texts = [c for c, t in df.dtypes if t == "string"]
    kinds = ("bigint", "double", "boolean", "date", "timestamp")
    if not texts:
        return df
    blank = lambda c: F.trim(col(c)) == ""
    bad = df.agg(*[F.count_if(~blank(c) & F.expr(f"try_cast(trim(`{c.replace('`', '``')}`) as {k})").isNull()).alias(f"b{i}_{k}") for i, c in enumerate(texts) for k in kinds],
                 *[F.count_if(~blank(c)).alias(f"n{i}") for i, c in enumerate(texts)]).first()
    kind = {c: next((k for k in kinds if bad[f"n{i}"] and bad[f"b{i}_{k}"] == 0), None) for i, c in enumerate(texts)}
    return df.select(*[F.expr(f"try_cast(nullif(trim(`{c.replace('`', '``')}`), '') as {kind[c]})").alias(c) if kind.get(c) else col(c) for c in df.columns])


def read_parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    df = spark.read.option("mergeSchema", "true").parquet(*([path] if isinstance(path, str) else path))
    return df if columns is None else df.select(*columns)


def read_json(spark: SparkSession, path: str, flatten: bool = True) -> DataFrame:
    df = spark.read.json(path)
    return flatten_structs(df) if flatten else df


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_log(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Groups of ``pattern`` in each line, by name; a line that does not match gives NULLs."""
    line = spark.read.text(path)
    ok = F.regexp_like("value", F.lit(pattern))
    return line.select(*[F.when(ok, F.regexp_extract("value", pattern, i + 1)).alias(n) for i, n in enumerate(names)])


def flatten_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns ``outer.inner``, to any depth."""
    while any(t.startswith("struct") for _, t in df.dtypes):
        cols = []
        for c, t in df.dtypes:
            if t.startswith("struct"):
                cols += [F.col(f"`{c}`").getField(f.name).alias(f"{c}{sep}{f.name}") for f in df.schema[c].dataType.fields]
            else:
                cols.append(F.col(f"`{c}`"))
        df = df.select(*cols)
    return df


def with_file_name(df: DataFrame, column: str = "file_name") -> DataFrame:
    return df.withColumn(column, F.element_at(F.split(F.input_file_name(), "/"), -1))


def glob_to_regex(pattern: str) -> str:
    """A file name pattern, or several with ``|`` between, as a regular expression of the whole name."""
    parts = [re.escape(p).replace(r"\*", ".*").replace(r"\?", ".") for p in pattern.split("|")]
    return "^" + (parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})") + "$"


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return ", ".join(sql_literal(v) for v in value)
    return "'" + str(value).replace("'", "''") + "'"


def render_sql(template: str, variables: dict) -> str:
    """``@{name}`` by its value as a literal; an unknown name is an error."""

    def put(m):
        if m[1] not in variables:
            raise KeyError(f"no value for @{{{m[1]}}}")
        return sql_literal(variables[m[1]])

    return re.sub(r"@\{\s*([A-Za-z_]\w*)\s*\}", put, template)


def split_statements(script: str) -> list[str]:
    """Statements parted by ``;`` outside quotes and comments."""
    out, now, i, n = [], [], 0, len(script)
    while i < n:
        c = script[i]
        if script.startswith("--", i):
            j = script.find("\n", i)
            i = n if j < 0 else j
            continue
        if script.startswith("/*", i):
            j = script.find("*/", i)
            i = n if j < 0 else j + 2
            continue
        if c in "'\"`":
            j = i + 1
            while j < n and script[j] != c:
                j += 1
            now.append(script[i : j + 1])
            i = j + 1
            continue
        if c == ";":
            out.append("".join(now).strip())
            now = []
        else:
            now.append(c)
        i += 1
    out.append("".join(now).strip())
    return [s for s in out if s]
