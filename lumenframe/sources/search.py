"""Finding files by pattern, guessing encodings, tables in HTML, lists of tables and columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import glob_to_regex, read_delimited, with_file_name


def search_files(spark: SparkSession, folder: str, pattern: str, ignore_case: bool = False) -> list[str]:
    """The sorted paths of the folder's own files whose name fits the pattern (several with ``|`` between)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    wanted = re.compile(glob_to_regex(pattern), re.IGNORECASE if ignore_case else 0)
    found = [s.getPath() for s in fs.listStatus(path) if s.isFile()]
    return sorted(p.toString() for p in found if wanted.match(p.getName()))


def read_found_delimited(spark: SparkSession, folder: str, pattern: str, ignore_case: bool = False, **options) -> DataFrame:
    """All files that fit, in one table, with ``file_name``. No file is an error."""
    paths = search_files(spark, folder, pattern, ignore_case)
    if not paths:
        raise FileNotFoundError(f"no file in {folder} fits {pattern}")
    return with_file_name(read_delimited(spark, paths, **options))


def read_found_parquet(spark: SparkSession, folder: str, pattern: str, ignore_case: bool = False) -> DataFrame:
    paths = search_files(spark, folder, pattern, ignore_case)
    if not paths:
        raise FileNotFoundError(f"no file in {folder} fits {pattern}")
    return with_file_name(spark.read.option("mergeSchema", "true").parquet(*paths))


def guess_encoding(head: bytes) -> str:
    """By byte order mark, else the first of UTF-8, Shift_JIS, EUC-JP and Windows-1252 that the bytes are valid in. A
    character cut off at the end of ``head`` does not count."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if head.startswith(mark):
            return name
    for name in ("UTF-8", "Shift_JIS", "EUC-JP"):
        for cut in range(4):
            try:
                head[: len(head) - cut].decode(name)
                return name
            except UnicodeDecodeError as e:
                if e.start < len(head) - 4:
                    break
    return "windows-1252"


def guess_file_encoding(spark: SparkSession, path: str, size: int = 1 << 16) -> str:
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, size).alias("h")).first()
    return guess_encoding(bytes(head["h"])) if head else "UTF-8"


def is_ndjson(spark: SparkSession, path: str) -> bool:
    """Whether the first lines are JSON objects of their own."""
    import json

    lines = [r[0] for r in spark.read.text(path).where("trim(value) <> ''").limit(2).collect()]
    try:
        return bool(lines) and all(isinstance(json.loads(x), dict) for x in lines)
    except ValueError:
        return False


def direct_download_url(url: str) -> str:
    """A share link of a file host that shows a page for ``dl=0`` as one that gives the file."""
    return re.sub(r"([?&])dl=0(?=&|#|$)", r"\1dl=1", url)


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def list_columns(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(table)]


def html_tables(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, table, row, cells): the rows of all tables of a page, numbered from 1, with the texts of their cells; a nested
    table is one of its own. Null or broken markup gives what can be read."""
    kind = pages.schema[id_col].dataType.simpleString()

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            out: list = []
            for i, html in enumerate(batch.column(1).to_pylist()):
                out += [(i, *r) for r in _tables(html or "")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r[0] for r in out], pa.int64())), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.list_(pa.string()))],
                names=["id", "table", "row", "cells"],
            )

    found = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").alias("html")).mapInArrow(rows, f"id {kind}, table int, row int, cells array<string>")
    return found.withColumnRenamed("id", id_col)


def _tables(html: str) -> list[tuple[int, int, list[str]]]:
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open: list[dict] = []
            self.done: list[dict] = []

        def handle_starttag(self, tag, attrs):
            if tag == "table":
                self.open.append({"n": len(self.open) + len(self.done) + 1, "rows": [], "cell": None})
                self.done.append(self.open[-1])
            elif self.open and tag == "tr":
                self.open[-1]["rows"].append([])
                self.open[-1]["cell"] = None
            elif self.open and tag in ("td", "th"):
                t = self.open[-1]
                if not t["rows"]:
                    t["rows"].append([])
                t["rows"][-1].append("")
                t["cell"] = True
            elif tag == "br":
                self.handle_data(" ")

        def handle_endtag(self, tag):
            if self.open and tag == "table":
                self.open.pop()
            elif self.open and tag in ("td", "th", "tr"):
                self.open[-1]["cell"] = None

        def handle_data(self, data):
            if self.open and self.open[-1]["cell"] and self.open[-1]["rows"] and self.open[-1]["rows"][-1]:
                self.open[-1]["rows"][-1][-1] += data

    reader = Reader()
    reader.feed(html)
    reader.close()
    return [(k, i, [" ".join(c.split()) for c in row]) for k, t in enumerate(reader.done, 1) for i, row in enumerate(t["rows"], 1)]
