"""Workbooks in the Office Open XML format, read on executors with the standard library: one task reads one file, rows
come out one by one. A sheet holds at most 1,048,576 rows by its format, which bounds a task."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _is_date(number: int, formats: dict[int, str]) -> bool:
    """Built-in formats 14-22 and 45-47 are dates and times; own ones are if they have a date letter outside quotes."""
    code = formats.get(number)
    if code is None:
        return 14 <= number <= 22 or 45 <= number <= 47
    return bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())))


def _text(node) -> str:
    """All text runs of a string item, phonetic guides left out."""
    return "".join(t.text or "" for run in node if run.tag != f"{_MAIN}rPh" for t in run.iter(f"{_MAIN}t"))


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: int | str = 1) -> Iterator[list[str | None]]:
    """The rows of a sheet (by number from 1, or by name) as text. Empty rows between others are kept; dates are in ISO form,
    booleans true and false, whole numbers without a point, errors and empty cells None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = book.findall(f"{_MAIN}sheets/{_MAIN}sheet")
        found = [s for i, s in enumerate(sheets, 1) if sheet in (i, s.get("name"))]
        if not found:
            raise ValueError(f"no sheet {sheet!r}; there are {[s.get('name') for s in sheets]}")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[found[0].get(f"{_REL}id")]
        shared = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            formats = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
            dates = [_is_date(int(x.get("numFmtId", 0)), formats) for x in styles.findall(f"{_MAIN}cellXfs/{_MAIN}xf")]
        pr = book.find(f"{_MAIN}workbookPr")
        start = datetime(1904, 1, 1) if pr is not None and pr.get("date1904") in ("1", "true") else datetime(1899, 12, 30)

        def value(cell) -> str | None:
            kind = cell.get("t", "n")
            if kind == "inlineStr":
                inner = cell.find(f"{_MAIN}is")
                return None if inner is None else _text([inner])
            raw = cell.findtext(f"{_MAIN}v")
            if raw is None or kind == "e":
                return None
            if kind == "s":
                return shared[int(raw)]
            if kind == "b":
                return "true" if raw == "1" else "false"
            if kind in ("str", "d"):
                return raw
            number, style = float(raw), int(cell.get("s", 0))
            if style < len(dates) and dates[style]:
                at = start + timedelta(seconds=round(number * 86400))
                return at.date().isoformat() if number == int(number) else at.isoformat(" ")
            return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)

        last = 0
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{_MAIN}row":
                    continue
                at = int(node.get("r") or last + 1)
                yield from ([] for _ in range(at - last - 1))
                last, cells = at, []
                for cell in node.iterfind(f"{_MAIN}c"):
                    k = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (k + 1 - len(cells))
                    cells[k] = value(cell)
                yield cells
                node.clear()


def read_excel(spark: SparkSession, path: str | list[str], sheet: int | str = 1, header: bool = True, skip: int = 0, na: tuple[str, ...] = ("", "NA")) -> DataFrame:
    """(file_name, row_number, columns as text) of a sheet of each workbook of ``path``; cast what is not text. Column names
    come from the first file in order of path; empty or repeated ones get their position. Cells beyond them are an error."""
    files = spark.read.format("binaryFile").load(path)
    least = files.agg(F.min("path")).first()[0]  # paths alone are read for this
    if least is None:
        return spark.createDataFrame([], "file_name string, row_number long")
    first = files.where(F.col("path") == least).select("content").first()
    rows = sheet_rows(bytes(first["content"]), sheet)
    head: list = []
    if header:
        for i, r in enumerate(rows):
            if i == skip:
                head = r
                break
    else:
        head = [None] * max((len(r) for i, r in enumerate(rows) if i >= skip), default=0)
    names: list[str] = []
    taken = {"file_name", "row_number"}
    for i, h in enumerate(head, 1):
        name = h if h and h.lower() not in taken else f"{h}...{i}" if h else f"X{i}"
        taken.add(name.lower())
        names.append(name)
    width, after, missing = len(names), skip + header, set(na)

    def parse(batches):
        import pandas as pd

        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                out = []
                for i, r in enumerate(sheet_rows(bytes(content), sheet)):
                    if i < after or all(v is None for v in r):
                        continue
                    if any(v is not None for v in r[width:]):
                        raise ValueError(f"{p}: row {i + 1} has cells beyond the {width} named columns")
                    out.append((p.rsplit("/", 1)[-1], i + 1, [None if v in missing else v for v in [*r[:width], *[None] * (width - len(r))]]))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=["file_name", "row_number", "v"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["file_name", "row_number", "v"])

    got = files.select("path", "content").mapInPandas(parse, "file_name string, row_number long, v array<string>")
    return got.select("file_name", "row_number", *[F.col("v")[i].alias(n) for i, n in enumerate(names)])


def sheet_names(content: bytes) -> list[str]:
    """The names of a workbook's sheets in order."""
    import io
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("xl/workbook.xml") as f:
        return [e.get("name") for e in ElementTree.parse(f).iter() if e.tag.endswith("}sheet")]


def excel_sheets(spark: SparkSession, path: str) -> list[str]:
    """The sheets of one workbook."""
    one = spark.read.format("binaryFile").load(path).select("content").first()
    return sheet_names(bytes(one["content"])) if one else []


def read_excel_sheets(spark: SparkSession, path: str, sheets: list[str] | None = None, **options) -> DataFrame:
    """Several sheets of a workbook (all by default) in one table by column name, with ``sheet_name``."""
    out = None
    for name in sheets or excel_sheets(spark, path):
        one = read_excel(spark, path, name, **options).withColumn("sheet_name", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return spark.createDataFrame([], "sheet_name string") if out is None else out
