"""Licence scan by canonical digest.

A text is put into canonical form: copyright statements and titles of short licences dropped by the line, A-Z lower-cased,
every ASCII character but letters and digits a space, runs of space single, equivalent spellings (licence/license, ...) and
the holder's name in the no-endorsement clause made one. The SHA-256 digest of the whole form is hash-joined to the digests
of known licence texts. Most documents carry a notice rather than a whole licence, so the digest of each line and each
paragraph goes through the same join, to the digests of known notices. All of it is JVM expressions.

The known texts are the files of ``license_texts``; the known notices are the wordings of ``PHRASES`` with each of
``NAMES``. Another table can be given. Digests are sent to the tasks up to ``max_broadcast`` of them, else shuffled.

Defined results: a null or empty text has no digest and no licence; repeated rows each get their result; of known texts
with the same digest the least id wins; an empty table on either side gives no licence; other input columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import q

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that states a copyright (not one that speaks of a copyright notice or holder), and a short licence's title.
DROPPED_LINES = (
    r"(?m)^[^\n\w]*(?:copyright[ \t:,]*(?:\(c\)|©|[0-9]{4}|<|\[|\{)|(?:\(c\)|©)[ \t]*(?:copyright|[0-9]{4})|copyright[^\n]*all rights reserved|all rights reserved[^\n\w]*$)[^\n]*$",
    r"(?m)^[^\n\w]*(?:the )?(?:mit|expat|isc|x11|zlib|bsd|new bsd|modified bsd|revised bsd|simplified bsd|bsd zero clause|(?:bsd )?[0-3]-clause(?: bsd)?)"
    r"(?: \"[a-z ]+\")? licen[cs]e(?: \([a-z0-9 -]+\))?[^\n\w]*$",
)
NOT_WORD = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
#: Equivalent spellings, in the order applied.
SPELLINGS = (("licence", "license"), ("acknowledgement", "acknowledgment"),
             ("authorised", "authorized"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("noncommercial", "non commercial"), ("whilst", "while"))
HOLDER = r"neither the names? of [^\n]{1,120}? nor the names of"
ANY_HOLDER = "neither the name of the copyright holder nor the names of"
PARAGRAPH = r"\n *(?:\n *)+"
#: Names of public licences in notices, by id.
NAMES = {
    "MIT": ("MIT License", "MIT"), "ISC": ("ISC License",), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1"), "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"), "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"), "Unlicense": ("Unlicense",), "Zlib": ("zlib License",), "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    **{f"CC-{k}-{v}": (f"CC {k} {v}", f"Creative Commons {w} {v} International License", f"Creative Commons {w} {v}")
       for v in ("3.0", "4.0") for k, w in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                                            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
}
#: Wordings of notices.
PHRASES = tuple(f"{a} {b} {c}{{}}" for a in ("", "This work is", "This file is", "This project is", "This software is", "This document is", "This text is", "The content is")
                for b in ("licensed under", "released under", "distributed under", "made available under", "available under") for c in ("", "the ", "the terms of the ", "a "))


def dropped_and_folded(text: Column) -> Column:
    """The canonical form with line breaks kept."""
    out = F.translate(text, _UPPER, _LOWER)
    for line in DROPPED_LINES:
        out = F.regexp_replace(out, line, "")
    out = F.regexp_replace(out, NOT_WORD, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def one_line(lines: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(lines, r"[\n ]+", " ")), HOLDER, ANY_HOLDER)


def _digest(form: Column) -> Column:
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form, as hex; null for a text without words."""
    return _digest(one_line(dropped_and_folded(text)))


def known_rows() -> list[tuple[str, str, str]]:
    """(license_id, kind, text): kind ``text`` for whole licences, ``notice`` for notices."""
    rows = [(p.stem, "text", p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    notices = {(i, f"SPDX-License-Identifier: {i}") for i in NAMES}
    notices |= {(i, " ".join(phrase.format(name).split())) for i, names in NAMES.items() for name in names for phrase in PHRASES}
    return rows + [(i, "notice", t) for i, t in sorted(notices)]


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_rows(), "license_id string, kind string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 1_000_000) -> DataFrame:
    """(id, digest, license_id, notices) for each document: the licence that the whole text is, and the sorted distinct
    ids of the notices among its lines and paragraphs, with commas between."""
    spark = docs.sparkSession
    known = known_licenses(spark) if known is None else known
    form = one_line(dropped_and_folded(F.col("text")))
    table = known.select("license_id", (F.col("kind") == "notice").alias("is_notice"), form.alias("form")).where("form <> ''")
    table = table.select("license_id", "is_notice", F.sha2(F.col("form").cast("binary"), 256).alias("digest"), F.length("form").alias("size"))
    table = table.groupBy("digest", "is_notice").agg(F.min("license_id").alias("known_id"), F.max("size").alias("size"))
    sizes = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("is_notice"), F.col("size"))).alias("longest")).first()
    longest = F.lit(sizes["longest"] or 0)
    whole = docs.select(q(id_col).alias("id"), F.xxhash64(q(id_col), q(text_col)).alias("row"), dropped_and_folded(q(text_col)).alias("lines"))
    pieces = F.transform(F.concat(F.split("lines", "\n"), F.split("lines", PARAGRAPH)), one_line)
    pieces = F.array_distinct(F.filter(pieces, lambda x: (x != "") & (F.length(x) <= longest)))
    digests = F.transform(F.coalesce(pieces, F.array().cast("array<string>")), lambda x: F.struct(F.lit(True).alias("is_notice"), F.sha2(x.cast("binary"), 256).alias("digest")))
    own = F.array(F.struct(F.lit(False).alias("is_notice"), _digest(one_line(F.col("lines"))).alias("digest")))
    rows = whole.select("id", "row", F.explode(F.concat(own, digests)).alias("x")).select("id", "row", "x.*")
    rows = rows.withColumn("key", F.coalesce("digest", F.concat(F.lit("none:"), F.col("row").cast("string"))))
    table = table.select(F.col("digest").alias("key"), "is_notice", "known_id")
    found = rows.join(F.broadcast(table) if sizes["n"] <= max_broadcast else table, ["key", "is_notice"], "left").where("not is_notice or known_id is not null")
    each = found.groupBy("id", "row").agg(
        F.max(F.when(~F.col("is_notice"), F.col("digest"))).alias("digest"), F.max(F.when(~F.col("is_notice"), F.col("known_id"))).alias("license_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_notice"), F.col("known_id")))), ",").alias("notices"), F.count_if(~F.col("is_notice")).cast("int").alias("rows"),
    )
    return each.withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(F.col("id").alias(id_col), "digest", "license_id", "notices")
