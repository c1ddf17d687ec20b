"""op7_license_scan: documents that are licences, at other wrappings and headings; clauses; notices; SQL on such documents."""

import textwrap

import duckdb
import pytest

from lumenframe.llm import licenses, queries

TEXTS = {i: t for i, k, t in licenses.known_rows() if k == "text"}
#: Their head or directions have a copyright line in a paragraph with other text, which another wrapping makes part of a longer line.
JOINED = {i for i in TEXTS if i.startswith(("GFDL", "GPL", "LGPL", "MPL-1.1"))}
BSD = TEXTS["BSD-3-Clause"]
CASES = [
    *[(100 + n, t, i, None) for n, (i, t) in enumerate(sorted(TEXTS.items()))],
    *[(200 + n, "\n\n".join(textwrap.fill(" ".join(p.split()), 60) for p in t.split("\n\n")), i, None) for n, (i, t) in enumerate(sorted(TEXTS.items())) if i not in JOINED],
    (1, "The MIT License (MIT)\n\nCopyright (c) 2019-2024 Some One <a@b.c>\n\n" + TEXTS["MIT"], "MIT", None),
    (2, "ISC License\n\nCopyright 2020 A, B\nCopyright © 2021 C. All rights reserved.\n\n" + TEXTS["ISC"], "ISC", None),
    (3, 'BSD 3-Clause "New" Licence\n\n' + BSD.replace("the copyright holder nor", "Example Organisation nor").replace("\n", "\r\n"), "BSD-3-Clause", None),
    (4, BSD.replace("this software without specific prior written permission", "this software with permission"), None, None),
    (5, "(a) one\n(b) two\n(c) you must keep it", None, None),
    (6, "(a) one\n(b) two\n(c) you need not keep it", None, None),
    (7, "Story.\n\nThis project is licensed under the terms of the\nMozilla Public License 2.0.\n\nEnd.", None, "MPL-2.0"),
    (8, "// SPDX-License-Identifier: Apache-2.0\ncode\nLicensed under CC BY-NC-SA 4.0", None, "Apache-2.0,CC-BY-NC-SA-4.0"),
    (9, "We spoke of the MIT License today", None, None),
    (10, None, None, None), (11, "", None, None), (12, "*** --- ***", None, None),
]


@pytest.fixture(scope="module")
def scanned(spark):
    docs = spark.createDataFrame([c[:2] for c in CASES], "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan(docs).collect()}


def test_licences_notices_and_clauses(scanned):
    assert len(TEXTS) >= 20
    for i, _, license_id, notices in CASES:
        assert scanned[i].license_id == license_id, i
        if notices is not None:
            assert scanned[i].notices == notices
    assert scanned[5].digest != scanned[6].digest
    assert scanned[10].digest is None and scanned[12].digest is None


def test_shuffled_digests_give_the_same(spark, scanned):
    docs = spark.createDataFrame([c[:2] for c in CASES], "doc_id long, text string")
    assert {r.doc_id: tuple(r) for r in licenses.scan(docs, max_broadcast=0).collect()} == {i: tuple(r) for i, r in scanned.items()}


def test_sql_gives_the_same(scanned):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [c[:2] for c in CASES])
    got = con.execute(queries.oracle_sql()["op7_license_scan"]).fetchall()
    assert {r[0]: r for r in got} == {i: tuple(r) for i, r in scanned.items()}
