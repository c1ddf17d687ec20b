"""Files by pattern, encodings, HTML tables, lists of tables and columns."""

import pytest

from lumenframe.sources import search


def test_files_by_pattern(spark, tmp_path):
    for n, rows in (("a_1.csv", "k,v\n1,x\n"), ("a_2.CSV", "k,v\n2,y\n"), ("b.tsv", "k\tv\n3\tz\n")):
        (tmp_path / n).write_text(rows)
    (tmp_path / "sub.csv").mkdir()
    got = search.read_found_delimited(spark, str(tmp_path), "a_*.csv|nothing*", ignore_case=True)
    assert sorted(map(tuple, got.collect())) == [(1, "x", "a_1.csv"), (2, "y", "a_2.CSV")]
    assert [p.rsplit("/", 1)[1] for p in search.search_files(spark, str(tmp_path), "*.csv|*.tsv")] == ["a_1.csv", "b.tsv"]
    with pytest.raises(FileNotFoundError):
        search.read_found_parquet(spark, str(tmp_path), "*.parquet")
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert search.read_found_parquet(spark, str(tmp_path / "p"), "part-*.parquet").count() == 3


@pytest.mark.parametrize("text, name", [("plain", "UTF-8"), ("café 製品", "UTF-8"), ("日本語のテキスト", "Shift_JIS"), ("日本語のテキストです。漢字", "EUC-JP"), ("café crème à la", "windows-1252")])
def test_encodings(spark, tmp_path, text, name):
    data = text.encode(name)
    assert search.guess_encoding(data) in ({name} if name != "EUC-JP" else {"EUC-JP", "Shift_JIS"})
    (tmp_path / "x.csv").write_bytes(data)
    assert search.guess_file_encoding(spark, str(tmp_path / "x.csv")) == search.guess_encoding(data)
    if name == "UTF-8" and len(data) > 6:
        assert search.guess_encoding(data[:-1]) == "UTF-8"


def test_ndjson_and_links(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "b.json").write_text('[{"a": 1},\n{"a": 2}]\n')
    assert search.is_ndjson(spark, str(tmp_path / "a.json")) and not search.is_ndjson(spark, str(tmp_path / "b.json"))
    assert search.direct_download_url("https://h/s/x.csv?dl=0") == "https://h/s/x.csv?dl=1" and search.direct_download_url("https://h/?dl=01") == "https://h/?dl=01"


def test_html_tables(spark):
    html = "<table><tr><th>A &amp; B<th>C</tr><tr><td> 1\n 2</td><td><table><tr><td>in</td></tr></table></td></tr></table><p>no</p><table><td>x<br>y</table>"
    d = spark.createDataFrame([(1, html), (2, None), (3, "<table><tr><td>open")], "page_id long, html string")
    got = sorted((r.page_id, r.table, r.row, r.cells) for r in search.html_tables(d, "page_id", "html").collect())
    assert got == [(1, 1, 1, ["A & B", "C"]), (1, 1, 2, ["1 2", ""]), (1, 2, 1, ["in"]), (1, 3, 1, ["x y"]), (3, 1, 1, ["open"])]


def test_tables_and_columns(spark):
    spark.range(1).selectExpr("id", "'x' AS name").createOrReplaceTempView("lf_search_view")
    assert "lf_search_view" in search.list_tables(spark) and search.list_columns(spark, "lf_search_view") == [("id", "bigint"), ("name", "string")]
