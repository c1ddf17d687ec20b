import zipfile

import pytest

from lumenframe.sources.excel import read_excel, sheet_rows

M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path, sheet, shared=(), name="Data"):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {M} {R}><sheets><sheet name="Empty" r:id="r1"/><sheet name="{name}" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {M}>{''.join(f'<si>{s}</si>' for s in shared)}</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {M}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/a.xml", f"<worksheet {M}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/b.xml", f"<worksheet {M}><sheetData>{sheet}</sheetData></worksheet>")


HEAD = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>0</v></c></row>'


def test_read_excel(spark, tmp_path):
    shared = ["<t>na me</t>", "<r><t>va</t></r><r><t>lue</t></r><rPh><t>x</t></rPh>", "<t>NA</t>"]
    body = '<row r="3"><c r="A3" t="inlineStr"><is><t>é</t></is></c><c r="B3"><v>1.5</v></c><c r="C3" t="b"><v>1</v></c><c r="D3" s="1"><v>45292</v></c></row>'
    body += '<row r="4"><c r="A4" t="s"><v>2</v></c><c r="B4" t="e"><v>#DIV/0!</v></c><c r="C4" s="3"><v>3</v></c><c r="D4" s="2"><v>45292.5</v></c></row>'
    for i in (1, 2):
        book(tmp_path / f"{i}.xlsx", HEAD + body, shared)
    df = read_excel(spark, str(tmp_path), "Data")
    assert df.columns == ["file_name", "row_number", "na me", "value", "X3", "na me...4"]
    got = sorted(tuple(r) for r in df.collect())
    assert got[:2] == [("1.xlsx", 3, "é", "1.5", "true", "2024-01-01"), ("1.xlsx", 4, None, None, "3", "2024-01-01 12:00:00")] and len(got) == 4
    assert read_excel(spark, str(tmp_path / "1.xlsx"), 1).count() == 0
    assert len(read_excel(spark, str(tmp_path / "1.xlsx"), 2, header=False).columns) == 6
    with pytest.raises(ValueError):
        list(sheet_rows((tmp_path / "1.xlsx").read_bytes(), "None"))


def test_cells_beyond_the_header_are_an_error(spark, tmp_path):
    book(tmp_path / "1.xlsx", HEAD + '<row r="2"><c r="F2"><v>1</v></c></row>', ["<t>a</t>", "<t>b</t>"])
    with pytest.raises(Exception, match="beyond the 4 named columns"):
        read_excel(spark, str(tmp_path / "1.xlsx"), "Data").collect()


def test_sheets(spark, tmp_path):
    from lumenframe.sources.excel import excel_sheets, read_excel_sheets

    book(tmp_path / "s.xlsx", HEAD + '<row r="2"><c r="A2" t="inlineStr"><is><t>v</t></is></c></row>', ["<t>a</t>", "<t>b</t>"])
    path = str(tmp_path / "s.xlsx")
    assert excel_sheets(spark, path) == ["Empty", "Data"]
    got = read_excel_sheets(spark, path, ["Data"]).collect()
    assert [(r["sheet_name"], r["a"]) for r in got] == [("Data", "v")]
    assert read_excel_sheets(spark, path).count() == 1
