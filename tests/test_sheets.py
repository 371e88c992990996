import io
import zipfile

from docwright.sources import files

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="One" r:id="a"/><sheet name="None" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>name</t></si><si><r><t>pri</t></r><r><t>ce</t></r></si></sst>')
        body = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>' + "".join(f'<row><c r="A{k}" t="inlineStr"><is><t>n{k}</t></is></c><c r="C{k}"><v>{k}</v></c></row>' for k in range(2, rows + 2))
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>')
    return out.getvalue()


def test_sheets_become_paragraphs(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook(12))
    (tmp_path / "b.xlsx").write_bytes(b"broken")
    rows = {r["file_name"]: r for r in files.documents(spark, str(tmp_path)).collect()}
    text = rows["a.xlsx"]["text"]
    assert "Headers: name |  | price" in text and "  Row 1: n2 |  | 2" in text and "  Row 10: n11 |  | 11" in text
    assert "... (2 more rows)" in text and text.endswith("Sheet: None\n" + "=" * 50 + "\n(Empty sheet)")
    assert rows["a.xlsx"]["metadata"] == {"sheets": "One, None"} and rows["b.xlsx"]["error"]
