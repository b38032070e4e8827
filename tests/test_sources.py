"""Workbooks and repaired answers."""

import json
import zipfile

import pytest

from larkspan.functions.answers import json_repaired, repaired
from larkspan.sources import sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, grids):
    with zipfile.ZipFile(path, "w") as z:
        names = list(grids)
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>Труба</t></si><si><r><t>Кран </t></r><r><t>шаровой</t></r></si></sst>")
        for i, n in enumerate(names):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{grids[n]}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"one": '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5.5</v></c></row><row r="2"/><row r="3"><c r="AA3" t="inlineStr"><is><t> x </t></is></c></row>', "two": '<row r="4"><c r="B4" t="s"><v>1</v></c></row>'})
    workbook(tmp_path / "b.xlsx", {"empty": ""})
    (tmp_path / "c.xlsx").write_bytes(b"no archive")
    got = {(r["path"][-6:], r["sheet"], r["row"]): r for r in sheets.read_workbooks(spark, str(tmp_path)).collect()}
    assert set(got) == {("a.xlsx", "one", 1), ("a.xlsx", "one", 3), ("a.xlsx", "two", 4), ("c.xlsx", None, None)}
    first = got["a.xlsx", "one", 1]["cells"]
    assert len(first) == 27 and first[0] == "Труба" and first[2] == "5.5" and got["a.xlsx", "one", 3]["cells"][26] == "x" and got["a.xlsx", "two", 4]["cells"] == ["", "Кран шаровой"]
    assert got["c.xlsx", None, None]["error"].startswith("BadZipFile")
    assert sheets.read_workbooks(spark, str(tmp_path), sheet="one", most_rows=1).where("error IS NULL").count() == 1
    text = {r["sheet"]: r["text"] for r in sheets.compact_text(sheets.read_workbooks(spark, str(tmp_path))).collect()}
    assert text == {"one": "Труба\t5.5\t\n\t\tx", "two": "Кран шаровой"}


@pytest.mark.parametrize(("text", "value"), [('{"a": 1,}', {"a": 1}), ('{"a": "x\\П"}', {"a": "xП"}), ('{"a": "x\ny\x01"}', {"a": "x y"}), ('{"a": [1, 2', {"a": [1, 2]}), ('{"a": "b', {"a": "b"}), ('[{"a": 1}, ]', [{"a": 1}]), ('{"a": 1}}', {"a": 1}), ('{"a": "\\u0041\\n"}', {"a": "A\n"}), ('{"a": 1,', {"a": 1})])
def test_json_repair(text, value):
    assert json.loads(repaired(text)) == value


def test_json_repair_of_a_column(spark):
    t = spark.createDataFrame([('{"a": 1,}',), (None,)], "t string")
    assert [r[0] for r in t.select(json_repaired("t")).collect()] == ['{"a": 1}', None]
