from __future__ import annotations

import io
import zipfile

from tessera.sources import listings, workbooks


def _book(cells: str, strings: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="S1" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="m">{strings}</sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="m"><sheetData><row r="1">{cells}</row></sheetData></worksheet>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(_book('<c r="A1" t="s"><v>0</v></c><c r="AB1"><v>1.5</v></c><c r="C1"><f>A1*2</f><v>3</v></c><c r="D1" t="inlineStr"><is><t>in</t></is></c><c r="E1" t="e"><v>#N/A</v></c><c r="F1"/>', "<si><t>na</t><t>me</t></si>"))
    (tmp_path / "b.xlsx").write_bytes(b"no archive")
    got = workbooks.read_workbooks(spark, str(tmp_path)).collect()
    cells = {(r.row, r.col): (r.value_type, r.raw, r.formula) for r in got if r.status == "ok"}
    assert cells == {(1, 1): ("string", "name", None), (1, 28): ("decimal", "1.5", None), (1, 3): ("decimal", "3", "A1*2"), (1, 4): ("string", "in", None), (1, 5): ("error", "#N/A", None)}
    assert [r.status for r in got if r.status != "ok"] == ["unreadable: BadZipFile"]


def test_listings(spark, tmp_path):
    html = "<table><tr><th>n</th><th>t</th></tr><tr><td> A &amp; <b>B</b></td><td>005930</td></tr><tr><td>short</td></tr></table>"
    rows = listings.html_table(spark.createDataFrame([(1, html)], "id int, html string"), "html", ["name", "ticker"])
    assert [(r.name, r.ticker) for r in rows.where(listings.valid_ticker(rows.ticker)).collect()] == [("A & B", "005930")]
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("codes.xml", "<r><list><code>1</code><name>X &lt; Y</name></list><list><code>2</code><name> </name></list></r>")
    got = listings.zipped_xml_records(spark, str(tmp_path / "c.zip"), "list", ["code", "name"]).collect()
    assert [(r.code, r["name"]) for r in got] == [("1", "X < Y"), ("2", None)]
    pages = spark.createDataFrame([('{"items":[{"a":1},{"a":2}]}',), ("broken",)], "j string")
    assert [r.a for r in listings.json_pages(pages, "j", "items", "a int").collect()] == [1, 2]
    ok, warned = listings.collect_sources(spark, {"good": lambda: spark.range(2).selectExpr("cast(id as int) a"), "bad": lambda: spark.read.parquet(str(tmp_path / "none"))}, "a int")
    assert ok.count() == 2 and warned.first().source == "bad"
    put = listings.put_immutable(spark.createDataFrame([("k", "x"), ("k", "x"), ("m", "y"), ("m", "z")], "key string, c string"), str(tmp_path / "store"), "key", "c")
    assert {r.key: r.status for r in put.collect()} == {"k": "stored", "m": "content_conflict"}
    again = listings.put_immutable(spark.createDataFrame([("k", "x"), ("n", "new"), ("k2", None)], "key string, c string"), str(tmp_path / "store"), "key", "c")
    other = listings.put_immutable(spark.createDataFrame([("k", "changed"), ("n", "new")], "key string, c string"), str(tmp_path / "store"), "key", "c")
    assert {r.key: r.status for r in again.collect()} == {"k": "kept", "n": "stored", "k2": "stored"}
    assert {r.key: r.status for r in other.collect()} == {"k": "content_conflict", "n": "kept"}
    assert {r.key: r.content for r in spark.read.parquet(str(tmp_path / "store")).collect()} == {"k": "x", "n": "new", "k2": None}
