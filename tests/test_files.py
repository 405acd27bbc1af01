import zipfile

import pytest
from pyspark.sql import functions as F

from gristmill.operators import grids
from gristmill.sources import files

PAGE = """<html><head><title>x</title><style>p{}</style></head><body><nav>Menu</nav><div id="article"><h3>Projections</h3><h3>Projections</h3>
<p>Growth was strong<sup>1</sup> in <b>all</b> districts.</p><div class="x">Loose text<br>next line</div><ul><li>First</li><li>Second</li></ul>
<h5>Table 1. Projections</h5><table><thead><tr><th rowspan="2">Variable</th><th colspan="2">Median</th></tr><tr><th>2026</th><th>2027</th></tr></thead>
<tr><td>PCE</td><td>2.5</td><td>2.3</td></tr><tr><td>GDP</td><td>1.8</td><td>n.a.</td></tr></table><table><tr><td>a box</td></tr></table>
<script>var a;</script><h3>Related Content</h3><ul><li>Other</li></ul></div></body></html>"""
SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData><mergeCells><mergeCell ref="B1:C1"/></mergeCells></worksheet>'
NS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path):
    grid = [["", "Assets", ""], ["quarter", "Loans", "Bonds"], ["26:Q1", 13.5, 2], ["26:Q2", 18.7705, 3]]
    cell = lambda r, c, v: f'<c r="{"ABC"[c]}{r + 1}"' + (f"><v>{v}</v></c>" if not isinstance(v, str) else f' t="inlineStr"><is><t>{v}</t></is></c>')
    rows = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v != "") + "</row>" for r, row in enumerate(grid))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="Data" r:id="r1"/><sheet name="Chart1" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", SHEET.format(rows))
        z.writestr("xl/worksheets/s2.xml", SHEET.format(""))


def document(path):
    p = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    table = lambda rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in row) + "</w:tr>" for row in rows) + "</w:tbl>"
    body = p("Survey", "Heading1") + p("1. Survey", "TOC1") + p("An item", "ListBullet") + table([["variable", "code"], ["rate", "7"], ["loan", "8"]]) + table([["a code box"]]) + p("The end.")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://w"><w:body>{body}</w:body></w:document>')


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    (at / "a.html").write_text(PAGE)
    (at / "empty.html").write_bytes(b"\xff")
    (at / "g.csv").write_bytes("﻿year,rate\n2003,\"1,5\"\n2004,2,extra\n\n".encode())
    workbook(at / "w.xlsx")
    document(at / "d.docx")
    (at / "metadata.csv").write_text('doc_id,filename,title,sha256\nd1,a.html,"Two\nlines",x\nd2,gone.html,Gone,\nd3,g.csv,Grid,\n')
    return str(at)


def test_web_pages(spark, folder):
    rows = files.page_blocks(files.contents(spark, folder, "html")).where("path like '%a.html'").orderBy("ord").collect()
    got = [(r.kind, r.level, r.text) for r in rows if r.kind != "table"]
    assert got == [
        ("heading", 1, "Projections"), ("text", None, "Growth was strong in all districts."), ("text", None, "Loose text"), ("text", None, "next line"),
        ("item", None, "• First"), ("item", None, "• Second"), ("heading", 2, "Table 1. Projections"), ("text", None, "a box"),
    ]
    cells = files.block_cells(files.page_blocks(files.contents(spark, folder, "html")))
    long = {(r.row_label, *r.h): r.value for r in grids.long_relation(grids.blocks(cells)).collect()}
    assert long == {("PCE", "Median", "2026"): 2.5, ("PCE", "Median", "2027"): 2.3, ("GDP", "Median", "2026"): 1.8, ("GDP", "Median", "2027"): None}


def test_workbooks(spark, folder):
    found = files.contents(spark, folder, "xlsx")
    cells = files.xlsx_cells(found).select(F.concat_ws("#", "path", "sheet").alias("grid"), "r", "c", "text")
    merged = files.xlsx_merged_ranges(found).select(F.concat_ws("#", "path", "sheet").alias("grid"), "r0", "c0", "r1", "c1")
    assert merged.count() == 1
    long = {(r.row_label, *r.h): r.value for r in grids.long_relation(grids.blocks(grids.filled_merged(cells, merged))).collect()}
    assert long["26:Q2", "Assets", "Loans"] == 18.7705 and len(long) == 4


def test_text_documents(spark, folder):
    rows = files.document_blocks(files.contents(spark, folder, "docx")).orderBy("ord").collect()
    assert [(r.kind, r.text) for r in rows] == [("heading", "Survey"), ("text", "• An item"), ("table", "variable | code"), ("table", "rate | 7"), ("table", "loan | 8"), ("text", "The end.")]


def test_grids_of_csv_files(spark, folder):
    rows = {(r.r, r.c): r.text for r in files.csv_cells(files.contents(spark, folder, "csv")).where("path like '%g.csv'").collect()}
    assert rows == {(0, 0): "year", (0, 1): "rate", (1, 0): "2003", (1, 1): "1,5", (2, 0): "2004", (2, 1): "2", (2, 2): "extra"}


def test_manifest_lists_the_files_there_are(spark, folder):
    found = files.manifest(spark, f"{folder}/metadata.csv", folder)
    assert {(r.doc_id, r.title) for r in found.collect()} == {("d1", "Two\nlines"), ("d3", "Grid")}
    assert files.manifest(spark, f"{folder}/metadata.csv", folder, only="d3").count() == 1
    assert {r.doc_id: r.intact for r in files.verified(found.select("doc_id", "filename", F.when(F.col("doc_id") == "d1", "x").alias("sha256")), folder).collect()} == {"d1": False, "d3": None}
    fresh = spark.createDataFrame([("d1", "n", "new"), ("d9", "z", "b"), ("d9", "y", "a"), (None, "q", "q")], "doc_id string, filename string, title string")
    more = {(r.doc_id, r.filename) for r in files.added_to_manifest(found, fresh).collect()}
    assert more == {("d1", "a.html"), ("d3", "g.csv"), ("d9", "y")}


def test_lines_and_tables_round_trip(spark, folder, tmp_path):
    df = spark.createDataFrame([("b", 2, None), ("a", 1, ["x"])], "doc_id string, n int, tables array<string>")
    files.write_sorted(df, f"{tmp_path}/docs", "doc_id")
    back = files.read_lines(spark, f"{tmp_path}/docs", "doc_id string, n int, tables array<string>, more string")
    assert sorted(tuple(r) for r in back.collect()) == [("a", 1, ["x"], None), ("b", 2, None, None)]
    files.save_table(df, str(tmp_path), "saved_docs")
    assert spark.sql("SELECT count(*) FROM saved_docs").first()[0] == 2
    names = spark.createDataFrame([("x.HTML", None), ("y", " PDF "), ("z.exe", "")], "f string, d string")
    assert [r[0] for r in names.select(files.format_of(F.col("f"), F.col("d"))).collect()] == ["html", "pdf", None]
