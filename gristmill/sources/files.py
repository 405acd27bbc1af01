"""Files of a collection as rows: manifest, JSON lines, CSV and workbook grids, web pages and text documents.

Files are listed and read by Spark, one row per file; a small parser turns each
file's bytes into rows (blocks or cells), and everything after that is joins and
windows over them: a grid's cells go to operators.grids, blocks to operators.passages.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CELLS = "path string, sheet string, r int, c int, text string"
MERGED = "path string, sheet string, r0 int, c0 int, r1 int, c1 int"
BLOCKS = "path string, ord int, kind string, level int, text string, grid int, header_rows int"
SKIPPED_SHEET = re.compile(r"(?i)^(?:disclaimer|licen[cs]e|(?:sheet|chart)\d*)$")
FORMATS = ("pdf", "html", "docx", "xlsx", "xls", "csv")
# HTML's elements by their part in a text.
HEADINGS = {f"h{i}": i for i in range(1, 7)}
TEXTS = frozenset("p li dd dt blockquote pre figcaption address summary caption".split())
BREAKS = frozenset("div section article main ul ol dl figure details aside header footer center tbody body form br table".split())
DROPPED = frozenset("script style nav button noscript iframe svg video audio select picture object map head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RELATED = re.compile(r"(?i)^related (?:content|information|links)$")
FOOTNOTE = re.compile(r"^[\d*†‡,\s]+$")
# End of the fixed values.


def manifest(spark: SparkSession, path: str, folder: str, only: str | None = None) -> DataFrame:
    """The rows of a CSV manifest, all text, whose file (column filename) lies in the folder, with its path; only: a part of the id."""
    rows = spark.read.option("multiLine", True).csv(path, header=True)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"))
    found = rows.join(there, "filename")
    return found.where(F.col("doc_id").contains(only)) if only else found


def added_to_manifest(known: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """known with the rows of fresh whose key it lacks, once each: the first in order of all their columns."""
    new = fresh.join(known.select(key).distinct(), key, "left_anti").where(F.col(key).isNotNull())
    rest = [c for c in new.columns if c != key]
    return known.unionByName(new.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*"), allowMissingColumns=True)


def verified(rows: DataFrame, folder: str) -> DataFrame:
    """rows (filename, sha256) with whether the file in the folder has this checksum; null where there is none."""
    files = rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    sums = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("found"))
    return rows.join(sums, "filename", "left").withColumn("intact", F.col("found") == F.lower("sha256")).drop("found")


def format_of(filename, declared):
    """A file's format (columns): the declared one, else its suffix; null for one that isn't known."""
    fmt = F.coalesce(F.nullif(F.lower(F.trim(declared)), F.lit("")), F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1)))
    return F.when(fmt.isin(*FORMATS), fmt)


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with an explicit schema; fields that a line lacks are null."""
    return spark.read.schema(schema).json(path)


def write_sorted(df: DataFrame, path: str, *order: str) -> None:
    """df as JSON lines, sorted over all its files."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def save_table(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df written as the Parquet table `name` of a folder in place of an older one, and its view made."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.createOrReplaceTempView(name)
    return out


def contents(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path, content of the files with a suffix below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(path).select("path", "content")


def _rows_of(parse: Callable[[bytes], list[tuple]], columns: list[str]):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame([(path, *row) for row in parse(bytes(content))], columns=columns)

    return rows


def _parsed(files: DataFrame, parse: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    return files.mapInPandas(_rows_of(parse, [f.split()[0] for f in schema.split(", ")]), schema)


def csv_rows(content: bytes) -> list[tuple]:
    text = content.decode("utf-8-sig", errors="replace")
    return [("", r, c, x) for r, row in enumerate(csv.reader(io.StringIO(text))) for c, x in enumerate(row) if x.strip()]


def _xml(archive: zipfile.ZipFile, name: str):
    """The root of an archive's part without name spaces; None where there is no such part."""
    if name not in archive.namelist():
        return None
    root = ElementTree.fromstring(archive.read(name))
    for node in root.iter():
        node.tag = node.tag.rsplit("}", 1)[-1]
        node.attrib = {k.rsplit("}", 1)[-1]: v for k, v in node.attrib.items()}
    return root


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)(\d+)", ref).groups()
    column = 0
    for letter in letters:
        column = column * 26 + ord(letter) - 64
    return int(digits) - 1, column - 1


def _sheets(archive: zipfile.ZipFile) -> Iterator[tuple[str, ElementTree.Element]]:
    links = {x.get("Id"): x.get("Target") for x in _xml(archive, "xl/_rels/workbook.xml.rels")}
    for sheet in _xml(archive, "xl/workbook.xml").iter("sheet"):
        target = links.get(sheet.get("id"), "")
        root = _xml(archive, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        if root is not None and root.tag == "worksheet" and not SKIPPED_SHEET.match(sheet.get("name")):
            yield sheet.get("name"), root


def xlsx_rows(content: bytes) -> list[tuple]:
    """sheet, r, c, text of a workbook's filled cells; formulas give their stored results, chart sheets nothing."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        strings = _xml(archive, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in item.iter("t")) for item in strings] if strings is not None else []
        for name, root in _sheets(archive):
            for cell in root.iter("c"):
                kind, value = cell.get("t"), cell.findtext("v")
                text = "".join(t.text or "" for t in cell.iter("t")) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value else value
                if text and text.strip():
                    out.append((name, *_place(cell.get("r")), text))
    return out


def xlsx_merged(content: bytes) -> list[tuple]:
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name, root in _sheets(archive):
            for merged in root.iter("mergeCell"):
                first, last = (merged.get("ref") + ":" + merged.get("ref")).split(":")[:2]
                out.append((name, *_place(first), *_place(last)))
    return out


def docx_blocks(content: bytes) -> list[tuple]:
    """ord, kind, level, text, grid, header_rows of a text document: headings by their style, list items with a bullet, table rows joined by ' | '."""
    out: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = _xml(archive, "word/document.xml").find("body")
    text_of = lambda node: re.sub(r"\s+", " ", "".join(t.text or "" for t in node.iter("t"))).strip()
    grid = 0
    for node in body:
        if node.tag == "tbl":
            rows = [[text_of(c) for c in row.iter("tc")] for row in node.iter("tr")]
            if sum(map(len, rows)) > 1:  # one cell alone is a box
                out += [(len(out) + i, "table", None, " | ".join(row), grid, 1) for i, row in enumerate(rows)]
                grid += 1
        elif node.tag == "p" and (text := text_of(node)):
            style = next((s.get("val", "") for s in node.iter("pStyle")), "")
            level = re.match(r"(?i)heading\s?(\d)|title$", style)
            listed = any(True for _ in node.iter("numPr")) or style.lower().startswith("list")
            if not style.lower().startswith("toc"):
                kind = "heading" if level else "text"
                out.append((len(out), kind, int(level.group(1) or 1) if level else None, f"• {text}" if listed and not level else text, None, None))
    return out


class _Page(HTMLParser):
    """Blocks of a page in order: headings, texts, and table rows; what is below DROPPED elements or after a heading of related links is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []
        self.text: list[str] = []
        self.kind, self.level, self.dropped, self.sup, self.grid, self.related = "text", None, 0, None, -1, 0
        self.rows: list[list[tuple[str, int, int, bool]]] = []
        self.cell: list[str] | None = None
        self.in_table = 0

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.text)).strip()
        self.text = []
        if text and self.kind == "heading" and RELATED.match(text):
            self.related = self.level
        elif text:
            if self.kind == "heading":
                self.related = 0 if self.level <= self.related else self.related
            if not self.related:
                self.out.append((self.kind, self.level, f"• {text}" if self.kind == "item" else text, None, None))
        self.kind, self.level = "text", None

    def handle_starttag(self, tag, attrs):
        if self.dropped or tag in DROPPED:
            self.dropped += tag not in VOID
            return
        if tag == "sup":
            self.sup = []
        elif tag == "table":
            self.flush()
            self.in_table, self.rows = self.in_table + 1, []
        elif self.in_table and tag == "tr":
            self.rows.append([])
        elif self.in_table and tag in ("td", "th"):
            size = lambda name, most: max(1, min(most, int(v))) if (v := dict(attrs).get(name) or "1").isdigit() else 1
            self.cell, self.span = [], (size("colspan", 50), size("rowspan", 200), tag == "th")
        elif tag in HEADINGS or tag in TEXTS or tag in BREAKS:
            if not self.in_table:
                self.flush()
                self.kind, self.level = ("heading", HEADINGS[tag]) if tag in HEADINGS else ("item" if tag == "li" else "text", None)

    def handle_endtag(self, tag):
        if self.dropped:
            self.dropped -= tag not in VOID
        elif tag == "sup" and self.sup is not None:
            mark = "".join(self.sup)
            self.sup = None
            if not FOOTNOTE.match(mark):
                self.handle_data(mark)
        elif self.in_table and tag in ("td", "th") and self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((re.sub(r"\s+", " ", "".join(self.cell)).strip(), *self.span))
            self.cell = None
        elif tag == "table" and self.in_table:
            self.in_table -= 1
            if not self.in_table:
                self.grid_done()
        elif (tag in HEADINGS or tag in TEXTS or tag in BREAKS) and not self.in_table:
            self.flush()

    def handle_data(self, data):
        if not self.dropped:
            (self.sup if self.sup is not None else self.cell if self.cell is not None else self.text).append(data)

    def grid_done(self) -> None:
        """The rows with spanning cells repeated; leading rows of header cells alone are the header."""
        taken: dict[tuple[int, int], str] = {}
        heads = 0
        for r, row in enumerate(self.rows):
            c = 0
            for text, across, down, _ in row:
                while (r, c) in taken:
                    c += 1
                taken |= {(r + i, c + j): text for i in range(down) for j in range(across)}
                c += across
            heads += heads == r and r < 6 and len(row) > 1 and all(x[3] for x in row)
        if not taken or self.related:
            return
        height, width = max(r for r, _ in taken) + 1, max(c for _, c in taken) + 1
        lines = [[taken.get((r, c), "") for c in range(width)] for r in range(height)]
        if height == 1 or width == 1:  # a layout, not a table
            self.out += [("text", None, " ".join(x for x in line if x), None, None) for line in lines if any(line)]
            return
        self.grid += 1
        self.out += [("table", None, " | ".join(line), self.grid, heads) for line in lines]


def html_blocks(content: bytes) -> list[tuple]:
    page = _Page()
    page.feed(content.decode("utf-8", errors="replace"))
    page.flush()
    return [(i, *row) for i, row in enumerate(page.out)]


def csv_cells(files: DataFrame) -> DataFrame:
    """path, sheet (empty), r, c, text of CSV files (path, content), ragged rows kept and no row taken for a header."""
    return _parsed(files, csv_rows, CELLS)


def xlsx_cells(files: DataFrame) -> DataFrame:
    return _parsed(files, xlsx_rows, CELLS)


def xlsx_merged_ranges(files: DataFrame) -> DataFrame:
    return _parsed(files, xlsx_merged, MERGED)


def page_blocks(files: DataFrame) -> DataFrame:
    """Blocks of HTML files (path, content): neighbours that repeat once, heading levels counted among those a page uses."""
    return ranked_blocks(_parsed(files, html_blocks, BLOCKS))


def document_blocks(files: DataFrame) -> DataFrame:
    """Blocks of DOCX files (path, content)."""
    return ranked_blocks(_parsed(files, docx_blocks, BLOCKS))


def ranked_blocks(blocks: DataFrame) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("path").orderBy("ord"))
    fresh = blocks.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("text")) | (F.col("kind") == "table")).drop("before")
    rank = fresh.where("level is not null").select("path", "level").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy("level")))
    return fresh.join(rank, ["path", "level"], "left").select("path", "ord", "kind", F.col("rank").alias("level"), "text", "grid", "header_rows")


def block_cells(blocks: DataFrame) -> DataFrame:
    """grid, r, c, text: the cells of the tables among blocks, as operators.grids reads them."""
    rows = blocks.where("kind = 'table'").withColumn("r", F.row_number().over(Window.partitionBy("path", "grid").orderBy("ord")) - 1)
    each = rows.select(F.concat_ws("#", "path", F.col("grid").cast("string")).alias("grid"), "r", F.posexplode(F.split("text", r" \| ", -1)).alias("c", "text"))
    return each.where(F.trim("text") != "")
