"""The catalog of extracted tables: entries, cards, views stacked over releases, and which tables a view reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import series_title

READS = r"(?i)\b(?:from|join)\s+[\"`]?(\w+)"
RELEASE = r"(?:19|20)\d{2}(?:_\d{2}){0,2}|\d{4}q\d"


def entries(catalog: DataFrame) -> DataFrame:
    """One entry of every table of kind 'table' (a null kind counts as one); of unequal repeated entries the last in order of document, title, size and about."""
    names = ("doc_id", "title", "source", "layout", "n_rows", "columns", "notes", "row_labels", "about")
    real = catalog.where((F.coalesce(F.lower("kind"), F.lit("table")) == "table") & F.col("table").isNotNull())
    empty = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    order = F.struct(empty("doc_id", ""), empty("title", ""), empty("n_rows", 0), empty("about", ""))
    return real.groupBy("table").agg(F.max_by(F.struct(*names), order).alias("e")).select("table", "e.*")


def _names(columns: Column) -> Column:
    return F.array_join(F.transform(F.filter(columns, lambda c: c["name"].isNotNull()), lambda c: F.lower(F.trim(c["name"]))), ",")


def stacked(tables: DataFrame, docs: DataFrame, least: int = 3) -> DataFrame:
    """view, doc_type, series, layout, names, n_docs, n_tables, first_date, last_date, n_rows, members: tables of one type, title but for dates, columns and layout.

    tables are entries, docs (doc_id, doc_type, sort_date). A view is named after its
    latest member without the date; it needs tables of `least` documents.
    """
    known = tables.join(docs.select("doc_id", "doc_type", "sort_date"), "doc_id")
    keys = ["doc_type", "series", "layout", "names"]
    known = known.withColumns({"series": series_title(F.col("title")), "names": _names(F.col("columns"))})
    groups = known.groupBy(*keys).agg(
        F.max_by("table", F.struct(F.coalesce("sort_date", F.lit("")), F.col("table"))).alias("latest"), F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_tables"),
        F.min("sort_date").alias("first_date"), F.max("sort_date").alias("last_date"), F.sum("n_rows").alias("n_rows"),
        F.collect_list(F.struct("table", "doc_id", F.col("sort_date").alias("doc_date"))).alias("members"),
    )
    name = F.concat(F.regexp_replace(F.regexp_replace("latest", RELEASE, ""), "_+", "_"), F.lit("__all"))
    return groups.where(F.col("n_docs") >= least).select(name.alias("view"), *keys, "n_docs", "n_tables", "first_date", "last_date", "n_rows", "members")


def stacked_rows(views: DataFrame, cells: DataFrame) -> DataFrame:
    """view, doc_id, doc_date, table, row_no, name, text: the union of every view's members; cells (table, row_no, name, text)."""
    members = views.select("view", F.explode("members").alias("m")).select("view", "m.doc_id", "m.doc_date", "m.table")
    return cells.join(members, "table").select("view", "doc_id", "doc_date", "table", "row_no", "name", "text")


def cards(tables: DataFrame, docs: DataFrame) -> DataFrame:
    """table, card: the text by which a table is found."""
    known = tables.join(docs.select("doc_id", "doc_title", "sort_date"), "doc_id", "left")
    text = lambda c, instead="": F.coalesce(F.col(c).cast("string"), F.lit(instead))
    columns = F.transform(F.filter(F.coalesce("columns", F.array()), lambda c: c["name"].isNotNull()), lambda c: F.concat(c["name"], F.lit(" ["), F.coalesce(c["type"], F.lit("text")), F.lit("]")))
    lines = (
        F.concat(F.lit("Data table `"), F.col("table"), F.lit("`: "), F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)"))),
        F.concat(F.lit("From: "), text("doc_title"), F.lit(" ("), text("sort_date"), F.lit("), "), text("source")),
        F.concat(F.lit("Shape: "), text("n_rows", "0"), F.lit(" rows, layout "), text("layout")),
        F.concat(F.lit("Columns: "), F.array_join(columns, "; ")),
        F.when(F.size("notes") > 0, F.concat(F.lit("Notes: "), F.array_join("notes", " "))),
        F.when(F.size("row_labels") > 0, F.concat(F.lit("Row labels: "), F.array_join(F.slice("row_labels", 1, 60), "; "))),
    )
    return known.select("table", F.concat_ws("\n", *lines).alias("card"))


def lineage(catalog: DataFrame) -> DataFrame:
    """view, reads: the tables named after FROM and JOIN in the SQL of the catalog's views, in lower case."""
    views = catalog.where((F.lower("kind") == "view") & F.col("sql").isNotNull())
    return views.select(F.col("table").alias("view"), F.explode(F.regexp_extract_all("sql", F.lit(READS), 1)).alias("reads")).select("view", F.lower("reads").alias("reads")).distinct()


def sources_of_views(reads: DataFrame, tables: DataFrame, docs: DataFrame) -> DataFrame:
    """view, doc_id, sort_date, nth: the documents of the tables a view reads, the newest first."""
    found = reads.join(tables.select(F.lower("table").alias("reads"), "doc_id"), "reads").join(docs.select("doc_id", "sort_date"), "doc_id", "left").select("view", "doc_id", "sort_date").distinct()
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("view").orderBy(F.col("sort_date").desc_nulls_last(), "doc_id")))
