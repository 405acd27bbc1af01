"""Queries over extracted tables: cells, types, grids on pages, stacked views, cards, lineage and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import text as t
from gristmill.operators import grids, table_catalog
from gristmill.operators.schema_drift import latest_records
from gristmill.session import table


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_records(table(spark, sf_dir, "table_records")).select("table", "row_no", F.explode("fields").alias("name", "text"))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_catalog.entries(table(spark, sf_dir, "table_catalog"))


def _doc_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "docs")
    return docs.groupBy("doc_id").agg(F.max("doc_type").alias("doc_type"), F.max("sort_date").alias("sort_date"), F.max("title").alias("doc_title"))


def period_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _cells(spark, sf_dir).where("name in ('period', 'row_label')").select("text").distinct()
    return labels.select("text", t.period_of(F.col("text")).alias("period"))


def number_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _cells(spark, sf_dir).select("text").where("text is not null").distinct()
    return texts.select("text", t.number_in(F.col("text")).alias("number"), t.is_missing(F.col("text")).alias("missing"))


def column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.typed_columns(_cells(spark, sf_dir))


def column_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column's first three values in order of its rows, and its smallest and largest number."""
    cells = _cells(spark, sf_dir).where("text is not null")
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("row_no", "text"))), 1, 3), lambda x: x["text"])
    nth = F.row_number().over(Window.partitionBy("table", "name").orderBy("row_no"))
    heads = cells.withColumn("nth", nth).where("nth <= 3").groupBy("table", "name").agg(F.array_join(first, "; ").alias("examples"))
    number = t.number_in(F.col("text"))
    return cells.groupBy("table", "name").agg(F.min(number).alias("low"), F.max(number).alias("high")).join(heads, ["table", "name"])


def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide tables as one row per period and measure; marks of missing values have a text and no number."""
    cells = _cells(spark, sf_dir)
    periods = cells.where("name = 'period'").select("table", "row_no", t.period_of(F.col("text")).alias("period"))
    values = cells.where("name <> 'period' and text is not null").join(periods, ["table", "row_no"])
    return values.select("table", "row_no", "period", "name", F.when(~t.is_missing(F.col("text")), t.number_in(F.col("text"))).alias("value"), F.col("text").alias("value_text"))


def long_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long tables as one row per label, its first-level headers as a map of name and number in order of the names."""
    fields = latest_records(table(spark, sf_dir, "table_records")).where(F.map_contains_key("fields", F.lit("h1")))
    get = lambda n: F.element_at("fields", F.lit(n))
    each = fields.select("table", get("row_label").alias("row_label"), F.lower(get("h1")).alias("head"), t.number_in(F.coalesce(get("value"), get("value_text"))).alias("value")).where("value is not null")
    heads = each.groupBy("table", "row_label", "head").agg(F.max("value").alias("value"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("head", "value"))), lambda x: F.concat_ws("=", x["head"], F.round(x["value"], 3).cast("decimal(20,3)").cast("string")))
    return heads.groupBy("table", "row_label").agg(F.array_join(pairs, "; ").alias("cells"), F.count("*").alias("n"))


def repeat_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's sections in order of their passages, repeated names qualified by the nearest single one."""
    once = table(spark, sf_dir, "chunks").where("section <> ''").groupBy("doc_id", "position").agg(F.max("section").alias("label"))
    rows = once.select(F.col("doc_id").alias("table"), F.col("position").alias("r"), "label")
    return grids.qualified(rows).select(F.col("table").alias("doc_id"), F.col("r").alias("position"), "label")


def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table as text, its cells in order of their names; of long tables both ends."""
    cells = _cells(spark, sf_dir)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " | ")
    return grids.rendered(cells.groupBy("table", F.col("row_no").alias("r")).agg(line.alias("line")), 8)


def grid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every table that stands on a page between '|' marks."""
    found = grids.blocks(grids.piped_cells(table(spark, sf_dir, "pages")))
    return found.select("grid", "block", "r", "part", "level", "group", F.size("cells").alias("n_cells"))


def grid_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long relation of every table on a page."""
    rows = grids.long_relation(grids.blocks(grids.piped_cells(table(spark, sf_dir, "pages"))))
    return rows.select("grid", "block", "r", "c", "row_group", "row_label", F.array_join("h", " | ", "").alias("header"), "value", "value_text")


def stacked_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views over tables that recur with the same title and columns in at least three documents."""
    return table_catalog.stacked(_tables(spark, sf_dir), _doc_dates(spark, sf_dir)).drop("members")


def stacked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of every stacked view with their document and date, as rows of record and field."""
    return table_catalog.stacked_rows(table_catalog.stacked(_tables(spark, sf_dir), _doc_dates(spark, sf_dir)), _cells(spark, sf_dir))


def table_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_catalog.cards(_tables(spark, sf_dir), _doc_dates(spark, sf_dir))


def sql_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_catalog.lineage(table(spark, sf_dir, "table_catalog"))


def query_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents a view's query draws on, the newest first."""
    catalog = table(spark, sf_dir, "table_catalog")
    return table_catalog.sources_of_views(table_catalog.lineage(catalog), _tables(spark, sf_dir), _doc_dates(spark, sf_dir))


def list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose title or name holds 'rates' or 'spending', with their size."""
    rows = _tables(spark, sf_dir)
    named = F.lower(F.concat_ws(" ", "title", "table"))
    return rows.where(named.contains("rates") | named.contains("spending")).select("table", "doc_id", "title", "layout", "n_rows", F.size("columns").alias("n_columns"))


def describe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table's columns with the values of its first record."""
    cells = _cells(spark, sf_dir)
    first = cells.groupBy("table").agg(F.min("row_no").alias("row_no"))
    sample = cells.join(first, ["table", "row_no"]).select("table", "name", F.col("text").alias("sample"))
    columns = _tables(spark, sf_dir).select("table", "doc_id", F.explode("columns").alias("c")).select("table", "doc_id", F.lower(F.trim(F.col("c.name"))).alias("name"), F.col("c.type").alias("type"))
    return columns.where("name is not null").groupBy("table", "doc_id", "name").agg(F.max("type").alias("type")).join(sample, ["table", "name"], "left")


def keyword_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve tables whose title and name hold most of the words 'inflation rate credit loans growth'."""
    words = "inflation rate credit loans growth".split()
    named = F.lower(F.concat_ws(" ", "table", "title"))
    hits = sum((named.contains(w).cast("int") for w in words), F.lit(0))
    return _tables(spark, sf_dir).select("table", "title", hits.alias("hits")).where("hits > 0").orderBy(F.col("hits").desc(), "table").limit(12)


def table_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short name of every document, later ones of the same name told apart by a hash."""
    docs = table(spark, sf_dir, "docs").select("doc_id").distinct().withColumn("base", t.slug(F.regexp_replace("doc_id", "^nrs_", ""), 30))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("doc_id"))
    return docs.select("doc_id", F.when(nth == 1, F.col("base")).otherwise(F.concat_ws("_", F.substring("base", 1, 24), F.substring(F.sha1("doc_id"), 1, 5))).alias("slug"))


QUERIES = {
    f.__name__: f
    for f in (
        period_normalize, number_clean, column_types, column_examples, wide_to_long, long_to_wide, repeat_qualify, table_text, grid_blocks, grid_long, stacked_views,
        stacked_rows, table_cards, sql_lineage, query_sources, list_tables, describe_tables, keyword_tables, table_slugs,
    )
}

_CELLS = r"""l AS (SELECT "table", row_no, arg_max(record, (loaded_at, record)) AS record FROM table_records WHERE "table" IS NOT NULL GROUP BY "table", row_no),
    keyed AS (SELECT "table", row_no, record, unnest(json_keys(record)) AS k FROM l),
    cells AS (SELECT "table", row_no, lower(trim(k)) AS name, trim(json_extract_string(record, '$."' || k || '"')) AS text FROM keyed)"""
_NUM = r"""CASE WHEN regexp_matches(replace(trim({0}), '−', '-'), '^\(?[-+−]?\$?\s?(\d{{1,3}}(,\d{{3}})+|\d+)?(\.\d+)?\)?\s?%?$') AND regexp_matches({0}, '\d') THEN
    (CASE WHEN regexp_matches(trim({0}), '^\(.*\)$') THEN -1 ELSE 1 END) * TRY_CAST(regexp_replace(replace(trim({0}), '−', '-'), '[()$,%\s]', '', 'g') AS DOUBLE) END"""
_MISSING = "lower(trim({0})) IN (" + ", ".join(f"'{m}'" for m in t.MISSING) + ")"
_PERIOD = r"""CASE WHEN regexp_full_match({0}, '\d{{2}}:Q[1-4]') THEN (CASE WHEN {0}[1:2] < '60' THEN '20' ELSE '19' END) || {0}[1:2] || '-Q' || {0}[5:5]
    WHEN regexp_matches({0}, '(?i)^\d{{4}}\s?[:-]?\s?Q[1-4]$') THEN {0}[1:4] || '-Q' || right({0}, 1)
    WHEN regexp_matches({0}, '(?i)^Q[1-4]\s?[:-]?\s?\d{{4}}$') THEN right({0}, 4) || '-Q' || {0}[2:2]
    WHEN regexp_full_match({0}, '\d{{4}}[-/]\d{{2}}') THEN {0}[1:4] || '-' || right({0}, 2)
    WHEN regexp_full_match({0}, '(19|20)\d\d(0[1-9]|1[0-2])') THEN {0}[1:4] || '-' || {0}[5:6]
    WHEN regexp_matches({0}, '^\d{{4}}-\d{{2}}-\d{{2}}([ T]00:00:00)?$') THEN {0}[1:10]
    WHEN regexp_full_match({0}, '\d{{1,2}}/\d{{1,2}}/\d{{4}}') THEN right({0}, 4) || '-' || lpad(split_part({0}, '/', 1), 2, '0') || '-' || lpad(split_part({0}, '/', 2), 2, '0')
    WHEN regexp_full_match({0}, '(18|19|20)\d\d') THEN {0} END"""
_P = "regexp_replace(trim(text), '^(\\d{4}|\\d{6})\\.0$', '\\1')"
_ENTRIES = """tables AS (SELECT "table", arg_max(e, o) AS e FROM (SELECT "table", {'doc_id': doc_id, 'title': title, 'source': source, 'layout': layout, 'n_rows': n_rows, 'columns': columns,
        'notes': notes, 'row_labels': row_labels, 'about': about} AS e, (coalesce(doc_id, ''), coalesce(title, ''), coalesce(n_rows, 0), coalesce(about, '')) AS o
        FROM table_catalog WHERE coalesce(lower(kind), 'table') = 'table' AND "table" IS NOT NULL) GROUP BY "table"),
    t AS (SELECT "table", e.doc_id AS doc_id, e.title AS title, e.source AS source, e.layout AS layout, e.n_rows AS n_rows, e.columns AS columns, e.notes AS notes, e.row_labels AS row_labels FROM tables)"""
_DATES = "dates AS (SELECT doc_id, max(doc_type) AS doc_type, max(sort_date) AS sort_date, max(title) AS doc_title FROM docs GROUP BY doc_id)"
_SERIES = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\b(" + "|".join(t.MONTH_NAMES) + r")\b', ' ', 'g'), '\b(19|20)\d{2}(\s*[–-]\s*\d{2,4})?\b', ' ', 'g'), '[^a-z]+', ' ', 'g'))"
_NAMES = "array_to_string(list_transform(list_filter(columns, lambda c: c.name IS NOT NULL), lambda c: lower(trim(c.name))), ',')"
_STACKED = f"""groups AS (SELECT doc_type, {_SERIES} AS series, {_NAMES} AS names, layout, t."table", t.doc_id, sort_date, n_rows FROM t JOIN dates ON t.doc_id = dates.doc_id),
    stacked AS (SELECT doc_type, series, layout, names, arg_max("table", (coalesce(sort_date, ''), "table")) AS latest, count(DISTINCT doc_id) AS n_docs, count(*) AS n_tables,
        min(sort_date) AS first_date, max(sort_date) AS last_date, sum(n_rows) AS n_rows, list("table") AS members
        FROM groups GROUP BY doc_type, series, layout, names HAVING count(DISTINCT doc_id) >= 3),
    views AS (SELECT regexp_replace(regexp_replace(latest, '(19|20)\\d{{2}}(_\\d{{2}}){{0,2}}|\\d{{4}}q\\d', '', 'g'), '_+', '_', 'g') || '__all' AS view, * FROM stacked)"""
_LINEAGE = r"""lineage AS (SELECT DISTINCT "table" AS view, lower(unnest(regexp_extract_all(sql, '(?i)\b(?:from|join)\s+["`]?(\w+)', 1))) AS reads FROM table_catalog WHERE lower(kind) = 'view' AND sql IS NOT NULL)"""

ORACLE_SQL = {
    "period_normalize": f"WITH {_CELLS}, d AS (SELECT DISTINCT text FROM cells WHERE name IN ('period', 'row_label')) SELECT text, {_PERIOD.format(_P)} AS period FROM d",
    "number_clean": f"WITH {_CELLS} SELECT DISTINCT text, {_NUM.format('text')} AS number, {_MISSING.format('text')} AS missing FROM cells WHERE text IS NOT NULL",
    "column_types": f"""WITH {_CELLS}, c AS (SELECT "table", name, text, text IS NOT NULL AND trim(text) <> '' AND NOT {_MISSING.format("text")} AS filled, {_NUM.format("text")} AS num FROM cells),
        g AS (SELECT "table", name, count(*) FILTER (WHERE filled) AS n_filled, count(*) FILTER (WHERE filled AND num IS NULL) AS n_text FROM c GROUP BY "table", name)
        SELECT "table", name, CASE WHEN n_filled > 0 AND n_text = 0 THEN 'number' ELSE 'text' END AS type, n_filled FROM g""",
    "column_examples": f"""WITH {_CELLS}, c AS (SELECT *, {_NUM.format("text")} AS num FROM cells WHERE text IS NOT NULL)
        SELECT "table", name, min(num) AS low, max(num) AS high, array_to_string(list(text ORDER BY row_no)[1:3], '; ') AS examples FROM c GROUP BY "table", name""",
    "wide_to_long": f"""WITH {_CELLS}, p AS (SELECT "table", row_no, {_PERIOD.format(_P)} AS period FROM cells WHERE name = 'period')
        SELECT c."table", c.row_no, period, name, CASE WHEN NOT {_MISSING.format("text")} THEN {_NUM.format("text")} END AS value, text AS value_text
        FROM cells c JOIN p ON c."table" = p."table" AND c.row_no = p.row_no WHERE name <> 'period' AND text IS NOT NULL""",
    "long_to_wide": f"""WITH {_CELLS}, r AS (SELECT "table", row_no, max(text) FILTER (WHERE name = 'row_label') AS row_label, lower(max(text) FILTER (WHERE name = 'h1')) AS head,
            coalesce(max(text) FILTER (WHERE name = 'value'), max(text) FILTER (WHERE name = 'value_text')) AS text FROM cells GROUP BY "table", row_no HAVING count(*) FILTER (WHERE name = 'h1') > 0),
        v AS (SELECT "table", row_label, head, max({_NUM.format("text")}) AS value FROM r WHERE {_NUM.format("text")} IS NOT NULL GROUP BY ALL)
        SELECT "table", row_label, string_agg(concat_ws('=', head, CAST(CAST(round(value, 3) AS DECIMAL(20, 3)) AS VARCHAR)), '; ' ORDER BY head) AS cells, count(*) AS n FROM v GROUP BY "table", row_label""",
    "repeat_qualify": """WITH o AS (SELECT doc_id, position, max(section) AS label FROM chunks WHERE section <> '' GROUP BY doc_id, position),
        n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, label) AS n FROM o),
        a AS (SELECT *, last_value(CASE WHEN n = 1 THEN label END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor FROM n)
        SELECT doc_id, position, CASE WHEN n > 1 AND anchor IS NOT NULL AND NOT starts_with(label, anchor || ' | ') THEN anchor || ' | ' || label ELSE label END AS label FROM a""",
    "table_text": f"""WITH {_CELLS}, r AS (SELECT "table", row_no, string_agg(coalesce(text, ''), ' | ' ORDER BY name, coalesce(text, '')) AS line FROM cells GROUP BY "table", row_no),
        c AS (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY row_no) AS nth, count(*) OVER (PARTITION BY "table") AS n FROM r),
        k AS (SELECT "table", nth, CASE WHEN n > 8 AND nth = 5 THEN line || chr(10) || '... (' || (n - 8) || ' rows omitted)' ELSE line END AS line FROM c WHERE n <= 8 OR nth <= 5 OR nth > n - 3)
        SELECT "table", string_agg(line, chr(10) ORDER BY nth) AS text FROM k GROUP BY "table" """,
    "stacked_views": f"WITH {_ENTRIES}, {_DATES}, {_STACKED} SELECT view, doc_type, series, layout, names, n_docs, n_tables, first_date, last_date, CAST(n_rows AS BIGINT) AS n_rows FROM views",
    "stacked_rows": f"""WITH {_CELLS}, {_ENTRIES}, {_DATES}, {_STACKED}, m AS (SELECT view, unnest(members) AS tab FROM views)
        SELECT view, t.doc_id, sort_date AS doc_date, c."table", row_no, name, text FROM m JOIN cells c ON c."table" = tab JOIN t ON t."table" = tab JOIN dates ON dates.doc_id = t.doc_id""",
    "table_cards": f"""WITH {_ENTRIES}, {_DATES} SELECT "table", concat_ws(chr(10), 'Data table `' || "table" || '`: ' || coalesce(nullif(title, ''), '(untitled)'),
        'From: ' || coalesce(doc_title, '') || ' (' || coalesce(sort_date, '') || '), ' || coalesce(source, ''), 'Shape: ' || coalesce(n_rows, 0) || ' rows, layout ' || coalesce(layout, ''),
        'Columns: ' || array_to_string(list_transform(list_filter(coalesce(columns, []), lambda c: c.name IS NOT NULL), lambda c: c.name || ' [' || coalesce(c.type, 'text') || ']'), '; '),
        CASE WHEN len(notes) > 0 THEN 'Notes: ' || array_to_string(notes, ' ') END, CASE WHEN len(row_labels) > 0 THEN 'Row labels: ' || array_to_string(row_labels[1:60], '; ') END) AS card
        FROM t LEFT JOIN dates ON t.doc_id = dates.doc_id""",
    "sql_lineage": f"WITH {_LINEAGE} SELECT * FROM lineage",
    "query_sources": f"""WITH {_LINEAGE}, {_ENTRIES}, {_DATES}, s AS (SELECT DISTINCT view, t.doc_id, sort_date FROM lineage JOIN t ON lower(t."table") = reads LEFT JOIN dates ON t.doc_id = dates.doc_id)
        SELECT view, doc_id, sort_date, row_number() OVER (PARTITION BY view ORDER BY sort_date DESC NULLS LAST, doc_id) AS nth FROM s""",
    "list_tables": f"""WITH {_ENTRIES} SELECT "table", doc_id, title, layout, n_rows, len(columns) AS n_columns FROM t
        WHERE contains(lower(concat_ws(' ', title, "table")), 'rates') OR contains(lower(concat_ws(' ', title, "table")), 'spending')""",
    "describe_tables": f"""WITH {_CELLS}, {_ENTRIES}, f AS (SELECT "table", min(row_no) AS row_no FROM cells GROUP BY "table"),
        s AS (SELECT c."table", name, text AS sample FROM cells c JOIN f ON c."table" = f."table" AND c.row_no = f.row_no),
        u AS (SELECT "table", doc_id, unnest(columns) AS c FROM t), k AS (SELECT "table", doc_id, lower(trim(c.name)) AS name, max(c.type) AS type FROM u WHERE c.name IS NOT NULL GROUP BY ALL)
        SELECT k."table", k.doc_id, k.name, k.type, sample FROM k LEFT JOIN s ON k."table" = s."table" AND k.name = s.name""",
    "keyword_tables": f"""WITH {_ENTRIES}, h AS (SELECT "table", title, {" + ".join(f"CAST(contains(lower(concat_ws(' ', \"table\", title)), '{w}') AS INT)" for w in "inflation rate credit loans growth".split())} AS hits FROM t)
        SELECT * FROM h WHERE hits > 0 ORDER BY hits DESC, "table" LIMIT 12""",
    "table_slugs": r"""WITH b AS (SELECT DISTINCT doc_id, trim(left(trim(regexp_replace(lower(regexp_replace(doc_id, '^nrs_', '')), '[^a-z0-9]+', '_', 'g'), '_'), 30), '_') AS base FROM docs),
        n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS nth FROM b)
        SELECT doc_id, CASE WHEN nth = 1 THEN base ELSE left(base, 24) || '_' || left(sha1(doc_id), 5) END AS slug FROM n""",
}
