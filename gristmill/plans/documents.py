"""Queries over documents' pages and passages: furniture, noise, sections, parts, chunks, labels and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import text as t
from gristmill.operators import passages
from gristmill.session import table


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("doc_id", "page", "section", "text")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = _pages(spark, sf_dir).where("text is not null").groupBy("doc_id", "page").agg(F.min("text").alias("text"))
    return once.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("ord", "line"))


def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.furniture(_pages(spark, sf_dir))


def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold numbers, months and units only, by page."""
    rows = _lines(spark, sf_dir).where(F.trim("line") != "").where(t.is_numeric_noise(F.col("line")))
    return rows.groupBy("doc_id", "page").agg(F.count("*").alias("n_noise"))


def adjacent_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept of each document once neighbours that repeat count once."""
    filled = _lines(spark, sf_dir).withColumn("line", F.trim("line")).where("line <> ''")
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("page", "ord"))
    return filled.withColumn("before", before).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("before").isNull() | (F.col("before") != F.col("line"))).alias("n_kept"))


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's section, the last one named before it where its own is missing."""
    once = _pages(spark, sf_dir).groupBy("doc_id", "page").agg(F.max(F.nullif(F.trim("section"), F.lit(""))).alias("own"))
    return once.select("doc_id", "page", F.last("own", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("page")).alias("section"))


def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's parts of about 600 words."""
    found = passages.parts(passages.paragraphs(_pages(spark, sf_dir)))
    return found.groupBy("doc_id", "part").agg(F.sum("n_words").alias("n_words"), F.min("page").alias("first_page"))


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.chunks(passages.paragraphs(_pages(spark, sf_dir)))


def passage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each passage is headed and cited."""
    names = ("title", "date", "section", "table", "unit", "page_start", "page_end")
    once = table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(*[F.max(c).alias(c) for c in names], F.max(F.coalesce("kind", F.lit("text"))).alias("kind"))
    label = t.citation_label(F.col("kind"), F.col("title"), F.col("table"), F.col("unit"), F.col("page_start"), F.col("page_end"))
    return once.select("chunk_id", t.passage_header(F.col("title"), F.col("date"), F.col("section")).alias("header"), label.alias("label"))


def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a passage can be read: its document's address, at the page of a PDF."""
    docs = table(spark, sf_dir, "docs").groupBy("doc_id").agg(F.max("url").alias("url"), F.max(F.lower(F.trim("format"))).alias("format"))
    once = table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(F.max("doc_id").alias("doc_id"), F.max("unit").alias("unit"), F.max("page_start").alias("page"))
    return once.join(docs, "doc_id").select("chunk_id", t.evidence_url(F.col("url"), F.nullif("format", F.lit("")), F.col("unit"), F.col("page")).alias("link"))


def build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages and their words by type of document and kind of passage, with totals."""
    once = table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(F.max("doc_type").alias("doc_type"), F.max(F.coalesce("kind", F.lit("text"))).alias("kind"), F.max("n_words").alias("n_words"))
    return once.rollup("doc_type", "kind").agg(F.count("*").alias("n"), F.round(F.avg("n_words"), 4).alias("mean_words"), F.max("n_words").alias("most_words"))


def conference_chairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chair named in the title line of each press conference's first page, and the title that follows from it."""
    named = r"(?i)transcript of (?:chair )?((?:[\p{L}-]+ )?[\p{L}-]+)[’']s press conference"
    docs = table(spark, sf_dir, "docs").where("doc_type = 'press_conference'").groupBy("doc_id").agg(F.max("sort_date").alias("sort_date"))
    first = _pages(spark, sf_dir).where("page = 1").groupBy("doc_id").agg(F.min("text").alias("text"))
    chair = F.nullif(F.regexp_extract("text", named, 1), F.lit(""))
    found = docs.join(first, "doc_id", "left").select("doc_id", "sort_date", chair.alias("chair"))
    return found.select("doc_id", "chair", F.concat(F.lit("Press conference of "), "sort_date", F.when(F.col("chair").isNotNull(), F.concat(F.lit(" ("), "chair", F.lit(")"))).otherwise(F.lit(""))).alias("title"))


def filed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date of a document as it is filed, and as the bounds of a filter."""
    dates = table(spark, sf_dir, "docs").select(F.trim("date").alias("date")).where("date is not null").distinct()
    return dates.select("date", t.filed_date(F.col("date")).alias("filed"), t.date_bound(F.col("date"), False).alias("first"), t.date_bound(F.col("date"), True).alias("last"))


def series_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "docs").select("title").where("title is not null").distinct()
    return titles.select("title", t.series_title(F.col("title")).alias("series"), t.heading_key(F.col("title")).alias("key"), t.slug(F.col("title")).alias("slug"))


def formats_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = F.coalesce(F.nullif(F.lower(F.trim("format")), F.lit("")), F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1)))
    return table(spark, sf_dir, "docs").groupBy(fmt.alias("format"), "doc_type").agg(F.count_distinct("doc_id").alias("n_docs"))


def manifest_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages that the pages do not know yet, once each: what a manifest would gain."""
    known = table(spark, sf_dir, "pages").select("doc_id").distinct()
    return table(spark, sf_dir, "docs").groupBy("doc_id").agg(F.max("retrieved_at").alias("at"), F.count("*").alias("n_fetched")).join(known, "doc_id", "left_anti").select("doc_id", "n_fetched")


QUERIES = {
    f.__name__: f
    for f in (
        furniture_lines, noise_lines, adjacent_dedupe, page_sections, page_parts, chunk_pages, passage_labels, evidence_links, build_stats, conference_chairs, filed_dates,
        series_titles, formats_counted, manifest_new,
    )
}

_LINES = """p AS (SELECT doc_id, page, min(text) AS text FROM pages WHERE text IS NOT NULL GROUP BY doc_id, page),
    s AS (SELECT doc_id, page, string_split(text, chr(10)) AS ls FROM p), l AS (SELECT doc_id, page, unnest(range(len(ls))) AS ord, unnest(ls) AS line FROM s)"""
_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '\d+', '#', 'g'), '\b[ivxlc]+\b', '#', 'g'), '[\s|]+', ' ', 'g'))"
_BOUND = "CASE WHEN regexp_full_match(date, '\\d{{4}}') THEN date || '{0}' WHEN regexp_full_match(date, '\\d{{4}}-\\d{{2}}') THEN date || '{1}' ELSE date END"
_MONTHS = "|".join(t.MONTH_NAMES)
ORACLE_SQL = {
    "furniture_lines": f"""WITH {_LINES}, f AS (SELECT doc_id, page, list(line ORDER BY ord) AS ls FROM l WHERE trim(line) <> '' GROUP BY doc_id, page),
        k AS (SELECT DISTINCT doc_id, page, unnest([{_KEY.format("ls[1]")}, {_KEY.format("ls[-1]")}]) AS key FROM f), n AS (SELECT doc_id, count(*) AS size FROM p GROUP BY doc_id),
        c AS (SELECT doc_id, key, count(*) AS n_pages FROM k WHERE key <> '' GROUP BY doc_id, key) SELECT c.* FROM c JOIN n ON c.doc_id = n.doc_id WHERE n_pages >= 3 AND n_pages >= 0.15 * size""",
    "noise_lines": rf"""WITH {_LINES}, w AS (SELECT doc_id, page, list_filter(regexp_split_to_array(lower(line), '[\s|]+'), lambda x: x <> '') AS ws FROM l WHERE trim(line) <> ''),
        m AS (SELECT doc_id, page, len(ws) AS n, list_filter(ws, lambda x: NOT regexp_matches(x, '^([-+]?\$?\(?[-+]?\d[\d,]*(\.\d+)?\)?%?|(jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec)\.?|q[1-4]|h[12]|\d{{4}}:[qh][1-4]|[-–—+=|]|n\.?a\.?)$')) AS rest FROM w)
        SELECT doc_id, page, count(*) AS n_noise FROM m WHERE len(rest) = 0 OR n <= 4 AND len(list_filter(rest, lambda x: regexp_replace(x, '^[().,:]+|[().,:]+$', '', 'g') NOT IN ({", ".join(f"'{w}'" for w in t.CHART_WORDS)}))) = 0
        GROUP BY doc_id, page""",
    "adjacent_dedupe": f"""WITH {_LINES}, f AS (SELECT doc_id, page, ord, trim(line) AS line FROM l WHERE trim(line) <> ''),
        b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY page, ord) AS before FROM f) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE before IS NULL OR before <> line) AS n_kept FROM b GROUP BY doc_id""",
    "page_sections": """WITH o AS (SELECT doc_id, page, max(nullif(trim(section), '')) AS own FROM pages GROUP BY doc_id, page)
        SELECT doc_id, page, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM o""",
    "passage_labels": """WITH o AS (SELECT chunk_id, max(title) AS title, max(date) AS date, max(section) AS section, max("table") AS tab, max(unit) AS unit, max(page_start) AS a, max(page_end) AS e, max(coalesce(kind, 'text')) AS kind
            FROM chunks GROUP BY chunk_id), z AS (SELECT *, coalesce(nullif(e, 0), a) AS b, coalesce(unit, 'page') AS u FROM o)
        SELECT chunk_id, coalesce(title, '') || ' (' || coalesce(date, '') || ')' || CASE WHEN len(section) > 0 THEN chr(10) || 'Section: ' || section ELSE '' END AS header,
            concat_ws(', ', title, CASE WHEN kind = 'table' THEN 'data table `' || tab || '`' WHEN u = 'page' THEN CASE WHEN a = b THEN 'p. ' || a ELSE 'pp. ' || a || '-' || b END
                WHEN u = 'table' THEN 'table ' || a WHEN a = b THEN 'part ' || a ELSE 'parts ' || a || '-' || b END) AS label FROM z""",
    "evidence_links": """WITH d AS (SELECT doc_id, max(url) AS url, nullif(max(lower(trim(format))), '') AS format FROM docs GROUP BY doc_id),
        o AS (SELECT chunk_id, max(doc_id) AS doc_id, max(unit) AS unit, max(page_start) AS page FROM chunks GROUP BY chunk_id)
        SELECT chunk_id, CASE WHEN coalesce(format, 'pdf') = 'pdf' AND coalesce(unit, 'page') = 'page' THEN url || '#page=' || coalesce(page, 1) ELSE url END AS link FROM o JOIN d USING (doc_id)""",
    "build_stats": """WITH o AS (SELECT chunk_id, max(doc_type) AS doc_type, max(coalesce(kind, 'text')) AS kind, max(n_words) AS n_words FROM chunks GROUP BY chunk_id)
        SELECT doc_type, kind, count(*) AS n, round(avg(n_words), 4) AS mean_words, max(n_words) AS most_words FROM o GROUP BY ROLLUP (doc_type, kind)""",
    "conference_chairs": r"""WITH d AS (SELECT doc_id, max(sort_date) AS sort_date FROM docs WHERE doc_type = 'press_conference' GROUP BY doc_id),
        f AS (SELECT doc_id, min(text) AS text FROM pages WHERE page = 1 GROUP BY doc_id),
        c AS (SELECT d.doc_id, sort_date, nullif(regexp_extract(text, '(?i)transcript of (?:chair )?((?:[\p{L}-]+ )?[\p{L}-]+)[’'']s press conference', 1), '') AS chair FROM d LEFT JOIN f ON d.doc_id = f.doc_id)
        SELECT doc_id, chair, 'Press conference of ' || sort_date || CASE WHEN chair IS NOT NULL THEN ' (' || chair || ')' ELSE '' END AS title FROM c""",
    "filed_dates": f"""WITH d AS (SELECT DISTINCT trim(date) AS date FROM docs WHERE date IS NOT NULL)
        SELECT date, {_BOUND.format("-12-31", "-15")} AS filed, {_BOUND.format("-01-01", "-01")} AS first, {_BOUND.format("-12-31", "-31")} AS last FROM d""",
    "series_titles": rf"""SELECT DISTINCT title, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\b({_MONTHS})\b', ' ', 'g'), '\b(19|20)\d{{2}}(\s*[–-]\s*\d{{2,4}})?\b', ' ', 'g'), '[^a-z]+', ' ', 'g')) AS series,
        regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS key, trim(left(trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_'), 40), '_') AS slug FROM docs WHERE title IS NOT NULL""",
    "formats_counted": r"""SELECT coalesce(nullif(lower(trim(format)), ''), lower(regexp_extract(filename, '\.([A-Za-z0-9]+)$', 1))) AS format, doc_type, count(DISTINCT doc_id) AS n_docs FROM docs GROUP BY 1, 2""",
    "manifest_new": "SELECT doc_id, count(*) AS n_fetched FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM pages WHERE doc_id IS NOT NULL) GROUP BY doc_id",
}
