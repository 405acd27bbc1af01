"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import inputs, leakage, main_content, mixing, near_duplicates, repeated_lines, sentences, speaker_turns
from gristmill.session import cut_lineage, small_side, table


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, key, text of the passages and pages that may hold the same text; press conferences are left out."""
    chunks = table(spark, sf_dir, "chunks").where((F.coalesce("kind", F.lit("text")) != "table") & (F.coalesce("doc_type", F.lit("")) != "press_conference"))
    prose = F.col("format").isin("html", "pdf", "docx") & (F.coalesce("doc_type", F.lit("")) != "press_conference")
    pages = inputs.pages_of(spark, sf_dir, prose, "text")
    page_key = F.concat("doc_id", F.lit("#p"), F.col("page").cast("string"))
    return chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), "text").unionByName(pages.select(F.lit("page").alias("kind"), page_key.alias("key"), "text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates.near_duplicate_pairs(_records(spark, sf_dir))
    return pairs.select(F.col("kind").alias("record_kind"), "key_a", "key_b")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_records(spark, sf_dir))


def _transcripts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = inputs.pages_of(spark, sf_dir, F.col("doc_type") == "press_conference", "text")
    return pages, table(spark, sf_dir, "docs").where("doc_type = 'press_conference'").select("doc_id", "speaker")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_turns.turn_bounds(*_transcripts(spark, sf_dir))


def p2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text of every turn."""
    return speaker_turns.speaker_turns(*_transcripts(spark, sf_dir)).select("doc_id", "turn_no", "speaker", F.array_join("words", " ").alias("text"), F.size("words").alias("n_words"))


def _web_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, main_content.BiLSTM | None]:
    """The pages of html documents, and the labeller trained on a sample of them with each document's type and title."""
    pages = inputs.pages_of(spark, sf_dir, F.col("format") == "html", "text")
    facts = table(spark, sf_dir, "docs").groupBy("doc_id").agg(F.max("doc_type").alias("doc_type"), F.max("title").alias("title"))
    return pages, main_content.fitted_once(pages.join(small_side(facts), "doc_id", "left"), "web pages", sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_content.boilerplate_lines(*_web_pages(spark, sf_dir))


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_content.main_content(*_web_pages(spark, sf_dir))


def _lines_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = inputs.doc_facts(spark, sf_dir).select("doc_id", F.col("doc_type").alias("source"))
    return cut_lineage(repeated_lines.identified_lines(table(spark, sf_dir, "pages"), small_side(sources)))


def _lines_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = F.nullif(F.lower(F.trim("series")), F.lit(""))
    sources = table(spark, sf_dir, "chunks").groupBy("doc_id").agg(F.max(series).alias("source"))
    return cut_lineage(repeated_lines.identified_lines(table(spark, sf_dir, "pages"), small_side(sources)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated_lines(_lines_by_type(spark, sf_dir))


def p5_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within one series; documents without one share a source."""
    return repeated_lines.repeated_lines(_lines_by_series(spark, sf_dir))


def p5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a repeated block of any number of lines."""
    return repeated_lines.longest_blocks(_lines_by_type(spark, sf_dir)).drop("source")


def p5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, sf_dir, "pages"), _lines_by_type(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.where("exact").select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item with the documents that hold it, near copies (edits above 0) included."""
    leaks = leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.groupBy("item_id", "field").agg(F.count_distinct("doc_id").alias("n_docs"), F.min("edits").alias("fewest_edits"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), TOKENIZER)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), TOKENIZER)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_turns, p4_found, p4_text, p5_found, p5_series, p5_blocks, p5_pages, p6_found, p6_items, p7_selection, p7_shares, p8_found)}
_KEYED = r"""p AS (SELECT DISTINCT doc_id, page, string_split(text, chr(10)) AS ls FROM pages),
        l AS (SELECT doc_id, page, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM p),
        k AS (SELECT l.doc_id, page, CAST(line_no AS INT) AS line_no, coalesce(source, '') AS source,
                     regexp_replace(lower(line), '[^\p{L}\p{N}]+', '', 'g') AS k
              FROM l LEFT JOIN t ON l.doc_id = t.doc_id),
        n AS (SELECT source, count(DISTINCT doc_id) AS n FROM k GROUP BY source)"""
_BY_TYPE = "t AS (SELECT doc_id, max(doc_type) AS source FROM docs GROUP BY doc_id)"
_BY_SERIES = "t AS (SELECT doc_id, max(nullif(lower(trim(series)), '')) AS source FROM chunks GROUP BY doc_id)"
_LINES = """, r AS (SELECT k.source, k FROM k JOIN n ON k.source = n.source WHERE k <> ''
              GROUP BY k.source, k, n.n HAVING count(DISTINCT doc_id) >= greatest(5, 0.2 * n.n))
        SELECT doc_id, page, line_no FROM k SEMI JOIN r ON k.source = r.source AND k.k = r.k"""
ORACLE_SQL: dict[str, str] = {
    "p5_found": f"WITH {_BY_TYPE}, {_KEYED}{_LINES}",
    "p5_series": f"WITH {_BY_SERIES}, {_KEYED}{_LINES}",
    # Every block of every length of every page, the longest repeated one at each line, none that an earlier one reaches over.
    "p5_blocks": f"""WITH {_BY_TYPE}, {_KEYED},
        g AS (SELECT source, doc_id, page, list(k ORDER BY line_no) AS ks, list(line_no ORDER BY line_no) AS nos FROM k WHERE k <> '' GROUP BY ALL),
        s AS (SELECT *, unnest(range(1, len(ks) + 1)) AS i FROM g), b AS (SELECT *, unnest(range(1, len(ks) - i + 2)) AS m FROM s),
        h AS (SELECT source, doc_id, page, i, m, nos, md5(array_to_string(ks[i : i + m - 1], chr(1))) AS h FROM b),
        r AS (SELECT h.source, m, h, count(DISTINCT doc_id) AS n_docs FROM h JOIN n ON h.source = n.source GROUP BY h.source, m, h, n.n
              HAVING count(DISTINCT doc_id) >= greatest(5, 0.2 * n.n)),
        o AS (SELECT h.*, n_docs FROM h JOIN r ON h.source = r.source AND h.m = r.m AND h.h = r.h QUALIFY row_number() OVER (PARTITION BY doc_id, page, i ORDER BY h.m DESC) = 1),
        z AS (SELECT *, lag(i + m) OVER (PARTITION BY doc_id, page ORDER BY i) AS reached FROM o)
        SELECT doc_id, page, nos[i] AS first_line, nos[i + m - 1] AS last_line, CAST(m AS INT) AS n_lines, n_docs FROM z WHERE reached IS NULL OR reached < i + m""",
}
