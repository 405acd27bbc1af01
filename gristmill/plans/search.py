"""Queries of ranked retrieval over passages, documents and vectors, and over the collection's lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions.text import sort_date, tokens
from gristmill.operators import retrieval
from gristmill.session import small_side, table


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk_id with its indexed text: title, date, section and body."""
    chunks = table(spark, sf_dir, "chunks")
    names = ("doc_id", "doc_type", "title", "date", "sort_date", "section", "position", "page_start", "text")
    once = chunks.groupBy("chunk_id").agg(*[F.max(c).alias(c) for c in names], F.max(F.coalesce("kind", F.lit("text"))).alias("kind"))
    return once.withColumn("indexed", F.concat_ws("\n", "title", "date", "section", "text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: items whose id is divisible by 50."""
    return table(spark, sf_dir, "eval_items").where("item_id % 50 = 0").groupBy("item_id").agg(F.max("question").alias("text")).withColumnRenamed("item_id", "query_id")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(passages(spark, sf_dir).select(F.col("chunk_id").alias("id"), F.col("indexed").alias("text")), questions(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("id")).agg(F.max("text").alias("text"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n"))


def bm25_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.postings(_documents(spark, sf_dir)).where("term <> ''")
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top(_scores(spark, sf_dir), 10)


def bm25_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics stay global; the filters apply to the scored passages."""
    kept = passages(spark, sf_dir).where(F.col("doc_type").isin("speech", "meeting_minutes") & F.col("sort_date").between("2020-01-01", "2024-12-31")).select(F.col("chunk_id").alias("id"))
    return retrieval.top(_scores(spark, sf_dir).join(kept, "id", "left_semi"), 10)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return retrieval.top(retrieval.dense(vectors, vectors.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 10), 10)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's words over documents, and the vector of its number over vectors of the same ids."""
    asked = questions(spark, sf_dir)
    vectors = _vectors(spark, sf_dir)
    asked_vectors = vectors.join(small_side(asked.select(F.col("query_id").alias("id"))), "id").select(F.col("id").alias("query_id"), "vector")
    return retrieval.hybrid_search(_documents(spark, sf_dir), vectors, asked, asked_vectors)


def diversified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = passages(spark, sf_dir).select(F.col("chunk_id").alias("id"), "doc_id")
    return retrieval.capped_per_document(_scores(spark, sf_dir), owner, 2, 8)


def find_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = passages(spark, sf_dir).select(F.col("chunk_id").alias("id"), "doc_id")
    return retrieval.find_documents(_scores(spark, sf_dir), owner)


def _passage_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Owners, BM25 scores and hashed-vector scores of all passages for the stated questions."""
    known = passages(spark, sf_dir)
    texts, asked = known.select(F.col("chunk_id").alias("id"), F.col("indexed").alias("text")), questions(spark, sf_dir)
    return known.select(F.col("chunk_id").alias("id"), "doc_id"), retrieval.bm25(texts, asked), retrieval.hashed_scores(texts, asked)


def passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text passages by fusion of both rankers' best, filtered by type and date before ranking; statistics stay global."""
    _, lexical, semantic = _passage_lists(spark, sf_dir)
    known = passages(spark, sf_dir)
    kept = retrieval.filtered(known, kinds=["text"], doc_types=["speech", "meeting_minutes", "policy_statement", "staff_note"], date_from="2019", date_to="2025-06").select(F.col("chunk_id").alias("id"))
    ranked = [retrieval.top(x.join(kept, "id", "left_semi"), retrieval.DEPTH) for x in (lexical, semantic)]
    return retrieval.top(retrieval.fuse(*ranked), 8)


def search_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best passages of every document that shares a term with a question."""
    owners, lexical, semantic = _passage_lists(spark, sf_dir)
    return retrieval.per_document(lexical, semantic, owners)


def related_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each question's 60 best passages, with their best passage."""
    owners, lexical, semantic = _passage_lists(spark, sf_dir)
    fused = retrieval.fuse(retrieval.top(lexical, retrieval.DEPTH), retrieval.top(semantic, retrieval.DEPTH))
    return retrieval.related_documents(retrieval.top(fused, 60), owners)


def bm25_stemmed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over stems without stop words."""
    texts = passages(spark, sf_dir).select(F.col("chunk_id").alias("id"), F.col("indexed").alias("text"))
    return retrieval.top(retrieval.bm25(texts, questions(spark, sf_dir), analysed=True), 10)


def focus_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.focus(_documents(spark, sf_dir), "liquidity coverage and bank lending risks", 600).withColumnRenamed("at", "para_no")


def table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table cards for each question, with their catalog entry and document."""
    cards = retrieval.filtered(passages(spark, sf_dir), kinds=["table"])
    best = retrieval.top(_scores(spark, sf_dir).join(cards.select(F.col("chunk_id").alias("id")), "id", "left_semi"), 15)
    about = cards.select(F.col("chunk_id").alias("id"), "doc_id", "title")
    return best.join(about, "id").select("query_id", "rank", "id", "doc_id", "title", "score")


def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three pages of every document, as a reader asks for them."""
    return table(spark, sf_dir, "pages").where(F.col("page").between(1, 3)).groupBy("doc_id", "page").agg(F.max(F.length("text")).alias("n_chars"))


def expand_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's best passage with up to two passages before and one after it in its document."""
    chunks = passages(spark, sf_dir).where("kind = 'text'").select("chunk_id", "doc_id", "position")
    best = retrieval.top(_scores(spark, sf_dir).join(chunks.select(F.col("chunk_id").alias("id")), "id", "left_semi"), 1).select("query_id", F.col("id").alias("chunk_id"))
    return best.join(retrieval.neighbours(chunks, chunks.join(best.select("chunk_id").distinct(), "chunk_id", "left_semi"), 2, 1), "chunk_id")


def stale_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose document is missing or has no text any more, and documents without one, counted by state."""
    docs = _documents(spark, sf_dir).select("id", F.col("text").isNotNull().alias("has_text"))
    both = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(True).alias("has_vector")).distinct(), "id", "full")
    state = F.when(F.col("has_vector").isNull(), F.lit("no vector")).when(~F.coalesce("has_text", F.lit(False)), F.lit("stale")).otherwise(F.lit("known"))
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def neighbours_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = passages(spark, sf_dir).where("kind = 'text'").select("chunk_id", "doc_id", "position")
    return retrieval.neighbours(chunks, chunks)


def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fetched row of every document, with its format and a date that sorts."""
    docs = table(spark, sf_dir, "docs")
    last = Window.partitionBy("doc_id").orderBy(F.col("retrieved_at").desc_nulls_last(), F.col("title").desc_nulls_last(), F.col("speaker").desc_nulls_last(), F.col("date").desc_nulls_last())
    fmt = F.coalesce(F.nullif(F.lower(F.trim("format")), F.lit("")), F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1)))
    once = docs.withColumn("nth", F.row_number().over(last)).where("nth = 1")
    return once.select("doc_id", "doc_type", "title", fmt.alias("format"), sort_date(F.col("date")).alias("sorts_at"))


def corpus_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "docs")
    return docs.groupBy("doc_type").agg(F.count_distinct("doc_id").alias("n_docs"), F.min("sort_date").alias("first_date"), F.max("sort_date").alias("last_date"))


def latest_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "docs").select("doc_type", "doc_id", "sort_date").where("sort_date is not null")
    return docs.groupBy("doc_type").agg(F.max_by("doc_id", F.struct("sort_date", "doc_id")).alias("doc_id"), F.max("sort_date").alias("sort_date"))


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's sections in order of their first passage."""
    found = passages(spark, sf_dir).where("section <> ''")
    return found.groupBy("doc_id", "section").agg(F.min("position").alias("first_position"), F.min_by("page_start", F.struct("position", "chunk_id")).alias("page"))


def embedding_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without a vector, once per text: the vectors known by the hash of their document's text are kept."""
    docs = _documents(spark, sf_dir).withColumn("hash", F.sha1("text"))
    known = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_semi").select("hash")
    return docs.where(F.col("text").isNotNull()).join(known, "hash", "left_anti").groupBy("hash").agg(F.min("id").alias("doc_id"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_counts, bm25_df, bm25_topk, bm25_filtered_topk, dense_topk, hybrid_search, diversified_search, find_documents, passage_search, search_per_document, related_docs,
        bm25_stemmed_topk, focus_passages, table_search, page_lookup, expand_context, stale_vectors,
        neighbours_window, list_documents, corpus_card, latest_card, outline, embedding_todo,
    )
}

_TOKENS = r"regexp_extract_all(lower({}), '[a-z0-9]+(?:\.[0-9]+)?')"
_PASSAGES = """passages AS (SELECT chunk_id, max(doc_id) AS doc_id, max(doc_type) AS doc_type, max(title) AS title, max(date) AS date,
    max(sort_date) AS sort_date, max(section) AS section, max(position) AS position, max(page_start) AS page_start,
    max(text) AS text, max(coalesce(kind, 'text')) AS kind FROM chunks GROUP BY chunk_id)"""
_DOCUMENTS = "corpus AS (SELECT doc_id AS id, max(text) AS text FROM documents GROUP BY doc_id)"
_CHUNKS = _PASSAGES + ", corpus AS (SELECT chunk_id AS id, concat_ws(chr(10), title, date, section, text) AS text FROM passages)"
_BM25 = f"""asked AS (SELECT item_id AS query_id, max(question) AS text FROM eval_items WHERE item_id % 50 = 0 GROUP BY item_id),
    terms AS (SELECT DISTINCT query_id, unnest({_TOKENS.format("text")}) AS term FROM asked),
    words AS (SELECT id, {_TOKENS.format("text")} AS ws FROM corpus),
    size AS (SELECT count(*) AS n, avg(coalesce(len(ws), 0)) AS avgdl FROM words),
    post AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM words) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    scored AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
               FROM post JOIN dfs USING (term) JOIN terms USING (term) CROSS JOIN size GROUP BY query_id, id)"""


def _top(source: str, k: int) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM {source} QUALIFY rank < {k}"


_DOT = "round(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"
_HASHED = f"""vec AS (SELECT id, bucket, count(*)::DOUBLE AS w FROM (SELECT id, ('0x' || substr(md5(term), 1, 2))::INT % 64 AS bucket FROM (SELECT id, unnest({_TOKENS.format("text")}) AS term FROM corpus)) GROUP BY ALL),
    qvec AS (SELECT query_id, bucket, count(*)::DOUBLE AS q FROM (SELECT query_id, ('0x' || substr(md5(term), 1, 2))::INT % 64 AS bucket FROM (SELECT query_id, unnest({_TOKENS.format("text")}) AS term FROM asked)) GROUP BY ALL),
    hashed AS (SELECT qvec.query_id, vec.id, round(sum(w * q) / (max(norm) * max(q_norm)), 6) AS score FROM vec JOIN qvec USING (bucket)
        JOIN (SELECT id, sqrt(sum(w * w)) AS norm FROM vec GROUP BY id) USING (id) JOIN (SELECT query_id, sqrt(sum(q * q)) AS q_norm FROM qvec GROUP BY query_id) USING (query_id) GROUP BY ALL)"""
_FUSED = """f AS (SELECT query_id, id, round(coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + m.rank), 0), 9) AS score, l.rank AS bm25_rank, m.rank AS dense_rank
              FROM lexical l FULL JOIN semantic m USING (query_id, id))"""
_NTH = "row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, id)"

ORACLE_SQL = {
    "tokenize_counts": f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY term",
    "bm25_df": f"""WITH {_DOCUMENTS}, w AS (SELECT id, unnest({_TOKENS.format("text")}) AS term FROM corpus)
        SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM w GROUP BY term""",
    "bm25_topk": f"WITH {_CHUNKS}, {_BM25} {_top('scored', 10)}",
    "bm25_filtered_topk": f"""WITH {_CHUNKS}, {_BM25}, kept AS (SELECT * FROM scored WHERE id IN (SELECT chunk_id FROM passages
        WHERE doc_type IN ('speech', 'meeting_minutes') AND sort_date BETWEEN '2020-01-01' AND '2024-12-31')) {_top("kept", 10)}""",
    "dense_topk": f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {_DOT} AS score
        FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0) {_top("s", 10)}""",
    "hybrid_search": f"""WITH {_DOCUMENTS}, {_BM25}, lexical AS ({_top("(SELECT * FROM scored WHERE score > 0)", 100)}),
        s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {_DOT} AS score FROM embeddings v, embeddings q JOIN asked ON q.vec_id = asked.query_id),
        semantic AS ({_top("s", 100)}),
        f AS (SELECT query_id, id, round(coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + m.rank), 0), 9) AS score, l.rank AS bm25_rank, m.rank AS dense_rank
              FROM lexical l FULL JOIN semantic m USING (query_id, id))
        {_top("f", 8)}""",
    "diversified_search": f"""WITH {_CHUNKS}, {_BM25}, o AS (SELECT s.*, doc_id FROM scored s JOIN passages ON id = chunk_id),
        c AS (SELECT * FROM o QUALIFY {_NTH} <= 2) {_top("c", 8)}""",
    "find_documents": f"""WITH {_CHUNKS}, {_BM25}, h AS ({_top("scored", 40)}), o AS (SELECT query_id, id, score, doc_id FROM h JOIN passages ON id = chunk_id),
        b AS (SELECT * FROM o QUALIFY {_NTH} <= 3),
        d AS (SELECT query_id, doc_id AS id, round(sum(score), 6) AS score FROM b GROUP BY query_id, doc_id) {_top("d", 8)}""",
    "passage_search": f"""WITH {_CHUNKS}, {_BM25}, {_HASHED}, kept AS (SELECT chunk_id AS id FROM passages WHERE kind = 'text'
            AND doc_type IN ('speech', 'meeting_minutes', 'policy_statement', 'staff_note') AND sort_date >= '2019-01-01' AND sort_date <= '2025-06-31'),
        a AS (SELECT * FROM scored SEMI JOIN kept USING (id)), b AS (SELECT * FROM hashed SEMI JOIN kept USING (id)),
        lexical AS ({_top("a", 100)}), semantic AS ({_top("b", 100)}), {_FUSED} {_top("f", 8)}""",
    "search_per_document": f"""WITH {_CHUNKS}, {_BM25}, {_HASHED},
        t AS (SELECT DISTINCT query_id, doc_id FROM scored JOIN passages ON id = chunk_id),
        r AS (SELECT t.query_id, t.doc_id, chunk_id AS id, coalesce(s.score, 0) AS a, coalesce(h.score, 0) AS b FROM t JOIN passages p ON t.doc_id = p.doc_id
              LEFT JOIN scored s ON s.query_id = t.query_id AND s.id = chunk_id LEFT JOIN hashed h ON h.query_id = t.query_id AND h.id = chunk_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY a DESC, id) - 1 AS ra, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY b DESC, id) - 1 AS rb FROM r),
        o AS (SELECT query_id, doc_id, id, round(1.0::DOUBLE / (60 + ra) + 1.0::DOUBLE / (60 + rb), 9) AS score FROM k)
        SELECT query_id, doc_id, id, score, {_NTH} AS nth FROM o QUALIFY nth <= 2""",
    "related_docs": f"""WITH {_CHUNKS}, {_BM25}, {_HASHED}, lexical AS ({_top("scored", 100)}), semantic AS ({_top("hashed", 100)}), {_FUSED},
        h AS ({_top("f", 60)}), d AS (SELECT query_id, doc_id, min((h.rank, id)) AS best, min(h.rank) AS first FROM h JOIN passages ON id = chunk_id GROUP BY query_id, doc_id)
        SELECT query_id, doc_id, best[2] AS id, row_number() OVER (PARTITION BY query_id ORDER BY first) - 1 AS rank FROM d QUALIFY rank < 12""",
    "table_search": f"""WITH {_CHUNKS}, {_BM25}, c AS (SELECT s.* FROM scored s JOIN passages ON id = chunk_id WHERE kind = 'table'), b AS ({_top("c", 15)})
        SELECT query_id, rank, id, doc_id, title, score FROM b JOIN passages ON id = chunk_id""",
    "page_lookup": "SELECT doc_id, page, max(len(text)) AS n_chars FROM pages WHERE page BETWEEN 1 AND 3 GROUP BY doc_id, page",
    "expand_context": f"""WITH {_CHUNKS}, {_BM25}, c AS (SELECT s.* FROM scored s JOIN passages ON id = chunk_id WHERE kind = 'text'), b AS ({_top("c", 1)})
        SELECT query_id, p.chunk_id, n.chunk_id AS near_id, n.position AS near_position FROM b JOIN passages p ON b.id = p.chunk_id
        JOIN passages n ON n.doc_id = p.doc_id AND n.kind = 'text' AND n.position BETWEEN p.position - 2 AND p.position + 1""",
    "stale_vectors": f"""WITH {_DOCUMENTS}, v AS (SELECT DISTINCT vec_id AS id FROM embeddings), b AS (SELECT c.text, v.id AS vec_id FROM corpus c FULL JOIN v ON c.id = v.id)
        SELECT CASE WHEN vec_id IS NULL THEN 'no vector' WHEN text IS NULL THEN 'stale' ELSE 'known' END AS state, count(*) AS n FROM b GROUP BY 1""",
    "focus_passages": rf"""WITH {_DOCUMENTS}, q AS (SELECT DISTINCT unnest({_TOKENS.format("'liquidity coverage and bank lending risks'")}) AS term),
        s AS (SELECT id, string_split_regex(text, '\n\s*\n') AS ps FROM corpus), e AS (SELECT id, CAST(unnest(range(len(ps))) AS INT) AS para_no, unnest(ps) AS raw FROM s),
        p AS (SELECT id, para_no, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS paragraph FROM e), g AS (SELECT *, {_TOKENS.format("paragraph")} AS ws FROM p WHERE len(paragraph) > 40),
        z AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, avg(len(ws)) OVER (PARTITION BY id) AS avgdl FROM g),
        t AS (SELECT id, para_no, n, avgdl, dl, term, count(*) AS tf FROM (SELECT id, para_no, n, avgdl, len(ws) AS dl, unnest(ws) AS term FROM z) SEMI JOIN q USING (term) GROUP BY ALL),
        w AS (SELECT *, count(*) OVER (PARTITION BY id, term) AS df FROM t),
        c AS (SELECT id, para_no, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM w GROUP BY id, para_no),
        r AS (SELECT g.id, g.para_no, paragraph, sum(len(paragraph)) OVER d AS used, row_number() OVER d AS place FROM g LEFT JOIN c ON g.id = c.id AND g.para_no = c.para_no
              WINDOW d AS (PARTITION BY g.id ORDER BY coalesce(score, 0) DESC, g.para_no)),
        k AS (SELECT * FROM r WHERE used <= 600 OR place = 1)
        SELECT id, para_no, paragraph, coalesce(lag(para_no) OVER (PARTITION BY id ORDER BY para_no), -1) <> para_no - 1 AS gap FROM k""",
    "neighbours_window": f"""WITH {_PASSAGES}, t AS (SELECT * FROM passages WHERE kind = 'text')
        SELECT a.chunk_id, b.chunk_id AS near_id, b.position AS near_position FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.position BETWEEN a.position - 1 AND a.position + 1""",
    "list_documents": r"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY retrieved_at DESC NULLS LAST, title DESC NULLS LAST,
            speaker DESC NULLS LAST, date DESC NULLS LAST) AS nth FROM docs)
        SELECT doc_id, doc_type, title, coalesce(nullif(lower(trim(format)), ''), lower(regexp_extract(filename, '\.([A-Za-z0-9]+)$', 1))) AS format,
            CASE WHEN regexp_full_match(trim(date), '\d{4}') THEN trim(date) || '-12-31' WHEN regexp_full_match(trim(date), '\d{4}-\d{2}') THEN trim(date) || '-31'
                 WHEN regexp_matches(trim(date), '^\d{4}-\d{2}-\d{2}') THEN substring(trim(date), 1, 10) END AS sorts_at
        FROM o WHERE nth = 1""",
    "corpus_card": "SELECT doc_type, count(DISTINCT doc_id) AS n_docs, min(sort_date) AS first_date, max(sort_date) AS last_date FROM docs GROUP BY doc_type",
    "latest_card": """SELECT doc_type, doc_id, sort_date FROM (SELECT DISTINCT doc_type, doc_id, sort_date FROM docs WHERE sort_date IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY doc_type ORDER BY sort_date DESC, doc_id DESC) = 1""",
    "outline": f"""WITH {_PASSAGES} SELECT doc_id, section, min(position) AS first_position, arg_min(page_start, (position, chunk_id)) AS page
        FROM passages WHERE section <> '' GROUP BY doc_id, section""",
    "embedding_todo": f"""WITH {_DOCUMENTS}, h AS (SELECT id, sha1(text) AS hash FROM corpus WHERE text IS NOT NULL)
        SELECT hash, min(id) AS doc_id FROM h WHERE hash NOT IN (SELECT hash FROM h WHERE id IN (SELECT vec_id FROM embeddings)) GROUP BY hash""",
}
