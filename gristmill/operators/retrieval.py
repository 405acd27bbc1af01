"""Ranked retrieval: BM25 postings, dense vectors, reciprocal-rank fusion and its variants.

Queries are a set: every operator scores many at once. Postings are aggregated
before they are shuffled, pruned to the queries' terms, and cut to the best per
query by rank windows, which Spark limits on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.stem import stemmed_terms
from gristmill.functions.text import content_tokens, date_bound, tokens
from gristmill.session import BROADCAST_ROWS, cut_lineage, small_side

K1, B = 1.2, 0.75
RRF = 60
DEPTH, CANDIDATES = 100, 40
QUERIES_AT_ONCE, QUERY_BLOCK = 10_000, 256  # 10,000 vectors of 1,000 doubles are 80 MB


def postings(corpus: DataFrame, wanted: DataFrame | None = None, analysed: bool = False) -> DataFrame:
    """id, term, tf, dl of corpus (id, text), and one row with the term '' for every text, empty ones included.

    wanted (term) keeps the postings of these terms only, before anything is shuffled.
    analysed leaves stop words out and takes stems.
    """
    words = corpus.select("id", (content_tokens if analysed else tokens)(F.col("text")).alias("words"))
    each = words.select("id", F.size("words").alias("dl"), F.explode(F.concat("words", F.array(F.lit("")))).alias("term"))
    if analysed:
        each = stemmed_terms(each.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))).groupBy("id", "term", "dl").agg(F.sum("tf").alias("tf"))
        return each if wanted is None else each.join(wanted, "term", "left_semi")
    if wanted is not None:
        each = each.join(wanted, "term", "left_semi")
    return each.groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, analysed: bool = False) -> DataFrame:
    """query_id, term: the different terms of queries (query_id, text)."""
    terms = queries.select("query_id", F.explode((content_tokens if analysed else tokens)(F.col("text"))).alias("term"))
    return (stemmed_terms(terms) if analysed else terms).distinct()


def bm25(corpus: DataFrame, queries: DataFrame, analysed: bool = False) -> DataFrame:
    """query_id, id, score: BM25 of every text that shares a term with a query; each distinct term counts once.

    corpus(id, text), queries(query_id, text). Statistics are those of the whole
    corpus: filter the result, not the input. The postings of the queries' terms are
    written once; size, frequencies and scores are all read from them. Scores are
    rounded to 9 decimals.
    """
    terms = query_terms(queries, analysed)
    few = terms.count() <= BROADCAST_ROWS  # one count holds for the terms, their different ones and their frequencies
    narrow = F.broadcast if few else lambda df: df
    wanted = terms.select("term").union(terms.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    found = cut_lineage(postings(corpus, narrow(wanted), analysed))
    size = found.where("term = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    found = found.where("term <> ''")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    weights = found.join(narrow(df), "term").crossJoin(F.broadcast(size)).select("id", "term", (idf * F.col("tf") * (K1 + 1) / norm).alias("w"))
    return weights.join(narrow(terms), "term").groupBy("query_id", "id").agg(F.round(F.sum("w"), 9).alias("score"))


def hashed_scores(corpus: DataFrame, queries: DataFrame, dims: int = 64) -> DataFrame:
    """query_id, id, score: cosine of hashed term-frequency vectors of every text and every query, where no embedder is at hand.

    A term falls into the bucket of its MD5's first two digits, modulo dims. Texts
    without terms are left out. Queries are a stated, counted set; scores are rounded to 6 decimals.
    """
    bucket = F.pmod(F.conv(F.substring(F.md5("term"), 1, 2), 16, 10).cast("int"), F.lit(dims))

    def vectors(texts: DataFrame, key: str) -> DataFrame:
        each = texts.select(key, F.explode(tokens(F.col("text"))).alias("term")).select(key, bucket.alias("bucket"))
        return each.groupBy(key, "bucket").agg(F.count("*").cast("double").alias("w"))

    mine = vectors(corpus, "id")
    asked = vectors(queries, "query_id").withColumnRenamed("w", "q")
    length = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
    asked = small_side(asked.join(length, "query_id"))
    # One row per text holds its whole vector: its length is known where it meets the queries.
    whole = mine.groupBy("id").agg(F.collect_list(F.struct("bucket", "w")).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    both = whole.select("id", "norm", F.explode("v").alias("x")).select("id", "norm", "x.bucket", "x.w").join(asked, "bucket")
    return both.groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") * F.col("q")) / (F.max("norm") * F.max("q_norm")), 6).alias("score"))


def _searcher(names: np.ndarray, shared, depth: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        ids, scores = np.empty((len(names), 0), object), np.empty((len(names), 0))
        for batch in batches:
            if not len(batch):
                continue
            vectors, here = np.stack(batch["vector"].to_numpy()).astype(np.float64), batch["id"].to_numpy()
            kept_ids, kept_scores = [], []
            for j in range(0, len(names), QUERY_BLOCK):
                block = np.round(q[j : j + QUERY_BLOCK] @ vectors.T, 6)
                for i, row in enumerate(block, j):
                    all_scores, all_ids = np.concatenate([scores[i], row]), np.concatenate([ids[i], here])
                    if len(all_scores) > depth:  # ties with the last place stay until they are sorted by id
                        edge = -np.partition(-all_scores, depth - 1)[depth - 1]
                        near = np.flatnonzero(all_scores >= edge)
                        all_scores, all_ids = all_scores[near], all_ids[near]
                    best = np.lexsort((all_ids, -all_scores))[:depth]
                    kept_ids.append(all_ids[best])
                    kept_scores.append(all_scores[best])
            ids, scores = np.stack(kept_ids), np.stack(kept_scores)
        if ids.shape[1]:
            yield pd.DataFrame({"query_id": np.repeat(names, ids.shape[1]), "id": ids.ravel(), "score": scores.ravel()})

    return search


def dense(vectors: DataFrame, queries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """query_id, id, score: the `depth` best of vectors (id, vector) for each of queries (query_id, vector), exactly.

    Each partition multiplies its batches with blocks of query vectors and keeps one
    running list of its best for each query. Queries beyond QUERIES_AT_ONCE are
    searched in further passes over the vectors. Null vectors are left out; scores are
    rounded to 6 decimals.
    """
    spark = vectors.sparkSession
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema, *vectors.schema]}
    schema = f"query_id {kind['query_id']}, id {kind['id']}, score double"
    held = vectors.where(F.col("vector").isNotNull()).select("id", "vector")
    rows = asked.limit(QUERIES_AT_ONCE + 1).collect()
    passes = 1 if len(rows) <= QUERIES_AT_ONCE else -(-asked.count() // QUERIES_AT_ONCE)
    out = spark.createDataFrame([], schema)
    for k in range(passes):
        if passes > 1:
            rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k).collect()
        if rows:
            shared = spark.sparkContext.broadcast(np.array([r.vector for r in rows], np.float64))
            out = out.unionByName(held.mapInPandas(_searcher(np.array([r.query_id for r in rows]), shared, depth), schema))
    return top(out, depth).drop("rank")


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank from 0; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return scores.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def fuse(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """query_id, id, score, bm25_rank, dense_rank: reciprocal-rank fusion of two ranked lists (rank from 0)."""
    a = lexical.select("query_id", "id", F.col("rank").alias("bm25_rank"))
    b = semantic.select("query_id", "id", F.col("rank").alias("dense_rank"))
    part = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    return a.join(b, ["query_id", "id"], "full").withColumn("score", F.round(part("bm25_rank") + part("dense_rank"), 9))


def hybrid_search(corpus: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int = 8) -> DataFrame:
    """query_id, id, score, bm25_rank, dense_rank, rank: the k best by fusion of both rankers' DEPTH best."""
    fused = fuse(top(bm25(corpus, queries).where("score > 0"), DEPTH), top(dense(vectors, query_vectors), DEPTH))
    return top(top(fused, CANDIDATES).drop("rank"), k)


def capped_per_document(scores: DataFrame, documents: DataFrame, per_document: int, k: int) -> DataFrame:
    """The k best of each query with at most per_document passages of one document; documents (id, doc_id)."""
    known = scores.join(documents, "id")
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.col("score").desc(), F.col("id"))
    return top(known.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_document).drop("nth"), k)


def find_documents(scores: DataFrame, documents: DataFrame, hits: int = 40, best_of: int = 3, k: int = 8) -> DataFrame:
    """query_id, id (a document), score, rank: documents by the sum of their best_of best scores among each query's `hits` best passages."""
    known = top(scores, hits).drop("rank").join(documents, "id")
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.col("score").desc(), F.col("id"))
    best = known.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= best_of)
    return top(best.groupBy("query_id", F.col("doc_id").alias("id")).agg(F.round(F.sum("score"), 6).alias("score")), k)


def neighbours(chunks: DataFrame, hits: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """chunk_id of every hit with the passages around it: near_id, near_position, one row per neighbour, the hit itself included."""
    near = chunks.select("doc_id", F.col("chunk_id").alias("near_id"), F.col("position").alias("near_position"))
    at = hits.select("chunk_id", "doc_id", F.explode(F.sequence(F.col("position") - before, F.col("position") + after)).alias("near_position"))
    return at.join(near, ["doc_id", "near_position"]).select("chunk_id", "near_id", "near_position")


def filtered(passages: DataFrame, kinds=None, formats=None, doc_types=None, doc_ids=None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Passages for which every given filter holds: lists of values, and bounds of sort_date compared as text. An empty filter lets all through."""
    for column, values in (("kind", kinds), ("format", formats), ("doc_type", doc_types), ("doc_id", doc_ids)):
        if values:
            passages = passages.where(F.col(column).isin(list(values)))
    if date_from:
        passages = passages.where(F.col("sort_date") >= date_bound(F.lit(date_from), False))
    if date_to:
        passages = passages.where(F.col("sort_date") <= date_bound(F.lit(date_to), True))
    return passages


def per_document(lexical: DataFrame, semantic: DataFrame, documents: DataFrame, pool: int = 5, best: int = 2) -> DataFrame:
    """query_id, doc_id, id, score, nth: the best passages of each document by fusion of their two ranks within it.

    lexical and semantic (query_id, id, score) are unranked; documents (id, doc_id).
    A document counts where a passage of it has a lexical score; its other passages
    take part with a score of 0, so that every passage has both ranks.
    """
    touched = lexical.join(documents, "id").select("query_id", "doc_id").distinct()
    rows = touched.join(documents, "doc_id")
    scored = lambda df, name: df.select("query_id", "id", F.col("score").alias(name))
    rows = rows.join(scored(lexical, "a"), ["query_id", "id"], "left").join(scored(semantic, "b"), ["query_id", "id"], "left").fillna(0.0, ["a", "b"])
    place = lambda c: F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.col(c).desc(), "id")) - 1
    rows = rows.withColumns({"rank_a": place("a"), "rank_b": place("b")})
    rows = rows.withColumn("score", F.round(1 / (RRF + F.col("rank_a")) + 1 / (RRF + F.col("rank_b")), 9))
    nth = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.col("score").desc(), "id"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= min(pool, best)).select("query_id", "doc_id", "id", "score", "nth")


def related_documents(ranked: DataFrame, documents: DataFrame, hits: int = 60, k: int = 12) -> DataFrame:
    """query_id, doc_id, id, rank: the documents of each query's `hits` best passages (query_id, id, rank), best first, with their best passage."""
    known = ranked.where(F.col("rank") < hits).join(documents, "id")
    first = known.groupBy("query_id", "doc_id").agg(F.min(F.struct("rank", "id")).alias("best"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("best.rank")) - 1
    return first.withColumn("place", place).where(F.col("place") < k).select("query_id", "doc_id", F.col("best.id").alias("id"), F.col("place").alias("rank"))


def focus(texts: DataFrame, query: str, max_chars: int = 1500, least: int = 40) -> DataFrame:
    """id, at, paragraph, gap: the paragraphs of each text (id, text) that fit a query best, in order, within a number of characters.

    Paragraphs end at blank lines; BM25 is fitted to each text alone. They are taken
    from the best down to the first that would go over max_chars, at least one; gap
    tells that one was left out before.
    """
    parts = texts.select("id", F.posexplode(F.split("text", r"\n\s*\n")).alias("at", "paragraph")).withColumn("paragraph", F.trim(F.regexp_replace("paragraph", r"^\s+|\s+$", "")))
    parts = parts.where(F.length("paragraph") > least).withColumn("words", tokens(F.col("paragraph")))
    asked = F.array_distinct(tokens(F.lit(query)))
    one = Window.partitionBy("id")
    sized = parts.withColumns({"n": F.count("*").over(one), "avgdl": F.avg(F.size("words")).over(one)})
    hits = sized.select("id", "at", "n", "avgdl", F.size("words").alias("dl"), F.explode(F.filter("words", lambda w: F.array_contains(asked, w))).alias("term"))
    tf = hits.groupBy("id", "at", "n", "avgdl", "dl", "term").agg(F.count("*").alias("tf"))
    tf = tf.withColumn("df", F.count("*").over(Window.partitionBy("id", "term")))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = tf.groupBy("id", "at").agg(F.round(F.sum(weight), 9).alias("score"))
    ranked = parts.select("id", "at", "paragraph").join(scores, ["id", "at"], "left").fillna(0.0, ["score"])
    down = Window.partitionBy("id").orderBy(F.col("score").desc(), "at")
    ranked = ranked.withColumns({"used": F.sum(F.length("paragraph")).over(down), "place": F.row_number().over(down)})
    before = F.lag("at").over(Window.partitionBy("id").orderBy("at"))
    kept = ranked.where((F.col("used") <= max_chars) | (F.col("place") == 1))
    return kept.select("id", "at", "paragraph", (F.coalesce(before, F.lit(-1)) != F.col("at") - 1).alias("gap"))


def unknown_texts(corpus: DataFrame, known: DataFrame) -> DataFrame:
    """id, hash: texts of corpus (id, text) whose hash has no vector in known (hash, vector)."""
    return corpus.where(F.col("text").isNotNull()).withColumn("hash", F.sha1("text")).join(known.select("hash").distinct(), "hash", "left_anti").select("id", "hash")


def merged_vectors(corpus: DataFrame, known: DataFrame, fresh: DataFrame) -> DataFrame:
    """id, vector of every text: known and fresh (hash, vector) by the text's hash; ValueError where one is missing."""
    both = known.select("hash", "vector").unionByName(fresh.select("hash", "vector")).groupBy("hash").agg(F.first("vector").alias("vector"))
    out = corpus.where(F.col("text").isNotNull()).withColumn("hash", F.sha1("text")).join(both, "hash", "left").select("id", "vector")
    if missing := out.where("vector is null").count():
        raise ValueError(f"{missing} texts have no vector")
    return out
