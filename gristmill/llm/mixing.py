"""Mixing sources to target weights by capped water-filling.

The tokens of every source are counted over all documents. Sources that would
need more than their maximum epochs are clamped there; what they can't give is
redistributed over the others in proportion to their targets, until nothing is
over its cap. Every document of a source is then used its whole number of
epochs, and the fraction left is taken in the order of a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import cut_lineage

MAX_SOURCES = 100_000
BUCKETS = 4096


def water_fill(tokens: dict[str, int], target: dict[str, float], cap: dict[str, int], total: float) -> dict[str, float]:
    """Epochs of each source so that its tokens times epochs come as near to target * total as the caps allow.

    Sources without tokens, with no share or with a cap of 0 get none; their share goes to the others.
    """
    live = {s for s in target if tokens.get(s, 0) > 0 and target[s] > 0 and cap.get(s, 0) > 0}
    epochs, left = dict.fromkeys(target, 0.0), float(total)
    while live:
        weight = sum(target[s] for s in live)
        wanted = {s: left * target[s] / weight / tokens[s] for s in live}
        full = {s for s in live if wanted[s] >= cap[s]}
        if not full:
            return epochs | wanted
        for s in full:
            epochs[s] = float(cap[s])
            left -= cap[s] * tokens[s]
        live -= full
    return epochs


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def count_tokens(documents: DataFrame, tokenizer_path: str | None) -> DataFrame:
    """documents with n_tokens of a public tokenizer's file; without a file, runs of letters or digits and single marks."""
    if tokenizer_path is None:
        return documents.withColumn("n_tokens", F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), 0)).cast("long"))

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = _tokenizer(tokenizer_path)
        for s in texts:
            yield pd.Series([len(e.ids) for e in tok.encode_batch_fast(s.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return documents.withColumn("n_tokens", F.pandas_udf(count, "long")("text"))


def mix(documents: DataFrame, targets: DataFrame, tokenizer_path: str | None = None, total: int | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """selection (doc_id, source, n_tokens, uses) and report (source, target_share, max_repeats, tokens, epochs, actual_share).

    documents(doc_id, source, text), targets(source, target_share, max_repeats). The
    default total is all tokens of the targeted sources. Repeated ids count once (with
    the smallest source, then the fewest tokens), null or empty texts hold no tokens, documents of other sources are not used; uses is
    never above max_repeats. No documents give an empty selection.
    """
    listed = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null")
    rows = listed.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    spark = documents.sparkSession
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**40))
    # Tokens are counted where the texts lie; only numbers are shuffled to drop repeats. At most MAX_SOURCES names are broadcast.
    known = documents.select("doc_id", "source", "text").join(F.broadcast(listed.select("source", F.lit(True).alias("listed"))), "source", "left")
    counted = count_tokens(known.select("doc_id", "source", "listed", F.when(F.col("listed"), F.col("text")).alias("text")), tokenizer_path)
    size = F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")
    once = counted.select("doc_id", "source", "listed", size).groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens", "listed")).alias("d")).select("doc_id", "d.*")
    sized = cut_lineage(once.where("listed").select("doc_id", "source", "n_tokens", u.alias("u")))
    tokens = {r.source: r.n or 0 for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    target = {r.source: float(r.target_share or 0) for r in rows}
    cap = {r.source: int(r.max_repeats or 0) for r in rows}
    epochs = water_fill(tokens, target, cap, sum(tokens.values()) if total is None else total)
    plan = spark.createDataFrame(
        [(s, target[s], cap[s], int(tokens.get(s, 0)), e, int(e), (e - int(e)) * tokens.get(s, 0)) for s, e in epochs.items()],
        "source string, target_share double, max_repeats int, tokens long, epochs double, whole int, part double",
    )
    # The fraction: whole hash buckets below the wanted size, and the bucket at its edge document by document.
    bucket = (F.col("u") / F.lit(2**40 // BUCKETS)).cast("int")
    per_bucket = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("n"))
    below = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = per_bucket.select("source", "bucket", "n", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("start")).join(F.broadcast(plan.select("source", "whole", "part")), "source")
    placed = sized.withColumn("bucket", bucket).join(begins, ["source", "bucket"])
    inner = F.col("start") + F.col("n") <= F.col("part")
    edge = ~inner & (F.col("start") < F.col("part"))
    within = Window.partitionBy("source", "bucket").orderBy("u", "doc_id")
    sure = placed.where(~edge).select("doc_id", "source", "n_tokens", "whole", inner.cast("int").alias("extra"))
    upto = F.col("start") + F.sum("n_tokens").over(within) - F.col("n_tokens") / 2
    near = placed.where(edge).select("doc_id", "source", "n_tokens", "whole", (upto <= F.col("part")).cast("int").alias("extra"))
    extra = sure.unionByName(near)
    selection = cut_lineage(extra.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("extra")).alias("uses")).where("uses > 0"))
    used = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used"))
    all_used = F.sum(F.coalesce("used", F.lit(0))).over(Window.partitionBy())
    report = plan.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", "tokens", "epochs", F.coalesce(F.try_divide(F.coalesce("used", F.lit(0)).cast("double"), all_used.cast("double")), F.lit(0.0)).alias("actual_share")
    )
    return selection, report
