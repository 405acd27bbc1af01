"""Views of the project's tables that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.session import small_side, table


def doc_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, doc_type, format (lower case, the suffix of filename where missing), one row per document."""
    docs = table(spark, sf_dir, "docs")
    fmt = F.coalesce(F.nullif(F.lower(F.trim("format")), F.lit("")), F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1)))
    return docs.select("doc_id", "doc_type", fmt.alias("format")).groupBy("doc_id").agg(F.max("doc_type").alias("doc_type"), F.max("format").alias("format"))


def pages_of(spark: SparkSession, sf_dir: str, keep, *columns: str) -> DataFrame:
    """Pages of the documents for which keep holds; their short keys are broadcast only below a counted bound."""
    wanted = doc_facts(spark, sf_dir).where(keep).select("doc_id")
    return table(spark, sf_dir, "pages").select("doc_id", "page", *columns).join(small_side(wanted), "doc_id", "left_semi")
