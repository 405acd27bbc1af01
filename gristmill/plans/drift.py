"""Queries over recurring tables whose schemas drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import schema_drift
from gristmill.session import table


def _inputs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("table_catalog", "docs", "table_records")]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A move counts as the field's removal in one place and its addition in the other."""
    changes = schema_drift.schema_changes(*_inputs(spark, sf_dir))
    none = F.lit("")
    parts = F.when(F.col("change_kind") == "moved", F.array(F.struct(F.lit("removed").alias("k"), F.col("old_name").alias("o"), none.alias("n")), F.struct(F.lit("added").alias("k"), none.alias("o"), F.col("new_name").alias("n"))))
    each = changes.select("table_from", "table_to", F.explode(F.coalesce(parts, F.array(F.struct(F.col("change_kind").alias("k"), F.col("old_name").alias("o"), F.col("new_name").alias("n"))))).alias("x"))
    return each.select("table_from", "table_to", F.col("x.k").alias("change_kind"), F.col("x.o").alias("old_name"), F.col("x.n").alias("new_name")).distinct()


def p3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One consistent typed table per series, as rows of record and field."""
    rows = schema_drift.unified_series(*_inputs(spark, sf_dir))
    return rows.select("series", "table", "sort_date", "row_no", F.explode("fields").alias("field", "x")).select("series", "table", "sort_date", "row_no", "field", "x.type", "x.number", "x.text")


QUERIES = {f.__name__: f for f in (p3_found, p3_table)}
ORACLE_SQL: dict[str, str] = {}
