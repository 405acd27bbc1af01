"""Guarded read-only SQL over the given tables: one query, only the known tables, a row limit and a time limit."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from gristmill.session import table

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings",
    "docs", "pages", "chunks", "table_catalog", "table_records", "documents", "eval_items", "mix_targets",
)
DENIED_FUNCTIONS = frozenset(("reflect", "try_reflect", "java_method", "input_file_name", "read_files", "read_kafka", "session_user", "current_user", "user", "version"))
TABLE_FUNCTIONS = frozenset(("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"))
SHOWN = frozenset(("DescribeRelation", "DescribeColumn", "DescribeQueryCommand", "ShowTables", "ShowColumns"))
_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."


class RefusedStatement(ValueError):
    """The statement isn't a single read-only query."""


@dataclass
class QueryResult:
    """What a caller gets: rows up to the limit, whether more were left out, the tables read, or the first line of an error."""

    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    truncated: bool = False
    tables: list[str] = field(default_factory=list)
    error: str | None = None


def _each(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _nodes(node) -> Iterator:
    """Every plan node and expression of a parsed statement, those of common table expressions and subqueries included."""
    yield node
    for child in _each(node.children()):
        yield from _nodes(child)
    for inner in _each(node.innerChildren()):
        yield from _nodes(inner)
    try:
        expressions = list(_each(node.expressions()))
    except Exception:  # an expression
        expressions = []
    for e in expressions:
        yield from _nodes(e)


def _parsed(spark: SparkSession, sql: str):
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise RefusedStatement(f"no single query: {str(e).splitlines()[0]}") from e


def tables_in(spark: SparkSession, sql: str) -> list[str]:
    """The tables a query reads, in order of the alphabet; RefusedStatement for anything but one read-only query over known tables.

    Spark's own parser takes the statement apart. Commands and inserts are refused at
    any depth, and every relation must be one known table or a name that the query
    itself gives; files, several-part names and functions that reach outside are refused.
    """
    plan = _parsed(spark, sql)
    types = {t: spark._jvm.java.lang.Class.forName(_LOGICAL + t) for t in ("Command", "ParsedStatement")}
    own: set[str] = set()
    read: set[str] = set()
    for node in _nodes(plan):
        name = node.nodeName()
        if name == "UnresolvedWith":
            own |= {str(part._1()).lower() for part in _each(node.cteRelations())}
        elif name == "UnresolvedRelation":
            parts = [str(x) for x in _each(node.multipartIdentifier())]
            if len(parts) != 1:
                raise RefusedStatement(f"unknown table {'.'.join(parts)}")
            read.add(parts[0].lower())
        elif name == "UnresolvedTableOrView":
            read |= {str(x).lower() for x in _each(node.multipartIdentifier())}
        elif name in ("UnresolvedTableValuedFunction", "UnresolvedFunction"):
            called = ".".join(str(x) for x in _each(node.name() if name.endswith("ValuedFunction") else node.nameParts())).lower()
            if called in DENIED_FUNCTIONS or name.endswith("ValuedFunction") and called not in TABLE_FUNCTIONS:
                raise RefusedStatement(f"function {called} can't be used")
        elif name not in SHOWN and any(t.isInstance(node) for t in types.values()):
            raise RefusedStatement("only queries can be run")
    if unknown := sorted(read - own - set(TABLES)):
        raise RefusedStatement(f"unknown table {unknown[0]}")
    return sorted(read & set(TABLES))


def check_read_only(spark: SparkSession, sql: str) -> None:
    tables_in(spark, sql)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The result of one read-only query; views are made only of the tables that it reads."""
    for name in tables_in(spark, sql):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    return spark.sql(sql)


def query(spark: SparkSession, sf_dir: str, sql: str, max_rows: int = 60, timeout: float = 20.0) -> QueryResult:
    """Run one query for a caller: at most max_rows rows come back, a longer run than timeout is cancelled, errors are told in one line."""
    group, sc = f"sql-{uuid.uuid4().hex}", spark.sparkContext
    timer = threading.Timer(timeout, lambda: sc.cancelJobGroup(group))
    try:
        names = tables_in(spark, sql)
        sc.setJobGroup(group, "read-only query", True)
        timer.start()
        df = run_sql(spark, sf_dir, sql)
        rows = [tuple(r) for r in df.limit(max_rows + 1).collect()]
        return QueryResult(df.columns, rows[:max_rows], len(rows) > max_rows, names)
    except Exception as e:
        told = "stopped: it ran too long" if not timer.is_alive() and timer.finished.is_set() else str(e).splitlines()[0][:400]
        return QueryResult(error=told)
    finally:
        timer.cancel()
        sc._jsc.clearJobGroup()
