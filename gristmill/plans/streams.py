"""Queries that run streams over the events there are, with the SQL of the same windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.streaming import events as ev

_DAY = "yyyy-MM-dd HH:mm:ss"


def _named(df: DataFrame, *rest: str) -> DataFrame:
    return df.select(F.date_format("w.start", _DAY).alias("starts"), F.date_format("w.end", _DAY).alias("ends"), *rest)


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(ev.run_once(ev.tumbling(ev.event_stream(spark, sf_dir), "1 day", "event_type")), "event_type", "n", "total")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(ev.run_once(ev.tumbling(ev.event_stream(spark, sf_dir), "1 day", slide="12 hours")), "n", "total")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(ev.run_once(ev.sessions(ev.event_stream(spark, sf_dir), "30 minutes", "user_id")), "user_id", "n")


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event id once."""
    return ev.run_once(ev.first_of_key(ev.event_stream(spark, sf_dir).select("event_id", "ts", "event_type"), "event_id", late="60 days"), "append").select("event_id", "event_type")


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_sessions, stream_dedupe)}
_T = "strftime({}, '%Y-%m-%d %H:%M:%S')"
ORACLE_SQL = {
    "stream_tumbling": f"""SELECT {_T.format("time_bucket(INTERVAL '1 day', ts)")} AS starts, {_T.format("time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day'")} AS ends, event_type, count(*) AS n, round(sum(value), 6) AS total
        FROM events GROUP BY time_bucket(INTERVAL '1 day', ts), event_type""",
    "stream_sliding": f"""WITH w AS (SELECT value, unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS s FROM events)
        SELECT {_T.format("s")} AS starts, {_T.format("s + INTERVAL '1 day'")} AS ends, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY s""",
    "stream_sessions": f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS opens FROM events),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
        SELECT {_T.format("min(ts)")} AS starts, {_T.format("max(ts) + INTERVAL '30 minutes'")} AS ends, user_id, count(*) AS n FROM s GROUP BY user_id, no""",
    "stream_dedupe": "SELECT DISTINCT event_id, event_type FROM events",
}
