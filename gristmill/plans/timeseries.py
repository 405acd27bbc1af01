"""Queries of time series: the highest daily value of every kind of event, and monthly order totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import series
from gristmill.session import table


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd").alias("date")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), day).agg(F.max("value").alias("value"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM").alias("date")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), month).agg(F.count("*").cast("double").alias("value"))


def series_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.changes(monthly(spark, sf_dir))


def series_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.year_over_year(monthly(spark, sf_dir))


def series_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.change_points(monthly(spark, sf_dir))


def series_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.sampled(monthly(spark, sf_dir))


def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.summary(monthly(spark, sf_dir))


def series_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the daily value of its type on the latest day before its own."""
    points = daily(spark, sf_dir).withColumn("date", F.date_format(F.date_add(F.to_date("date"), 1), "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.date_format("ts", "yyyy-MM-dd").alias("date"), "event_id")
    return series.as_of(rows, points)


def series_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each priority's monthly series is best shown."""
    return series.described(monthly(spark, sf_dir)).select("series", "n", "n_changes", "shows", "change_pct")


QUERIES = {f.__name__: f for f in (series_changes, series_yoy, series_change_points, series_sampled, series_summary, series_described, series_as_of)}

_M = "m AS (SELECT o_orderpriority AS series, strftime(o_orderdate, '%Y-%m') AS date, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2)"
_LAG = "l AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY date) AS before FROM m)"
ORACLE_SQL = {
    "series_changes": f"WITH {_M}, {_LAG} SELECT series, date, round(value - before, 6) AS diff, round(value / nullif(before, 0) * 100 - 100, 6) AS pct FROM l WHERE before IS NOT NULL",
    "series_yoy": f"""WITH {_M} SELECT a.series, a.date, round(a.value / b.value * 100 - 100, 6) AS yoy FROM m a JOIN m b
        ON a.series = b.series AND CAST(CAST(substring(b.date, 1, 4) AS INT) + 1 AS VARCHAR) || substring(b.date, 5) = a.date WHERE b.value <> 0""",
    "series_change_points": f"WITH {_M}, {_LAG} SELECT series, date, before, value FROM l WHERE before <> value",
    "series_sampled": f"""WITH {_M}, r AS (SELECT *, count(*) OVER (PARTITION BY series) AS n, row_number() OVER (PARTITION BY series ORDER BY date) AS nth FROM m)
        SELECT series, date, value FROM r WHERE (nth - 1) % CAST(ceil(n / 24.0) AS BIGINT) = 0 OR nth = n""",
    "series_summary": f"""WITH {_M} SELECT series, count(value) AS n, arg_min(value, date) AS first, arg_max(value, date) AS last, min(value) AS low,
        arg_min(date, (value, date)) AS low_date, max(value) AS high, arg_min(date, (-value, date)) AS high_date, round(avg(value), 6) AS mean,
        round(arg_max(value, date) - arg_min(value, date), 6) AS change, round((arg_max(value, date) - arg_min(value, date)) / nullif(arg_min(value, date), 0) * 100, 6) AS change_pct
        FROM m GROUP BY series""",
    "series_described": f"""WITH {_M}, {_LAG}, c AS (SELECT series, count(*) FILTER (WHERE before <> value) AS n_changes FROM l GROUP BY series),
        g AS (SELECT series, count(value) AS n, round((arg_max(value, date) - arg_min(value, date)) / nullif(arg_min(value, date), 0) * 100, 6) AS change_pct FROM m GROUP BY series)
        SELECT g.series, n, n_changes, CASE WHEN n > 24 AND n_changes <= 40 THEN 'changes' ELSE 'sample' END AS shows, change_pct FROM g JOIN c ON g.series = c.series""",
    "series_as_of": """WITH d AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, max(value) AS value FROM events GROUP BY 1, 2)
        SELECT e.event_type AS series, strftime(e.ts, '%Y-%m-%d') AS date, e.event_id, d.value AS as_of
        FROM events e ASOF LEFT JOIN d ON e.event_type = d.series AND CAST(e.ts AS DATE) > d.day""",
}
