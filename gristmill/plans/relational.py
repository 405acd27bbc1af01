"""The SQL surface: one query per kind of relational operation, run through the read-only guard.

The same text runs in any engine with standard SQL; sums of money are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import plain_number
from gristmill.operators.schema_drift import latest_records
from gristmill.session import table
from gristmill.sources.sql_surface import run_sql

SHARED = {
    "agg_pricing": """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
        round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "agg_distinct": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_customers, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "agg_filter": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS n_high, count(*) AS n FROM events GROUP BY event_type",
    "agg_rollup": """SELECT n_regionkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)""",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "join_inner": """SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer
        JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_full": """SELECT coalesce(d.doc_id, p.doc_id) AS doc_id, d.doc_id IS NULL AS no_doc, p.doc_id IS NULL AS no_pages
        FROM (SELECT DISTINCT doc_id FROM docs) d FULL JOIN (SELECT DISTINCT doc_id FROM pages) p ON d.doc_id = p.doc_id""",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "join_range": """SELECT a.event_id, count(*) AS n_after FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1' HOUR
        GROUP BY a.event_id""",
    "win_top_per_group": """SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3""",
    "win_lag": """SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
        lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events""",
    "win_frame_rows": """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS n,
        max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS high FROM events""",
    "win_session": """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS opens FROM events),
        s AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM g)
        SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n FROM s GROUP BY user_id, session_no""",
    "runs_merged": """WITH o AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
            - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events)
        SELECT user_id, event_type, min(event_id) AS first_id, count(*) AS n FROM o GROUP BY user_id, event_type, island""",
    "win_rank_family": """SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS quarter,
        round(percent_rank() OVER w, 9) AS share FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY floor(o_totalprice / 1000))""",
    "win_frame_range": """SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS high FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '2' HOUR PRECEDING AND CURRENT ROW)""",
    "win_first_last": """SELECT event_id, first_value(event_type) OVER w AS opened, last_value(event_type) OVER w AS latest, nth_value(event_type, 2) OVER w AS second
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "join_right": "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "join_using": "SELECT doc_id, count(*) AS n FROM docs JOIN chunks USING (doc_id) GROUP BY doc_id",
    "join_cross": "SELECT r_name, o_orderpriority FROM region CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p",
    "join_lateral": """SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t""",
    "sort_nulls_offset": "SELECT doc_id, series FROM (SELECT DISTINCT doc_id, series FROM docs) d ORDER BY series DESC NULLS LAST, doc_id LIMIT 50 OFFSET 20",
    "set_union_all": "SELECT doc_type, count(*) AS n FROM (SELECT doc_type FROM docs UNION ALL SELECT doc_type FROM chunks) u GROUP BY doc_type",
    "quantiles": """SELECT l_returnflag, round(median(l_quantity), 6) AS middle, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p90
        FROM lineitem GROUP BY l_returnflag""",
    "cte_recursive": """WITH RECURSIVE days(day_no) AS (SELECT 0 UNION ALL SELECT day_no + 1 FROM days WHERE day_no < 29),
        e AS (SELECT CAST(extract(DAY FROM ts) AS INT) - 1 AS day_no, count(*) AS n FROM events GROUP BY CAST(extract(DAY FROM ts) AS INT) - 1)
        SELECT d.day_no, coalesce(n, 0) AS n FROM days d LEFT JOIN e ON d.day_no = e.day_no""",
    "fn_string": """SELECT p_partkey, upper(p_name) AS up, length(p_name) AS n, substring(p_name, 2, 4) AS part, replace(p_name, ' ', '-') AS dashed, lpad(p_brand, 12, '.') AS padded,
        position('a' IN p_name) AS at, trim(concat('  ', p_type)) AS kind, reverse(p_brand) AS back, split_part(p_type, ' ', 1) AS word FROM part""",
    "fn_math": """SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 9) AS root, round(ln(l_extendedprice), 9) AS log, CAST(floor(l_extendedprice) AS BIGINT) AS low,
        CAST(ceil(l_tax * 100) AS BIGINT) AS up, CAST(l_orderkey % 7 AS BIGINT) AS rest, round(power(l_discount, 2), 9) AS square, CAST(sign(l_quantity - 25) AS INT) AS side FROM lineitem""",
    "set_union": "SELECT doc_id FROM docs UNION SELECT doc_id FROM chunks",
    "set_intersect": "SELECT doc_id FROM pages INTERSECT SELECT doc_id FROM chunks",
    "set_except": "SELECT doc_id FROM docs EXCEPT SELECT doc_id FROM table_catalog",
    "sub_correlated": """SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT 1.6 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)""",
    "sort_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "usage_by_type": """SELECT user_id, event_type, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (user_id, event_type)""",
    "sections_shared": """SELECT doc_type, section, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM chunks GROUP BY doc_type, section HAVING count(DISTINCT doc_id) > 1""",
}


def _shared(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, sql)


def fn_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(day, "yyyy-MM").alias("month"), F.date_format(F.date_trunc("quarter", day), "yyyy-MM-dd").alias("quarter"),
        F.datediff(F.lit("1999-01-01").cast("date"), F.to_date(day)).cast("long").alias("days_left"), F.dayofweek(day).alias("weekday"),
        F.date_format(F.add_months(F.to_date(day), 1), "yyyy-MM-dd").alias("next_month"), F.date_format(F.last_day(F.to_date(day)), "yyyy-MM-dd").alias("month_end"),
    )


def fn_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of a document's tables and contents: length, membership, sorting, slices and set operations."""
    docs = table(spark, sf_dir, "docs").where(F.size("tables") > 0)
    once = docs.groupBy("doc_id").agg(F.max("tables").alias("tables"), F.max(F.size("toc")).alias("n_toc"))
    part = F.array_sort("tables")
    return once.select(
        "doc_id", F.size("tables").alias("n"), F.array_join(part, ",").alias("sorted"), F.array_join(F.slice(part, 1, 2), ",").alias("first_two"),
        F.array_max(F.transform("tables", F.length)).alias("longest"), F.size(F.array_distinct("tables")).alias("n_distinct"),
        F.size(F.filter("tables", lambda t: t.contains("_2"))).alias("n_dated"), "n_toc",
    )


def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties of events by key, counted."""
    props = F.from_json("props", "map<string,string>")
    each = table(spark, sf_dir, "events").select("event_type", F.explode(props).alias("name", "value"))
    return each.groupBy("event_type", "name").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey"))
    return orders.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(f"n_{c.lower()}") for c in "FOP"])


def unpivot_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return rows.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "amount")


def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user within the hour after each; both sides are binned by the hour, so a busy user's events spread over many keys."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    hour = F.floor(F.unix_seconds("ts") / 3600)
    a = events.select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("at"), F.explode(F.array(hour, hour + 1)).alias("hour"))
    b = events.select("user_id", "ts", hour.alias("hour"))
    near = a.join(b, ["user_id", "hour"]).where((F.col("ts") > F.col("at")) & (F.col("ts") <= F.col("at") + F.expr("INTERVAL '1' HOUR")))
    return near.groupBy(F.col("id").alias("event_id")).agg(F.count("*").alias("n_after"))


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table's columns: filled cells, different values, and how many cells are plain numbers."""
    cells = latest_records(table(spark, sf_dir, "table_records")).select("table", F.explode("fields").alias("name", "text"))
    return cells.groupBy("table", "name").agg(F.count("text").alias("n_filled"), F.count_distinct("text").alias("n_values"), F.count(plain_number(F.col("text"))).alias("n_numbers"))


QUERIES = {name: _shared(sql) for name, sql in SHARED.items()} | {f.__name__: f for f in (column_profile, fn_date, fn_array, fn_json, pivot_status, unpivot_amounts, join_range)}
ORACLE_SQL = SHARED | {
    "column_profile": r"""WITH l AS (SELECT "table", row_no, arg_max(record, (loaded_at, record)) AS record FROM table_records WHERE "table" IS NOT NULL GROUP BY "table", row_no),
        k AS (SELECT "table", record, unnest(json_keys(record)) AS k FROM l),
        c AS (SELECT "table", lower(trim(k)) AS name, trim(json_extract_string(record, '$."' || k || '"')) AS text FROM k)
        SELECT "table", name, count(text) AS n_filled, count(DISTINCT text) AS n_values,
            count(TRY_CAST(regexp_replace(text, '[,$€£%\s]', '', 'g') AS DOUBLE)) AS n_numbers FROM c GROUP BY "table", name""",
    "fn_date": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter,
        date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS days_left, CAST(dayofweek(o_orderdate) + 1 AS INT) AS weekday,
        strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end FROM orders""",
    "fn_array": """WITH o AS (SELECT doc_id, max(tables) AS tables, max(len(toc)) AS n_toc FROM docs WHERE len(tables) > 0 GROUP BY doc_id)
        SELECT doc_id, len(tables) AS n, array_to_string(list_sort(tables), ',') AS sorted, array_to_string(list_sort(tables)[1:2], ',') AS first_two,
            list_max(list_transform(tables, lambda x: len(x))) AS longest, len(list_distinct(tables)) AS n_distinct,
            len(list_filter(tables, lambda x: contains(x, '_2'))) AS n_dated, n_toc FROM o""",
    "fn_json": """WITH k AS (SELECT event_type, props, unnest(json_keys(props)) AS name FROM events)
        SELECT event_type, name, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || name)) AS n_values FROM k GROUP BY event_type, name""",
    "pivot_status": """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o,
        count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY o_orderpriority""",
    "unpivot_amounts": """SELECT l_orderkey, l_linenumber, measure, amount FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
        UNPIVOT (amount FOR measure IN (l_quantity, l_discount, l_tax))""",
}
