"""Queries over evaluation records, traces and evidence, derived from the items, events and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import text as t
from gristmill.operators import runs
from gristmill.session import table

AGENTS = {"docs": "policy", "data": "rate", "web": "report", "market": "price"}


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of each item under two systems; scores and times follow from the item's number and texts."""
    items = table(spark, sf_dir, "eval_items").groupBy("item_id").agg(F.max("category").alias("category"), F.max("question").alias("question"), F.max("reference").alias("reference"))
    each = items.withColumn("run", F.explode(F.array(F.lit(0), F.lit(1))))
    n = F.col("item_id")
    return each.select(
        "item_id", "category", "question", F.concat(F.lit("s"), F.col("run").cast("string")).alias("system"), ((n * 7 + F.col("run") * 2) % 3).cast("int").alias("score"),
        F.when(n % 11 != 0, n % 4 != 0).alias("routing_ok"), (n % 5 != 0).alias("is_tool"), (n % 6 != 0).alias("cited"), (F.length("question") + F.col("run")).cast("double").alias("seconds"),
        (F.length("reference") % 5).cast("int").alias("n_docs"),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("agent"), "ts", "event_id", "value")


def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summarized(_records(spark, sf_dir).where("system = 's0'"), "category")


def eval_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.compared(_records(spark, sf_dir), ["s0", "s1"])


def eval_differing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose score isn't the same under both systems."""
    g = _records(spark, sf_dir).groupBy("item_id").agg(F.min("score").alias("worst"), F.max("score").alias("best"))
    return g.where("worst <> best")


def routing_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the agents a question's words call for hold those its reference calls for."""
    items = table(spark, sf_dir, "eval_items").groupBy("item_id").agg(F.lower(F.max("question")).alias("q"), F.lower(F.max("reference")).alias("r"))
    called = lambda c: F.filter(F.array(*[F.when(F.col(c).contains(w), F.lit(a)) for a, w in AGENTS.items()]), lambda x: x.isNotNull())
    any_of = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("docs"), F.lit("web")))
    forbidden = F.when(F.col("item_id") % 4 == 0, F.array(F.lit("market")))
    return items.select("item_id", runs.routing_ok(called("r"), any_of, forbidden, called("q")).alias("routing_ok"))


def agents_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.in_order_of_start(_events(spark, sf_dir))
    return found.select("run", F.array_join("agents", ",").alias("agents"), "n_events")


def gaps_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each table with a mark of a missing value, of those that hold any text."""
    text = F.get_json_object("record", "$.value_text")
    rows = table(spark, sf_dir, "table_records").where("table is not null").select("table", F.coalesce(text, F.lit("")).alias("text"))
    return rows.groupBy("table").agg(F.count("*").alias("n"), F.count_if((F.col("text") != "") & t.is_missing(F.col("text"))).alias("n_missing"))


def evidence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages and table cards as evidence, once per title and section."""
    chunks = table(spark, sf_dir, "chunks")
    key = F.concat_ws("|", F.lower(F.trim("title")), F.lower(F.trim("section")))
    items = chunks.select(F.when(F.coalesce("kind", F.lit("text")) == "table", F.lit("M")).otherwise(F.lit("D")).alias("prefix"), key.alias("key"), F.col("chunk_id").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    return runs.deduplicated_evidence(items).select("id", "key", F.length("text").alias("n_chars"), "n_seen")


def round_robin_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = _events(spark, sf_dir).select("run", "agent", F.col("event_id").alias("ord"), F.concat("agent", (F.col("event_id") % 50).cast("string")).alias("evidence"))
    return runs.round_robin(cited)


def context_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a document's pages would be cut to keep a conversation over them within 6,000 characters."""
    pages = table(spark, sf_dir, "pages").groupBy("doc_id", "page").agg(F.min("text").alias("text"))
    return runs.compacted(pages.select(F.col("doc_id").alias("run"), F.col("page").alias("ord"), "text"), 6000, 1)


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's events as tasks; each needs the task of half its number, and every seventh the one after it too."""
    nth = F.row_number().over(Window.partitionBy("run").orderBy("ts", "event_id"))
    tasks = _events(spark, sf_dir).select("run", nth.alias("task"), "agent")
    half, n = F.floor(F.col("task") / 2).cast("int"), F.col("task")
    return tasks.withColumn("depends_on", F.filter(F.array(half, F.when(n % 7 == 0, n - 1)), lambda d: d.isNotNull() & (d > 0)))


def plan_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.valid_tasks(_tasks(spark, sf_dir), ["click", "view", "purchase"])
    return found.select("run", "task", "agent", F.array_join(F.transform(F.array_sort("depends_on"), lambda d: d.cast("string")), ",").alias("depends_on"))


def task_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _tasks(spark, sf_dir)
    return runs.waves(tasks, tasks.select("run", "task", F.explode("depends_on").alias("needs")))


def evidence_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as evidence: twice as many characters as a passage's, then an ellipsis."""
    pages = table(spark, sf_dir, "pages").where("text is not null").groupBy("doc_id", "page").agg(F.min("text").alias("text"))
    shown = F.when(F.length("text") <= 2400, F.col("text")).otherwise(F.concat(F.substring("text", 1, 2400), F.lit(" ...")))
    return pages.select("doc_id", "page", F.concat(F.lit("["), F.col("doc_id"), F.lit(", "), t.locator(F.lit("page"), F.col("page"), F.col("page")), F.lit("]\n"), shown).alias("evidence"))


def history_last3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginnings of the last three pages of each document, in order, as an earlier conversation is told."""
    pages = table(spark, sf_dir, "pages").groupBy("doc_id", "page").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("page").desc()))
    last = pages.withColumn("nth", nth).where("nth <= 3").select("doc_id", "page", F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"\[[DWM]\d+\]", ""), 1, 700).alias("said"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("page", "said"))), lambda x: x["said"])
    return last.groupBy("doc_id").agg(F.array_join(told, "\n\n").alias("history"), F.count("*").alias("n_turns"))


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite evidence: each item's reference with citations by the item's number."""
    n = F.col("item_id").cast("int")
    items = table(spark, sf_dir, "eval_items").groupBy("item_id").agg(F.max("reference").alias("reference"))
    cite = F.concat(F.lit(" [D"), (n % 9).cast("string"), F.lit(", W"), (n % 4).cast("string"), F.lit("] as before [D"), (n % 5).cast("string"), F.lit("]."))
    return items.select("item_id", F.concat("reference", cite).alias("draft"))


def citations_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drafts(spark, sf_dir).select("item_id", F.posexplode(t.cited_ids(F.col("draft"))).alias("place", "evidence"))


def citations_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers with the citations of D1 to D4 and W1 alone."""
    known = F.array(*[F.lit(x) for x in ("D1", "D2", "D3", "D4", "W1")])
    return _drafts(spark, sf_dir).select("item_id", t.known_citations(F.col("draft"), known).alias("answer"))


QUERIES = {
    f.__name__: f
    for f in (
        eval_rollup, eval_compare, eval_differing, routing_predicate, agents_in_order, gaps_counted, evidence_dedupe, round_robin_select, context_compacted, plan_valid, task_waves,
        evidence_rendered, history_last3, citations_extract, citations_known,
    )
}

_ITEMS = "i AS (SELECT item_id, max(category) AS category, max(question) AS question, max(reference) AS reference FROM eval_items GROUP BY item_id)"
_RECORDS = f"""{_ITEMS}, r AS (SELECT item_id, category, 's' || run AS system, CAST((item_id * 7 + run * 2) % 3 AS INT) AS score, CASE WHEN item_id % 11 <> 0 THEN item_id % 4 <> 0 END AS routing_ok,
    item_id % 5 <> 0 AS is_tool, item_id % 6 <> 0 AS cited, CAST(len(question) + run AS DOUBLE) AS seconds, len(reference) % 5 AS n_docs FROM i, (VALUES (0), (1)) v(run))"""
_TASKS = """n AS (SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS task, event_type AS agent FROM events),
    e AS (SELECT run, task, task // 2 AS needs FROM n WHERE task >= 2 UNION SELECT run, task, task - 1 FROM n WHERE task % 7 = 0)"""
_CALLED = "list_filter([" + ", ".join(f"CASE WHEN contains({{0}}, '{w}') THEN '{a}' END" for a, w in AGENTS.items()) + "], lambda x: x IS NOT NULL)"
_DRAFTS = f"""{_ITEMS}, d AS (SELECT item_id, reference || ' [D' || (item_id % 9) || ', W' || (item_id % 4) || '] as before [D' || (item_id % 5) || '].' AS draft FROM i)"""
ORACLE_SQL = {
    "eval_rollup": f"""WITH {_RECORDS} SELECT category, count(*) AS n, CASE WHEN count(routing_ok) = count(*) THEN round(avg(CAST(routing_ok AS INT)), 3) END AS routing_acc,
        round(avg(CAST(score = 2 AS INT)), 3) AS correct_rate, round(avg(score) / 2, 3) AS mean_score,
        round(count(*) FILTER (WHERE is_tool AND cited) / nullif(CAST(count(*) FILTER (WHERE is_tool) AS DOUBLE), 0), 3) AS cited_rate, round(median(seconds), 1) AS median_seconds,
        round(avg(n_docs), 1) AS mean_docs FROM r WHERE system = 's0' GROUP BY ROLLUP (category)""",
    "eval_compare": f"""WITH {_RECORDS}, g AS (SELECT category, round(avg(CAST(score = 2 AS INT)) FILTER (WHERE system = 's0'), 6) AS s0, round(avg(CAST(score = 2 AS INT)) FILTER (WHERE system = 's1'), 6) AS s1
        FROM r GROUP BY category) SELECT *, s0 IS DISTINCT FROM s1 AS differs FROM g""",
    "eval_differing": f"WITH {_RECORDS} SELECT item_id, min(score) AS worst, max(score) AS best FROM r GROUP BY item_id HAVING min(score) <> max(score)",
    "routing_predicate": f"""WITH {_ITEMS}, c AS (SELECT item_id, {_CALLED.format("lower(question)")} AS used, {_CALLED.format("lower(reference)")} AS expected FROM i)
        SELECT item_id, list_has_all(used, expected) AND (item_id % 3 <> 0 OR list_has_any(used, ['docs', 'web'])) AND NOT (item_id % 4 = 0 AND list_has_any(used, ['market'])) AS routing_ok FROM c""",
    "agents_in_order": """WITH f AS (SELECT user_id AS run, event_type AS agent, min((ts, event_id)) AS first, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT run, string_agg(agent, ',' ORDER BY first) AS agents, CAST(sum(n) AS BIGINT) AS n_events FROM f GROUP BY run""",
    "gaps_counted": f"""WITH r AS (SELECT "table", coalesce(json_extract_string(record, '$.value_text'), '') AS text FROM table_records WHERE "table" IS NOT NULL)
        SELECT "table", count(*) AS n, count(*) FILTER (WHERE text <> '' AND lower(trim(text)) IN ({", ".join(f"'{m}'" for m in t.MISSING)})) AS n_missing FROM r GROUP BY "table" """,
    "evidence_dedupe": """WITH k AS (SELECT CASE WHEN coalesce(kind, 'text') = 'table' THEN 'M' ELSE 'D' END AS prefix, concat_ws('|', lower(trim(title)), lower(trim(section))) AS key, chunk_id, coalesce(text, '') AS text FROM chunks),
        g AS (SELECT prefix, key, min(chunk_id) AS first, max(len(text)) AS n_chars, count(*) AS n_seen FROM k GROUP BY prefix, key)
        SELECT prefix || row_number() OVER (PARTITION BY prefix ORDER BY first, key) AS id, key, n_chars, n_seen FROM g""",
    "round_robin_select": """WITH c AS (SELECT user_id AS run, event_type AS agent, event_type || (event_id % 50) AS evidence, min(event_id) AS ord FROM events GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (PARTITION BY run, agent ORDER BY ord, evidence) AS turn FROM c)
        SELECT run, evidence, CAST(row_number() OVER (PARTITION BY run ORDER BY turn, agent, evidence) AS INT) AS place FROM n QUALIFY place <= 40""",
    "context_compacted": """WITH p AS (SELECT doc_id AS run, page AS ord, len(coalesce(min(text), '')) AS n_chars FROM pages GROUP BY doc_id, page),
        s AS (SELECT *, sum(n_chars) OVER (PARTITION BY run) AS total, row_number() OVER (PARTITION BY run ORDER BY ord DESC) > 1 AND n_chars > 900 AS open FROM p),
        b AS (SELECT *, coalesce(sum(CASE WHEN open THEN n_chars - 600 ELSE 0 END) OVER (PARTITION BY run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saved FROM s)
        SELECT run, ord, CAST(n_chars AS INT) AS n_chars, open AND total - saved > 6000 AS shortened FROM b""",
    "plan_valid": f"""WITH {_TASKS}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY task) AS nth FROM n WHERE agent IN ('click', 'view', 'purchase') QUALIFY nth <= 5),
        d AS (SELECT e.run, e.task, string_agg(needs, ',' ORDER BY needs) AS depends_on FROM e JOIN k a ON a.run = e.run AND a.task = e.task JOIN k b ON b.run = e.run AND b.task = e.needs GROUP BY e.run, e.task)
        SELECT k.run, k.task, agent, coalesce(depends_on, '') AS depends_on FROM k LEFT JOIN d ON k.run = d.run AND k.task = d.task""",
    # A task's wave is the length of the longest chain that ends in it.
    "task_waves": f"""WITH RECURSIVE {_TASKS}, w(run, task, wave) AS (SELECT run, task, 1 FROM n WHERE task = 1 UNION SELECT e.run, e.task, wave + 1 FROM w JOIN e ON e.run = w.run AND e.needs = w.task)
        SELECT run, task, max(wave) AS wave FROM w GROUP BY run, task""",
    "evidence_rendered": """WITH p AS (SELECT doc_id, page, min(text) AS text FROM pages WHERE text IS NOT NULL GROUP BY doc_id, page)
        SELECT doc_id, page, '[' || doc_id || ', p. ' || page || ']' || chr(10) || CASE WHEN len(text) <= 2400 THEN text ELSE substring(text, 1, 2400) || ' ...' END AS evidence FROM p""",
    "history_last3": r"""WITH p AS (SELECT doc_id, page, min(text) AS text FROM pages GROUP BY doc_id, page),
        l AS (SELECT doc_id, page, substring(regexp_replace(coalesce(text, ''), '\[[DWM]\d+\]', '', 'g'), 1, 700) AS said FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page DESC) <= 3)
        SELECT doc_id, string_agg(said, chr(10) || chr(10) ORDER BY page) AS history, count(*) AS n_turns FROM l GROUP BY doc_id""",
    "citations_extract": f"""WITH {_DRAFTS}, c AS (SELECT item_id, ['D' || (item_id % 9), 'W' || (item_id % 4)] || CASE WHEN item_id % 9 = item_id % 5 THEN [] ELSE ['D' || (item_id % 5)] END AS ids FROM d)
        SELECT item_id, CAST(unnest(range(len(ids))) AS INT) AS place, unnest(ids) AS evidence FROM c""",
    "citations_known": f"""WITH {_ITEMS} SELECT item_id, reference || ' ' || CASE WHEN item_id % 9 BETWEEN 1 AND 4 THEN '[D' || (item_id % 9) || ']' ELSE '' END || CASE WHEN item_id % 4 = 1 THEN '[W1]' ELSE '' END
        || ' as before ' || CASE WHEN item_id % 5 BETWEEN 1 AND 4 THEN '[D' || (item_id % 5) || ']' ELSE '' END || '.' AS answer FROM i""",
}
