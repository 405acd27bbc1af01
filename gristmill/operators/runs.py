"""Evaluation records, traces and evidence: aggregates, order of first use, deduplication, fair selection, task waves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import cut_lineage


def summarized(records: DataFrame, *keys: str) -> DataFrame:
    """Rates of records (score 0 to 2, routing_ok, is_tool, cited, seconds, n_docs) by keys, and over all of them (keys null).

    routing_acc is null where any record has none, cited_rate counts records that used a tool and is null without any.
    """
    routing = F.when(F.count("routing_ok") == F.count("*"), F.round(F.avg(F.col("routing_ok").cast("int")), 3))
    cited = F.round(F.try_divide(F.count_if(F.col("is_tool") & F.col("cited")).cast("double"), F.count_if("is_tool").cast("double")), 3)
    return records.rollup(*keys).agg(
        F.count("*").alias("n"), routing.alias("routing_acc"), F.round(F.avg((F.col("score") == 2).cast("int")), 3).alias("correct_rate"),
        F.round(F.avg("score") / 2, 3).alias("mean_score"), cited.alias("cited_rate"), F.round(F.percentile("seconds", F.lit(0.5)), 1).alias("median_seconds"),
        F.round(F.avg("n_docs"), 1).alias("mean_docs"),
    )


def compared(records: DataFrame, systems: list[str]) -> DataFrame:
    """category, one column of correct shares per system, and differs: whether a system's share isn't that of the first."""
    wide = records.groupBy("category").pivot("system", systems).agg(F.round(F.avg((F.col("score") == 2).cast("int")), 6))
    differs = F.lit(False)
    for s in systems[1:]:
        differs = differs | ~F.col(systems[0]).eqNullSafe(F.col(s))
    return wide.withColumn("differs", differs)


def routing_ok(expected: Column, any_of: Column, forbidden: Column, used: Column) -> Column:
    """Whether the agents used hold all expected ones, one of any_of (where it names any) and none that is forbidden."""
    enough = (F.size(F.array_except(expected, used)) == 0) & ((F.coalesce(F.size(any_of), F.lit(0)) <= 0) | F.arrays_overlap(any_of, used))
    return enough & ~F.coalesce(F.arrays_overlap(forbidden, used), F.lit(False))


def in_order_of_start(events: DataFrame) -> DataFrame:
    """run, agents, n_events: each run's different agents in order of their first event; events (run, agent, ts, event_id)."""
    first = events.groupBy("run", "agent").agg(F.min(F.struct("ts", "event_id")).alias("first"), F.count("*").alias("n"))
    agents = F.transform(F.array_sort(F.collect_list(F.struct("first", "agent"))), lambda x: x["agent"])
    return first.groupBy("run").agg(agents.alias("agents"), F.sum("n").alias("n_events"))


def deduplicated_evidence(items: DataFrame) -> DataFrame:
    """id, prefix, key, text, n_seen: items (prefix, key, ord, text) once per key with their longest text, numbered by prefix in order of first sight."""
    once = items.groupBy("prefix", "key").agg(F.min("ord").alias("first"), F.max_by("text", F.struct(F.length("text"), F.col("text"))).alias("text"), F.count("*").alias("n_seen"))
    number = F.row_number().over(Window.partitionBy("prefix").orderBy("first", "key"))
    return once.select(F.concat("prefix", number.cast("string")).alias("id"), "prefix", "key", "text", "n_seen")


def round_robin(cited: DataFrame, most: int = 40) -> DataFrame:
    """run, evidence, place: up to `most` items of each run, one of each agent in turn; cited (run, agent, ord, evidence).

    An item that several agents cite counts for the one whose turn comes first.
    """
    own = cited.groupBy("run", "agent", "evidence").agg(F.min("ord").alias("ord"))
    turn = F.row_number().over(Window.partitionBy("run", "agent").orderBy("ord", "evidence"))
    first = own.withColumn("turn", turn).groupBy("run", "evidence").agg(F.min(F.struct("turn", "agent")).alias("at"))
    place = F.row_number().over(Window.partitionBy("run").orderBy("at.turn", "at.agent", "evidence"))
    return first.select("run", "evidence", place.alias("place")).where(F.col("place") <= most)


def compacted(messages: DataFrame, budget: int, keep_last: int = 4, long: int = 900, kept: int = 600) -> DataFrame:
    """run, ord, n_chars, shortened: which of a run's oldest results (run, ord, text) are cut to `kept` characters until all fit the budget.

    The newest keep_last stay whole, and so does what is no longer than `long`. What
    earlier cuts save decides about later ones; a running sum of all possible savings
    is the same, because once the rest fits nothing more is cut.
    """
    sized = messages.select("run", "ord", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))
    whole = Window.partitionBy("run")
    from_end = F.row_number().over(whole.orderBy(F.col("ord").desc()))
    sized = sized.withColumns({"total": F.sum("n_chars").over(whole), "open": (from_end > keep_last) & (F.col("n_chars") > long)})
    saving = F.when(F.col("open"), F.col("n_chars") - kept).otherwise(F.lit(0))
    before = F.coalesce(F.sum(saving).over(whole.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.select("run", "ord", "n_chars", (F.col("open") & (F.col("total") - before > budget)).alias("shortened"))


def valid_tasks(tasks: DataFrame, agents: list[str], most: int = 5) -> DataFrame:
    """run, task, agent, depends_on of tasks (run, task, agent, depends_on): the first `most` of known agents; dependencies on others, and on themselves, are dropped."""
    known = tasks.where(F.col("agent").isin(agents)).withColumn("nth", F.row_number().over(Window.partitionBy("run").orderBy("task"))).where(F.col("nth") <= most)
    ids = F.collect_set("task").over(Window.partitionBy("run"))
    return known.withColumn("ids", ids).select("run", "task", "agent", F.filter("depends_on", lambda d: F.array_contains("ids", d) & (d != F.col("task"))).alias("depends_on"))


def waves(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """run, task, wave (from 1): a task runs once all it depends on are done; tasks in or behind a cycle run together in the last wave.

    tasks (run, task), edges (run, task, needs). A round is one join and one
    aggregation over the edges of the tasks that are left; there are as many rounds as waves.
    """
    left = tasks.select("run", "task").distinct()
    needs = edges.join(left.withColumnRenamed("task", "needs"), ["run", "needs"], "left_semi").select("run", "task", "needs").distinct()
    done, wave = None, 1
    while True:
        blocked = needs.select("run", "task").distinct()
        ready = cut_lineage(left.join(blocked, ["run", "task"], "left_anti").withColumn("wave", F.lit(wave)))
        stuck = ready.isEmpty()
        if stuck:
            ready = cut_lineage(left.withColumn("wave", F.lit(wave)))
        done = ready if done is None else done.unionByName(ready)
        if stuck or needs.isEmpty():
            return done
        left = cut_lineage(left.join(ready.select("run", "task"), ["run", "task"], "left_anti"))
        needs = cut_lineage(needs.join(ready.select("run", F.col("task").alias("needs")), ["run", "needs"], "left_anti").join(left, ["run", "task"], "left_semi"))
        wave += 1
