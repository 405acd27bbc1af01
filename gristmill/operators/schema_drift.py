"""Releases of recurring tables whose schemas drift: changes, and one typed table per series.

A release's schema is a tree: the table, its columns, and below each header level
that level's values. The tree edit distance between neighbouring releases gives the
cheapest script of adds, deletes, renames and moves: children are unordered, so the
subtrees below two matched nodes are matched by minimum-cost assignment, from the
leaves up, and what is deleted under one node and added under another of the same
name is a move. What a rename costs comes from the records: the share of common
periods on which two fields hold the same number, counted by joins over all
records. The scripts of a series, chained, compile into every release's projection
onto the latest names and types.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import cut_lineage, small_side

RELEASE_DATE = r"_(\d{4}(?:q[1-4]|_\d{2}(?:_\d{2})?)?)(?=__|$)"
NUMBER = r"^\s*[($]*\s*([-−]?\d[\d,]*(?:\.\d+)?|[-−]?\.\d+)"
AGREEMENT = 0.5  # least share of common periods on which a renamed field's values are equal
ADD = REMOVE = 1.0
RENAME, CONTRADICTED, MOVE, NEVER = 0.5, 1.2, 1.5, 1e6
LEVEL = r"^h\d+$"


def number_of(text: Column) -> Column:
    """The number a cell holds, marks such as r or (e) left out; null for anything else."""
    digits = F.regexp_replace(F.replace(F.regexp_extract(text, NUMBER, 1), F.lit("−"), F.lit("-")), ",", "")
    return F.round(F.when(digits != "", digits.cast("double")), 9)


def releases(catalog: DataFrame, docs: DataFrame) -> DataFrame:
    """series, table, sort_date, columns, header_values: one row per table of kind 'table'.

    Repeated entries count once. Names and header values are trimmed and in lower
    case; a null kind counts as 'table', null columns as none.
    """
    kind = F.coalesce(F.lower("kind"), F.lit("table"))
    cols = F.transform(
        F.filter(F.coalesce("columns", F.array()), lambda c: c["name"].isNotNull()),
        lambda c: F.struct(F.lower(F.trim(c["name"])).alias("name"), F.lower(F.trim(F.coalesce(c["type"], F.lit("text")))).alias("type")),
    )
    levels = F.transform(
        F.map_entries(F.coalesce("header_values", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>")))),
        lambda e: F.struct(F.lower(F.trim(e["key"])).alias("level"), F.array_distinct(F.transform(F.coalesce(e["value"], F.array()), lambda v: F.lower(F.trim(v)))).alias("values")),
    )
    once = (
        catalog.where((kind == "table") & F.col("table").isNotNull())
        .select("table", "doc_id", cols.alias("columns"), levels.alias("levels"))
        .groupBy("table").agg(F.max_by(F.struct("doc_id", "columns", "levels"), F.struct(F.size("columns"), F.col("doc_id"))).alias("r"))
        .select("table", "r.*")
    )
    dates = docs.groupBy("doc_id").agg(F.max_by("sort_date", F.struct(F.col("retrieved_at"), F.col("sort_date"))).alias("sort_date"))
    return once.join(dates, "doc_id", "left").select(F.regexp_replace("table", RELEASE_DATE, "_").alias("series"), "table", "sort_date", "columns", "levels")


def neighbours(found: DataFrame) -> DataFrame:
    """Each release with the next one of its series, in order of sort_date and name."""
    order = Window.partitionBy("series").orderBy(F.col("sort_date").asc_nulls_first(), "table")
    here = F.struct("table", "columns", "levels")
    return found.select("series", here.alias("a"), F.lead(here).over(order).alias("b")).where("b is not null")


def latest_records(records: DataFrame) -> DataFrame:
    """table, row_no, fields (map of lower-case name to text): the last loaded record of every key; texts that are no object hold nothing."""
    last = records.where(F.col("table").isNotNull()).groupBy("table", "row_no").agg(F.max_by("record", F.struct("loaded_at", "record")).alias("record"))
    parsed = F.from_json("record", "map<string,string>")
    entries = F.transform(F.map_entries(parsed), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), F.trim(e["value"]).alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    fields = F.map_from_arrays(names, F.transform(names, lambda n: F.filter(entries, lambda e: e["key"] == n)[0]["value"]))
    return last.select("table", "row_no", fields.alias("fields"))


def _cells(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """id (of pair and axis), pair, side, key, name, number: per period for wide tables, per row and header values for long ones; both sides in one pass."""
    shared = F.array_intersect(F.transform("a.levels", lambda l: l["level"]), F.transform("b.levels", lambda l: l["level"]))
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}.table").alias("table")) for side in "ab"])
    mine = pairs.select("pair", shared.alias("shared_levels"), F.explode(sides).alias("x")).select("pair", "shared_levels", "x.side", "x.table")
    rows = records.join(small_side(mine), "table")
    get = lambda n: F.element_at("fields", F.lit(n))
    is_long = F.map_contains_key("fields", F.lit("row_label")) & F.map_contains_key("fields", F.lit("h1"))
    level_at = lambda l: F.lower(F.trim(F.coalesce(F.element_at("fields", l), F.lit(""))))
    one = lambda axis, key, name, text: F.struct(axis.alias("axis"), key.alias("key"), name.alias("name"), text.alias("text"))
    wide = F.transform(
        F.map_entries(F.map_filter("fields", lambda k, v: (k != "period") & v.isNotNull())),
        lambda e: one(F.lit(""), F.lower(get("period")), e["key"], e["value"]),
    )
    label = F.lower(F.coalesce(get("row_label"), F.lit("")))
    others = lambda axis: F.transform(F.filter("shared_levels", lambda l: l != axis), level_at)
    long = F.transform(
        "shared_levels",
        lambda l: one(l, F.concat_ws("\x1f", label, F.concat_ws("\x1f", others(l))), F.concat(l, F.lit("="), level_at(l)), F.coalesce(get("value"), get("value_text"))),
    )
    each = rows.select("pair", "side", F.explode(F.when(is_long, long).otherwise(wide)).alias("c")).select("pair", "side", "c.*")
    numbered = each.withColumn("number", F.round(number_of(F.col("text")), 6)).where("number is not null and key is not null")
    named = numbered.select(F.xxhash64("pair", "axis").alias("id"), "pair", "side", F.xxhash64("key").alias("key"), "name", "number")
    return named.groupBy("id", "side", "key", "name").agg(F.max("number").alias("number"), F.max("pair").alias("pair"))


def evidence(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """pair, seen: (old, new, shared, equal) for every two fields of one axis that hold the same number for two periods, or have one name.

    Only equal cells are joined, so two fields meet as often as they agree; the periods
    they share are counted for those pairs alone.
    """
    cells = cut_lineage(_cells(records, pairs))
    a = cells.where("side = 'a'").select("id", "key", F.col("name").alias("old"), "number", "pair")
    b = cells.where("side = 'b'").select("id", "key", F.col("name").alias("new"), F.col("number").alias("number_b"))
    same = F.col("number") == F.col("number_b")
    kept = a.join(b.withColumnRenamed("new", "old"), ["id", "key", "old"]).groupBy("id", "old").agg(F.max("pair").alias("pair"), F.count("*").alias("shared"), F.count_if(same).alias("equal"))
    kept = kept.select("pair", "old", F.col("old").alias("new"), "shared", "equal")
    equal = a.join(b.withColumnRenamed("number_b", "number"), ["id", "key", "number"]).where("old <> new").groupBy("id", "old", "new").agg(F.max("pair").alias("pair"), F.count("*").alias("equal"))
    other = cut_lineage(equal.where("equal >= 2"))
    shared = other.select("id", "old", "new").join(a.select("id", "key", "old"), ["id", "old"]).join(b.select("id", "key", "new"), ["id", "key", "new"]).groupBy("id", "old", "new").agg(F.count("*").alias("shared"))
    renamed = other.join(shared, ["id", "old", "new"]).select("pair", "old", "new", "shared", "equal")
    return kept.unionByName(renamed).groupBy("pair").agg(F.collect_list(F.struct("old", "new", "shared", "equal")).alias("seen"))


def assignment(cost: np.ndarray) -> list[int]:
    """Column of each row in the cheapest perfect matching of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    u, v, match, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


@dataclass
class Node:
    """A node of a schema tree; path names it below its parent, for the values of a level 'level=value'."""

    kind: str  # 'column', 'level' or 'value'
    path: str
    name: str
    type: str = ""
    parent: str = ""
    children: list[Node] = field(default_factory=list)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


def schema_tree(release: dict) -> Node:
    """The tree of a release (columns, levels)."""
    root = Node("table", "", "")
    root.children = [Node("column", n, n, t) for n, t in {c["name"]: c["type"] for c in release["columns"]}.items()]
    for level in release["levels"]:
        node = Node("level", level["level"], level["level"])
        node.children = [Node("value", f"{level['level']}={v}", v, parent=level["level"]) for v in dict.fromkeys(level["values"]) if v is not None]
        root.children.append(node)
    return root


def relabel_cost(a: Node, b: Node, seen: dict[tuple[str, str], tuple[int, int]]) -> float:
    """Cost of a node's going on as another: nothing for the same name, RENAME where the records agree."""
    if a.kind != b.kind:
        return NEVER
    shared, equal = seen.get((a.path, b.path), (0, 0))
    share = equal / shared if shared else 0.0
    if a.name == b.name:
        return CONTRADICTED if shared >= 3 and share < 0.2 else 0.0
    if shared >= 2 and equal >= 2 and share >= AGREEMENT:
        return RENAME + (1 - share) / 10
    return NEVER


def match_forests(old: list[Node], new: list[Node], seen: dict[tuple[str, str], tuple[int, int]]) -> tuple[float, list[tuple[Node | None, Node | None]]]:
    """Cost of the cheapest edit of one forest into another, and its mapping of nodes; None stands for an added or removed node."""
    n, m = len(old), len(new)
    if not n + m:
        return 0.0, []
    cost, below = np.full((n + m, n + m), NEVER), {}
    for i, a in enumerate(old):
        for j, b in enumerate(new):
            label = relabel_cost(a, b, seen)
            if label < NEVER:
                inner, pairs = match_forests(a.children, b.children, seen)
                cost[i, j], below[i, j] = label + inner, pairs
        cost[i, m + i] = REMOVE * a.size()
    for j, b in enumerate(new):
        cost[n + j, j] = ADD * b.size()
    cost[n:, m:] = 0.0
    to = assignment(cost)
    pairs: list[tuple[Node | None, Node | None]] = []
    for i, a in enumerate(old):
        if to[i] < m:
            pairs += [(a, new[to[i]]), *below[i, to[i]]]
        else:
            pairs += [(x, None) for x in (a, *a.children)]
    for j, b in enumerate(new):
        if to.index(j) >= n:
            pairs += [(None, x) for x in (b, *b.children)]
    return float(sum(cost[i, to[i]] for i in range(n + m))), pairs


def tree_script(a: dict, b: dict, seen: dict[tuple[str, str], tuple[int, int]]) -> list[tuple[str, str, str]]:
    """(kind, old, new) of every field of two schema trees: 'added', 'removed', 'renamed', 'moved', 'retyped', and 'same' for those that stay.

    A move takes a field to another parent: a column becomes a level's value, or a
    value another level's. Values of a level that only one release has are told only
    where they moved.
    """
    _, pairs = match_forests(schema_tree(a).children, schema_tree(b).children, seen)
    shared_levels = {x.name for x, y in pairs if x and y and x.kind == "level"}
    gone = [x for x, y in pairs if not y and x.kind != "level"]
    fresh = [y for x, y in pairs if not x and y.kind != "level"]
    plain = lambda n: re.sub(r"[\W_]+", " ", n.name).strip()
    out, moved = [], {}
    for x in gone:  # MOVE is cheaper than ADD and REMOVE together, so every possible move is taken
        y = next((y for y in fresh if id(y) not in moved and plain(x) == plain(y) and (x.kind, x.parent) != (y.kind, y.parent)), None)
        if y is not None and MOVE < ADD + REMOVE:
            moved[id(x)] = moved[id(y)] = True
            out.append(("moved", x.path, y.path))
    told = lambda x: x.kind == "column" or x.parent in shared_levels
    for x, y in pairs:
        if x and y and x.kind != "level":
            out.append(("same" if x.name == y.name else "renamed", x.path, y.path))
            if x.type != y.type:
                out.append(("retyped", x.path, y.path))
        elif x and not y and x.kind != "level" and id(x) not in moved and told(x):
            out.append(("removed", x.path, ""))
        elif y and not x and y.kind != "level" and id(y) not in moved and told(y):
            out.append(("added", "", y.path))
    return out


def _scripts_of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for series, a, b, seen in zip(batch["series"], batch["a"], batch["b"], batch["seen"]):
            known = {(s["old"], s["new"]): (s["shared"], s["equal"]) for s in (seen if seen is not None else [])}
            rows += [(series, a["table"], b["table"], *step) for step in tree_script(a, b, known)]
        yield pd.DataFrame(rows, columns=["series", "table_from", "table_to", "change_kind", "old_name", "new_name"])


def edit_scripts(catalog: DataFrame, docs: DataFrame, records: DataFrame) -> DataFrame:
    """series, table_from, table_to, change_kind, old_name, new_name: the whole script, 'same' steps included."""
    pairs = cut_lineage(neighbours(releases(catalog, docs)).withColumn("pair", F.concat_ws("\x1f", "a.table", "b.table")))
    found = evidence(pairs, latest_records(records))
    return pairs.join(found, "pair", "left").select("series", "a", "b", "seen").mapInPandas(
        _scripts_of_batches, "series string, table_from string, table_to string, change_kind string, old_name string, new_name string"
    )


def schema_changes(catalog: DataFrame, docs: DataFrame, records: DataFrame) -> DataFrame:
    """table_from, table_to, change_kind, old_name, new_name: 'added', 'removed', 'renamed', 'moved' and 'retyped' fields between neighbouring releases."""
    return edit_scripts(catalog, docs, records).where("change_kind <> 'same'").select("table_from", "table_to", "change_kind", "old_name", "new_name").distinct()


def _projections_of_series(rows: pd.DataFrame) -> pd.DataFrame:
    """Chain one series' scripts backwards: each release's field gets the name it has in the last release that holds it."""
    nxt = dict(zip(rows["table_from"], rows["table_to"]))
    kept = rows[rows["change_kind"].isin(["same", "renamed"])]
    step = {(t, o): n for t, o, n in zip(kept["table_from"], kept["old_name"], kept["new_name"])}
    fields = {(t, o) for t, o in zip(rows["table_from"], rows["old_name"]) if o} | {(t, n) for t, n in zip(rows["table_to"], rows["new_name"]) if n}
    out = []
    for t, name in sorted(fields):
        at, to = t, name
        while (at, to) in step:
            at, to = nxt[at], step[at, to]
        out.append((rows["series"].iloc[0], t, name, to))
    return pd.DataFrame(out, columns=["series", "table", "name", "unified_name"])


def unified_series(catalog: DataFrame, docs: DataFrame, records: DataFrame) -> DataFrame:
    """series, table, sort_date, row_no, fields (map of name to struct of type, number, text): every record under the latest name and type of each of its fields.

    A series with one release keeps its names. Header values of long tables are
    renamed like columns. A field whose latest name clashes with another of its
    release keeps its own name. A field's type is that of the last release that has it:
    where it is 'number', numbers written as text are cast, and what is no number is null.
    """
    found = cut_lineage(releases(catalog, docs))
    maps = (
        edit_scripts(catalog, docs, records).groupBy("series").applyInPandas(_projections_of_series, "series string, table string, name string, unified_name string")
        .groupBy("table").agg(F.map_from_entries(F.collect_set(F.struct("name", "unified_name"))).alias("names"))
    )
    to = lambda n: F.coalesce(F.element_at("names", n), n)
    typed = found.join(maps, "table", "left").select("series", "table", "sort_date", "names", F.explode("columns").alias("c"))
    types = typed.groupBy("series", to(F.col("c.name")).alias("name")).agg(F.max_by("c.type", F.struct(F.coalesce("sort_date", F.lit("")), F.col("table"))).alias("type"))
    types = types.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("name", "type"))).alias("types"))
    plans = found.select("series", "table", "sort_date").join(maps, "table", "left").join(types, "series", "left")
    rows = latest_records(records).join(plans, "table")
    values = F.transform_values("fields", lambda k, v: F.when(k.rlike(LEVEL) & v.isNotNull(), F.regexp_replace(to(F.concat(k, F.lit("="), F.lower(v))), r"^h\d+=", "")).otherwise(v))
    keys = F.map_keys("fields")
    renamed = F.transform(keys, to)
    safe = F.transform(keys, lambda k: F.when((F.size(F.filter(renamed, lambda r: r == to(k))) > 1) | ((to(k) != k) & F.array_contains(keys, to(k))), k).otherwise(to(k)))
    named = rows.select("series", "table", "sort_date", "row_no", "types", F.map_from_arrays(safe, F.map_values(values)).alias("fields"))
    kind = lambda k: F.coalesce(F.element_at("types", k), F.lit("text"))
    cast = F.transform_values("fields", lambda k, v: F.struct(kind(k).alias("type"), F.when(kind(k) == "number", number_of(v)).alias("number"), v.alias("text")))
    return named.select("series", "table", "sort_date", "row_no", cast.alias("fields"))


def series_table(rows: DataFrame, series: str, columns: dict[str, str]) -> DataFrame:
    """One series of unified_series as a table: table, sort_date, row_no and the named columns with their types."""
    of = lambda n, t: F.element_at("fields", F.lit(n))["number" if t == "number" else "text"].alias(n)
    return rows.where(F.col("series") == series).select("table", "sort_date", "row_no", *[of(n, t) for n, t in columns.items()])
