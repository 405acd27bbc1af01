"""Tables inside grids of cells: header, data, group and note rows, and the relations made of them.

A grid is rows (grid, r, c, text) of its filled cells; empty cells have no row. All
grids are treated at once: windows by grid find the rows' parts, joins over the
column numbers of a block spread its header labels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import cell, is_missing, is_value, number_in, period_of, shown_number

NOTE = r"(?i)^(?:sources?|notes?)\b\s*[:.]"
NO_TITLE = r"(?i)^(?:sources?|notes?|©|\*|return to)"
LONG_NOTE, LONG_GROUP, LONG_LABEL, LONG_TITLE = 60, 100, 120, 200
GAP = 3  # so many blank rows end a table


def piped_cells(pages: DataFrame) -> DataFrame:
    """grid, r, c, text: the cells of pages (doc_id, page, text) whose lines hold '|' between cells; other lines are one cell."""
    once = pages.where(F.col("text").contains("|")).groupBy("doc_id", "page").agg(F.min("text").alias("text"))
    grid = F.concat_ws("#p", "doc_id", F.col("page").cast("string"))
    lines = once.select(grid.alias("grid"), F.posexplode(F.split("text", "\n")).alias("r", "line"))
    return lines.select("grid", "r", F.posexplode(F.split("line", r"\|")).alias("c", "text")).withColumn("text", cell(F.col("text"))).where("text is not null")


def filled_merged(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """cells with the first cell's text in every empty one of each merged range (grid, r0, c0, r1, c1; both ends included)."""
    whole = merged.select("grid", "r0", "c0", F.explode(F.sequence("r0", "r1")).alias("r"), "c1").select("grid", "r0", "c0", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    first = cells.select("grid", F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("text").alias("first"))
    spread = whole.join(first, ["grid", "r0", "c0"]).groupBy("grid", "r", "c").agg(F.max("first").alias("first"))
    return cells.join(spread, ["grid", "r", "c"], "full").select("grid", "r", "c", F.coalesce("text", "first").alias("text"))


def _year(text: Column) -> Column:
    return text.rlike(r"^(?:1[89]\d\d|20\d\d|2100)(?:\.0)?$")


def _is_data(first_value: Column | None = None) -> Column:
    """Whether a row (cells: array of c, text, is_value, is_year) holds data: at least half of its cells from the first value column on are values, and it is no row of years."""
    cells = F.col("cells")
    right = cells if first_value is None else F.filter(cells, lambda x: x["c"] >= first_value)
    values = F.filter(right, lambda x: x["is_value"])
    years = F.forall(values, lambda x: x["is_year"]) & (F.size(values) >= 2) & ~cells[0]["is_value"]
    all_years = F.forall(cells, lambda x: x["is_year"]) & (F.size(cells) >= 3)
    return (F.size(values) >= F.greatest(F.lit(1), 0.5 * F.size(right))) & ~years & ~all_years


def blocks(cells: DataFrame) -> DataFrame:
    """grid, block, r, part, level, group, first_value, cells: every filled row of a grid with its part in a table.

    part is 'title', 'note', 'header' (level from 1), 'group' or 'data'. Columns left of
    first_value hold row labels. A row of labels alone before data names the group of
    the rows after it; three blank rows, or a new header after data, begin another table.
    """
    held = F.struct("c", "text", is_value(F.col("text")).alias("is_value"), _year(F.col("text")).alias("is_year"))
    rows = cells.where(F.col("text").isNotNull()).groupBy("grid", "r").agg(F.array_sort(F.collect_list(held)).alias("cells"))
    order = Window.partitionBy("grid").orderBy("r")
    size = F.size("cells")
    rows = rows.withColumn("data", _is_data()).withColumns({
        "next_data": F.lead("data").over(order), "next_size": F.lead(size).over(order), "next_gap": F.lead("r").over(order) - F.col("r"), "gap": F.col("r") - F.lag("r").over(order),
    })
    label_only = (size <= 2) & ~F.exists("cells", lambda x: x["is_value"])
    group_like = ~F.col("data") & label_only & F.coalesce(F.col("next_data"), F.lit(False)) & (F.col("next_gap") <= GAP)
    opens = ~F.col("data") & ~group_like & ((size >= 3) | (F.coalesce("next_size", F.lit(0)) >= 2) & ~F.coalesce("next_data", F.lit(True)) & (F.col("next_gap") <= GAP))
    rows = rows.withColumns({"opens": opens, "seen": F.max(F.col("data").cast("int")).over(order)})
    begins = (F.coalesce("gap", F.lit(1)) > GAP) | F.col("opens") & ~F.coalesce(F.lag("opens").over(order), F.lit(False)) & (F.col("seen") == 1)
    rows = rows.withColumn("block", F.sum(begins.cast("int")).over(order))
    in_block = Window.partitionBy("grid", "block")
    first_data = F.min(F.when(F.col("data"), F.col("r"))).over(in_block)
    rows = rows.withColumn("d", first_data)
    values = F.transform(F.filter("cells", lambda x: x["is_value"]), lambda x: x["c"])
    # A first column of periods labels its rows though its cells are numbers.
    lead = F.struct(F.col("cells")[0]["text"].alias("text"), F.col("cells")[0]["c"].alias("c"))
    leads = F.collect_list(F.when(F.col("data"), lead)).over(in_block)
    texts = F.transform("leads", lambda x: x["text"])
    periods = (F.size(texts) >= 2) & F.forall(texts, lambda t: period_of(t).isNotNull()) & (F.size(F.array_distinct(texts)) > 1)
    at_first = F.max(F.when(F.col("r") == F.col("d"), F.struct(values.alias("values"), F.col("cells")[0]["c"].alias("first")))).over(in_block)
    rows = rows.withColumns({"leads": leads, "at_first": at_first})
    labels_rows = periods & (F.size("at_first.values") > 1) & (F.col("at_first.values")[0] == F.col("at_first.first"))
    rows = rows.withColumn("first_value", F.when(labels_rows, F.get("at_first.values", F.lit(1))).otherwise(F.get("at_first.values", F.lit(0))))
    first_value = F.col("first_value")
    own_text = F.array_distinct(F.transform("cells", lambda x: x["text"]))
    caption = (F.size(own_text) == 1) & (F.col("cells")[0]["c"] < first_value)
    note = F.forall("cells", lambda x: x["text"].rlike(NOTE)) | (F.size(own_text) == 1) & (F.length(own_text[0]) > LONG_NOTE)
    above = (F.col("r") < F.col("d")) & F.exists("cells", lambda x: x["c"] >= first_value) & ~caption & ~note & ~F.exists("cells", lambda x: F.length(x["text"]) > LONG_LABEL)
    data = (F.col("r") >= F.col("d")) & _is_data(first_value)
    rows = rows.withColumns({"above": above, "is_data": data})
    short = F.length(F.array_join(own_text, " ")) <= LONG_GROUP
    lead_group = (F.col("r") < F.col("d")) & caption & short & (F.coalesce(F.lead("is_data").over(order), F.lit(False)))
    # A header stands right above its data: only notes, the first group and up to two blank rows come between.
    below = Window.partitionBy("grid", "block").orderBy("r").rowsBetween(1, Window.unboundedFollowing)
    barrier = (F.col("r") < F.col("d")) & (~F.col("above") & ~lead_group & ~note | (F.coalesce("gap", F.lit(1)) > GAP))
    rows = rows.withColumn("barrier", barrier)
    rows = rows.withColumn("above", F.col("above") & (F.coalesce(F.sum(F.col("barrier").cast("int")).over(below), F.lit(0)) == 0))
    has_header = F.max(F.col("above").cast("int")).over(in_block) == 1
    group = (F.col("r") > F.col("d")) & ~F.col("is_data") & F.forall("cells", lambda x: x["c"] < first_value) & (size <= 2) & short & F.coalesce(F.lead("is_data").over(order), F.lit(False))
    part = (
        F.when(F.col("is_data"), F.lit("data")).when(F.col("above"), F.lit("header")).when(group | lead_group & has_header, F.lit("group"))
        .when(F.col("d").isNull() | (F.col("r") > F.col("d")) | F.exists("cells", lambda x: x["text"].rlike(NO_TITLE)) | (F.length(F.col("cells")[0]["text"]) > LONG_TITLE), F.lit("note"))
        .otherwise(F.lit("title"))
    )
    rows = rows.withColumn("part", part)
    so_far = Window.partitionBy("grid", "block").orderBy("r")
    named = F.array_join(F.transform("cells", lambda x: x["text"]), " ")
    rows = rows.withColumns({
        "level": F.when(F.col("part") == "header", F.sum((F.col("part") == "header").cast("int")).over(so_far)).cast("int"),
        "group": F.when(F.col("part") == "data", F.last(F.when(F.col("part") == "group", named), ignorenulls=True).over(so_far)),
        "part": F.when((F.col("part") == "title") & (F.sum((F.col("part") == "title").cast("int")).over(so_far) > 1), F.lit("note")).otherwise(F.col("part")),
    })
    return rows.select("grid", "block", "r", "part", "level", "group", "first_value", F.transform("cells", lambda x: F.struct(x["c"].alias("c"), x["text"].alias("text"))).alias("cells"))


def forced_blocks(cells: DataFrame, depths: DataFrame) -> DataFrame:
    """blocks of grids whose header depth is declared; depths (grid, header_rows). Blank rows don't count.

    Leading columns with less than half values, ranges counted as such, label the rows;
    a row of labels alone, or of one text over several columns, names a group.
    """
    held = F.struct("c", "text", is_value(F.col("text"), ranges=True).alias("is_value"))
    rows = cells.where(F.col("text").isNotNull()).groupBy("grid", "r").agg(F.array_sort(F.collect_list(held)).alias("cells")).join(depths, "grid")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("grid").orderBy("r")))
    body = rows.where(F.col("nth") > F.col("header_rows")).select("grid", F.explode("cells").alias("x")).select("grid", "x.*")
    kinds = body.groupBy("grid", "c").agg((F.count_if("is_value") < 0.5 * F.count("*")).alias("labels"))
    first = kinds.groupBy("grid").agg(F.coalesce(F.min(F.when(~F.col("labels"), F.col("c"))), F.max("c") + 1).alias("first_value"))
    rows = rows.join(first, "grid")
    texts = F.array_distinct(F.transform("cells", lambda x: x["text"]))
    alone = (F.size("cells") > 1) & (F.size(texts) == 1) | F.forall("cells", lambda x: x["c"] < F.col("first_value"))
    part = F.when(F.col("nth") <= F.col("header_rows"), F.lit("header")).when(alone, F.lit("group")).otherwise(F.lit("data"))
    rows = rows.withColumns({"part": part, "named": F.array_join(texts, " ")})
    so_far = Window.partitionBy("grid").orderBy("r")
    group = F.when(F.col("part") == "data", F.last(F.when(F.col("part") == "group", F.col("named")), ignorenulls=True).over(so_far))
    level = F.when(F.col("part") == "header", F.col("nth")).cast("int")
    return rows.select("grid", F.lit(0).cast("long").alias("block"), "r", "part", level.alias("level"), group.alias("group"), "first_value", F.transform("cells", lambda x: F.struct(x["c"].alias("c"), x["text"].alias("text"))).alias("cells"))


def with_inherited_headers(found: DataFrame) -> DataFrame:
    """blocks in which one without header rows takes those of the nearest block before it in its grid, if both have the same columns and label columns."""
    shape = found.where("part = 'data'").groupBy("grid", "block").agg(F.max(F.element_at("cells", -1)["c"]).alias("last"), F.max("first_value").alias("labels"))
    has = found.groupBy("grid", "block").agg(F.max((F.col("part") == "header").cast("int")).alias("has"))
    blocks_ = shape.join(has, ["grid", "block"])
    giver = F.last(F.when(F.col("has") == 1, F.struct("block", "last", "labels")), ignorenulls=True).over(Window.partitionBy("grid").orderBy("block"))
    takers = blocks_.withColumn("giver", giver).where((F.col("has") == 0) & (F.col("giver.last") == F.col("last")) & (F.col("giver.labels") == F.col("labels")))
    taken = takers.select("grid", F.col("block").alias("to"), F.col("giver.block").alias("block"))
    extra = found.where("part = 'header'").join(taken, ["grid", "block"]).select("grid", F.col("to").alias("block"), *[c for c in found.columns if c not in ("grid", "block")])
    return found.unionByName(extra)


def year_quarter(year: Column, quarter: Column) -> Column:
    """'2026-Q3' of a year's and a quarter's column; null where either is none."""
    y, q = number_in(year).cast("int"), number_in(quarter).cast("int")
    return F.when(y.isNotNull() & q.between(1, 4), F.concat(y.cast("string"), F.lit("-Q"), q.cast("string")))


def headers(found: DataFrame) -> DataFrame:
    """grid, block, c, h: the header labels over each column of a block that holds data, from the top level down; h is null where there is none.

    A label spreads right over the empty columns after it, but never past the end of
    the label above it, and never on the last level. One pass per level of the deepest
    header.
    """
    each = found.select("grid", "block", "part", "level", "first_value", F.explode("cells").alias("x")).select("grid", "block", "part", "level", "first_value", "x.c", "x.text")
    columns = each.where((F.col("part") == "data") | (F.col("part") == "header") & (F.col("c") < F.col("first_value"))).select("grid", "block", "c").distinct()
    labels = each.where("part = 'header'")
    depth = labels.groupBy("grid", "block").agg(F.max("level").alias("depth"))
    wide = columns.join(depth, ["grid", "block"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    deepest = depth.agg(F.max("depth")).first()[0] or 0
    parent: list[str] = []
    for k in range(1, deepest + 1):
        own = labels.where(F.col("level") == k).select("grid", "block", "c", F.col("text").alias(f"t{k}"))
        wide = wide.join(own, ["grid", "block", "c"], "left")
        fill = F.last(f"t{k}", ignorenulls=True).over(Window.partitionBy("grid", "block", *parent).orderBy("c"))
        wide = wide.withColumn(f"h{k}", F.when(F.col("depth") > k, fill).otherwise(F.col(f"t{k}")))
        # The columns under one label are a run of the next level's partitions.
        order = Window.partitionBy("grid", "block").orderBy("c")
        changed = ~F.lag(f"h{k}").over(order).eqNullSafe(F.col(f"h{k}"))
        wide = wide.withColumn(f"run{k}", F.sum(changed.cast("int")).over(order))
        parent.append(f"run{k}")
    return wide.select("grid", "block", "c", F.slice(F.array(*[f"h{k}" for k in range(1, deepest + 1)]) if deepest else F.array().cast("array<string>"), 1, F.greatest("depth", F.lit(1))).alias("h"))


def column_labels(heads: DataFrame) -> DataFrame:
    """grid, block, c, label: the levels of a column's header joined by ' | ', neighbours that repeat once."""
    filled = F.filter("h", lambda x: x.isNotNull())
    once = F.filter(filled, lambda x, i: (i == 0) | (x != F.get(filled, i - 1)))
    return heads.select("grid", "block", "c", F.array_join(once, " | ").alias("label"))


def qualified(rows: DataFrame) -> DataFrame:
    """rows (table, r, label) with repeated labels prefixed by the nearest label before them that stands once in its table; without one they stay."""
    n = F.count("*").over(Window.partitionBy("table", "label"))
    anchor = F.last(F.when(F.col("n") == 1, F.col("label")), ignorenulls=True).over(Window.partitionBy("table").orderBy("r"))
    counted = rows.withColumn("n", n).withColumn("anchor", anchor)
    needed = (F.col("n") > 1) & F.col("anchor").isNotNull() & ~F.col("label").startswith(F.concat("anchor", F.lit(" | ")))
    return counted.select(*[c for c in rows.columns if c != "label"], F.when(needed, F.concat_ws(" | ", "anchor", "label")).otherwise(F.col("label")).alias("label"))


def long_relation(found: DataFrame) -> DataFrame:
    """grid, block, r, row_group, row_label, h, value, value_text: one row per value cell under a header.

    value is null for marks of missing values and for text such as ranges. A label that
    repeats in its block is qualified by the nearest one before it that doesn't, unless
    the labels are periods or stand in several columns.
    """
    data = found.where("part = 'data'")
    left = F.transform(F.filter("cells", lambda x: x["c"] < F.col("first_value")), lambda x: x["text"])
    named = data.select("grid", "block", "r", "group", "first_value", "cells", F.array_join(left, " | ").alias("label"), F.size(left).alias("n_labels"))
    whole = Window.partitionBy("grid", "block")
    hits = F.count(F.when(period_of(F.col("label")).isNotNull(), 1)).over(whole)
    named = named.withColumn("stays", (hits >= F.greatest(F.lit(3), 0.8 * F.count("*").over(whole))) | (F.max("n_labels").over(whole) > 1))
    again = qualified(named.withColumn("table", F.concat_ws("#", "grid", "block")))
    labels = again.select("grid", "block", "r", F.col("label").alias("qualified"))
    each = named.join(labels, ["grid", "block", "r"]).select(
        "grid", "block", "r", F.col("group").alias("row_group"), F.when(F.col("stays"), F.col("label")).otherwise(F.col("qualified")).alias("row_label"), "first_value", F.explode("cells").alias("x"),
    )
    values = each.where(F.col("x.c") >= F.col("first_value")).select("grid", "block", "r", "row_group", "row_label", F.col("x.c").alias("c"), F.col("x.text").alias("value_text"))
    under = headers(found).where(F.exists("h", lambda x: x.isNotNull()))
    value = F.when(~is_missing(F.col("value_text")), number_in(F.col("value_text")))
    return values.join(under, ["grid", "block", "c"]).select("grid", "block", "r", "c", "row_group", "row_label", "h", value.alias("value"), "value_text")


def typed_columns(cells: DataFrame) -> DataFrame:
    """table, name, type, n_filled: 'number' for a column whose cells are all numbers but for marks of missing values, else 'text'; cells (table, row_no, name, text)."""
    text = cell(F.col("text"))
    real = text.isNotNull() & ~is_missing(F.col("text"))
    g = cells.groupBy("table", "name").agg(F.count_if(real).alias("n_filled"), F.count_if(real & number_in(text).isNull()).alias("n_text"))
    return g.select("table", "name", F.when((F.col("n_filled") > 0) & (F.col("n_text") == 0), F.lit("number")).otherwise(F.lit("text")).alias("type"), "n_filled")


def rendered(rows: DataFrame, most: int = 40) -> DataFrame:
    """table, text: rows (table, r, line) as text; of more than `most` rows the first 5 and the last most - 5, with a line for those left out."""
    order = Window.partitionBy("table").orderBy("r")
    counted = rows.withColumns({"at": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("table"))})
    kept = counted.where((F.col("n") <= most) | (F.col("at") <= 5) | (F.col("at") > F.col("n") - (most - 5)))
    told = F.when((F.col("n") > most) & (F.col("at") == 5), F.concat(F.col("line"), F.lit("\n... ("), (F.col("n") - most).cast("string"), F.lit(" rows omitted)"))).otherwise(F.col("line"))
    return kept.groupBy("table").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", told.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def shown_cells(values: DataFrame, *names: str) -> DataFrame:
    """values with the named numbers as cells show them."""
    return reduce(lambda df, n: df.withColumn(n, shown_number(F.col(n))), names, values)
