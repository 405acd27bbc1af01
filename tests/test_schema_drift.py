import itertools
import json

import numpy as np

from gristmill.operators import schema_drift as sd


def test_assignment_is_cheapest():
    rng = np.random.default_rng(1)
    for n in range(1, 6):
        cost = rng.random((n, n)).round(3)
        to = sd.assignment(cost)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert sorted(to) == list(range(n)) and abs(sum(cost[i, to[i]] for i in range(n)) - best) < 1e-9


def tables(spark, shift):
    col = lambda n, t: (n, None, t, None)
    cols = "array<struct<name:string,label:string,type:string,examples:array<string>>>"
    catalog = [
        ("t_2020", "d1", [col("period", "text"), col("rate", "number"), col("old", "number")], {}, "table"),
        ("t_2021", "d2", [col("period", "text"), col("bank_rate", "text"), col("fresh", "number")], {}, "table"),
        ("t_2021", "d2", [col("period", "text"), col("bank_rate", "text"), col("fresh", "number")], {}, None),
        (None, "d2", None, None, "view"),
    ]
    catalog = spark.createDataFrame(catalog, f"table string, doc_id string, columns {cols}, header_values map<string,array<string>>, kind string")
    docs = spark.createDataFrame([("d1", "2020-01-01", None), ("d2", "2021-01-01", None)], "doc_id string, sort_date string, retrieved_at timestamp")
    rec = [("t_2020", i, json.dumps({"period": f"p{i}", "rate": str(i + 0.5), "old": str(i * 7)})) for i in range(6)]
    rec += [("t_2021", i, json.dumps({"fresh": str(100 + i), "period": f"p{i}", "bank_rate": str(i + shift)})) for i in range(6)] + [("t_2021", 9, "no object"), (None, 1, None)]
    records = spark.createDataFrame([(*r, None) for r in rec], "table string, row_no int, record string, loaded_at timestamp")
    return catalog, docs, records


def test_changes_follow_the_values(spark):
    got = {tuple(r)[2:] for r in sd.schema_changes(*tables(spark, 0.5)).collect()}
    assert got == {("renamed", "rate", "bank_rate"), ("retyped", "rate", "bank_rate"), ("removed", "old", ""), ("added", "", "fresh")}
    got = {tuple(r)[2:] for r in sd.schema_changes(*tables(spark, 50.0)).collect()}
    assert got == {("removed", "rate", ""), ("added", "", "bank_rate"), ("removed", "old", ""), ("added", "", "fresh")}


def test_unified_rows_use_the_latest_names_and_types(spark):
    rows = {(r.table, r.row_no): r.fields for r in sd.unified_series(*tables(spark, 0.5)).collect()}
    got = {k: (v["type"], v["number"], v["text"]) for k, v in rows["t_2020", 1].items()}
    assert got == {"period": ("text", None, "p1"), "bank_rate": ("text", None, "1.5"), "old": ("number", 7.0, "7")}
    table = sd.series_table(sd.unified_series(*tables(spark, 0.5)), "t_", {"bank_rate": "text", "old": "number"})
    assert dict(table.dtypes)["old"] == "double" and {r.old for r in table.where("table = 't_2020'").collect()} == {float(7 * i) for i in range(6)}


def test_a_column_that_becomes_a_level_moves():
    a = {"columns": [{"name": "row_label", "type": "text"}, {"name": "new_loans", "type": "number"}], "levels": [{"level": "h1", "values": ["total"]}]}
    b = {"columns": [{"name": "row_label", "type": "text"}], "levels": [{"level": "h1", "values": ["total", "new loans"]}]}
    assert ("moved", "new_loans", "h1=new loans") in sd.tree_script(a, b, {})
    assert ("moved", "h1=new loans", "new_loans") in sd.tree_script(b, a, {})
    two = {"columns": [], "levels": [{"level": "h1", "values": ["a"]}, {"level": "h2", "values": ["x", "y"]}]}
    other = {"columns": [], "levels": [{"level": "h1", "values": ["a", "y"]}, {"level": "h2", "values": ["x"]}]}
    assert set(sd.tree_script(two, other, {})) == {("same", "h1=a", "h1=a"), ("same", "h2=x", "h2=x"), ("moved", "h2=y", "h1=y")}


def test_distance_is_the_cheapest_script():
    col = lambda n, t="number": {"name": n, "type": t}
    a, b = {"columns": [col("x"), col("y"), col("z")], "levels": []}, {"columns": [col("y", "text"), col("w"), col("v")], "levels": []}
    seen = {("x", "w"): (10, 9), ("x", "v"): (10, 6), ("z", "v"): (10, 7)}
    cost, _ = sd.match_forests(sd.schema_tree(a).children, sd.schema_tree(b).children, seen)
    assert abs(cost - (0.5 + 0.01 + 0.5 + 0.03)) < 1e-9
    assert set(sd.tree_script(a, b, seen)) == {("renamed", "x", "w"), ("renamed", "z", "v"), ("same", "y", "y"), ("retyped", "y", "y")}


def test_empty_tables(spark):
    assert sd.schema_changes(*[t.limit(0) for t in tables(spark, 0.5)]).count() == 0
