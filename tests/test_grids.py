from pyspark.sql import functions as F

from gristmill.functions import text as t
from gristmill.operators import grids


def cells_of(spark, grid, name="g"):
    rows = [(name, r, c, str(v)) for r, row in enumerate(grid) for c, v in enumerate(row) if v is not None]
    return spark.createDataFrame(rows, "grid string, r int, c int, text string").withColumn("text", t.cell(F.col("text")))


CROSSTAB = [
    ["Table 4. Income of families", None, None, None, None],
    ["Thousands of crowns", None, None, None, None],
    [None, None, None, None, None],
    ["Kind of family", "2019", None, "2022", None],
    [None, "Median", "Mean", "Median", "Mean"],
    ["All families", "410.5", "865.72", "440", "901"],
    ["Percentile of income", None, None, None, None],
    ["Below 20", "9.8", "12", "10", "—"],
    ["90–100", "2,400", "5,100", "2600", "5,800"],
    ["Source: survey of families.", None, None, None, None],
]


def test_a_crosstab_becomes_a_long_relation(spark):
    cells = grids.filled_merged(cells_of(spark, CROSSTAB), spark.createDataFrame([("g", 3, 1, 3, 2), ("g", 3, 3, 3, 4)], "grid string, r0 int, c0 int, r1 int, c1 int"))
    found = grids.blocks(cells)
    parts = {r.r: r.part for r in found.collect()}
    assert parts == {0: "title", 1: "note", 3: "header", 4: "header", 5: "data", 6: "group", 7: "data", 8: "data", 9: "note"}
    rows = {(r.row_label, *r.h): (r.row_group, r.value, r.value_text) for r in grids.long_relation(found).collect()}
    assert rows["90–100", "2022", "Median"] == ("Percentile of income", 2600.0, "2600")
    assert rows["All families", "2019", "Mean"] == (None, 865.72, "865.72")
    assert rows["Below 20", "2022", "Mean"] == ("Percentile of income", None, "—")
    assert len(rows) == 12


def test_spanning_labels_spread_without_merged_cells(spark):
    labels = {r.c: r.label for r in grids.column_labels(grids.headers(grids.blocks(cells_of(spark, CROSSTAB)))).collect()}
    assert labels == {0: "Kind of family", 1: "2019 | Median", 2: "2019 | Mean", 3: "2022 | Median", 4: "2022 | Mean"}


def test_two_tables_in_one_grid_and_years_as_labels(spark):
    grid = [["Rates"], ["year", "low", "high"], ["2003", "1.5", "2"], ["2004", "n.a.", "3"], [None], [None], [None], ["Loans", "a", "b"], ["north", "7", "8"], ["south", "(9)", "5%"]]
    found = grids.blocks(cells_of(spark, grid))
    assert {r.r: (r.block, r.part) for r in found.collect() if r.part == "data"} == {2: (0, "data"), 3: (0, "data"), 8: (1, "data"), 9: (1, "data")}
    rows = {(r.row_label, r.h[0]): r.value for r in grids.long_relation(found).collect()}
    assert rows == {("2003", "low"): 1.5, ("2003", "high"): 2.0, ("2004", "low"): None, ("2004", "high"): 3.0, ("north", "a"): 7.0, ("north", "b"): 8.0, ("south", "a"): -9.0, ("south", "b"): 5.0}


def test_repeated_labels_take_the_nearest_single_one(spark):
    rows = [("t", i, x) for i, x in enumerate(["Growth", "June", "Prices", "June", "Rate"])] + [("u", 0, "Wages"), ("u", 1, "Wages")]
    got = {(r.table, r.r): r.label for r in grids.qualified(spark.createDataFrame(rows, "table string, r int, label string")).collect()}
    assert [got["t", i] for i in range(5)] == ["Growth", "Growth | June", "Prices", "Prices | June", "Rate"] and got["u", 1] == "Wages"


def test_long_tables_keep_both_ends(spark):
    rows = spark.createDataFrame([("t", i, f"row {i}") for i in range(30)] + [("u", 0, "only")], "table string, r int, line string")
    got = {r.table: r.text.split("\n") for r in grids.rendered(rows, 10).collect()}
    assert got["t"] == [f"row {i}" for i in range(5)] + ["... (20 rows omitted)"] + [f"row {i}" for i in range(25, 30)] and got["u"] == ["only"]


def test_a_declared_header_with_ranges(spark):
    grid = [["Variable", "June", "June", "March"], [None, "2026", "2027", "2026"], ["Growth", "1.8–2.0", "1.9", "2"], ["Range", None, None, None], ["June projection", "3.5–3.7", "—", "3"]]
    found = grids.forced_blocks(cells_of(spark, grid), spark.createDataFrame([("g", 2)], "grid string, header_rows int"))
    assert {r.r: r.part for r in found.collect()} == {0: "header", 1: "header", 2: "data", 3: "group", 4: "data"}
    rows = {(r.row_label, *r.h): (r.row_group, r.value, r.value_text) for r in grids.long_relation(found).collect()}
    assert rows["Growth", "June", "2026"] == (None, None, "1.8–2.0") and rows["June projection", "March", "2026"] == ("Range", 3.0, "3")


def test_a_continued_table_takes_the_header_before_it(spark):
    grid = [["Rates"], ["kind", "low", "high"], ["first", "1", "2"], [None], [None], [None], [None], ["second", "3", "4"]]
    found = grids.blocks(cells_of(spark, grid))
    rows = {(r.row_label, r.h[0]): r.value for r in grids.long_relation(grids.with_inherited_headers(found)).collect()}
    assert rows == {("first", "low"): 1.0, ("first", "high"): 2.0, ("second", "low"): 3.0, ("second", "high"): 4.0}


def test_years_and_quarters(spark):
    df = spark.createDataFrame([("2026", "3"), ("2026.0", "5"), (None, "1")], "y string, q string")
    assert [r[0] for r in df.select(grids.year_quarter(F.col("y"), F.col("q"))).collect()] == ["2026-Q3", None, None]


def test_no_cells(spark):
    assert grids.long_relation(grids.blocks(cells_of(spark, CROSSTAB).limit(0))).count() == 0


def test_text_functions(spark):
    labels = ["03:Q1", "201306.0", "2026 Q1", "2003-03-01", "2022.0", "Median", "Q2:1999", "6/30/2014", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "s string").select(t.period_of(F.col("s"))).collect()]
    assert got == ["2003-Q1", "2013-06", "2026-Q1", "2003-03-01", "2022", None, "1999-Q2", "2014-06-30", None]
    numbers = {"$1,200.5": 1200.5, "(3.5)": -3.5, "−2": -2.0, "12 %": 12.0, "1.3–1.8": None, "n/a": None, "": None, "1,00": None}
    got = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in numbers], "s string").select("s", t.number_in(F.col("s"))).collect()}
    assert got == numbers
    row = spark.createDataFrame([("A [D3, W1] b [D9] [W1; M2].", ["D3", "W1"], ["GDP %", "gdp", "GDP", "2020 rate", ""])], "a string, k array<string>, l array<string>").select(
        t.cited_ids(F.col("a")), t.known_citations(F.col("a"), F.col("k")), t.sql_names(F.col("l"))
    ).first()
    assert row[0] == ["D3", "W1", "D9", "M2"] and row[1] == "A [D3][W1] b  [W1]." and row[2] == ["gdp_pct", "gdp", "gdp_2", "c_2020_rate", "col"]
    noise = {"5 | 10 | 15": True, "Jan Feb": True, "percent of dollars": True, "Inflation rose to 3": False, "": True, "Q1 2024": True}
    got = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in noise], "s string").select("s", t.is_numeric_noise(F.col("s"))).collect()}
    assert got == noise
    row = spark.createDataFrame([("ﬁrst   cut−back­ é", ["pros-", "pects are", "good"], "10/1/2026 1:30 PM", '```json\n{"a": 1}\n```', "text [1, 2] none")], "a string, l array<string>, d string, j string, k string").select(
        t.normal_text(F.col("a")), t.joined_lines(F.col("l")), t.us_date(F.col("d")), t.repaired_json(F.col("j")), t.repaired_json(F.col("k"))
    ).first()
    assert tuple(row) == ("first cut-back é", "prospects are good", "2026-10-01", '{"a": 1}', None)
    shown = spark.createDataFrame([(12.0,), (0.123456789,), (0.0000123456,), (None,)], "v double").select(t.shown_number(F.col("v"))).collect()
    assert [r[0] for r in shown] == ["12", "0.123457", "1.23e-05", None]
