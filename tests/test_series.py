from gristmill.operators import series


def points(spark, rows):
    return spark.createDataFrame(rows, "series string, date string, value double")


def test_changes_and_year_over_year(spark):
    p = points(spark, [("a", "2023-01", 100.0), ("a", "2024-01", 103.0), ("a", "2024-02", 104.0), ("b", "2024-01", 0.0), ("b", "2025-01", 1.0)])
    got = {(r.series, r.date): (r["diff"], r.pct) for r in series.changes(p).collect()}
    assert got[("a", "2024-01")] == (3.0, 3.0) and got[("b", "2025-01")] == (1.0, None)
    assert [tuple(r) for r in series.year_over_year(p).collect()] == [("a", "2024-01", 3.0)]


def test_change_points_sampling_and_summary(spark):
    rows = [("s", f"{i:04d}", 5.0 if i < 26 else 4.0 if i < 30 else 3.0) for i in range(40)]
    p = points(spark, rows)
    assert sorted(r.date for r in series.change_points(p).collect()) == ["0026", "0030"]
    assert sorted(r.date for r in series.sampled(p).collect()) == [f"{i:04d}" for i in range(0, 40, 2)] + ["0039"]
    s = series.summary(p).first()
    assert (s.first, s.last, s.low_date, s.high_date, s.change, s.change_pct) == (5.0, 3.0, "0030", "0000", -2.0, -40.0)


def test_as_of(spark):
    rows = spark.createDataFrame([("a", "1", 10), ("a", "3", 11), ("a", "5", 12)], "series string, date string, key int")
    got = series.as_of(rows, points(spark, [("a", "2", 1.0), ("a", "5", 2.0)])).collect()
    assert {r.key: r.as_of for r in got} == {10: None, 11: 1.0, 12: 2.0}


def test_as_of_with_ties_nulls_and_no_points(spark):
    rows = spark.createDataFrame([("s", "2024-01-02", 1), ("s", "2024-01-05", 2), ("s", "2023-12-31", 3), ("s", None, 4), ("t", "2024-01-02", 5)], "series string, date string, id int")
    points = spark.createDataFrame([("s", "2024-01-01", 1.0), ("s", "2024-01-05", 2.0), ("s", "2024-01-05", 3.0), ("s", None, 9.0)], "series string, date string, value double")
    assert {r.id: r.as_of for r in series.as_of(rows, points).collect()} == {1: 1.0, 2: 3.0, 3: None, 4: None, 5: None}


def test_a_step_series_shows_its_changes(spark):
    rows = [("step", f"2025-{1 + i // 28:02d}-{1 + i % 28:02d}", 4.0 if i < 260 else 3.5 if i < 300 else 3.0) for i in range(330)] + [("short", f"2025-01-{i + 1:02d}", float(i)) for i in range(5)]
    points = spark.createDataFrame(rows, "series string, date string, value double")
    got = {r.series: (r.shows, r.n_changes) for r in series.described(points).collect()}
    assert got == {"step": ("changes", 2), "short": ("sample", 4)}
