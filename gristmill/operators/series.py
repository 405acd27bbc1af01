"""Time series: changes, growth, change points, down-sampling, summaries and as-of values.

Series are (series, date, value) with a date text that sorts; windows are
partitioned by series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order():
    return Window.partitionBy("series").orderBy("date")


def changes(points: DataFrame) -> DataFrame:
    """diff and pct against the previous row; null for the first, pct also after a zero."""
    before = F.lag("value").over(_order())
    rows = points.withColumn("before", before).where(F.col("before").isNotNull())
    return rows.select("series", "date", F.round(F.col("value") - F.col("before"), 6).alias("diff"), F.round(F.try_divide(F.col("value"), F.col("before")) * 100 - 100, 6).alias("pct"))


def year_over_year(points: DataFrame) -> DataFrame:
    """yoy in percent against the same date text a year before; dates without one, and zero values there, drop out."""
    last = points.select("series", F.concat(F.lpad((F.substring("date", 1, 4).cast("int") + 1).cast("string"), 4, "0"), F.expr("substring(date, 5)")).alias("date"), F.col("value").alias("past"))
    return points.join(last.where("past <> 0"), ["series", "date"]).select("series", "date", F.round(F.col("value") / F.col("past") * 100 - 100, 6).alias("yoy"))


def change_points(points: DataFrame) -> DataFrame:
    """Rows whose value differs from the one before, with it."""
    return points.withColumn("before", F.lag("value").over(_order())).where("before <> value").select("series", "date", "before", "value")


def sampled(points: DataFrame, most: int = 24) -> DataFrame:
    """Every ceil(n / most)-th row of each series, and its last."""
    whole = Window.partitionBy("series")
    rows = points.withColumns({"n": F.count("*").over(whole), "at": F.row_number().over(_order())})
    return rows.where((F.pmod(F.col("at") - 1, F.ceil(F.col("n") / most)) == 0) | (F.col("at") == F.col("n"))).select("series", "date", "value")


def summary(points: DataFrame) -> DataFrame:
    """n, first, last, low and high with their first dates, mean and the change in absolute terms and percent (null from zero)."""
    g = points.groupBy("series").agg(
        F.count("value").alias("n"), F.min_by("value", "date").alias("first"), F.max_by("value", "date").alias("last"),
        F.min("value").alias("low"), F.min_by("date", F.struct("value", "date")).alias("low_date"), F.max("value").alias("high"),
        F.min_by("date", F.struct(-F.col("value"), F.col("date"))).alias("high_date"), F.round(F.avg("value"), 6).alias("mean"),
    )
    change = F.col("last") - F.col("first")
    return g.withColumns({"change": F.round(change, 6), "change_pct": F.round(F.try_divide(change, F.col("first")) * 100, 6)})


def as_of(rows: DataFrame, points: DataFrame) -> DataFrame:
    """rows (series, date, ...) with the value of the latest point on or before their date, null before the first and for null dates.

    The points are carried forward over the different dates that rows have, which are
    few however many rows there are; rows then meet them by series and date alone, so
    no row enters a window. Of several points of one date the greatest value holds.
    """
    once = points.where("date is not null").groupBy("series", "date").agg(F.max("value").alias("value"))
    asked = rows.where("date is not null").select("series", "date").distinct()
    order = Window.partitionBy("series").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = asked.join(once, ["series", "date"], "full").withColumn("as_of", F.last("value", ignorenulls=True).over(order))
    return rows.join(filled.select("series", "date", "as_of"), ["series", "date"], "left")


def described(points: DataFrame, is_rate: bool = False, most: int = 24, changes_at_most: int = 40) -> DataFrame:
    """summary with `points_change` for rates (percentage points), and which rows tell a series best: its changes or a sample of it.

    A long series with few changes is a step series: `shows` is 'changes', else 'sample'.
    """
    counts = change_points(points).groupBy("series").agg(F.count("*").alias("n_changes"))
    found = summary(points).join(counts, "series", "left").fillna(0, ["n_changes"])
    steps = (F.col("n") > most) & (F.col("n_changes") <= changes_at_most)
    named = found.withColumn("shows", F.when(steps, F.lit("changes")).otherwise(F.lit("sample")))
    return named.drop("change_pct").withColumnRenamed("change", "points_change") if is_rate else named
