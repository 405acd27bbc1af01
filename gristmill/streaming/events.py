"""Streams of events: windows, sessions, keyed deduplication and upserts with Structured Streaming.

An extension: batch queries of the same results are the check. Events are rows with
a timestamp `ts`; what comes later than the watermark allows is left out in append
and update mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.session import cut_lineage, shared_folder

LATE = "10 minutes"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The rows of a folder's Parquet files of that name as a stream; ts becomes a timestamp with the session's zone."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str, *keys: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """Count and sum of values by window of a length, sliding ones where slide is given, and keys."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def sessions(events: DataFrame, gap: str, key: str, late: str = LATE) -> DataFrame:
    """Count of events by key and session: a session ends once nothing comes for `gap`."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))


def first_of_key(events: DataFrame, *keys: str, late: str = LATE) -> DataFrame:
    """The first row of every key within the watermark; its state goes once the watermark has passed it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is now and return its result as a table in the shared folder; with mode 'append' all batches together."""
    spark = stream.sparkSession
    parts: list[DataFrame] = []

    def keep(batch: DataFrame, _: int) -> None:
        if mode == "complete":
            parts.clear()
        parts.append(cut_lineage(batch))

    folder = f"{shared_folder(spark)}/stream-{id(stream)}"
    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
    out = parts[0] if parts else spark.createDataFrame([], stream.schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def upsert(target: DataFrame, batch: DataFrame, key: str, newest: str) -> DataFrame:
    """target with the rows of batch: the newest row of each key stays."""
    both = target.unionByName(batch, allowMissingColumns=True)
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), newest).alias("row")).select(key, "row.*")


def into(table: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends batches to a Parquet folder."""
    return lambda batch, _: batch.write.mode("append").parquet(table)
