"""Structured Streaming over event tables; an extension, as a stream reads one file after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The parquet files of a folder as a stream."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, every: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per window; with ``late`` a watermark that far behind."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", slide: str = "1 hour", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, last, n): events of a user without a gap that long. One that comes exactly a gap later begins
    the next session."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("ts").alias("last")).select("user_id", F.col("session_window.start").alias("start"), "last", "n")


def keep_latest(events: DataFrame, path: str, checkpoint: str, key: str = "event_id", at: str = "ts", buckets: int = 64):
    """A query that appends each micro-batch's latest row of every key, by the greatest ``at``, to a parquet table
    partitioned by batch and by a bucket of the key; :func:`latest` reads the current rows.

    A batch writes itself and nothing else, whatever the table holds, and writes the same files if it is run again."""
    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in (key, at)]
        new = batch.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("r")).select(key, "r.*")
        new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str, key: str = "event_id", at: str = "ts") -> DataFrame:
    """The current row of every key of a table :func:`keep_latest` writes; of equal times the later batch's."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rest = [c for c in rows.columns if c not in (key, at, "batch", "bucket")]
    return rows.groupBy(key).agg(F.max(F.struct(at, F.col("batch").alias("__b"), *rest)).alias("r")).select(key, F.col("r")[at].alias(at), *[F.col("r")[c].alias(c) for c in rest])


def compact(spark: SparkSession, path: str, into: str, key: str = "event_id", at: str = "ts", buckets: int = 64) -> None:
    """The current rows as a table of one batch, numbered before all others, in another folder: run now and then, while
    no stream writes."""
    latest(spark, path, key, at).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(f"{into}/batch=-1")


def append_log(events: DataFrame, path: str, checkpoint: str):
    """An append-only JSON log of a stream, exactly once."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
