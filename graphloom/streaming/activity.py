"""Behaviour events as a stream: activity windows, latest preferences, sessions.

An addition to the batch operators. Events carry ``ts`` (a timestamp), ``user_id``,
``event_type`` and ``event_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.scratch import settled

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream of events."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def activity_windows(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts per window and event type, each event id once, rows later than ``late`` left out."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user: start, end and number of events."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_k", k).filter("_k = 1").drop("_k")


def upsert_batches(events: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Keep the latest event per user and type under ``path``, partitioned by a hash of the user.

    A micro-batch writes the buckets that it touches anew, each once, from what the table
    had before and the new events; a batch that is run again gives the same table, and
    the number of batches before it doesn't matter.
    """
    keep, columns = ["user_id", "event_type"], ["user_id", "event_type", "event_id", "ts"]

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = settled(batch.select(*columns, F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int").alias("bucket")), "batch")
        table = spark._jvm.org.apache.hadoop.fs.Path(path)
        if table.getFileSystem(spark._jsc.hadoopConfiguration()).exists(table):
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
            new = settled(spark.read.parquet(path).filter(F.col("bucket").isin(touched)).select(*columns, "bucket").unionByName(new), "merged")
        latest(new, keep, "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cold_users(events: DataFrame, least: int = 3) -> DataFrame:
    """Running number of events per user, with the flag that recommenders use for cold users (in update mode)."""
    return events.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("cold", F.col("n") < least)
