"""Streams of events and chunks: windowed rollups with late data, sessions, and upserts batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillhouse.operators.corpus import keep_latest


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_rollup(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count and mean value per window and event type; events later than ``late`` behind the newest are left out."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def session_rollup(events: DataFrame, pause: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Events per user and session, a session ending with a pause."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.session_window("ts", pause), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert_batches(target: str, keys: list[str], *order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps one Parquet version per batch under ``target``: rows of the batch replace those
    with the same keys. Version n is written from version n - 1, so that a repeated batch writes the same again."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = keep_latest(batch, keys, *[F.desc(c) for c in (order or batch.columns)])
        if number > 0:
            old = spark.read.parquet(f"{target}/version={number - 1}")
            fresh = old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)
        fresh.write.mode("overwrite").parquet(f"{target}/version={number}")

    return run
