"""Streaming forms of the time-based operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_time(points: DataFrame, delay: str = "18 hours") -> DataFrame:
    """Points with a watermark; naive times are read as UTC, which watermarks need."""
    return points.withColumn("event_time", F.col("datetime").cast("timestamp")).withWatermark("event_time", delay)


def gap_sessions(points: DataFrame, gap: str = "18 hours") -> DataFrame:
    """Chains of one user without longer gaps: the streaming twin of the gap cut, exact at the boundary."""
    return (
        event_time(points, gap)
        .groupBy("user_id", F.session_window("event_time", gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("num_points"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))
    )


def unique_points(points: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Points without the repeats that a retrying sender makes."""
    return event_time(points, delay).dropDuplicatesWithinWatermark(["user_id", "source_file", "ord"])


def classify_jobs(stays: DataFrame, classify: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Classify each arriving batch of users and append results with their job state.

    A batch that is repeated after a failure overwrites its own folder.
    """

    def work(batch: DataFrame, number: int) -> None:
        valid = F.col("departure") > F.col("arrival")
        done = classify(batch.filter(valid)).withColumn("state", F.lit("completed"))
        done.write.mode("overwrite").parquet(f"{out}/results/batch={number}")
        failed = batch.filter(~F.coalesce(valid, F.lit(False))).select("user_id").distinct()
        failed.withColumn("state", F.lit("failed")).write.mode("overwrite").parquet(f"{out}/failed/batch={number}")

    return stays.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
