"""Writers of clean points, stays and quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_points(points: DataFrame, path: str) -> None:
    """One folder a user, each file in order of recording and time; salted by file so a long history isn't one task's."""
    ordered = points.repartition("user_id", "source_file").sortWithinPartitions("user_id", "source_file", "datetime", "ord")
    ordered.write.mode("overwrite").option("compression", "snappy").partitionBy("user_id").parquet(path)


def write_stays(stays: DataFrame, processed_users: DataFrame, path: str) -> None:
    """Stays by user, and a manifest of all users processed: a user without stays has no folder."""
    stays.repartition("user_id").write.mode("overwrite").partitionBy("user_id").parquet(f"{path}/stays")
    processed_users.select("user_id").distinct().write.mode("overwrite").parquet(f"{path}/processed_users")


def write_quarantine(rows: DataFrame, path: str) -> None:
    """CSV with a header, in order of recording and time within each file."""
    rows.sortWithinPartitions("user_id", "source_file", "datetime").write.mode("overwrite").option("header", "true").csv(path)
