"""Trace sources: GPS log files, label files, and the projection of an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.times import plus_seconds

HEADER_LINES = 6
BURST_POINTS, BURST_STEP_S = 9, 300


def parse_plt(lines: DataFrame) -> DataFrame:
    """Points of log lines ``(file, ord, line)``, ``ord`` from 0 in each file.

    Six header lines, then latitude, longitude, reserved, altitude in feet, day
    number, date and time.  Lines without a valid time are dropped; a coordinate
    or altitude that isn't a number is null, for the bounds filter to judge.
    Files are named ``.../<user>/Trajectory/<file>.plt``.
    """
    part = F.split("line", ",")
    parts = F.split("file", "/")
    number = [F.expr(f"try_cast(get(split(line, ','), {i}) AS double)") for i in (0, 1, 3)]
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.get(part, 5), F.trim(F.get(part, 6))), F.lit("yyyy-MM-dd HH:mm:ss"))
    return (
        lines.filter(F.col("ord") >= HEADER_LINES)
        .select(
            F.element_at(parts, -3).alias("user_id"),
            F.element_at(parts, -1).alias("source_file"),
            F.col("ord").cast("long").alias("ord"),
            stamp.cast("timestamp_ntz").alias("datetime"),
            number[0].alias("lat"),
            number[1].alias("lon"),
            number[2].alias("altitude"),
        )
        .filter("datetime IS NOT NULL")
    )


def read_plt(spark: SparkSession, path: str) -> DataFrame:
    """Points of all ``.plt`` logs below ``path``, see :func:`parse_plt`; a log is one row while it is split into lines."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.plt", recursiveFileLookup=True)
    files = files.select("value", F.col("_metadata.file_path").alias("file"))
    return parse_plt(files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("ord", "line")))


def users_below(spark: SparkSession, path: str) -> DataFrame:
    """``user_id, files`` of every user with logs below ``path``, without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.plt").option("recursiveFileLookup", "true").load(path)
    user = F.element_at(F.split("path", "/"), -3).alias("user_id")
    return found.select(user).groupBy("user_id").agg(F.count(F.lit(1)).alias("files"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label intervals: tab-separated start, end and mode after one header line; bad rows are dropped."""
    rows = spark.read.option("sep", "\t").option("header", "true").csv(path).toDF("start", "end", "mode")
    when = {c: F.try_to_timestamp(c, F.lit("yyyy/MM/dd HH:mm:ss")).cast("timestamp_ntz") for c in ("start", "end")}
    return rows.withColumns(when).dropna()


def _events(events: DataFrame) -> DataFrame:
    start = F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return events.select(
        "event_id",
        "user_id",
        "event_type",
        start.alias("start"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long")).alias("k"),
    )


def points_of_events(events: DataFrame) -> DataFrame:
    """Each event as a burst of nine points five minutes apart, at a place that follows its local hour.

    Views move on, purchases hold a spike, errors repeat a second with another position.
    A recording is a day of a user, but one event in twenty is a recording of its own that two users hold.
    """
    e = _events(events)
    local = plus_seconds(F.col("start"), F.lit(8 * 3600))
    hour = F.hour(local)
    place = (
        F.when((hour >= 22) | (hour < 8), 0)
        .when((F.weekday(local) < 5) & (hour >= 9) & (hour < 18), 1)
        .otherwise(2 + F.col("k") % 3)
    )
    i = F.col("i")
    pid = F.col("event_id") * 10 + i
    lat = (
        39.80
        + (F.col("user_id") % 20) * 0.01
        + F.col("place") * 0.02
        + ((pid * 7919) % 200 - 100) * 0.000004
        + F.when(F.col("event_type") == "view", i * 0.004).otherwise(0.0)
        + F.when((F.col("event_type") == "purchase") & (i == 4), 8.0).otherwise(0.0)
    )
    lon = 116.20 + (F.col("user_id") % 15) * 0.01 + F.col("place") * 0.015
    # The extra rows of repeated seconds are generated with the rest: one pass, no union.
    copies = F.when((F.col("event_type") == "error") & (i == 3), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    shift = F.when(pid % 3 == 0, 0.0001).when(pid % 3 == 1, 0.004).otherwise(9.0)
    apart = F.col("event_id") % 20 == 7
    mate = F.when(F.col("event_id") % 40 == 7, 1).otherwise(2).cast("long")
    owners = F.when(apart, F.array("user_id", F.col("user_id").bitwiseXOR(mate))).otherwise(F.array("user_id"))
    rows = e.withColumn("place", place).select("*", F.explode(owners).alias("owner"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(BURST_POINTS - 1))).alias("i"))
    rows = rows.select("*", F.explode(copies).alias("again"))
    when = plus_seconds(F.col("start"), i * BURST_STEP_S)
    return rows.select(
        F.col("owner").alias("user_id"),
        F.when(apart, F.concat(F.lit("S"), "event_id")).otherwise(F.date_format(when, "yyyyMMdd")).alias("source_file"),
        (pid + F.col("again") * 5_000_000_000).alias("ord"),
        when.alias("datetime"),
        (lat + F.when(F.col("again") == 1, shift).otherwise(0.0)).alias("lat"),
        lon.alias("lon"),
        F.when(F.col("k") % 7 == 0, -777.0).otherwise(100.0 + F.col("k")).alias("altitude"),
    )


def labels_of_events(events: DataFrame) -> DataFrame:
    """A label interval of 40 minutes for each event, with its type as mode."""
    e = _events(events)
    return e.select(
        "user_id",
        F.col("event_id").alias("label_id"),
        "start",
        plus_seconds(F.col("start"), F.lit(2400)).alias("end"),
        F.col("event_type").alias("mode"),
    )


def content_hashes(points: DataFrame) -> DataFrame:
    """``user_id, source_file, start, end, n_points, print``: MD5 of each recording's points in order, whoever holds it."""
    micro = [F.round(F.col(c) * 1e6).cast("long").cast("string") for c in ("lat", "lon")]
    row = F.concat_ws(",", F.date_format("datetime", "yyyyMMddHHmmss"), *micro, F.round(F.col("altitude") * 10).cast("long").cast("string"))
    return (
        points.groupBy("user_id", "source_file")
        .agg(
            F.min("datetime").alias("start"),
            F.max("datetime").alias("end"),
            F.count(F.lit(1)).alias("n_points"),
            F.array_sort(F.collect_list(F.struct("datetime", "ord", row.alias("row")))).alias("rows"),
        )
        .withColumn("print", F.md5(F.array_join("rows.row", "|").cast("binary")))
        .drop("rows")
    )
