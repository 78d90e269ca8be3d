"""Stay detection: chains without long gaps, a greedy scan in each, and figures of the stays."""

from __future__ import annotations

from math import asin, cos, radians, sin, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftline.functions.geo import MEAN_RADIUS_KM, mean_haversine_m, seconds_between
from driftline.functions.times import plus_seconds, to_local, zone_of
from driftline.operators import grouped

DEGREE = radians(1)
METRES_PER_DEGREE = MEAN_RADIUS_KM * 1000 * DEGREE
RADIUS_M, LEAST_MINUTES, CUT_HOURS, STEP_S = 200.0, 30.0, 18.0, 1200.0


def gap_chains(points: DataFrame, cut_hours: float | None = CUT_HOURS, keys: tuple[str, ...] = ("user_id",), pieces: int | None = None) -> DataFrame:
    """``chain``: a new chain where the gap to the previous point is longer than ``cut_hours``; None never cuts.

    ``pieces``, here and below: number of partitions, where the engine shouldn't choose it.
    """
    if cut_hours is None:
        return points.withColumn("chain", F.lit(0).cast("long"))
    points = points.repartition(pieces, *keys) if pieces else points
    order = Window.partitionBy(*keys).orderBy("datetime", "ord")
    cut = seconds_between(F.lag("datetime").over(order), F.col("datetime")) > cut_hours * 3600
    rows = points.withColumn("__cut", F.coalesce(cut, F.lit(False)).cast("long"))
    return rows.withColumn("chain", F.sum("__cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__cut")


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b = radians(lat1), radians(lat2)
    h = sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(radians(lon2 - lon1) / 2) ** 2
    return 2000 * MEAN_RADIUS_KM * asin(sqrt(min(1.0, max(0.0, h))))


def scan_windows(
    lat: list[float], lon: list[float], us: list[int], radius_m: float, least_minutes: float, anchor: bool
) -> list[tuple[int, int]]:
    """(first, last) of each stay in one chain.

    A window grows while the next point is within the radius of the mean so far
    (or of the first point).  When it ends, it is a stay if it spans enough
    time, and the scan goes on behind it, else at its second point.
    """
    found, start, n = [], 0, len(lat)
    # On a flat map, in degrees: away from the poles its distances are within two percent, and only those near the radius are worked out.
    reach = radius_m / METRES_PER_DEGREE
    inner, outer = (0.98 * reach) ** 2, (1.02 * reach) ** 2
    flat = radius_m <= 5000
    while start < n:
        total_lat, total_lon, end = lat[start], lon[start], start
        while end + 1 < n:
            size, y, x = end - start + 1, lat[end + 1], lon[end + 1]
            at_lat, at_lon = (lat[start], lon[start]) if anchor else (total_lat / size, total_lon / size)
            up, over, gap = y - at_lat, x - at_lon, -1.0
            if flat and -80 < y < 80 and -1 < up < 1 and -1 < over < 1:
                over *= cos(y * DEGREE)
                gap = up * up + over * over
            if not 0 <= gap < inner and (gap > outer or not _metres(at_lat, at_lon, y, x) <= radius_m):
                break
            end += 1
            total_lat, total_lon = total_lat + y, total_lon + x
        if us[end] - us[start] >= least_minutes * 60e6:
            found.append((start, end))
            start = end + 1
        else:
            start += 1
    return found


def stay_members(
    chains: DataFrame,
    radius_m: float = RADIUS_M,
    least_minutes: float = LEAST_MINUTES,
    anchor: bool = False,
    keys: tuple[str, ...] = ("user_id",),
    pieces: int | None = None,
) -> DataFrame:
    """The points that belong to a stay, with ``stay`` (number of its first point in the chain).

    The scan is sequential within a chain; chains are independent and are
    spread by (keys, chain), so a long history is not one task's.
    """
    group = [*keys, "chain"]

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        lat, lon, us = _arrays(table)
        stay = np.full(len(lat), -1, dtype=np.int64)
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(lat)], strict=True):
            for first, last in scan_windows(lat[lo:hi], lon[lo:hi], us[lo:hi], radius_m, least_minutes, anchor):
                stay[lo + first : lo + last + 1] = first + 1
        return table.append_column("stay", pa.array(stay)).filter(pa.array(stay >= 0))

    schema = T.StructType([*chains.schema.fields, T.StructField("stay", T.LongType())])
    return grouped.apply(chains, group, ["datetime", "ord"], run, schema, pieces)


def _arrays(table: pa.Table) -> list[list]:
    """``lat, lon`` and microseconds of points as plain numbers."""
    us = table.column("datetime").cast(pa.timestamp("us")).cast(pa.int64())
    return [table.column("lat").to_numpy().tolist(), table.column("lon").to_numpy().tolist(), us.to_numpy().tolist()]


def sweep(chains: DataFrame, settings: list[tuple[int, int]], pieces: int | None = None) -> DataFrame:
    """``user_id, radius_m, minutes, stays`` of chains under several settings (radius, minutes): points move once for all of them."""
    kind = chains.schema["user_id"].dataType.simpleString()

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        lat, lon, us = _arrays(table)
        found: list[tuple[int, int, int, int]] = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(lat)], strict=True):
            chain = lat[lo:hi], lon[lo:hi], us[lo:hi]
            found += [(lo, a, b, n) for a, b in settings if (n := len(scan_windows(*chain, a, b, False)))]
        first, radius, minutes, n = np.array(found, dtype=np.int64).reshape(-1, 4).T
        numbers = {"radius_m": pa.array(radius, pa.int32()), "minutes": pa.array(minutes, pa.int32()), "stays": pa.array(n)}
        return pa.table({"user_id": table.column("user_id").take(pa.array(first)), **numbers})

    rows = chains.select("user_id", "chain", "datetime", "ord", "lat", "lon")
    return grouped.apply(rows, ["user_id", "chain"], ["datetime", "ord"], run, f"user_id {kind}, radius_m int, minutes int, stays long", pieces)


def stays_of(members: DataFrame, keys: tuple[str, ...] = ("user_id",), pieces: int | None = None, gaps: bool = False) -> DataFrame:
    """One row per stay: times, mean position, points, mean altitude and observed minutes (steps up to 20 minutes).

    ``gaps`` adds a column of that name: the longer steps, as (start, end).
    """
    group = [*keys, "chain", "stay"]
    members = members.repartition(pieces, *group) if pieces else members
    before = F.lag("datetime").over(Window.partitionBy(*group).orderBy("datetime", "ord"))
    long = F.when(F.col("__step") > STEP_S, F.struct(F.col("__before").alias("start"), F.col("datetime").alias("end")))
    return (
        members.withColumn("__before", before)
        .withColumn("__step", seconds_between("__before", "datetime"))
        .groupBy(*group)
        .agg(
            F.min("datetime").alias("arrival"),
            F.max("datetime").alias("departure"),
            F.avg("lat").alias("lat"),
            F.avg("lon").alias("lon"),
            F.count(F.lit(1)).alias("num_points"),
            F.avg("altitude_m").alias("altitude_m"),
            (F.coalesce(F.sum(F.when(F.col("__step") <= STEP_S, F.col("__step"))), F.lit(0.0)) / 60).alias("observed_minutes"),
            *([F.collect_list(long).alias("gaps")] if gaps else []),
        )
        .withColumn("duration_minutes", seconds_between("arrival", "departure") / 60)
    )


def stay_points(
    points: DataFrame, radius_m: float = RADIUS_M, least_minutes: float = LEAST_MINUTES, anchor: bool = False, cut_hours: float | None = CUT_HOURS,
    pieces: int | None = None,
) -> DataFrame:
    """Stays of clean points; other columns of theirs don't move."""
    points = points.select("user_id", "datetime", "ord", "lat", "lon", "altitude_m")
    return stays_of(stay_members(gap_chains(points, cut_hours, pieces=pieces), radius_m, least_minutes, anchor, pieces=pieces), pieces=pieces)


def localized(stays: DataFrame) -> DataFrame:
    """``tz_name, arrival_local, departure_local`` by the stay's centre."""
    rows = stays.withColumn("tz_name", zone_of(F.col("lat"), F.col("lon")))
    return rows.withColumn("arrival_local", to_local(F.col("arrival"), F.col("tz_name"))).withColumn(
        "departure_local", to_local(F.col("departure"), F.col("tz_name"))
    )


def overnight(stays: DataFrame) -> DataFrame:
    """``overnight``: the first three o'clock at or after arrival is not after departure, in local time."""
    three = plus_seconds(F.to_date("arrival_local").cast("timestamp_ntz"), F.lit(3 * 3600))
    next_three = F.when(three >= F.col("arrival_local"), three).otherwise(plus_seconds(three, F.lit(86400)))
    return stays.withColumn("overnight", next_three <= F.col("departure_local"))


def gaps_in_stays(members: DataFrame) -> DataFrame:
    """Steps of more than 20 minutes inside stays, with their length in metres."""
    order = Window.partitionBy("user_id", "chain", "stay").orderBy("datetime", "ord")
    rows = members.withColumn("__p", F.lag(F.struct("datetime", "lat", "lon")).over(order))
    rows = rows.withColumn("gap_s", seconds_between("__p.datetime", "datetime"))
    return rows.filter(F.col("gap_s") > STEP_S).select(
        "user_id", "chain", "stay", F.col("__p.datetime").alias("gap_start"), F.col("datetime").alias("gap_end"), "gap_s",
        mean_haversine_m("__p.lat", "__p.lon", "lat", "lon").alias("jump_m"),
    )
