"""Jumps of a recording, and what lies between a jump out and the jump back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.functions.geo import CLEANING_RADIUS_M, haversine_m, seconds_between, speed_kmh
from driftline.operators import grouped
from driftline.operators.cleaning import FILE, LIMITS, Thresholds


def _metres(lat1: float, lon1: float, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * CLEANING_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def excursions(points: DataFrame, limits: Thresholds = LIMITS) -> DataFrame:
    """Impossible steps of each recording, each with the first later unused one whose landing its start can reach.

    ``user_id, source_file, ord`` (of the point before the jump), ``kind`` (excursion,
    or one_sided without a way back), ``first_moved, last_moved`` (places of the moved
    points in the recording), ``start, end`` (their times), ``n_points, minutes, jump_km, jump_s``.
    Only the impossible steps of a recording, a few of its points, come together; many recordings share one Python call.
    """
    order = Window.partitionBy(*FILE).orderBy("datetime", "ord")
    spot = F.struct("datetime", "lat", "lon")
    rows = points.withColumns(
        {
            "rn": F.row_number().over(order),
            "next": F.lead(spot).over(order),
            "last": F.max(F.struct("datetime", "ord")).over(Window.partitionBy(*FILE)),
            "n": F.count(F.lit(1)).over(Window.partitionBy(*FILE)),
        }
    )
    metres = haversine_m("lat", "lon", "next.lat", "next.lon")
    seconds = seconds_between("datetime", "next.datetime")
    jumps = rows.withColumns({"m": metres, "dt": seconds}).filter(speed_kmh(F.col("m"), F.col("dt")) > limits.impossible_kmh)
    jumps = jumps.select(
        *FILE, "ord", "rn", "n", F.col("datetime").alias("t"), "lat", "lon", F.col("next.datetime").alias("t_next"),
        F.col("next.lat").alias("lat_next"), F.col("next.lon").alias("lon_next"), F.col("last.datetime").alias("t_last"), "m", "dt",
    )


    def pair(table: pa.Table, starts: np.ndarray) -> pa.Table:
        us, us_next, us_last = (table[c].cast(pa.timestamp("us")).cast(pa.int64()).to_numpy() for c in ("t", "t_next", "t_last"))
        t, t_next = us / 1e6, us_next / 1e6
        lat, lon, lat_next, lon_next = (table[c].to_numpy() for c in ("lat", "lon", "lat_next", "lon_next"))
        back = np.full(len(t), -1)
        used = np.zeros(len(t), dtype=bool)
        for first, end in zip(starts.tolist(), [*starts[1:].tolist(), len(t)], strict=True):
            for i in range(first, end):
                if used[i]:
                    continue
                # Most ways back are near: a few jumps are looked at first, then more and more of them.
                lo, step = i + 1, 16
                while lo < end and back[i] < 0:
                    hi = min(end, lo + step)
                    metres = _metres(lat[i], lon[i], lat_next[lo:hi], lon_next[lo:hi])
                    good = ~used[lo:hi] & (metres / np.maximum(t_next[lo:hi] - t[i], 1e-9) * 3.6 <= limits.impossible_kmh)
                    if good.any():
                        back[i] = lo + int(good.argmax())
                        used[back[i]] = True
                    lo, step = hi, min(2 * step, 65_536)
        made = np.flatnonzero(~used)
        row, home = table.take(pa.array(made)), back[made]
        there = home >= 0
        other = table.take(pa.array(np.where(there, home, made)))
        mask = pa.array(there)
        end, stop = pc.if_else(mask, other["rn"], row["n"]), pc.if_else(mask, other["t"], row["t_last"])
        minutes = (np.where(there, us[home], us_last[made]) - us_next[made]) / 1e6 / 60
        values = [
            row["user_id"], row["source_file"], row["ord"], pc.if_else(mask, "excursion", "one_sided"), pc.add(row["rn"], 1), end, row["t_next"], stop,
            pc.subtract(end, row["rn"]), pa.array(minutes), pc.divide(row["m"], 1000.0), row["dt"],
        ]
        return pa.table(values, names=_NAMES)

    kept = jumps.withColumns({"rn": F.col("rn").cast("long"), "n": F.col("n").cast("long")})
    return grouped.apply(kept, FILE, ["rn"], pair, _schema(points))


_NAMES = ["user_id", "source_file", "ord", "kind", "first_moved", "last_moved", "start", "end", "n_points", "minutes", "jump_km", "jump_s"]


def _schema(points: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    own = [kinds["user_id"], kinds["source_file"], kinds["ord"], "string", "long", "long", "timestamp_ntz", "timestamp_ntz", "long", "double", "double", "double"]
    return ", ".join(f"`{n}` {k}" for n, k in zip(_NAMES, own, strict=True))


def _ends(lat: np.ndarray, lon: np.ndarray, radius_m: float) -> tuple[int, int, int, int]:
    """First and last place, from 1, after one cut and after the last."""
    a, b = 0, len(lat) - 1
    once = None
    while True:
        far = _metres(lat[a : b + 1].mean(), lon[a : b + 1].mean(), lat, lon) > radius_m
        before = (a, b)
        while a < b and far[a]:
            a += 1
        while b > a and far[b]:
            b -= 1
        once = once or (a, b)
        if before == (a, b):
            return once[0] + 1, once[1] + 1, a + 1, b + 1


def trimmed(members: DataFrame, radius_m: float = 200.0) -> DataFrame:
    """``user_id, chain, stay, once_first, once_last, first, last``: the places among a stay's points that are left.

    Ends beyond the radius of the mean are cut once, and then again until the
    mean of what is left holds both.  Many stays share one Python call.
    """
    kind = members.schema["user_id"].dataType.simpleString()

    def cut(table: pa.Table, starts: np.ndarray) -> pa.Table:
        lat, lon = (table[c].to_numpy() for c in ("lat", "lon"))
        found = np.array([_ends(lat[i:j], lon[i:j], radius_m) for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(lat)], strict=True)], dtype=np.int64)
        out = table.select(["user_id", "chain", "stay"]).take(pa.array(starts))
        for i, name in enumerate(("once_first", "once_last", "first", "last")):
            out = out.append_column(name, pa.array(found[:, i]))
        return out

    rows = members.select("user_id", "chain", "stay", "datetime", "ord", "lat", "lon")
    schema = f"user_id {kind}, chain long, stay long, once_first long, once_last long, first long, last long"
    return grouped.apply(rows, ["user_id", "chain", "stay"], ["datetime", "ord"], cut, schema)
