"""Time and time-zone column functions; times are naive UTC unless named local."""

from __future__ import annotations

from functools import cache
from importlib.resources import files

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Boxes (lat_min, lat_max, lon_min, lon_max, zone) that lie wholly inside one zone; they spare the search.
CERTAIN = [
    (24.5, 41.0, 102.0, 119.0, "Asia/Shanghai"),
    (33.0, 41.0, -121.0, -115.0, "America/Los_Angeles"),
]
#: Cities of countries that reach far from the place their zone is named after.
CITIES = """
Asia/Shanghai 45.75 126.65, 41.80 123.43, 43.88 125.32, 38.91 121.60, 30.66 104.07, 25.04 102.72, 23.13 113.26, 22.54 114.06, 20.04 110.34, 24.48 118.09, 36.06 103.83, 29.65 91.13, 22.82 108.32, 25.27 110.29, 40.82 111.65, 49.21 119.77, 36.62 101.77
Asia/Kolkata 28.61 77.21, 19.08 72.88, 13.08 80.27, 12.97 77.59, 17.38 78.48, 23.02 72.57, 26.91 75.79, 31.63 74.87, 34.08 74.80, 8.52 76.94, 26.14 91.74, 26.85 80.95, 25.32 82.99
Asia/Tokyo 43.06 141.35, 34.69 135.50, 33.59 130.40, 26.21 127.68, 38.27 140.87, 31.60 130.56
Asia/Seoul 35.18 129.08, 33.50 126.53
Asia/Bangkok 18.79 98.98, 7.88 98.39, 17.41 102.79, 15.23 104.86
Asia/Ho_Chi_Minh 21.03 105.85, 16.05 108.20
Asia/Phnom_Penh 13.36 103.86, 11.56 104.92
Asia/Jakarta 3.59 98.67, -7.26 112.75, -0.95 100.35
Asia/Manila 10.32 123.89, 7.07 125.61
Europe/Berlin 48.14 11.58, 53.55 9.99, 50.94 6.96, 50.11 8.68, 48.78 9.18, 51.05 13.74, 49.45 11.08
Europe/Paris 45.76 4.84, 43.30 5.37, 44.84 -0.58, 47.22 -1.55, 43.60 1.44, 48.57 7.75, 50.63 3.06
Europe/London 53.48 -2.24, 55.95 -3.19, 54.60 -5.93, 51.45 -2.59, 57.15 -2.09
Europe/Madrid 41.39 2.17, 37.39 -5.99, 39.47 -0.38, 43.26 -2.93
Europe/Rome 45.46 9.19, 40.85 14.27, 38.12 13.36, 45.44 12.32, 43.77 11.26
Europe/Warsaw 50.06 19.94, 54.35 18.65, 51.11 17.03
Europe/Stockholm 57.71 11.97, 55.60 13.00, 65.58 22.15
Europe/Oslo 60.39 5.32, 69.65 18.96, 63.43 10.40
Europe/Istanbul 39.93 32.86, 38.42 27.14, 37.00 35.32
Europe/Moscow 59.93 30.34, 56.33 44.00, 47.24 39.71, 64.54 40.52
America/New_York 42.36 -71.06, 38.91 -77.04, 39.95 -75.17, 33.75 -84.39, 25.76 -80.19, 28.54 -81.38, 41.50 -81.69, 35.23 -80.84, 40.44 -79.99, 39.96 -82.99
America/Chicago 29.76 -95.37, 32.78 -96.80, 44.98 -93.27, 29.95 -90.07, 38.63 -90.20, 36.16 -86.78, 39.10 -94.58, 30.27 -97.74, 35.15 -90.05, 41.26 -95.93
America/Denver 40.76 -111.89, 35.08 -106.65, 43.62 -116.20, 45.78 -108.50
America/Phoenix 32.22 -110.97
America/Los_Angeles 37.77 -122.42, 47.61 -122.33, 45.52 -122.68, 36.17 -115.14, 32.72 -117.16, 39.53 -119.81
America/Toronto 45.50 -73.57, 45.42 -75.70, 46.81 -71.21
America/Vancouver 48.43 -123.37, 53.92 -122.75
America/Mexico_City 20.67 -103.35, 19.04 -98.21, 17.07 -96.72
America/Sao_Paulo -22.91 -43.17, -15.79 -47.88, -19.92 -43.94, -30.03 -51.23, -25.43 -49.27
America/Argentina/Buenos_Aires -32.95 -60.64, -38.00 -57.56
Australia/Sydney -35.28 149.13, -32.93 151.78
Africa/Johannesburg -33.92 18.42, -29.86 31.02
Africa/Lagos 9.06 7.49, 12.00 8.52
Africa/Cairo 31.20 29.92, 24.09 32.90
"""
UNKNOWN_ZONE = "Etc/UTC"


@cache
def zone_places() -> list[tuple[float, float, str]]:
    """(lat, lon, zone) of the places that zones are named after, from the public time zone tables, and of ``CITIES``."""
    found = []
    try:
        listed = files("tzdata.zoneinfo").joinpath("zone1970.tab").read_text().splitlines()
    except (ModuleNotFoundError, FileNotFoundError):
        listed = []  # the tables aren't installed: cities alone

    def degrees(text: str) -> float:
        sign, digits = (-1 if text[0] == "-" else 1), text[1:]
        whole = len(digits) - (4 if len(digits) > 5 else 2)
        return sign * (int(digits[:whole]) + int(digits[whole : whole + 2]) / 60)

    for line in listed:
        if not line.startswith("#"):
            place, zone = line.split("\t")[1:3]
            cut = max(place.rfind("+"), place.rfind("-"))
            found.append((degrees(place[:cut]), degrees(place[cut:]), zone))
    for line in CITIES.split("\n"):
        zone, _, spots = line.partition(" ")
        found += [(float(y), float(x), zone) for y, x in (spot.split() for spot in spots.split(", ") if spot)]
    return found


def zone_of(lat: Column, lon: Column, places: list[tuple[float, float, str]] | None = None) -> Column:
    """Zone name of a position, by its cell of a hundredth of a degree (half-even rounding).

    It is the zone of the nearest of ``places``; boxes inside one zone are
    answered at once.  Without a position it is ``UNKNOWN_ZONE``.  Near a border
    the nearest place may lie beyond it: pass more places where that matters.
    """
    y, x = F.bround(lat, 2), F.bround(lon, 2)
    known = zone_places() if places is None else places
    names = F.split(F.lit(";".join(z for _, _, z in known)), ";")
    a, b = (np.radians([p[i] for p in known]) for i in (0, 1))
    # Unit vectors: the nearest place has the largest inner product.
    axes = [np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)]
    there = [F.split(F.lit(";".join(f"{v:.9f}" for v in axis)), ";").cast("array<double>") for axis in axes]
    here = [F.cos(F.radians(y)) * F.cos(F.radians(x)), F.cos(F.radians(y)) * F.sin(F.radians(x)), F.sin(F.radians(y))]

    def nearer(best: Column, i: Column) -> Column:
        product = sum((h * F.get(t, i) for h, t in zip(here[1:], there[1:], strict=True)), here[0] * F.get(there[0], i))
        return F.when(product > best["p"], F.struct(product.alias("p"), i.alias("i"))).otherwise(best)

    start = F.struct(F.lit(-2.0).alias("p"), F.lit(0).alias("i"))
    found = F.get(names, F.aggregate(F.sequence(F.lit(0), F.lit(len(known) - 1)), start, nearer, lambda best: best["i"]))
    found = F.when(y.isNull() | x.isNull(), UNKNOWN_ZONE).otherwise(found)
    for lat0, lat1, lon0, lon1, zone in reversed(CERTAIN if places is None else []):
        found = F.when(y.between(lat0, lat1) & x.between(lon0, lon1), F.lit(zone)).otherwise(found)
    return found


def to_local(ts: Column, zone: Column) -> Column:
    """Wall-clock time in a zone, summer time included."""
    return F.convert_timezone(F.lit("UTC"), zone, ts)


def in_hours(hour: Column, start: int, end: int) -> Column:
    """Whether an hour is in [start, end), past midnight if end <= start."""
    if start < end:
        return (hour >= start) & (hour < end)
    return (hour >= start) | (hour < end)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def window_minutes(arrival: Column, departure: Column, day: Column, start: int, end: int) -> Column:
    """Minutes of [arrival, departure) in the window that opens at ``start`` o'clock of ``day``.

    It closes at ``end`` o'clock, on the next day if that isn't later.
    """
    midnight = day.cast("timestamp_ntz")
    close = end if end > start else end + 24
    opens, closes = plus_seconds(midnight, F.lit(start * 3600)), plus_seconds(midnight, F.lit(close * 3600))
    inside = F.timestamp_diff("MICROSECOND", F.greatest(arrival, opens), F.least(departure, closes))
    return F.greatest(F.lit(0.0), inside / 60e6)
