"""Geographic column functions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radius of the cleaning operators, in metres.
CLEANING_RADIUS_M = 6_371_000.0
#: Mean earth radius of stay detection and classification, in kilometres.
MEAN_RADIUS_KM = 6371.0088

BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"  # fixed: the geohash alphabet


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str, radius: float) -> Column:
    """Great-circle distance in the radius's unit; null if any coordinate is."""
    spots = [_col(c) for c in (lat1, lon1, lat2, lon2)]
    a1, o1, a2, o2 = map(F.radians, spots)
    h = F.pow(F.sin((a2 - a1) / 2), 2.0) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2.0)
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))
    # least and greatest skip nulls, so a missing coordinate must be caught here; asked of the distance, its code would be there
    # twice, and the virtual machine doesn't compile methods of more than 8000 bytes.
    whole = reduce(and_, (c.isNotNull() for c in spots))
    return F.when(whole, 2 * radius * F.asin(F.sqrt(bounded)))


def haversine_m(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Metres under the cleaning radius."""
    return haversine(lat1, lon1, lat2, lon2, CLEANING_RADIUS_M)


def mean_haversine_m(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Metres under the mean radius."""
    return haversine(lat1, lon1, lat2, lon2, MEAN_RADIUS_KM) * 1000


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds from ``start`` to ``end``, with fractions."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / 1e6


def speed_kmh(metres: Column, seconds: Column) -> Column:
    """Kilometres an hour; null unless time went forward."""
    return F.when(seconds > 0, metres / seconds * 3.6)


def round_half_up(x: Column, digits: int) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d``, the same in any engine."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def _cell(x: Column, low: float, span: float, bits: int) -> Column:
    n = 1 << bits
    return F.least(F.floor((x - low) / span * float(n)).cast("long"), F.lit(n - 1).cast("long"))


def geohash_encode(lat: Column | str, lon: Column | str, precision: int = 6) -> Column:
    """Geohash of ``precision`` characters: longitude and latitude bits interleaved, five to a character."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    x = _cell(_col(lon), -180.0, 360.0, lon_bits)
    y = _cell(_col(lat), -90.0, 180.0, lat_bits)
    chars = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for b in range(5):
            k = 5 * c + b  # from the left; even bits are longitude
            source, left = (x, lon_bits - 1 - k // 2) if k % 2 == 0 else (y, lat_bits - 1 - k // 2)
            value = value * 2 + F.shiftright(source, left).bitwiseAND(F.lit(1).cast("long"))
        chars.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def geohash_bounds(code: Column | str, precision: int) -> Column:
    """``struct(lat_min, lat_max, lon_min, lon_max)`` of a geohash of known length."""
    code = _col(code)
    x = y = F.lit(0).cast("long")
    for c in range(precision):
        digit = F.instr(F.lit(BASE32), F.substring(code, c + 1, 1)) - 1
        for b in range(5):
            bit = F.shiftright(digit, 4 - b).bitwiseAND(1).cast("long")
            if (5 * c + b) % 2 == 0:
                x = x * 2 + bit
            else:
                y = y * 2 + bit
    bits = 5 * precision
    dx, dy = 360.0 / (1 << (bits + 1) // 2), 180.0 / (1 << bits // 2)
    return F.struct(
        (y * dy - 90.0).alias("lat_min"),
        ((y + 1) * dy - 90.0).alias("lat_max"),
        (x * dx - 180.0).alias("lon_min"),
        ((x + 1) * dx - 180.0).alias("lon_max"),
    )


def enu_offsets(lat: Column | str, lon: Column | str, lat0: Column | str, lon0: Column | str) -> Column:
    """``struct(east_m, north_m)`` of a point from a nearby origin."""
    lat, lon, lat0, lon0 = map(_col, (lat, lon, lat0, lon0))
    return F.struct(
        ((lon - lon0) * 111_320.0 * F.cos(F.radians(lat0))).alias("east_m"), ((lat - lat0) * 110_540.0).alias("north_m")
    )
