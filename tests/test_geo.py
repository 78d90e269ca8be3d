import pytest
from pyspark.sql import functions as F

from driftline.functions import geo, times


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_geohash_vectors(spark):
    row = one(
        spark,
        geo.geohash_encode(F.lit(39.9847), F.lit(116.3184), 6),
        geo.geohash_encode(F.lit(57.64911), F.lit(10.40744), 11),
    )
    assert tuple(row) == ("wx4eqy", "u4pruydqqvj")


def test_geohash_bounds_hold_the_point(spark):
    b = one(spark, geo.geohash_bounds(F.lit("wx4eqy"), 6).alias("b")).b
    assert b.lat_min <= 39.9847 < b.lat_max and b.lon_min <= 116.3184 < b.lon_max


def test_haversine(spark):
    row = one(
        spark,
        geo.haversine_m(F.lit(39.9847), F.lit(116.3184), F.lit(31.2391), F.lit(121.4944)).alias("m"),
        geo.haversine_m(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("none"),
    )
    assert row.m == pytest.approx(1_070_000, rel=0.01) and row.none is None


def test_hours_wrap(spark):
    row = one(spark, times.in_hours(F.lit(23), 22, 6).alias("a"), times.in_hours(F.lit(6), 22, 6).alias("b"))
    assert row.a and not row.b


def test_window_minutes_past_midnight(spark):
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    row = one(
        spark,
        times.window_minutes(ts("2024-01-01 21:00:00"), ts("2024-01-02 07:00:00"), F.lit("2024-01-01").cast("date"), 22, 8).alias("m"),
        times.window_minutes(ts("2024-01-01 21:00:00"), ts("2024-01-02 07:00:00"), F.lit("2024-01-02").cast("date"), 22, 8).alias("none"),
    )
    assert row.m == 540 and row.none == 0
