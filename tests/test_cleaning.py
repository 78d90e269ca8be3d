from datetime import datetime

import pytest

from driftline.operators import cleaning, places, stays
from driftline.operators.stays import scan_windows

SCHEMA = "user_id long, source_file string, ord long, datetime timestamp_ntz, lat double, lon double, altitude double"


def track(spark, rows):
    """Rows of (HH:MM:SS, lat, lon[, altitude])."""
    full = [
        (1, "a", i, datetime.fromisoformat(f"2024-01-01 {t}"), lat, lon, float(alt[0]) if alt else 100.0)
        for i, (t, lat, lon, *alt) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def test_bounds(spark):
    p = track(spark, [("00:00:00", 0.0, 0.0), ("00:00:01", 91.0, 0.0), ("00:00:02", 0.0, 1.0), ("00:00:03", -90.0, 180.0)])
    assert [r.ord for r in cleaning.physical_bounds(p).orderBy("ord").collect()] == [2, 3]


def test_alternating_spikes_all_go_in_one_pass(spark):
    a, b = (39.9847, 116.3184), (31.2391, 121.4944)
    p = track(spark, [(f"00:00:0{i}", *(a if i % 2 == 0 else b)) for i in range(5)])
    assert [r.ord for r in cleaning.speed_spikes(p).filter("is_spike").orderBy("ord").collect()] == [1, 2, 3]


def test_far_candidate_is_rejected_and_near_ones_tie(spark):
    p = track(
        spark,
        [
            ("00:00:00", 39.9, 116.3), ("00:01:00", 39.9, 116.3), ("00:01:00", 31.2, 121.4),
            ("00:02:00", 39.9, 116.3), ("00:03:00", 39.9, 116.3), ("00:03:00", 39.9001, 116.3), ("00:04:00", 39.9, 116.3),
        ],
    )
    kept, out = cleaning.resolve_duplicates(p)
    assert sorted(r.ord for r in kept.collect()) == [0, 1, 3, 4, 6]
    assert [(r.ord, r.reason) for r in out.collect()] == [(2, "duplicate_rejected")]


def test_altitude_interpolates_by_position(spark):
    p = track(spark, [("00:00:00", 1.0, 1.0, -777), ("00:00:10", 1.0, 1.0, 100), ("00:00:11", 1.0, 1.0, -777), ("00:10:00", 1.0, 1.0, 200), ("00:10:01", 1.0, 1.0, -777)])
    got = [r.altitude_m / cleaning.FEET for r in cleaning.altitude_clean(p).orderBy("ord").collect()]
    assert got == pytest.approx([100, 100, 150, 200, 200])


def test_gap_of_exactly_eighteen_hours_stays_joined(spark):
    p = track(spark, [("00:00:00", 1.0, 1.0), ("18:00:00", 1.0, 1.0)])
    assert {r.chain for r in stays.gap_chains(p).collect()} == {0}


def test_scan_restarts_behind_a_stay_and_at_the_second_point():
    lat = [0.0, 0.0, 0.0, 1.0, 2.0, 2.0]
    us = [int(m * 60e6) for m in (0, 15, 30, 31, 40, 80)]
    assert scan_windows(lat, [0.0] * 6, us, 200, 30, False) == [(0, 2), (4, 5)]


def test_dbscan_chains_and_noise(spark):
    rows = [(1, datetime(2024, 1, 1, i), 39.9 + x, 116.3) for i, x in enumerate((0.0, 0.001, 0.002, 0.1))]
    got = places.dbscan(spark.createDataFrame(rows, "user_id long, arrival timestamp_ntz, lat double, lon double")).orderBy("arrival")
    assert [r.place for r in got.collect()] == [0, 0, 0, 3]


def test_radius_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(1, str(i), 60 + rng.random() * 0.02, 10 + rng.random() * 0.04) for i in range(120)]
    df = spark.createDataFrame(rows, "user_id long, id string, lat double, lon double")
    got = {(r.a, r.b) for r in places.radius_pairs(df, df, ["user_id"], 200.0).collect()}
    want = {(a[1], b[1]) for a in rows for b in rows if stays._metres(a[2], a[3], b[2], b[3]) <= 200}
    assert got == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    good, bad = cleaning.clean(empty)
    assert good.count() == 0 and bad.count() == 0


def test_cleaning_sorts_points_once(spark):
    rows = track(spark, [("00:00:00", 1.0, 1.0), ("00:00:10", 1.0, 1.0)]).repartition(3, *cleaning.FILE)
    good, _ = cleaning.clean(rows)
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_flat_map_finds_the_windows_of_exact_distances():
    import random

    rng = random.Random(4)
    for base, step in ((0.0, 0.0016), (60.0, 0.0016), (79.99, 0.004), (89.0, 0.05), (39.9, 0.0009)):
        lat, lon, us = [], [], []
        y, x = base, rng.choice([179.999, 10.0])
        for i in range(400):
            y, x = min(90.0, y + rng.uniform(-step, step)), x + rng.uniform(-step, step)
            x = x - 360 if x > 180 else x + 360 if x < -180 else x
            lat.append(y), lon.append(x), us.append(int(i * 300e6))
        for anchor in (False, True):
            want, start = [], 0
            while start < len(lat):
                end = start
                while end + 1 < len(lat):
                    n = end - start + 1
                    at = (lat[start], lon[start]) if anchor else (sum(lat[start : end + 1]) / n, sum(lon[start : end + 1]) / n)
                    if not stays._metres(*at, lat[end + 1], lon[end + 1]) <= 200:
                        break
                    end += 1
                found = us[end] - us[start] >= 15 * 60e6
                want += [(start, end)] if found else []
                start = end + 1 if found else start + 1
            assert scan_windows(lat, lon, us, 200, 15, anchor) == want
