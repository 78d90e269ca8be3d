import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import times
from driftline.operators import classify, excursions, graphs, grouped, intervals, monitoring, places, privacy, stays
from driftline.sources import sinks, traces

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def spans(rng, n, users=3, longest=3000):
    out = []
    for i in range(n):
        a = rng.randrange(20_000)
        out.append((rng.randrange(users), i, at(a), at(a + rng.randrange(longest))))
    return out


@pytest.mark.parametrize("touching", [False, True])
def test_meeting_intervals_equal_all_pairs(spark, touching):
    rng = random.Random(1)
    left, right = spans(rng, 60), [*spans(rng, 60), (0, 99, at(100), at(100)), (1, 98, None, at(5))]
    kind = "user_id long, n long, start timestamp_ntz, end timestamp_ntz"
    got = intervals.meeting(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), ["user_id"], width=3600, touching=touching)
    want = []
    for u, i, a, b in left:
        for v, j, c, d in right:
            if u == v and c is not None and ((a <= d and b >= c) if touching else (a < d and b > c)):
                want.append((i, j))
    assert sorted((r.l.n, r.r.n) for r in got.collect()) == sorted(want) and len(want) > 50


def test_hour_runs(spark):
    sets = {1: [22, 23, 0, 1, 5], 2: range(24), 3: [7], 4: [23], 5: [0, 1, 2]}
    rows = spark.createDataFrame([(u, h) for u, hs in sets.items() for h in hs], "user_id long, hour int")
    got = {r.user_id: r.runs for r in intervals.hour_runs(rows, ["user_id"]).collect()}
    assert got == {1: "05-06 h, 22-02 h", 2: "all day", 3: "07-08 h", 4: "23-00 h", 5: "00-03 h"}


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(5, 5), (None, 3)]
    label = {}
    for a, b in pairs:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    assert {r.node: r.label for r in graphs.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == label
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusters_equal_plain_dbscan():
    rng = np.random.default_rng(3)
    lat, lon = 39.9 + rng.normal(0, 0.002, 120), 116.3 + rng.normal(0, 0.002, 120)
    days = rng.integers(0, 5, 120)
    for eps, least, by_day in ((100.0, 2, None), (100.0, 4, None), (150.0, 3, days), (50.0, 1, None)):
        gap = np.array([[stays._metres(a, b, c, d) for c, d in zip(lat, lon)] for a, b in zip(lat, lon)])
        near = gap <= eps
        count = near.sum(1) if by_day is None else np.array([len(set(days[x])) for x in near])
        core = count >= least
        label = np.arange(120)
        for _ in range(120):
            for i in np.flatnonzero(core):
                label[i] = min(label[j] for j in np.flatnonzero(near[i] & core))
        for i in np.flatnonzero(~core & (near & core).any(1)):
            label[i] = label[np.where(near[i] & core, gap[i], np.inf).argmin()]
        assert places.clusters(lat, lon, eps, least, by_day).tolist() == label.tolist()


def test_excursions_pair_the_first_reachable_landing(spark):
    # Out at 2, back at 4; a last jump without a way back.
    lat = [39.9, 39.9, 49.9, 49.9, 39.9, 39.9, 60.0]
    rows = [(1, "f", i, at(i), x, 116.3, 100.0) for i, x in enumerate(lat)]
    got = excursions.excursions(spark.createDataFrame(rows, "user_id long, source_file string, ord long, datetime timestamp_ntz, lat double, lon double, altitude double"))
    found = sorted((r.ord, r.kind, r.n_points, r.first_moved, r.last_moved, r.minutes) for r in got.collect())
    assert found == [(1, "excursion", 2, 3, 4, 1.0), (5, "one_sided", 1, 7, 7, 0.0)]


def test_positions_and_ranks_equal_a_sorted_list(spark):
    rng = random.Random(4)
    rows = [(("hot" if i % 3 else "cold"), i, float(rng.randrange(40))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id long, v double")
    got = {r.id: (r.rn, r.n) for r in monitoring.positions(df, "k", ["v", "id"], parts=7).collect()}
    for k in ("hot", "cold"):
        mine = sorted((v, i) for kk, i, v in rows if kk == k)
        assert [got[i] for _, i in mine] == [(p, len(mine)) for p in range(1, len(mine) + 1)]
    stats = {r.k: r for r in monitoring.latency(df, ["k"], "v", failed=F.col("v") >= 30).collect()}
    for k in ("hot", "cold"):
        mine = sorted(v for kk, _, v in rows if kk == k)
        r = stats[k]
        assert (r["count"], r.p95, r.p99, r.errors) == (len(mine), mine[int(len(mine) * 0.95)], mine[int(len(mine) * 0.99)], sum(v >= 30 for v in mine))
        assert r.p50 == np.median(mine) and r["mean"] == pytest.approx(np.mean(mine))


def test_drift_ladder_and_stability_index(spark):
    rows = spark.createDataFrame([(10.0, 10.4), (10.0, 10.7), (10.0, 11.5), (10.0, 13.0), (0.0, 0.3)], "b double, c double")
    got = [r.x.severity for r in rows.select(monitoring.drift(F.col("b"), F.col("c"), 0.1).alias("x")).collect()]
    assert got == ["none", "low", "medium", "high", "high"]
    a, b = (spark.createDataFrame([(float(x),) for x in xs], "v double") for xs in (range(100), [*range(100), *[5] * 50]))
    assert monitoring.population_stability(a, a, "v").first().psi == pytest.approx(0)
    assert monitoring.population_stability(a, b, "v").first().psi > 0.1


def test_zones_of_positions(spark):
    rows = spark.createDataFrame([(37.5, 127.0), (28.6, 77.2), (39.9, 116.4), (48.86, 2.35), (None, 3.0)], "lat double, lon double")
    assert [r.z for r in rows.select(times.zone_of(F.col("lat"), F.col("lon")).alias("z")).collect()] == ["Asia/Seoul", "Asia/Kolkata", "Asia/Shanghai", "Europe/Paris", "Etc/UTC"]


def test_logs_labels_and_tables_round_trip(spark, tmp_path):
    for user, name in (("000", "a"), ("000", "b"), ("007", "a")):
        folder = tmp_path / "Data" / user / "Trajectory"
        folder.mkdir(parents=True, exist_ok=True)
        lines = ["x"] * 6 + ["39.9,116.3,0,492,39744.1,2008-10-23,02:53:04", "bad,116.3,0,-777,39744.1,2008-10-23,02:53:10", "39.9,116.3,0,492,39744.1,no,02:53:15", ""]
        (folder / f"{name}.plt").write_text("\r\n".join(lines))
    (tmp_path / "Data" / "000" / "labels.txt").write_text("Start Time\tEnd Time\tMode\n2008/10/23 02:00:00\t2008/10/23 03:00:00\tbus\nbad\tbad\twalk\n")
    points = traces.read_plt(spark, f"{tmp_path}/Data")
    rows = sorted((r.user_id, r.source_file, r.ord, str(r.datetime), r.lat, r.altitude) for r in points.collect())
    assert len(rows) == 6 and rows[0] == ("000", "a.plt", 6, "2008-10-23 02:53:04", 39.9, 492.0) and rows[1][4] is None
    assert {(r.user_id, r.files) for r in traces.users_below(spark, f"{tmp_path}/Data").collect()} == {("000", 2), ("007", 1)}
    assert [r.mode for r in traces.read_labels(spark, f"{tmp_path}/Data/000/labels.txt").collect()] == ["bus"]
    prints = traces.content_hashes(points).collect()
    assert len({r.print for r in prints}) == 1 and {r.n_points for r in prints} == {2}
    sinks.write_points(points, f"{tmp_path}/points")
    again = spark.read.parquet(f"{tmp_path}/points")
    assert again.count() == 6


def test_noise_repeats_and_stays_on_the_globe(spark):
    rows = spark.range(2000).select(F.col("id").alias("ord"), F.lit(89.999).alias("lat"), F.lit(10.0).alias("lon"))
    a, b = (sorted(map(tuple, privacy.noisy(x, 1.0).collect())) for x in (rows, rows.repartition(5)))
    assert a == b and max(x[1] for x in a) <= 90 and 0.002 < np.median([abs(x[2] - 10) for x in a]) < 0.02


def test_sent_stays_take_one_form(spark):
    rows = [("2024-01-01T10:00:00+08:00", None, None, "2024-01-01 05:00:00", float("nan")), (None, "2024-01-01T02:00:00", "2024-01-01T01:00:00", None, 5.0), (None, None, None, "2024-01-01", 1.0)]
    sent = spark.createDataFrame(rows, "arrival_time string, arrival string, departure string, departure_time string, altitude_m double")
    got = classify.coerced(sent).collect()
    assert [(str(r.arrival), str(r.departure), r.altitude_m) for r in got] == [("2024-01-01 02:00:00", "2024-01-01 05:00:00", None)]


def test_sweep_counts_as_single_scans_do(spark):
    rng = random.Random(5)
    rows = [(u, 0, at(5 * i), i, 39.9 + rng.choice([0, 0.0005, 0.004]), 116.3, 1.0) for u in range(3) for i in range(80)]
    chains = spark.createDataFrame(rows, "user_id long, chain long, datetime timestamp_ntz, ord long, lat double, lon double, altitude_m double")
    found = {(r.user_id, r.radius_m, r.minutes): r.stays for r in stays.sweep(chains, [(200, 30), (500, 10)]).collect()}
    for radius, minutes in ((200, 30), (500, 10)):
        one = stays.stays_of(stays.stay_members(chains, radius, minutes)).groupBy("user_id").count().collect()
        assert {(r.user_id, radius, minutes): r["count"] for r in one} == {k: v for k, v in found.items() if k[1:] == (radius, minutes)}


@pytest.mark.parametrize("name", ["colocation", "core_place", "window_grid", "rule_comparison"])
def test_rows_of_events_are_not_broadcast(spark, name):
    import __spark_entry__

    # An event becomes nine points, so the sizes of files say nothing about what would be sent to the driver.
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_core_place_has_all_members_of_the_area(spark):
    from driftline.plans import studies

    def stay(chain, day, hour, lat, hours=8):
        a = T0 + dt.timedelta(days=day, hours=hour)
        return (1, chain, 1, a, a, a + dt.timedelta(hours=hours), lat, 116.0, hours * 60.0)

    # Two nights at one place, one in the evening nearby without core hours, one night elsewhere.
    rows = [stay(0, 0, 22, 40.0), stay(1, 1, 22, 40.0005), stay(2, 2, 20, 40.0006, hours=1), stay(3, 3, 22, 41.0)]
    kind = "user_id long, chain long, stay long, arrival timestamp_ntz, arrival_local timestamp_ntz, departure_local timestamp_ntz, lat double, lon double, duration_minutes double"
    got = studies._core_stays(spark.createDataFrame(rows, kind)).filter("type = 'home'").collect()
    assert sorted(r.chain for r in got) == [0, 1, 2] and {r.core_minutes for r in got} == {360.0} and {r.core.chain for r in got} == {0}


def test_small_groups_share_a_call_and_stay_whole(spark):
    import pyarrow as pa

    def run(table, starts):
        sizes = np.diff([*starts, len(table)])
        return pa.table({"k": table["k"].take(pa.array(starts)), "n": sizes, "groups": np.full(len(starts), len(starts))})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame([(k, i) for k in range(500) for i in range(1 + k % 9)], "k long, i long")
        got = grouped.apply(rows, ["k"], ["i"], run, "k long, n long, groups long", pieces=1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.k, r.n) for r in got) == [(k, 1 + k % 9) for k in range(500)] and {r.groups for r in got} == {500}


@pytest.mark.parametrize("name", ["jump_excursions", "jump_impact", "mode_at_jump", "stay_tail_trim"])
def test_recordings_cost_no_call_of_their_own(spark, name):
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsIn" not in plan


def test_points_are_dealt_by_the_size_of_the_table(spark, monkeypatch):
    from driftline.plans import catalogue

    def rows():
        df = catalogue.stay_points_centroid(spark, "/root/testdata/sf0.001")
        return df._jdf.queryExecution().executedPlan().toString(), sorted(map(str, df.collect()))

    small = rows()
    monkeypatch.setattr(catalogue, "PIECE", 100)
    plan, dealt = rows()
    # 1,000 events: cleaning, chains, scan and figures of stays each in ten pieces, which the engine may not put together.
    fixed = ", 10), REPARTITION_BY_NUM"
    assert plan.count(fixed) >= 4 and fixed not in small[0] and dealt == small[1]


def test_meeting_whole_keeps_rows_without_a_partner(spark):
    kind = "user_id long, n long, start timestamp_ntz, end timestamp_ntz"
    left = spark.createDataFrame([(1, 0, at(0), at(900)), (1, 1, at(2000), at(2010)), (2, 2, at(0), at(10))], kind)
    right = spark.createDataFrame([(1, 5, at(100), at(800)), (1, 6, at(905), at(906)), (3, 7, at(0), at(10))], kind)
    rows = intervals.meeting(left, right, ["user_id"], whole=True).collect()
    assert [(r.l.n, r.r.n) for r in rows if r.met] == [(0, 5)]
    assert {r.l.n for r in rows if r.l} == {0, 1, 2} and {r.r.n for r in rows if r.r} == {5, 6, 7}


@pytest.mark.parametrize("name", ["stay_evaluation", "unobserved_share"])
def test_stays_are_found_once(spark, name):
    import __spark_entry__

    rows = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_events_are_dealt_before_they_become_points(spark, monkeypatch):
    from driftline.plans import catalogue

    def rows():
        df = catalogue.clean_trajectory(spark, "/root/testdata/sf0.001")
        return df._jdf.queryExecution().executedPlan().toString(), sorted(map(str, df.collect()))

    small = rows()
    monkeypatch.setattr(catalogue, "STAY_PIECE", 250)
    plan, dealt = rows()
    fixed = re.compile(r"hashpartitioning\(event_id#\d+L, 4\), REPARTITION_BY_NUM")
    assert fixed.search(plan) and not fixed.search(small[0]) and dealt == small[1]


@pytest.mark.parametrize("name", [
    "batch_classify", "boundary_errors", "classify_v1", "classify_v2", "coerced_stays", "cut_simulation", "dbscan_general", "dbscan_places",
    "drift_record", "duration_histogram", "false_stay_modes", "gap_start_hours",
])
def test_rows_of_users_are_dealt_by_the_size_of_the_table(spark, monkeypatch, name):
    import __spark_entry__
    from driftline.plans import catalogue

    def rows():
        df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
        return df._jdf.queryExecution().executedPlan().toString(), sorted(map(str, df.collect()))

    small = rows()
    monkeypatch.setattr(catalogue, "PIECE", 250)
    monkeypatch.setattr(catalogue, "STAY_PIECE", 250)
    plan, dealt = rows()
    # The engine chooses no number of partitions for points, labels or stays.
    assert not re.search(r"hashpartitioning\([^()]*user_id[^()]*\), ENSURE_REQUIREMENTS", plan) and dealt == small[1]
