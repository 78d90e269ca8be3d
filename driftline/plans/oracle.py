"""DuckDB SQL by query name, written apart from the DataFrame code."""

from __future__ import annotations

from driftline.plans.sqlbase import _IN, _SPOT, geohash, hav, kmh, mean_m, query, rnd, secs

_K = "user_id, source_file, ord"
_STAY = (
    f"user_id, chain, stay, arrival, departure, {rnd('lat', 10)} AS lat, {rnd('lon', 10)} AS lon, num_points, {rnd('altitude_m', 3)} AS altitude_m, "
    f"{rnd('observed_minutes', 3)} AS observed_minutes, {rnd('duration_minutes', 3)} AS duration_minutes"
)
_LATLON = f"{rnd('lat', 6)} AS lat, {rnd('lon', 6)} AS lon"
_CENTRE = f"{rnd('lat', 10)} AS lat, {rnd('lon', 10)} AS lon"


def _filtered(source: str, radius_test: str) -> str:
    return f"SELECT * FROM (SELECT *, lag({_SPOT}) OVER ({_IN}) AS p, row_number() OVER ({_IN}) AS rn FROM {source}) WHERE rn = 1 OR {radius_test}"


_NEAR50 = f"{mean_m('p.lat', 'p.lon', 'lat', 'lon')} <= 50000"
_SLOW300 = f"{kmh(mean_m('p.lat', 'p.lon', 'lat', 'lon'), secs('p.datetime', 'datetime'))} <= 300"
_LIMITS = "(10.0), (50.0), (100.0), (200.0), (300.0), (500.0), (1000.0), (2000.0)"

_BODIES: dict[str, str] = {
    "physical_bounds": f"SELECT {_K}, {_LATLON} FROM bounded",
    "min_points_gate": "SELECT user_id, source_file, count(*) AS n FROM gated GROUP BY ALL",
    "dedup_exact": f"SELECT {_K} FROM dedup",
    "dup_candidates": f"SELECT {_K}, {rnd('v_in', 3)} AS v_in, {rnd('v_out', 3)} AS v_out, valid, {rnd('score', 3)} AS score, invalid_anchors FROM cand",
    "dup_decisions": f"SELECT user_id, source_file, datetime, n_candidates, n_valid, {rnd('valid_spread_m', 3)} AS valid_spread_m, decision FROM dec",
    "dup_valid_spread": f"""SELECT user_id, source_file, datetime, {rnd('max(m)', 3)} AS valid_spread_m FROM (
      SELECT a.user_id, a.source_file, a.datetime, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m
      FROM cand a JOIN cand b USING (user_id, source_file, datetime) WHERE a.ord < b.ord AND a.valid AND b.valid) GROUP BY ALL""",
    "dup_survivors": f"SELECT {_K}, decision FROM decided WHERE survivor",
    "dup_quarantine": f"SELECT {_K}, reason FROM dupq",
    "resolve_duplicates": f"SELECT {_K}, {_LATLON} FROM kept",
    "speed_spikes": f"SELECT {_K} FROM marked WHERE is_spike",
    "altitude_clean": f"SELECT {_K}, {rnd('altitude_m', 3)} AS altitude_m FROM alt",
    "segment_trajectories": "SELECT sub_trip_id, count(*) AS n, min(datetime) AS first_seen FROM clean GROUP BY ALL",
    "localize": f"SELECT {_K}, tz_name, timestamp_local FROM clean",
    "clean_trajectory": f"SELECT {_K}, datetime, {_LATLON}, {rnd('altitude_m', 3)} AS altitude_m, sub_trip_id, tz_name FROM clean",
    "quarantine": f"SELECT {_K}, reason FROM quarantine",
    "pipeline_summary": """SELECT 'clean' AS part, count(*) AS n, count(DISTINCT user_id) AS users FROM clean
      UNION ALL SELECT reason, count(*), count(DISTINCT user_id) FROM quarantine GROUP BY reason""",
    "point_speed": f"SELECT {_K}, {rnd('step_s', 3)} AS step_s, {rnd('step_m', 3)} AS step_m, {rnd('step_kmh', 3)} AS step_kmh FROM kept_steps",
    "distance_filter": f"SELECT {_K} FROM ({_filtered('kept', _NEAR50)})",
    "speed_filter": f"SELECT {_K} FROM ({_filtered('kept', _SLOW300)})",
    "gps_clean_chain": f"""SELECT {_K} FROM ({_filtered(
        "(SELECT user_id, source_file, ord, datetime, lat, lon FROM (" + _filtered(
            "(SELECT * FROM pts WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 QUALIFY row_number() OVER (PARTITION BY user_id, source_file, datetime ORDER BY ord) = 1)",
            _NEAR50) + "))", _SLOW300)})""",
    "split_by_gaps": f"""SELECT user_id, source_file, part, count(*) AS n FROM (
      SELECT *, CAST(sum(CAST(coalesce(g > 21600, FALSE) AS BIGINT)) OVER ({_IN} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM (
        SELECT *, {secs(f'lag(datetime) OVER ({_IN})', 'datetime')} AS g FROM (
          SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY user_id, source_file, datetime, lat, lon ORDER BY CAST(altitude = -777 AS INT), ord) = 1)))
      GROUP BY ALL HAVING count(*) >= 10""",
    "suspect_points": f"""SELECT {_K} FROM (SELECT *, lead(step_kmh) OVER ({_IN}) AS nx FROM kept_steps) WHERE step_kmh > 1100 OR nx > 1100""",
    "dup_cases": f"""SELECT CASE WHEN spots = 1 THEN 1 WHEN spots = n THEN 2 ELSE 3 END AS "case", count(*) AS n_groups FROM (
      SELECT count(*) AS n, count(DISTINCT ({rnd('lat', 6)}, {rnd('lon', 6)})) AS spots FROM gated GROUP BY user_id, source_file, datetime)
      WHERE n > 1 GROUP BY 1""",
    "dup_sensitivity": f"""SELECT limit_m, count(*) FILTER (WHERE valid_spread_m > limit_m) AS ambiguous, count(*) FILTER (WHERE valid_spread_m <= limit_m) AS tie_break
      FROM dec, (SELECT CAST(x AS DOUBLE) AS limit_m FROM (VALUES {_LIMITS}) t(x)) WHERE n_valid > 1 GROUP BY 1""",
    "dup_scope": """SELECT count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE files > 1) AS across_files FROM (
      SELECT count(*) AS n, count(DISTINCT source_file) AS files FROM pts GROUP BY user_id, datetime)""",
    "decision_branches": f"""SELECT decision, count(*) AS n_groups, CAST(quantile_cont(CAST(n_candidates AS DOUBLE), 0.5) AS DOUBLE) AS median_candidates,
      {rnd('quantile_cont(valid_spread_m, 0.5)', 3)} AS median_spread, {rnd('max(valid_spread_m)', 3)} AS max_spread,
      {rnd('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)', 6)} AS share FROM dec GROUP BY decision""",
    "gap_chains": "SELECT user_id, chain, count(*) AS n, min(datetime) AS first_seen FROM chained GROUP BY ALL",
    "stay_points_centroid": f"SELECT {_STAY} FROM st",
    "stay_points_anchor": f"SELECT {_STAY} FROM st_anchor",
    "observed_minutes": f"SELECT user_id, {rnd('sum(observed_minutes)', 3)} AS observed, {rnd('sum(duration_minutes)', 3)} AS duration FROM st GROUP BY 1",
    "stay_points_local": "SELECT user_id, chain, stay, tz_name, arr AS arrival_local, dep AS departure_local FROM stl",
    "overnight_flag": """SELECT user_id, count(*) FILTER (WHERE CASE WHEN t3 >= arr THEN t3 ELSE t3 + INTERVAL 1 DAY END <= dep) AS nights, count(*) AS stays
      FROM (SELECT *, date_trunc('day', arr) + INTERVAL 3 HOUR AS t3 FROM stl) GROUP BY 1""",
    "gaps_in_stays": f"""SELECT user_id, chain, stay, g0 AS gap_start, datetime AS gap_end, {rnd(secs('g0', 'datetime'), 3)} AS gap_s,
        {rnd(mean_m('plat', 'plon', 'lat', 'lon'), 3)} AS jump_m
      FROM (SELECT c.*, s.stay, lag(c.datetime) OVER w AS g0, lag(c.lat) OVER w AS plat, lag(c.lon) OVER w AS plon
            FROM chained c JOIN st s ON s.user_id = c.user_id AND s.chain = c.chain AND c.rn BETWEEN s.stay AND s.stay + s.num_points - 1
            WINDOW w AS (PARTITION BY c.user_id, c.chain, s.stay ORDER BY c.datetime, c.ord))
      WHERE {secs('g0', 'datetime')} > 1200""",
    "session_18h": "SELECT user_id, min(datetime) AS first_seen, count(*) AS n FROM chained GROUP BY user_id, chain",
    "window_overlap_days": f"""SELECT user_id, chain, stay, CAST(d AS DATE) AS day, {rnd('home_min', 3)} AS home_min, {rnd('office_min', 3)} AS office_min
      FROM days WHERE home_min > 0 OR office_min > 0""",
    "window_minutes": f"SELECT user_id, chain, stay, {rnd('home', 3)} AS home, {rnd('office', 3)} AS office FROM sc",
    "window_days": """SELECT user_id, count(DISTINCT d) FILTER (WHERE home_min > 0) AS home_days, count(DISTINCT d) FILTER (WHERE office_min > 0) AS office_days
      FROM days GROUP BY 1""",
    "classify_v1": f"SELECT user_id, type, {_CENTRE}, {rnd('minutes', 3)} AS minutes, support, {rnd('confidence', 6)} AS confidence, status, reason FROM win1",
    "v1_pois": f"""SELECT user_id, geohash, {_CENTRE}, visit_count, {rnd('dur', 3)} AS duration_minutes, {rnd('least(1.0, dur / total)', 6)} AS confidence, rank FROM (
      SELECT *, sum(dur) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY dur DESC, geohash) AS rank FROM (
        SELECT user_id, geohash, arg_min(lat, (arrival, chain, stay)) AS lat, arg_min(lon, (arrival, chain, stay)) AS lon, count(*) AS visit_count,
               sum(duration_minutes) AS dur FROM (SELECT *, {geohash('lat', 'lon', 6)} AS geohash FROM sc WHERE home = 0 AND office = 0) GROUP BY ALL))
      WHERE rank <= 5""",
    "dbscan_places": """SELECT user_id, count(*) AS places, max(n) AS largest FROM (SELECT user_id, place, count(*) AS n FROM placed GROUP BY ALL) GROUP BY 1""",
    "classify_v2": f"""SELECT user_id, type, {_CENTRE}, visit_count, {rnd('minutes', 3)} AS minutes, n_days AS days, {rnd('confidence', 6)} AS confidence, status, reason FROM win2""",
    "v2_pois": f"""SELECT user_id, rank, {_CENTRE}, visit_count, {rnd('duration_minutes', 3)} AS duration_minutes, {rnd('least(1.0, duration_minutes / total)', 6)} AS confidence
      FROM (SELECT *, sum(duration_minutes) OVER (PARTITION BY user_id) AS total,
                   row_number() OVER (PARTITION BY user_id ORDER BY duration_minutes DESC, first_seen) AS rank FROM pl WHERE home = 0 AND office = 0) WHERE rank <= 5""",
    "shadow_compare": "SELECT user_id, type, outcome FROM compared",
    "shadow_summary": "SELECT type, " + ", ".join(
        f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ("both_unknown", "shadow_only", "primary_only", "same_place", "different_place")
    ) + " FROM compared GROUP BY 1",
    "radius_support": f"""SELECT a.user_id, a.chain || '-' || a.stay AS id, count(*) AS support FROM st a JOIN st b ON a.user_id = b.user_id
      WHERE {mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200 GROUP BY ALL""",
    "hourly_profile": f"""SELECT hour(slot) AS hour, isodow(slot) <= 5 AS workday,
        {rnd("sum((epoch_us(least(dep, slot + INTERVAL 1 HOUR)) - epoch_us(greatest(arr, slot))) / 60e6::DOUBLE)", 3)} AS minutes
      FROM (SELECT *, unnest(generate_series(date_trunc('hour', arr), dep, INTERVAL 1 HOUR)) AS slot FROM stl) GROUP BY ALL""",
    "interval_mode": """SELECT mode, count(*) AS n FROM (
      SELECT k.user_id, k.ord, arg_max(l.mode, (l.start, l.label_id)) AS mode FROM kept k JOIN lab l ON k.user_id = l.user_id AND k.datetime BETWEEN l.start AND l."end"
      GROUP BY ALL) GROUP BY 1""",
    "asof_label": """SELECT CASE WHEN k.datetime <= l."end" THEN l.mode END AS mode, count(*) AS n
      FROM kept k ASOF LEFT JOIN (SELECT * FROM lab QUALIFY row_number() OVER (PARTITION BY user_id, start ORDER BY label_id DESC) = 1) l
        ON k.user_id = l.user_id AND k.datetime >= l.start GROUP BY 1""",
    "join_semi": f"SELECT {_K} FROM decided WHERE decision = 'tie_break'",
    "join_anti": f"SELECT {_K} FROM kept WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.user_id = kept.user_id AND c.source_file = kept.source_file AND c.ord = kept.ord)",
    "join_left": """SELECT user_id, source_file, raw, coalesce(bad, 0) AS bad FROM (SELECT user_id, source_file, count(*) AS raw FROM pts GROUP BY ALL)
      LEFT JOIN (SELECT user_id, source_file, count(*) AS bad FROM quarantine GROUP BY ALL) USING (user_id, source_file)""",
    "join_inner": f"SELECT c_mktsegment, count(*) AS n, {rnd('sum(o_totalprice)', 2)} AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "join_broadcast_lookup": "SELECT r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "file_boundaries": f"""SELECT user_id, source_file, {rnd(secs('e', 'ns'), 3)} AS gap_s, {rnd(hav('llat', 'llon', 'nlat', 'nlon'), 3)} AS metres FROM (
      SELECT *, lead(s) OVER w AS ns, lead(flat) OVER w AS nlat, lead(flon) OVER w AS nlon FROM (
        SELECT user_id, source_file, min(datetime) AS s, max(datetime) AS e, arg_min(lat, (datetime, ord)) AS flat, arg_min(lon, (datetime, ord)) AS flon,
               arg_max(lat, (datetime, ord)) AS llat, arg_max(lon, (datetime, ord)) AS llon FROM clean GROUP BY ALL)
      WINDOW w AS (PARTITION BY user_id ORDER BY s, source_file)) WHERE ns IS NOT NULL""",
    "agg_quantiles": "SELECT source_file, " + ", ".join(f"{rnd(f'quantile_cont(step_kmh, {q})', 3)} AS {n}" for q, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99")))
    + " FROM kept_steps WHERE step_kmh IS NOT NULL GROUP BY 1",
    "agg_basic": f"""SELECT event_type, count(*) AS n, {rnd('sum(value)', 2)} AS total, {rnd('avg(value)', 4)} AS mean, min(value) AS low, max(value) AS high,
      count(DISTINCT user_id) AS users FROM events GROUP BY 1""",
    "agg_conditional": f"""SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, {rnd("avg(CAST(event_type = 'view' AS INT))", 6)} AS share FROM events GROUP BY 1""",
    "agg_first_last": "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1",
    "agg_weighted_mean": f"SELECT l_returnflag, {rnd('sum(l_extendedprice * l_quantity) / sum(l_quantity)', 4)} AS mean FROM lineitem GROUP BY 1",
    "agg_argmax": "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top_order FROM orders GROUP BY 1",
    "agg_having": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 60",
    "agg_listagg": "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1",
    "hour_distribution": f"""SELECT CAST(h.i AS INT) AS hour, count(c.ord) AS n, {rnd('count(c.ord) / CAST(sum(count(c.ord)) OVER () AS DOUBLE)', 6)} AS share
      FROM (SELECT unnest(range(24)) AS i) h LEFT JOIN clean c ON hour(c.timestamp_local) = h.i GROUP BY h.i""",
    "crosstab": """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o,
      count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1""",
    "crosstab_margins": """SELECT event_type, odd, count(*) AS n, CAST(grouping_id(event_type, odd) AS BIGINT) AS gid
      FROM (SELECT *, user_id % 2 AS odd FROM events) GROUP BY CUBE (event_type, odd)""",
    "topk_longest": f"SELECT user_id, arrival, {rnd('duration_minutes', 3)} AS duration_minutes FROM st ORDER BY st.duration_minutes DESC, user_id, arrival LIMIT 20",
    "trajectory_thinning": f"""SELECT {_K} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY datetime, ord) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM clean)
      WHERE (k - 1) % greatest(1, CAST(floor(c / 100) AS BIGINT)) = 0""",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT user_id, count(*) AS n FROM (SELECT user_id FROM clean UNION ALL SELECT user_id FROM quarantine) GROUP BY 1",
    "set_intersect": "SELECT user_id, arrival, departure FROM st INTERSECT SELECT user_id, arrival, departure FROM st_anchor",
    "set_except": f"SELECT {_K} FROM gated EXCEPT ALL SELECT {_K} FROM kept",
    "set_symdiff": """SELECT *, 'left' AS side FROM (SELECT user_id, arrival, departure FROM st EXCEPT SELECT user_id, arrival, departure FROM st_anchor)
      UNION ALL SELECT *, 'right' FROM (SELECT user_id, arrival, departure FROM st_anchor EXCEPT SELECT user_id, arrival, departure FROM st)""",
    "distinct_on": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "geohash_encode": f"SELECT {geohash('lat', 'lon', 6)} AS g6, {geohash('lat', 'lon', 5)} AS g5, count(*) AS n FROM kept GROUP BY ALL",
    "hash_identifier": "SELECT c_custkey, substr(sha256(c_custkey || ':salt'), 1, 16) AS pseudonym FROM customer",
    "make_sub_trip_id": "SELECT DISTINCT lpad(CAST(user_id AS VARCHAR), 6, '0') || '_' || source_file AS id FROM pts",
    "time_parts": "SELECT hour(ts) AS hour, isodow(ts) - 1 AS weekday, count(*) AS n FROM events GROUP BY ALL",
    "hour_in_range": "SELECT count(*) FILTER (WHERE hour(ts) >= 22 OR hour(ts) < 6) AS night, count(*) FILTER (WHERE hour(ts) >= 9 AND hour(ts) < 18) AS day FROM events",
    "k_anonymity_stats": f"""SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS total, min(n) AS least, {rnd('coalesce(avg(CAST(n >= 5 AS INT)), 0.0)', 6)} AS ratio,
      coalesce(bool_and(n >= 5), TRUE) AS all_ok FROM (SELECT {geohash('lat', 'lon', 6)} AS g, count(*) AS n FROM kept GROUP BY 1)""",
    "k_generalize": "SELECT source_file, CAST(coalesce(max(p) FILTER (WHERE least_n >= 5), 2) AS INT) AS precision FROM (SELECT source_file, p, min(n) AS least_n FROM ("
    + " UNION ALL ".join(f"SELECT source_file, {p} AS p, {geohash('lat', 'lon', p)} AS g, count(*) AS n FROM kept GROUP BY 1, 3" for p in range(7, 1, -1))
    + ") GROUP BY ALL) GROUP BY 1",
    "psi": f"""SELECT {rnd('sum((a - e) * ln(a / e))', 6)} AS psi FROM (
      SELECT i, greatest(coalesce(max(p) FILTER (WHERE side = 0), 0.0), 1e-4::DOUBLE) AS e, greatest(coalesce(max(p) FILTER (WHERE side = 1), 0.0), 1e-4::DOUBLE) AS a
      FROM (SELECT unnest(range(10)) AS i) g LEFT JOIN (
        SELECT side, b, n / CAST(sum(n) OVER (PARTITION BY side) AS DOUBLE) AS p FROM (
          SELECT user_id % 2 AS side, CASE WHEN value BETWEEN 0 AND 100 THEN least(CAST(floor(value / 10) AS INT), 9) END AS b, count(*) AS n FROM events GROUP BY ALL)) x
      ON x.b = g.i GROUP BY i)""",
    "wilson_ci": f"""SELECT event_type, {rnd('c - h', 6)} AS low, {rnd('c + h', 6)} AS high FROM (
      SELECT event_type, (p + 1.96::DOUBLE * 1.96 / (2 * n)) / (1 + 1.96::DOUBLE * 1.96 / n) AS c,
             1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE * 1.96 / (4 * n * n)) / (1 + 1.96::DOUBLE * 1.96 / n) AS h
      FROM (SELECT event_type, count(*) AS n, avg(CAST(value > 50 AS INT)) AS p FROM events GROUP BY 1))""",
    "stratified_sample": """SELECT event_type, event_id FROM events
      QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) <= 50""",
    "content_fingerprint": "SELECT user_id, source_file, n_points, print FROM hashed",
}

ORACLE_SQL: dict[str, str] = {name: query(body) for name, body in _BODIES.items()}
