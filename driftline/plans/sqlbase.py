"""Building blocks of the DuckDB counterparts: named CTEs, assembled on demand."""

from __future__ import annotations

import re

CLEANING_M, MEAN_KM = 6_371_000.0, 6371.0088


def hav(lat1: str, lon1: str, lat2: str, lon2: str, radius: str = "6371000.0::DOUBLE") -> str:
    h = (
        f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    )
    return f"(CASE WHEN {h} IS NOT NULL THEN 2 * {radius} * asin(sqrt(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {h})))) END)"


def mean_m(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(1000 * {hav(lat1, lon1, lat2, lon2, '6371.0088::DOUBLE')})"


def secs(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 1e6::DOUBLE)"


def kmh(metres: str, seconds: str) -> str:
    return f"(CASE WHEN {seconds} > 0 THEN {metres} / {seconds} * 3.6::DOUBLE END)"


def rnd(x: str, digits: int) -> str:
    return f"(floor(({x}) * {10**digits}.0::DOUBLE + 0.5) / {10**digits}.0::DOUBLE)"


def geohash(lat: str, lon: str, precision: int) -> str:
    bits = 5 * precision
    lb, ab = (bits + 1) // 2, bits // 2
    x = f"least(CAST(floor(({lon} + 180.0::DOUBLE) / 360.0 * {float(1 << lb)}::DOUBLE) AS BIGINT), {(1 << lb) - 1})"
    y = f"least(CAST(floor(({lat} + 90.0::DOUBLE) / 180.0 * {float(1 << ab)}::DOUBLE) AS BIGINT), {(1 << ab) - 1})"
    chars = []
    for c in range(precision):
        value = "0"
        for b in range(5):
            k = 5 * c + b
            source, left = (x, lb - 1 - k // 2) if k % 2 == 0 else (y, ab - 1 - k // 2)
            value = f"({value} * 2 + (({source} >> {left}) & 1))"
        chars.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST({value} + 1 AS BIGINT), 1)")
    return " || ".join(chars)


FILE = "user_id, source_file"
_IN = f"PARTITION BY {FILE} ORDER BY datetime, ord"
_SPOT = "{'datetime': datetime, 'lat': lat, 'lon': lon}"
_POINT = "user_id, source_file, ord, datetime, lat, lon, altitude"


def _speed(p: str, q: str) -> str:
    return kmh(hav(f"{p}lat", f"{p}lon", f"{q}lat", f"{q}lon"), secs(f"{p}datetime", f"{q}datetime"))


def _judged(source: str, extra: str = "") -> str:
    return f"""
  SELECT *, coalesce(NOT (v_in > 1100), TRUE) AND coalesce(NOT (v_out > 1100), TRUE) AS valid,
         coalesce(greatest(v_in, v_out), 0.0) AS score, coalesce(v_anchors > 1100, FALSE) {extra} AS invalid_anchors
  FROM (SELECT *, {_speed("prev.", "")} AS v_in, {_speed("", "next.")} AS v_out, {_speed("prev.", "next.")} AS v_anchors FROM {source})"""


def _decided(source: str, decisions: str) -> str:
    return f"""
  SELECT *, decision IN ('single_valid', 'tie_break') AND rk = 1 AS survivor,
         CASE WHEN decision = 'invalid_anchors' THEN 'duplicate_invalid_anchors' WHEN decision = 'no_valid' THEN 'duplicate_no_valid'
              WHEN decision = 'ambiguous' THEN 'duplicate_ambiguous' WHEN NOT valid THEN 'duplicate_rejected' END AS reason
  FROM (SELECT c.*, d.decision, row_number() OVER (PARTITION BY c.user_id, c.source_file, c.datetime
               ORDER BY CAST(NOT valid AS INT), score, bad_altitude, ord) AS rk
        FROM {source} c JOIN {decisions} d USING (user_id, source_file, datetime))"""


def _decisions(source: str) -> str:
    return f"""
  SELECT g.*, CASE WHEN inv THEN 'invalid_anchors' WHEN n_valid = 0 THEN 'no_valid' WHEN n_valid = 1 THEN 'single_valid'
                   WHEN valid_spread_m > 200 THEN 'ambiguous' ELSE 'tie_break' END AS decision
  FROM (SELECT c.user_id, c.source_file, c.datetime, count(DISTINCT c.ord) AS n_candidates,
               count(DISTINCT c.ord) FILTER (WHERE c.valid) AS n_valid, bool_or(c.invalid_anchors) AS inv,
               coalesce(max({hav("c.lat", "c.lon", "o.lat", "o.lon")}) FILTER (WHERE c.valid AND o.valid), 0.0) AS valid_spread_m
        FROM {source} c JOIN {source} o USING (user_id, source_file, datetime) GROUP BY ALL) g"""


def _minutes(start: int, end: int) -> str:
    close = end if end > start else end + 24
    return (
        f"greatest(0.0::DOUBLE, (epoch_us(least(dep, d + INTERVAL {close} HOUR)) "
        f"- epoch_us(greatest(arr, d + INTERVAL {start} HOUR))) / 60e6::DOUBLE)"
    )


def _local(ts: str, zone: str = "tz_name") -> str:
    return f"timezone({zone}, timezone('UTC', {ts}))"


def zone(lat: str, lon: str) -> str:
    """The recordings lie around Beijing; other zones are compared city by city."""
    y, x = f"round_even({lat}, 2)", f"round_even({lon}, 2)"
    return f"CASE WHEN {y} BETWEEN 38 AND 49 AND {x} BETWEEN 115 AND 118 THEN 'Asia/Shanghai' ELSE 'Etc/UTC' END"


CTES: dict[str, str] = {
    "ev": """
  SELECT event_id, user_id, event_type, date_trunc('second', ts) AS start, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k
  FROM events""",
    "pts": """
  SELECT owner AS user_id, CASE WHEN event_id % 20 = 7 THEN 'S' || event_id ELSE strftime(datetime, '%Y%m%d') END AS source_file, ord, datetime, lat, lon, altitude
  FROM (SELECT *, unnest(CASE event_id % 40 WHEN 7 THEN [user_id, xor(user_id, 1)] WHEN 27 THEN [user_id, xor(user_id, 2)] ELSE [user_id] END) AS owner FROM (
    SELECT user_id, event_id, pid + again * 5000000000 AS ord, start + INTERVAL (i * 300) SECOND AS datetime,
           39.8::DOUBLE + (user_id % 20) * 0.01::DOUBLE + place * 0.02::DOUBLE + ((pid * 7919) % 200 - 100) * 0.000004::DOUBLE
             + CASE WHEN event_type = 'view' THEN i * 0.004::DOUBLE ELSE 0.0::DOUBLE END
             + CASE WHEN event_type = 'purchase' AND i = 4 THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END
             + CASE WHEN again = 1 THEN CASE pid % 3 WHEN 0 THEN 0.0001::DOUBLE WHEN 1 THEN 0.004::DOUBLE ELSE 9.0::DOUBLE END ELSE 0.0::DOUBLE END AS lat,
           116.2::DOUBLE + (user_id % 15) * 0.01::DOUBLE + place * 0.015::DOUBLE AS lon,
           CASE WHEN k % 7 = 0 THEN -777.0::DOUBLE ELSE 100.0::DOUBLE + k END AS altitude
    FROM (SELECT *, event_id * 10 + i AS pid, unnest(CASE WHEN event_type = 'error' AND i = 3 THEN [0, 1] ELSE [0] END) AS again
          FROM (SELECT *, unnest(range(9)) AS i, CASE WHEN hour(l) >= 22 OR hour(l) < 8 THEN 0
                       WHEN isodow(l) <= 5 AND hour(l) >= 9 AND hour(l) < 18 THEN 1 ELSE 2 + k % 3 END AS place
                FROM (SELECT *, start + INTERVAL 8 HOUR AS l FROM ev)))))""",
    "hashed": """
  SELECT user_id, source_file, min(datetime) AS s0, max(datetime) AS s1, count(*) AS n_points,
         md5(string_agg(strftime(datetime, '%Y%m%d%H%M%S') || ',' || CAST(round(lat * 1e6::DOUBLE) AS BIGINT) || ',' || CAST(round(lon * 1e6::DOUBLE) AS BIGINT)
                        || ',' || CAST(round(altitude * 10) AS BIGINT), '|' ORDER BY datetime, ord)) AS print
  FROM pts GROUP BY ALL""",
    "lab": "SELECT user_id, event_id AS label_id, start, start + INTERVAL 40 MINUTE AS \"end\", event_type AS mode FROM ev",
    "bounded": "SELECT * FROM pts WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)",
    "gated": f"SELECT * FROM bounded QUALIFY count(*) OVER (PARTITION BY {FILE}) >= 2",
    "dedup": f"""SELECT *, CAST(altitude = -777 AS INT) AS bad_altitude FROM gated
  QUALIFY row_number() OVER (PARTITION BY {FILE}, datetime, lat, lon ORDER BY CAST(altitude = -777 AS INT), ord) = 1""",
    "anchored": f"""
  SELECT *, last_value(CASE WHEN NOT is_candidate THEN {_SPOT} END IGNORE NULLS) OVER (PARTITION BY {FILE} ORDER BY datetime, bad_altitude, ord
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
            first_value(CASE WHEN NOT is_candidate THEN {_SPOT} END IGNORE NULLS) OVER (PARTITION BY {FILE} ORDER BY datetime, bad_altitude, ord
              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next
  FROM (SELECT *, count(*) OVER (PARTITION BY {FILE}, datetime) > 1 AS is_candidate FROM dedup)""",
    "judged": _judged("anchored"),
    "cand": "SELECT * FROM judged WHERE is_candidate",
    "dec": _decisions("cand"),
    "decided": _decided("cand", "dec"),
    "kept": f"SELECT {_POINT} FROM judged WHERE NOT is_candidate UNION ALL SELECT {_POINT} FROM decided WHERE survivor",
    "dupq": f"SELECT {_POINT}, reason FROM decided WHERE reason IS NOT NULL",
    "marked": f"""
  SELECT *, a IS NOT NULL AND b IS NOT NULL AND coalesce({_speed("a.", "")} > 1100, FALSE) AND coalesce({_speed("", "b.")} > 1100, FALSE)
            AND NOT coalesce({_speed("a.", "b.")} > 1100, FALSE) AS is_spike
  FROM (SELECT *, lag({_SPOT}) OVER ({_IN}) AS a, lead({_SPOT}) OVER ({_IN}) AS b FROM kept)""",
    "base": f"SELECT {_POINT} FROM marked WHERE NOT is_spike",
    "again_rows": f"""
  SELECT *, CAST(altitude = -777 AS INT) AS bad_altitude FROM (
    SELECT *, last_value(CASE WHEN b THEN {_SPOT} END IGNORE NULLS) OVER ({_IN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
              first_value(CASE WHEN b THEN {_SPOT} END IGNORE NULLS) OVER ({_IN} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next
    FROM (SELECT *, TRUE AS b FROM base UNION ALL SELECT {_POINT}, FALSE AS b FROM dupq WHERE reason = 'duplicate_invalid_anchors'))
  WHERE NOT b""",
    "rejudged": _judged("again_rows", "OR prev IS NULL OR next IS NULL"),
    "rejudged_dec": _decisions("rejudged"),
    "rejudged_decided": _decided("rejudged", "rejudged_dec"),
    "whole": f"""SELECT * FROM (SELECT {_POINT} FROM base UNION ALL SELECT {_POINT} FROM rejudged_decided WHERE survivor)
  QUALIFY count(*) OVER (PARTITION BY {FILE}) >= 2""",
    "alt": f"""
  SELECT {_POINT}, coalesce(CASE WHEN p.rn = q.rn THEN p.m ELSE p.m + (q.m - p.m) * ((rn - p.rn) / CAST(q.rn - p.rn AS DOUBLE)) END, p.m, q.m) AS altitude_m
  FROM (SELECT *, last_value(known IGNORE NULLS) OVER ({_IN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
                  first_value(known IGNORE NULLS) OVER ({_IN} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q
        FROM (SELECT *, CASE WHEN altitude IS NOT NULL THEN {{'rn': rn, 'm': altitude * 0.3048::DOUBLE}} END AS known
              FROM (SELECT * REPLACE (CASE WHEN altitude <> -777 THEN altitude END AS altitude), row_number() OVER ({_IN}) AS rn FROM whole)))""",
    "steps": f"""
  SELECT *, {secs("p.datetime", "datetime")} AS step_s, {hav("p.lat", "p.lon", "lat", "lon")} AS step_m, {_speed("p.", "")} AS step_kmh
  FROM (SELECT *, lag({_SPOT}) OVER ({_IN}) AS p FROM alt)""",
    "clean": f"""
  SELECT {_POINT}, altitude_m, user_id::VARCHAR || '_' || source_file || '_' || CAST(seg AS VARCHAR) AS sub_trip_id, tz_name, {_local("datetime")} AS timestamp_local
  FROM (SELECT *, CAST(sum(CAST(coalesce(step_s > 1200, FALSE) OR coalesce(step_kmh > 1100, FALSE) AS BIGINT)) OVER ({_IN} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg,
               {zone("lat", "lon")} AS tz_name FROM steps)""",
    "quarantine": f"""
  SELECT * FROM dupq WHERE reason <> 'duplicate_invalid_anchors'
  UNION ALL SELECT {_POINT}, 'speed_spike' FROM marked WHERE is_spike
  UNION ALL SELECT {_POINT}, reason FROM rejudged_decided WHERE reason IS NOT NULL""",
    "chained": """
  SELECT *, row_number() OVER (PARTITION BY user_id, chain ORDER BY datetime, ord) AS rn, count(*) OVER (PARTITION BY user_id, chain) AS n_chain
  FROM (SELECT *, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY datetime, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain
        FROM (SELECT *, CAST(coalesce((epoch_us(datetime) - epoch_us(lag(datetime) OVER (PARTITION BY user_id ORDER BY datetime, ord))) / 1e6 > 64800, FALSE) AS BIGINT) AS cut
              FROM clean))""",
}


def _scan(name: str, anchor: bool, source: str = "chained", radius: int = 200, minutes: int = 30) -> str:
    """Greedy stay scan as a state machine: one step takes the next point in, or ends the window and restarts."""
    ref_lat, ref_lon = ("s.p0lat", "s.p0lon") if anchor else ("s.slat / s.n", "s.slon / s.n")
    inside = f"coalesce({mean_m(ref_lat, ref_lon, 'x.lat', 'x.lon')} <= {radius}, FALSE)"
    return f"""
  SELECT user_id, chain, n_chain, 1::BIGINT AS start_rn, 1::BIGINT AS cur, lat AS slat, lon AS slon, 1::BIGINT AS n, lat AS p0lat, lon AS p0lon,
         datetime AS t0, datetime AS t1, CAST(NULL AS BIGINT) AS from_rn, CAST(NULL AS BIGINT) AS to_rn
  FROM {source} WHERE rn = 1
  UNION ALL
  SELECT s.user_id, s.chain, s.n_chain,
         CASE WHEN w.ok THEN s.start_rn ELSE r.rn END, CASE WHEN w.ok THEN x.rn ELSE r.rn END,
         CASE WHEN w.ok THEN s.slat + x.lat ELSE r.lat END, CASE WHEN w.ok THEN s.slon + x.lon ELSE r.lon END,
         CASE WHEN w.ok THEN s.n + 1 ELSE 1 END, CASE WHEN w.ok THEN s.p0lat ELSE r.lat END, CASE WHEN w.ok THEN s.p0lon ELSE r.lon END,
         CASE WHEN w.ok THEN s.t0 ELSE r.datetime END, CASE WHEN w.ok THEN x.datetime ELSE r.datetime END,
         CASE WHEN NOT w.ok AND w.long THEN s.start_rn END, CASE WHEN NOT w.ok AND w.long THEN s.cur END
  FROM {name} s
  LEFT JOIN {source} x ON x.user_id = s.user_id AND x.chain = s.chain AND x.rn = s.cur + 1,
  LATERAL (SELECT {inside} AS ok, epoch_us(s.t1) - epoch_us(s.t0) >= {minutes * 60_000_000} AS long) w
  LEFT JOIN {source} r ON r.user_id = s.user_id AND r.chain = s.chain AND r.rn = CASE WHEN w.long THEN s.cur + 1 ELSE s.start_rn + 1 END
  WHERE s.start_rn <= s.n_chain"""


CTES["scan"] = _scan("scan", False)
CTES["scan_anchor"] = _scan("scan_anchor", True)
for _from, _to in (("scan", "stays"), ("scan_anchor", "stays_anchor")):
    CTES[_to] = f"""
  SELECT c.user_id, c.chain, s.from_rn, min(c.datetime) AS arrival, max(c.datetime) AS departure, avg(c.lat) AS lat, avg(c.lon) AS lon,
         count(*) AS num_points, avg(c.altitude_m) AS altitude_m,
         coalesce(sum(CASE WHEN c.rn > s.from_rn AND gap <= 1200 THEN gap END), 0) / 60.0 AS observed_minutes
  FROM {_from} s JOIN (SELECT *, (epoch_us(datetime) - epoch_us(lag(datetime) OVER (PARTITION BY user_id, chain ORDER BY rn))) / 1e6 AS gap FROM chained) c
    ON c.user_id = s.user_id AND c.chain = s.chain AND c.rn BETWEEN s.from_rn AND s.to_rn
  WHERE s.from_rn IS NOT NULL GROUP BY c.user_id, c.chain, s.from_rn"""


def cte(name: str) -> list[str]:
    """Names that a CTE or query needs, in order."""
    seen: list[str] = []

    def visit(n: str) -> None:
        for other in CTES:
            if other != n and re.search(rf"\b{other}\b", CTES[n]) and other not in seen:
                visit(other)
        if n not in seen:
            seen.append(n)

    visit(name)
    return seen


def query(body: str) -> str:
    """A SELECT with all CTEs that it names, directly or not."""
    needed: list[str] = []
    for name in CTES:
        if re.search(rf"\b{name}\b", body):
            needed += [n for n in cte(name) if n not in needed]
    recursive = "RECURSIVE " if any(n.startswith(("scan", "reach")) for n in needed) else ""
    if not needed:
        return body
    # Shared steps are evaluated once; recursive ones always are.
    kind = {n: "" if n.startswith(("scan", "reach")) else "MATERIALIZED " for n in needed}
    return f"WITH {recursive}" + ",\n".join(f"{n} AS {kind[n]}({CTES[n]})" for n in needed) + "\n" + body


CTES["st"] = """
  SELECT user_id, chain, from_rn AS stay, arrival, departure, lat, lon, num_points, altitude_m, observed_minutes,
         (epoch_us(departure) - epoch_us(arrival)) / 60e6::DOUBLE AS duration_minutes FROM stays"""
CTES["st_anchor"] = CTES["st"].replace("FROM stays", "FROM stays_anchor")
CTES["stl"] = f"""
  SELECT *, {_local("arrival")} AS arr, {_local("departure")} AS dep FROM (SELECT *, {zone("lat", "lon")} AS tz_name FROM st)"""
CTES["days"] = f"""
  SELECT *, {_minutes(22, 8)} AS home_min, CASE WHEN isodow(d) <= 5 THEN {_minutes(9, 18)} ELSE 0.0 END AS office_min
  FROM (SELECT *, unnest(generate_series(date_trunc('day', arr) - INTERVAL 1 DAY, date_trunc('day', dep), INTERVAL 1 DAY)) AS d FROM stl)"""
CTES["sc"] = """
  SELECT s.*, m.home, m.office FROM stl s
  JOIN (SELECT user_id, chain, stay, sum(home_min) AS home, sum(office_min) AS office FROM days GROUP BY ALL) m USING (user_id, chain, stay)
  WHERE duration_minutes >= 30"""
CTES["typed"] = """
  SELECT *, 'home' AS type, home AS minutes FROM sc WHERE home > 0 UNION ALL SELECT *, 'office', office FROM sc WHERE office > 0"""
CTES["win1"] = f"""
  SELECT *, CASE WHEN reason IS NULL THEN 'found' ELSE 'unknown' END AS status FROM (
    SELECT *, CASE WHEN minutes < 240 THEN 'too_few_window_minutes' WHEN support < 2 THEN 'one_off_place' END AS reason FROM (
      SELECT w.*, least(1.0, minutes / total) AS confidence,
             (SELECT count(*) FROM typed o WHERE o.user_id = w.user_id AND o.type = w.type AND {mean_m("w.lat", "w.lon", "o.lat", "o.lon")} <= 200) AS support
      FROM (SELECT *, sum(minutes) OVER (PARTITION BY user_id, type) AS total FROM typed
            QUALIFY row_number() OVER (PARTITION BY user_id, type ORDER BY minutes DESC, duration_minutes DESC, arrival) = 1) w))"""
CTES["ranked_stays"] = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arrival, lat, lon) - 1 AS node FROM st"
CTES["near_edges"] = f"""
  SELECT a.user_id, a.node AS a, b.node AS b FROM ranked_stays a JOIN ranked_stays b ON a.user_id = b.user_id
  WHERE abs(a.lat - b.lat) < 0.002 AND {mean_m("a.lat", "a.lon", "b.lat", "b.lon")} <= 150"""
CTES["reach"] = """
  SELECT user_id, node AS a, node AS b FROM ranked_stays
  UNION
  SELECT s.user_id, s.a, e.b FROM reach s JOIN near_edges e ON s.user_id = e.user_id AND s.b = e.a AND s.a < e.b"""
CTES["placed"] = """
  SELECT r.*, p.place FROM ranked_stays r JOIN (SELECT user_id, b AS node, min(a) AS place FROM reach GROUP BY ALL) p USING (user_id, node)"""
CTES["scp"] = "SELECT s.*, p.place FROM sc s JOIN placed p USING (user_id, chain, stay)"
CTES["pl"] = """
  SELECT g.*, d.home_days, d.office_days FROM (
    SELECT user_id, place, sum(home) AS home, sum(office) AS office, sum(lat * duration_minutes) / sum(duration_minutes) AS lat,
           sum(lon * duration_minutes) / sum(duration_minutes) AS lon, sum(duration_minutes) AS duration_minutes, count(*) AS visit_count,
           min(arrival) AS first_seen FROM scp GROUP BY ALL) g
  JOIN (SELECT p.user_id, p.place, count(DISTINCT d) FILTER (WHERE home_min > 0) AS home_days, count(DISTINCT d) FILTER (WHERE office_min > 0) AS office_days
        FROM days JOIN scp p USING (user_id, chain, stay) GROUP BY ALL) d USING (user_id, place)"""
CTES["win2"] = """
  SELECT *, CASE WHEN reason IS NULL THEN 'found' ELSE 'unknown' END AS status FROM (
    SELECT *, least(1.0, minutes / total) AS confidence,
           CASE WHEN minutes < 240 THEN 'too_few_window_minutes' WHEN n_days < 2 THEN 'one_off_place' END AS reason
    FROM (SELECT *, sum(minutes) OVER (PARTITION BY user_id, type) AS total FROM (
            SELECT *, 'home' AS type, home AS minutes, home_days AS n_days FROM pl WHERE home > 0
            UNION ALL SELECT *, 'office', office, office_days FROM pl WHERE office > 0)
          QUALIFY row_number() OVER (PARTITION BY user_id, type ORDER BY minutes DESC, duration_minutes DESC, first_seen) = 1))"""
CTES["compared"] = f"""
  SELECT user_id, type, CASE WHEN p.lat IS NULL AND s.lat IS NULL THEN 'both_unknown' WHEN p.lat IS NULL THEN 'shadow_only'
           WHEN s.lat IS NULL THEN 'primary_only' WHEN {mean_m("p.lat", "p.lon", "s.lat", "s.lon")} <= 200 THEN 'same_place' ELSE 'different_place' END AS outcome
  FROM (SELECT user_id, type, CASE WHEN status = 'found' THEN lat END AS lat, CASE WHEN status = 'found' THEN lon END AS lon FROM win1) p
  FULL JOIN (SELECT user_id, type, CASE WHEN status = 'found' THEN lat END AS lat, CASE WHEN status = 'found' THEN lon END AS lon FROM win2) s
  USING (user_id, type)"""
CTES["kept_steps"] = f"""
  SELECT *, {secs("p.datetime", "datetime")} AS step_s, {hav("p.lat", "p.lon", "lat", "lon")} AS step_m, {_speed("p.", "")} AS step_kmh
  FROM (SELECT *, lag({_SPOT}) OVER ({_IN}) AS p FROM kept)"""
CTES["mins"] = """
  SELECT user_id, strftime(datetime, '%Y-%m-%d %H:%M') AS m, arg_min(lat, (datetime, ord)) AS lat, arg_min(lon, (datetime, ord)) AS lon FROM kept GROUP BY 1, 2"""


CTES["chained_file"] = f"""
  SELECT *, row_number() OVER (PARTITION BY user_id, chain ORDER BY datetime, ord) AS rn, count(*) OVER (PARTITION BY user_id, chain) AS n_chain
  FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY source_file) - 1 AS chain FROM clean)"""
CTES["scan_file"] = _scan("scan_file", False, "chained_file")
SWEEP = [*[(x, 30) for x in (50, 100, 150, 200, 300, 500)], *[(200, t) for t in (5, 10, 15, 20, 45, 60)]]
for _r, _m in SWEEP:
    CTES[f"scan_{_r}_{_m}"] = _scan(f"scan_{_r}_{_m}", False, "chained", _r, _m)
CTES["members"] = """
  SELECT c.*, s.stay FROM chained c JOIN st s ON s.user_id = c.user_id AND s.chain = c.chain AND c.rn BETWEEN s.stay AND s.stay + s.num_points - 1"""
