"""Named queries that sum up and check what the operators found, and those around serving; each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.functions import times
from driftline.functions.geo import haversine_m, mean_haversine_m, round_half_up, seconds_between
from driftline.operators import classify, cleaning, intervals, monitoring, places, privacy, stays
from driftline.plans import catalogue as base
from driftline.plans import studies
from driftline.plans.catalogue import KEY, r, table
from driftline.plans.sqlbase import _IN, CTES, SWEEP, _minutes, geohash, hav, kmh, mean_m, rnd, secs
from driftline.plans.sqlbase import query as assembled
from driftline.plans.studies import FILE, STAY, _daily, _median, _spans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = assembled(sql)
        return f

    return register


def _n() -> Column:
    return F.count(F.lit(1))


def _total() -> Window:
    return Window.partitionBy(F.lit(0))


# --- users ---


@query(
    f"""SELECT p.user_id, p.points, p.files, p.first_seen, p.last_seen, coalesce(t.stays, 0) AS stays, {rnd('coalesce(t.hours, 0.0)', 6)} AS stay_hours
      FROM (SELECT user_id, count(*) AS points, count(DISTINCT source_file) AS files, min(datetime) AS first_seen, max(datetime) AS last_seen FROM clean GROUP BY 1) p
      LEFT JOIN (SELECT user_id, count(*) AS stays, sum(duration_minutes) / 60 AS hours FROM st GROUP BY 1) t USING (user_id)"""
)
def user_summary(s: SparkSession, d: str) -> DataFrame:
    """Every user with points, those without a stay included."""
    clean = base.clean(s, d)
    found = stays.stay_points(clean, pieces=base.pieces(s, d)).groupBy("user_id").agg(_n().alias("stays"), (F.sum("duration_minutes") / 60).alias("h"))
    p = clean.groupBy("user_id").agg(_n().alias("points"), F.count_distinct("source_file").alias("files"), F.min("datetime").alias("first_seen"), F.max("datetime").alias("last_seen"))
    rows = p.join(found, "user_id", "left")
    return rows.select("user_id", "points", "files", "first_seen", "last_seen", F.coalesce("stays", F.lit(0).cast("long")).alias("stays"), r("stay_hours", 6, F.coalesce("h", F.lit(0.0))))


_BOTH = f"""(SELECT h1.user_id, {mean_m('h2.lat', 'h2.lon', 'o2.lat', 'o2.lon')} / 1000 AS km, h2.n_days AS home_days, o2.n_days AS office_days,
  {mean_m('h1.lat', 'h1.lon', 'h2.lat', 'h2.lon')} AS home_m, {mean_m('o1.lat', 'o1.lon', 'o2.lat', 'o2.lon')} AS office_m
  FROM win1 h1 JOIN win1 o1 USING (user_id) JOIN win2 h2 USING (user_id) JOIN win2 o2 USING (user_id)
  WHERE h1.type = 'home' AND o1.type = 'office' AND h2.type = 'home' AND o2.type = 'office' AND h1.status = 'found' AND o1.status = 'found' AND h2.status = 'found' AND o2.status = 'found')"""


@query(
    f"""SELECT row_number() OVER (ORDER BY home_m <= 200 AND office_m <= 200 DESC, office_days DESC, home_days DESC, user_id) AS place, user_id, {rnd('km', 6)} AS home_office_km, home_days, office_days,
      home_m <= 200 AND office_m <= 200 AS v1_equals_v2 FROM {_BOTH} WHERE km >= 1 AND home_days >= 5 AND office_days >= 5"""
)
def candidate_users(s: SparkSession, d: str) -> DataFrame:
    """Users whose home and office both models find, a kilometre apart or more and on five days or more, the clearest first."""
    rows = base.scores(s, d)
    spot = [F.col("lat"), F.col("lon")]
    one = classify.winners_v1(rows).filter("status = 'found'").select("user_id", "type", F.struct(*spot).alias("p"), F.lit(None).cast("long").alias("days"), F.lit("v1").alias("m"))
    two = classify.winners_v2(classify.place_scores(rows, pieces=base.stay_pieces(s, d))).filter("status = 'found'").select("user_id", "type", F.struct(*spot).alias("p"), "days", F.lit("v2").alias("m"))
    pick = {f"{k}{n}": F.first(F.when((F.col("type") == k) & (F.col("m") == n), F.struct("p", "days")), ignorenulls=True).alias(f"{k}_{n}") for k in ("home", "office") for n in ("v1", "v2")}
    both = one.unionByName(two).groupBy("user_id").agg(*pick.values()).dropna()

    def metres(a: str, b: str) -> Column:
        return mean_haversine_m(f"{a}.p.lat", f"{a}.p.lon", f"{b}.p.lat", f"{b}.p.lon")

    both = both.select(
        "user_id", (metres("home_v2", "office_v2") / 1000).alias("km"), F.col("home_v2.days").alias("home_days"), F.col("office_v2.days").alias("office_days"),
        ((metres("home_v1", "home_v2") <= 200) & (metres("office_v1", "office_v2") <= 200)).alias("v1_equals_v2"),
    ).filter("km >= 1 AND home_days >= 5 AND office_days >= 5")
    order = _total().orderBy(F.desc("v1_equals_v2"), F.desc("office_days"), F.desc("home_days"), "user_id")
    return both.select(F.row_number().over(order).cast("long").alias("place"), "user_id", r("home_office_km", 6, F.col("km")), "home_days", "office_days", "v1_equals_v2")


@query("SELECT lpad(user_id::VARCHAR, 3, '0') AS user_key, count(*) AS n FROM kept GROUP BY 1 ORDER BY 1 LIMIT 10")
def first_users(s: SparkSession, d: str) -> DataFrame:
    """The first ten users in order of their padded key: a report, limited by design."""
    key = F.lpad(F.col("user_id").cast("string"), 3, "0").alias("user_key")
    return base.kept(s, d).groupBy(key).agg(_n().alias("n")).orderBy("user_key").limit(10)


# --- gaps and stages ---

_BANDS = [(0, "<=5m", 300.0), (1, "<=20m", 1200.0), (2, "<=1h", 3600.0), (3, "<=6h", 21600.0), (4, "<=18h", 64800.0), (5, ">18h", None)]
CTES["user_gap"] = f"""
  SELECT *, {secs('p.datetime', 'datetime')} AS g, {hav('p.lat', 'p.lon', 'lat', 'lon')} AS m FROM (
    SELECT *, lag({{'datetime': datetime, 'lat': lat, 'lon': lon}}) OVER (PARTITION BY user_id ORDER BY datetime, ord) AS p FROM clean) WHERE p IS NOT NULL"""


def _user_gap(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("datetime", "ord")
    rows = base.clean(s, d).withColumn("p", F.lag(F.struct("datetime", "lat", "lon")).over(w)).filter("p IS NOT NULL")
    return rows.withColumns({"g": seconds_between("p.datetime", "datetime"), "m": haversine_m("p.lat", "p.lon", "lat", "lon")})


@query(
    f"""SELECT b.band, b.name, count(g) AS n, count(DISTINCT user_id) AS users, {rnd('count(g) / CAST(sum(count(g)) OVER () AS DOUBLE)', 6)} AS share,
      {rnd('100 * avg(CAST(m <= 200 AS INT))', 6)} AS stationary_pct, {rnd('quantile_cont(m, 0.5)', 3)} AS median_m
      FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n, _ in _BANDS)}) b(band, name)
      LEFT JOIN (SELECT *, CASE {' '.join(f'WHEN g <= {t} THEN {i}' for i, _, t in _BANDS[:-1])} ELSE 5 END AS band FROM user_gap WHERE g > 0) x ON x.band = b.band GROUP BY ALL"""
)
def gap_bands(s: SparkSession, d: str) -> DataFrame:
    """Gaps by length: how many, of whom, and how often the user hadn't moved; empty bands stay."""
    rows = _user_gap(s, d).filter("g > 0")
    band = F.lit(5)
    for i, _, top in reversed(_BANDS[:-1]):
        band = F.when(F.col("g") <= top, i).otherwise(band)
    counted = rows.groupBy(band.alias("band")).agg(_n().alias("n"), F.count_distinct("user_id").alias("users"), (100 * F.avg((F.col("m") <= 200).cast("int"))).alias("still"), _median("m").alias("mid"))
    dim = s.createDataFrame([(i, name) for i, name, _ in _BANDS], "band int, name string")
    zero = F.lit(0).cast("long")
    out = dim.join(counted, "band", "left").withColumns({"n": F.coalesce("n", zero), "users": F.coalesce("users", zero)})
    return out.select("band", "name", "n", "users", r("share", 6, F.col("n") / F.sum("n").over(_total())), r("stationary_pct", 6, F.col("still")), r("median_m", of=F.col("mid")))


_LIMITS = (6, 12, 18, 24, 36, 48, None)
_COVERS = "CASE WHEN t3 >= a THEN t3 ELSE t3 + INTERVAL 1 DAY END <= b"
CTES["near_pairs"] = f"""
  SELECT *, {_COVERS} AS overnight FROM (SELECT *, date_trunc('day', a) + INTERVAL 3 HOUR AS t3 FROM (
    SELECT *, e + INTERVAL 8 HOUR AS a, ns + INTERVAL 8 HOUR AS b FROM file_pairs WHERE m <= 200 AND gap_h > 1 / 3::DOUBLE))"""


def _near_pairs(s: SparkSession, d: str) -> DataFrame:
    """Recordings that resume near the last end after 20 minutes or more, in local time of the study's city."""
    rows = studies._file_pairs(studies._file_ends(s, d)).filter("near").filter(F.col("gap_h") > 1 / 3)
    rows = rows.withColumns({"a": times.plus_seconds(F.col("end"), F.lit(28800)), "b": times.plus_seconds(F.col("next.start"), F.lit(28800))})
    three = times.plus_seconds(F.to_date("a").cast("timestamp_ntz"), F.lit(10800))
    return rows.withColumn("overnight", F.when(three >= F.col("a"), three).otherwise(times.plus_seconds(three, F.lit(86400))) <= F.col("b"))


@query(
    " UNION ALL ".join(
        f"""SELECT {t if t else 'NULL::INT'} AS hours, count(*) AS bridged, count(*) FILTER (WHERE overnight) AS overnight, count(DISTINCT user_id) AS users, {rnd('coalesce(sum(round(gap_h * 3600)), 0.0) / 3600', 3)} AS bridged_hours,
      {rnd('quantile_cont(gap_h, 0.5)', 6)} AS median_h FROM near_pairs {f'WHERE gap_h <= {t}' if t else ''}"""
        for t in _LIMITS
    )
)
def tmax_sweep(s: SparkSession, d: str) -> DataFrame:
    """What a limit on gaps between recordings would bridge; no limit comes last, as null."""
    rows = _near_pairs(s, d).withColumn("hours", F.explode(F.array(*[F.lit(t).cast("int") for t in _LIMITS]))).filter("hours IS NULL OR gap_h <= hours")
    return rows.groupBy("hours").agg(
        _n().alias("bridged"), F.count_if("overnight").alias("overnight"), F.count_distinct("user_id").alias("users"), r("bridged_hours", of=F.sum(F.round(F.col("gap_h") * 3600)) / 3600), r("median_h", 6, _median("gap_h"))
    )


@query(
    f"""SELECT CAST(i AS INT) AS hour, {rnd('100 * coalesce(x.n, 0) / (SELECT count(*) FROM near_pairs WHERE gap_h <= 18)::DOUBLE', 6)} AS end_pct,
      {rnd('100 * coalesce(y.n, 0) / (SELECT count(*) FROM near_pairs WHERE gap_h <= 18)::DOUBLE', 6)} AS start_pct FROM (SELECT unnest(range(24)) AS i)
      LEFT JOIN (SELECT hour(a) AS h, count(*) AS n FROM near_pairs WHERE gap_h <= 18 GROUP BY 1) x ON x.h = i LEFT JOIN (SELECT hour(b) AS h, count(*) AS n FROM near_pairs WHERE gap_h <= 18 GROUP BY 1) y ON y.h = i"""
)
def bridge_hours(s: SparkSession, d: str) -> DataFrame:
    """Local hours at which bridged gaps start and end, in percent, all 24."""
    ends = F.explode(F.array(F.struct(F.hour("a").alias("hour"), F.lit(0).alias("side")), F.struct(F.hour("b").alias("hour"), F.lit(1).alias("side"))))
    n = _near_pairs(s, d).filter("gap_h <= 18").select(ends.alias("x")).groupBy("x.hour").agg(*[F.count_if(F.col("x.side") == i).alias(k) for i, k in enumerate(("a", "b"))])
    rows = s.range(24).select(F.col("id").cast("int").alias("hour")).join(n, "hour", "left").fillna(0)
    return rows.select("hour", *[r(k, 6, 100 * F.col(c) / F.sum(c).over(_total())) for k, c in (("end_pct", "a"), ("start_pct", "b"))])


@query(
    " UNION ALL ".join(
        f"""SELECT '{n}' AS stage, count(*) AS stays, count(DISTINCT user_id) AS users, {rnd('sum(duration_minutes)', 3)} AS minutes, {rnd('max(duration_minutes)', 3)} AS longest,
      count(*) FILTER (WHERE duration_minutes > 2880) AS over_48h FROM {t}"""
        for n, t in (("centroid", "st"), ("anchor", "st_anchor"))
    )
)
def stage_summary(s: SparkSession, d: str) -> DataFrame:
    clean, out = base.clean(s, d), None
    for name, anchor in (("centroid", False), ("anchor", True)):
        rows = stays.stay_points(clean, anchor=anchor, pieces=base.pieces(s, d))
        part = rows.agg(
            F.lit(name).alias("stage"), _n().alias("stays"), F.count_distinct("user_id").alias("users"), r("minutes", of=F.sum("duration_minutes")), r("longest", of=F.max("duration_minutes")),
            F.count_if(F.col("duration_minutes") > 2880).alias("over_48h"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""SELECT user_id, arrival, {rnd('m', 3)} AS shift_m, {rnd('dd', 3)} AS duration_change, overlapping, reasons, CASE WHEN m <= 50 AND abs(dd) <= 10 THEN 'small' ELSE 'large' END AS change FROM (
      SELECT a.user_id, a.chain, a.stay, a.arrival, arg_min(b.duration_minutes - a.duration_minutes, ({rnd(mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon'), 6)}, b.arrival)) AS dd, min({mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS m,
        count(*) AS overlapping, (SELECT coalesce(string_agg(DISTINCT q.reason, ',' ORDER BY q.reason), '') FROM quarantine q WHERE q.user_id = a.user_id AND q.datetime BETWEEN a.arrival AND a.departure) AS reasons
      FROM st_anchor a JOIN st b ON a.user_id = b.user_id AND a.arrival < b.departure AND a.departure > b.arrival
      GROUP BY a.user_id, a.chain, a.stay, a.arrival, a.departure)"""
)
def stage_match_nearest(s: SparkSession, d: str) -> DataFrame:
    """Each stay of one way of detection beside the nearest overlapping of the other: shift, change of duration, what was rejected in its time."""
    good, bad = cleaning.clean(base.by_file(s, d))
    a, b = _spans(stays.stay_points(good, anchor=True, pieces=base.pieces(s, d))), _spans(stays.stay_points(good, pieces=base.pieces(s, d)))
    metres = mean_haversine_m("l.lat", "l.lon", "r.lat", "r.lon")
    change = F.col("r.duration_minutes") - F.col("l.duration_minutes")
    met = intervals.meeting(a, b, ["user_id"]).groupBy("user_id", "l.chain", "l.stay", F.col("l.start").alias("arrival")).agg(
        F.min(metres).alias("m"), F.min_by(change, F.struct(round_half_up(metres, 6), "r.start")).alias("dd"), _n().alias("overlapping")
    )
    inside = intervals.meeting(a, bad.select("user_id", F.col("datetime").alias("start"), F.col("datetime").alias("end"), "reason"), ["user_id"], touching=True)
    reasons = inside.groupBy("user_id", "l.chain", "l.stay").agg(F.array_join(F.array_sort(F.collect_set("r.reason")), ",").alias("reasons"))
    rows = met.join(reasons, STAY, "left")
    small = (F.col("m") <= 50) & (F.abs("dd") <= 10)
    return rows.select(
        "user_id", "arrival", r("shift_m", of=F.col("m")), r("duration_change", of=F.col("dd")), "overlapping", F.coalesce("reasons", F.lit("")).alias("reasons"), F.when(small, "small").otherwise("large").alias("change")
    )


@query(
    f"""SELECT covered, overlapped, inside, count(*) AS n FROM (
      SELECT coalesce(bool_or(l.start <= g.p.datetime AND l."end" >= g.datetime), FALSE) AS covered, coalesce(bool_or(l.start < g.datetime AND l."end" > g.p.datetime), FALSE) AS overlapped,
        coalesce(bool_or(l.start >= g.p.datetime AND l."end" <= g.datetime), FALSE) AS inside
      FROM user_gap g LEFT JOIN lab l ON l.user_id = g.user_id AND l.start <= g.datetime AND l."end" >= g.p.datetime WHERE g.g > 1200 GROUP BY g.user_id, g.source_file, g.ord) GROUP BY ALL"""
)
def gap_label_evidence(s: SparkSession, d: str) -> DataFrame:
    """Long gaps by what labels say: one covers the gap, overlaps it, lies in it, or none."""
    gaps = _user_gap(s, d).filter("g > 1200").select(*KEY, F.col("p.datetime").alias("start"), F.col("datetime").alias("end"))
    met = intervals.meeting(gaps, base.labels(s, d), ["user_id"], touching=True)
    tests = {
        "covered": (F.col("r.start") <= F.col("l.start")) & (F.col("r.end") >= F.col("l.end")),
        "overlapped": (F.col("r.start") < F.col("l.end")) & (F.col("r.end") > F.col("l.start")),
        "inside": (F.col("r.start") >= F.col("l.start")) & (F.col("r.end") <= F.col("l.end")),
    }
    found = met.groupBy("user_id", "l.source_file", "l.ord").agg(*[F.bool_or(c).alias(n) for n, c in tests.items()])
    rows = gaps.join(found, KEY, "left")
    return rows.groupBy(*[F.coalesce(n, F.lit(False)).alias(n) for n in tests]).agg(_n().alias("n"))


CTES["chain_spans"] = "SELECT user_id, chain, min(datetime) AS c0, max(datetime) AS c1 FROM chained GROUP BY ALL"


@query(
    """SELECT p.user_id, count(*) AS stops, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM chain_spans c WHERE c.user_id = p.user_id AND c.c0 <= p.s0 AND c.c1 >= p.s1)) AS inside_chain
      FROM stops p GROUP BY 1"""
)
def label_stops(s: SparkSession, d: str) -> DataFrame:
    """Stops between labelled trips, and those that one chain of recordings holds."""
    stops = studies._stops(s, d)
    spans = base.chained(s, d).groupBy("user_id", "chain").agg(F.min("datetime").alias("c0"), F.max("datetime").alias("c1"))
    # Chains of a user don't overlap: the last that began before the stop is the only one that can hold it.
    rows = stops.select("user_id", F.col("start").alias("t"), F.lit(1).alias("kind"), F.col("end").alias("e")).unionByName(spans.select("user_id", F.col("c0").alias("t"), F.lit(0).alias("kind"), F.col("c1").alias("e")))
    w = Window.partitionBy("user_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("c1", F.last(F.when(F.col("kind") == 0, F.col("e")), ignorenulls=True).over(w)).filter("kind = 1")
    return rows.groupBy("user_id").agg(_n().alias("stops"), F.count_if(F.col("c1") >= F.col("e")).alias("inside_chain"))


# --- stays, checked and swept ---


@query(" UNION ALL ".join(f"SELECT {a} AS radius_m, {b} AS minutes, count(*) AS stays, count(DISTINCT user_id) AS users FROM scan_{a}_{b} WHERE from_rn IS NOT NULL" for a, b in SWEEP))
def stay_sweep(s: SparkSession, d: str) -> DataFrame:
    """Stays under twelve settings, from one pass over the chains."""
    found = stays.sweep(base.chained(s, d), SWEEP, pieces=base.pieces(s, d))
    return found.groupBy("radius_m", "minutes").agg(F.sum("stays").alias("stays"), F.count_distinct("user_id").alias("users"))


CTES["walked"] = """
  SELECT m.*, avg(lat) OVER w AS rlat, avg(lon) OVER w AS rlon, lag(datetime) OVER (PARTITION BY user_id, chain, stay ORDER BY rn) AS before
  FROM members m WINDOW w AS (PARTITION BY user_id, chain, stay ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query(
    f"""SELECT count(*) AS stays, count(*) FILTER (WHERE NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)) AS bad_bounds, count(*) FILTER (WHERE num_points <> n OR n < 2) AS bad_count,
      count(*) FILTER (WHERE abs(lat - mlat) > 1e-9 OR abs(lon - mlon) > 1e-9) AS bad_centroid, count(*) FILTER (WHERE duration_minutes < 30) AS bad_duration,
      count(*) FILTER (WHERE observed_minutes > duration_minutes + 1e-6) AS bad_observed, count(*) FILTER (WHERE gap > 64800) AS bad_gap, count(*) FILTER (WHERE far > 200.000001) AS bad_radius,
      count(*) FILTER (WHERE next_m <= 199.999999) AS bad_maximal, count(*) FILTER (WHERE nx < departure) AS bad_overlap FROM (
      SELECT s.*, w.*, lead(s.arrival) OVER (PARTITION BY s.user_id ORDER BY s.arrival) AS nx, {mean_m('w.mlat', 'w.mlon', 'c.lat', 'c.lon')} AS next_m
      FROM st s JOIN (SELECT user_id AS u, chain AS ch, stay AS sy, count(*) AS n, avg(lat) AS mlat, avg(lon) AS mlon, max(rn) AS last_rn, max({secs('before', 'datetime')}) AS gap,
        max({mean_m('rlat', 'rlon', 'lat', 'lon')}) AS far FROM walked GROUP BY ALL) w ON w.u = s.user_id AND w.ch = s.chain AND w.sy = s.stay
      LEFT JOIN chained c ON c.user_id = s.user_id AND c.chain = s.chain AND c.rn = w.last_rn + 1)"""
)
def stay_invariants(s: SparkSession, d: str) -> DataFrame:
    """Nine properties that every stay has: bounds, count, centre, length, recorded time, gaps, radius as it grew, no further point, no overlap."""
    chains = base.chained(s, d)
    order = Window.partitionBy("user_id", "chain").orderBy("datetime", "ord")
    members = stays.stay_members(chains.withColumn("after", F.lead(F.struct("lat", "lon")).over(order)))
    inside = Window.partitionBy(*STAY).orderBy("datetime", "ord")
    grown = inside.rowsBetween(Window.unboundedPreceding, -1)
    walked = members.withColumns({"rlat": F.avg("lat").over(grown), "rlon": F.avg("lon").over(grown), "before": F.lag("datetime").over(inside)})
    figures = walked.groupBy(*STAY).agg(
        _n().alias("n"), F.avg("lat").alias("mlat"), F.avg("lon").alias("mlon"), F.max(seconds_between("before", "datetime")).alias("gap"),
        F.max(mean_haversine_m("rlat", "rlon", "lat", "lon")).alias("far"), F.max_by("after", F.struct("datetime", "ord")).alias("after"),
    )
    nxt = F.lead("arrival").over(Window.partitionBy("user_id").orderBy("arrival"))
    rows = stays.stays_of(members.drop("after")).withColumn("nx", nxt).join(figures, STAY)
    checks = {
        "bounds": ~(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)),
        "count": (F.col("num_points") != F.col("n")) | (F.col("n") < 2),
        "centroid": (F.abs(F.col("lat") - F.col("mlat")) > 1e-9) | (F.abs(F.col("lon") - F.col("mlon")) > 1e-9),
        "duration": F.col("duration_minutes") < stays.LEAST_MINUTES,
        "observed": F.col("observed_minutes") > F.col("duration_minutes") + 1e-6,
        "gap": F.col("gap") > stays.CUT_HOURS * 3600,
        "radius": F.col("far") > stays.RADIUS_M + 1e-6,
        "maximal": mean_haversine_m("mlat", "mlon", "after.lat", "after.lon") <= stays.RADIUS_M - 1e-6,
        "overlap": F.col("nx") < F.col("departure"),
    }
    return rows.agg(_n().alias("stays"), *[F.count_if(c).alias(f"bad_{k}") for k, c in checks.items()])


@query(
    f"""SELECT user_id, '{{"type":"' || type || '","geohash":"' || ({geohash('lat', 'lon', 6)}) || '","support":' || support
      || CASE WHEN a IS NOT NULL AND a <> 0 THEN ',"altitude_m":' || a ELSE '' END || '}}' AS payload
      FROM (SELECT *, CAST(round(altitude_m) AS BIGINT) AS a FROM win1 WHERE status = 'found')"""
)
def result_json(s: SparkSession, d: str) -> DataFrame:
    """Answers as JSON: the geohash is derived again from the position, and an altitude of zero is left out."""
    rows = classify.winners_v1(base.scores(s, d)).filter("status = 'found'")
    altitude = F.nullif(F.round("altitude_m").cast("long"), F.lit(0).cast("long")).alias("altitude_m")
    return rows.select("user_id", F.to_json(F.struct("type", "geohash", "support", altitude)).alias("payload"))


# --- rules ---


@query(
    """SELECT user_id, type, min(arrival) AS earliest, max(arrival) AS latest, arg_max(arrival, (duration_minutes, -epoch_us(arrival))) AS longest, count(*) AS tied FROM (
      SELECT *, rank() OVER (PARTITION BY user_id, type ORDER BY round(minutes, 3) DESC) AS rk FROM typed) WHERE rk = 1 GROUP BY ALL"""
)
def tie_breaks(s: SparkSession, d: str) -> DataFrame:
    """Of the stays with most minutes the earliest, the latest and the longest."""
    w = Window.partitionBy("user_id", "type").orderBy(F.desc(F.round("minutes", 3)))
    rows = classify.by_type(base.scores(s, d)).withColumn("rk", F.rank().over(w)).filter("rk = 1")
    longest = F.max_by("arrival", F.struct("duration_minutes", -F.unix_micros(F.col("arrival").cast("timestamp"))))
    return rows.groupBy("user_id", "type").agg(F.min("arrival").alias("earliest"), F.max("arrival").alias("latest"), longest.alias("longest"), _n().alias("tied"))


CTES["office_again"] = f"""
  SELECT o.* FROM (SELECT * FROM typed WHERE type = 'office') o LEFT JOIN (SELECT user_id, arrival FROM win1 WHERE type = 'home') h ON h.user_id = o.user_id AND h.arrival = o.arrival
  WHERE h.arrival IS NULL QUALIFY row_number() OVER (PARTITION BY o.user_id ORDER BY o.minutes DESC, o.duration_minutes DESC, o.arrival) = 1"""


@query(
    f"""SELECT count(*) AS users, count(*) FILTER (WHERE {mean_m('h.lat', 'h.lon', 'o.lat', 'o.lon')} <= 200) AS same_area, count(*) FILTER (WHERE h.arrival = o.arrival) AS same_stay,
      count(a.user_id) AS picked_again, count(*) FILTER (WHERE {mean_m('a.lat', 'a.lon', 'o.lat', 'o.lon')} <= 200) AS again_same
      FROM (SELECT * FROM win1 WHERE type = 'home') h JOIN (SELECT * FROM win1 WHERE type = 'office') o USING (user_id) LEFT JOIN office_again a USING (user_id)"""
)
def home_office_overlap(s: SparkSession, d: str) -> DataFrame:
    """Homes and offices in one place, and whether the office stays when the home's stay may not be it."""
    rows = base.scores(s, d)
    won = classify.winners_v1(rows).select("user_id", "type", "lat", "lon", "arrival")
    home, office = won.filter("type = 'home'"), won.filter("type = 'office'")
    best = Window.partitionBy("user_id").orderBy(F.desc("minutes"), F.desc("duration_minutes"), "arrival")
    left = classify.by_type(rows).filter("type = 'office'").join(home.select("user_id", "arrival"), ["user_id", "arrival"], "left_anti")
    again = left.withColumn("rk", F.row_number().over(best)).filter("rk = 1").select("user_id", "lat", "lon", F.lit(True).alias("is_picked"))
    both = home.alias("h").join(office.alias("o"), "user_id").join(again.alias("a"), "user_id", "left")
    return both.agg(
        _n().alias("users"), F.count_if(mean_haversine_m("h.lat", "h.lon", "o.lat", "o.lon") <= 200).alias("same_area"), F.count_if(F.col("h.arrival") == F.col("o.arrival")).alias("same_stay"),
        F.count("is_picked").alias("picked_again"), F.count_if(mean_haversine_m("a.lat", "a.lon", "o.lat", "o.lon") <= 200).alias("again_same"),
    )


@query(
    f"""SELECT type, count(*) FILTER (WHERE m < w) AS below, count(*) FILTER (WHERE m = w) AS exact, count(*) FILTER (WHERE m > w) AS above, count(*) FILTER (WHERE tied > 1) AS ties,
      {rnd('avg(CAST(support = 1 AS INT))', 6)} AS one_off_share FROM (
      SELECT x.type, x.support, {rnd('x.minutes', 3)} AS m, CASE x.type WHEN 'home' THEN 600 ELSE 540 END AS w,
        (SELECT count(*) FROM typed t WHERE t.user_id = x.user_id AND t.type = x.type AND {rnd('t.minutes', 3)} = {rnd('x.minutes', 3)}) AS tied FROM win1 x) GROUP BY 1"""
)
def winner_fills(s: SparkSession, d: str) -> DataFrame:
    """Winners that fill less, exactly or more than one window, ties, and places seen once."""
    rows = base.scores(s, d)
    tied = classify.by_type(rows).groupBy("user_id", "type", r("m", of=F.col("minutes"))).agg(_n().alias("tied"))
    won = classify.winners_v1(rows).select("user_id", "type", "support", r("m", of=F.col("minutes")), F.when(F.col("type") == "home", 600).otherwise(540).alias("w"))
    won = won.join(tied, ["user_id", "type", "m"])
    return won.groupBy("type").agg(
        F.count_if(F.col("m") < F.col("w")).alias("below"), F.count_if(F.col("m") == F.col("w")).alias("exact"), F.count_if(F.col("m") > F.col("w")).alias("above"),
        F.count_if(F.col("tied") > 1).alias("ties"), r("one_off_share", 6, F.avg((F.col("support") == 1).cast("int"))),
    )


@query(
    """SELECT type, v1, v2, count(*) AS n, CAST(grouping_id(v1, v2) AS BIGINT) AS gid FROM (
      SELECT a.type, coalesce(a.reason, a.status) AS v1, coalesce(b.reason, b.status) AS v2 FROM win1 a JOIN win2 b USING (user_id, type)) GROUP BY GROUPING SETS ((type, v1, v2), (type, v1), (type, v2), (type))"""
)
def status_crosstab(s: SparkSession, d: str) -> DataFrame:
    """Outcomes of both models against each other, with margins per type."""
    rows = base.scores(s, d)
    outcome = F.coalesce("reason", "status")
    a = classify.winners_v1(rows).select("user_id", "type", outcome.alias("v1"))
    b = classify.winners_v2(classify.place_scores(rows, pieces=base.stay_pieces(s, d))).select("user_id", "type", outcome.alias("v2"))
    cells = F.explode(F.array(*[F.struct(F.lit(g).cast("long").alias("gid"), (F.col("v1") if not g & 2 else F.lit(None)).alias("v1"), (F.col("v2") if not g & 1 else F.lit(None)).alias("v2")) for g in range(4)]))
    return a.join(b, ["user_id", "type"]).select("type", cells.alias("x")).groupBy("type", "x.v1", "x.v2", "x.gid").agg(_n().alias("n"))


@query(
    f"""SELECT user_id, {', '.join(f"{rnd(f'CASE WHEN sum(d.{k}) > 0 THEN 1 - sum(o.{k}) / sum(d.{k}) END', 6)} AS {k}_unobserved" for k in ('home', 'office'))}
      FROM sc d JOIN seen_minutes o USING (user_id, chain, stay) GROUP BY 1"""
)
def unobserved_share(s: SparkSession, d: str) -> DataFrame:
    """Share of a user's window minutes without recorded points."""
    rows = studies._observed(s, d)
    share = {k: F.when(F.sum(k) > 0, 1 - F.sum(f"{k}_seen") / F.sum(k)) for k in ("home", "office")}
    return rows.groupBy("user_id").agg(*[r(f"{k}_unobserved", 6, v) for k, v in share.items()])


@query(
    f"""SELECT coalesce(a.hour, b.hour) AS hour, coalesce(a.n, 0) AS present, coalesce(b.n, 0) AS arrivals, {rnd('coalesce(b.n, 0) / sum(coalesce(b.n, 0)) OVER ()', 6)} AS arrival_share FROM (
      SELECT hour(slot) AS hour, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('hour', arr), dep, INTERVAL 1 HOUR)) AS slot FROM stl) GROUP BY 1) a
      FULL JOIN (SELECT hour(arr) AS hour, count(*) AS n FROM stl GROUP BY 1) b ON a.hour = b.hour"""
)
def overnight_hours(s: SparkSession, d: str) -> DataFrame:
    """Stays present at each local hour, and those that arrive in it."""
    slots = studies._slots(stays.localized(base.stay_table(s, d)))
    starts = F.date_format("slot", "yyyyMMddHH") == F.date_format("arrival_local", "yyyyMMddHH")
    rows = slots.groupBy(F.hour("slot").alias("hour")).agg(_n().alias("present"), F.count_if(starts).alias("arrivals"))
    return rows.select("hour", "present", "arrivals", r("arrival_share", 6, F.col("arrivals") / F.sum("arrivals").over(_total())))


@query(
    """SELECT coalesce(a.hour, b.hour) AS hour, coalesce(a.n, 0) AS local_slots, coalesce(b.n, 0) AS gmt_slots FROM (
      SELECT hour(h) AS hour, count(*) AS n FROM (SELECT DISTINCT user_id, date_trunc('hour', timestamp_local) AS h FROM clean) GROUP BY 1) a
      FULL JOIN (SELECT hour(h) AS hour, count(*) AS n FROM (SELECT DISTINCT user_id, date_trunc('hour', datetime) AS h FROM clean) GROUP BY 1) b ON a.hour = b.hour"""
)
def active_hours(s: SparkSession, d: str) -> DataFrame:
    """Distinct hours with points by clock hour, in local time and in GMT."""
    both = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.date_format(c, "yyyyMMddHH").alias("slot"), F.hour(c).alias("hour")) for i, c in enumerate(("timestamp_local", "datetime"))]))
    rows = base.clean(s, d).select("user_id", both.alias("x")).select("user_id", "x.*").distinct()
    return rows.groupBy("hour").agg(*[F.count_if(F.col("side") == i).alias(n) for i, n in enumerate(("local_slots", "gmt_slots"))])


# --- speeds ---

_SPEED_Q = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p99_9": 0.999, "p99_99": 0.9999}


def _labelled_steps(s: SparkSession, d: str) -> DataFrame:
    return base._in_interval(cleaning.with_steps(base.kept(s, d)).filter("step_kmh IS NOT NULL"), base.labels(s, d))


CTES["label_steps"] = """
  SELECT l.mode, k.* FROM kept_steps k JOIN lab l ON k.user_id = l.user_id AND k.datetime BETWEEN l.start AND l."end" WHERE k.step_kmh IS NOT NULL"""


@query(f"SELECT mode, count(*) AS n, {rnd('avg(step_kmh)', 3)} AS mean, {', '.join(f'{rnd(f"quantile_cont(step_kmh, {q})", 3)} AS {n}' for n, q in _SPEED_Q.items())}, {rnd('max(step_kmh)', 3)} AS high FROM label_steps GROUP BY 1")
def speed_stats_by_mode(s: SparkSession, d: str) -> DataFrame:
    q = F.percentile("step_kmh", F.array(*map(F.lit, _SPEED_Q.values())))
    return _labelled_steps(s, d).groupBy("mode").agg(_n().alias("n"), r("mean", of=F.avg("step_kmh")), *[r(n, of=F.get(q, i)) for i, n in enumerate(_SPEED_Q)], r("high", of=F.max("step_kmh")))


@query(
    f"""SELECT mode, count(*) AS n, {rnd('quantile_cont(step_m, 0.5)', 3)} AS p50, {rnd('quantile_cont(step_m, 0.99)', 3)} AS p99, {rnd('quantile_cont(step_m, 0.999)', 3)} AS p99_9
      FROM label_steps WHERE step_s = 300 GROUP BY 1 HAVING count(*) >= 1000"""
)
def gps_noise(s: SparkSession, d: str) -> DataFrame:
    """Metres of the shortest regular step, five minutes here, by mode, where there are a thousand or more."""
    q = F.percentile("step_m", F.array(F.lit(0.5), F.lit(0.99), F.lit(0.999)))
    rows = _labelled_steps(s, d).filter("step_s = 300").groupBy("mode").agg(_n().alias("n"), *[r(n, of=F.get(q, i)) for i, n in enumerate(("p50", "p99", "p99_9"))])
    return rows.filter("n >= 1000")


#: Highest real speeds in km/h by mode; events stand for modes.
_TOP_KMH = {"view": 8.0, "signup": 20.0, "click": 100.0, "purchase": 350.0, "error": 1100.0}


@query(
    " UNION ALL ".join(
        f"""SELECT {k} AS k, mode, count(*) AS n, {', '.join(f'{rnd(f"quantile_cont(v, {q})", 3)} AS {n}' for n, q in (('p50', 0.5), ('p95', 0.95), ('p99', 0.99), ('p99_9', 0.999)))},
      {rnd(f"100 * avg(CAST(v > CASE mode {' '.join(f'''WHEN '{m}' THEN {x}''' for m, x in _TOP_KMH.items())} END AS INT))", 6)} AS over_pct FROM (
      SELECT mode, greatest(0.0, m - 50) / t * 3.6 AS v FROM (SELECT mode, {hav('a.lat', 'a.lon', 'lat', 'lon')} AS m, {secs('a.datetime', 'datetime')} AS t FROM (
        SELECT *, lag({{'datetime': datetime, 'lat': lat, 'lon': lon}}, {k}) OVER ({_IN}) AS a FROM moded)) WHERE t > 0 AND mode IS NOT NULL) GROUP BY mode"""
        for k in (5, 10)
    )
)
def corrected_speed(s: SparkSession, d: str) -> DataFrame:
    """Speeds over five and ten points less the noise of positions, and how often they pass what the mode can reach."""
    rows = base.kept(s, d).select(*KEY, "datetime", "lat", "lon")
    hit = base._in_interval(rows, base.labels(s, d)).groupBy(*KEY).agg(F.max_by("mode", F.struct("start", "label_id")).alias("mode"))
    order, spot = Window.partitionBy(*FILE).orderBy("datetime", "ord"), F.struct("datetime", "lat", "lon")
    rows = rows.join(hit, KEY, "left").withColumns({f"a{k}": F.lag(spot, k).over(order) for k in (5, 10)}).filter("mode IS NOT NULL")
    rows = rows.withColumn("x", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"a{k}").alias("a")) for k in (5, 10)])))
    rows = rows.select("mode", "x.k", haversine_m("x.a.lat", "x.a.lon", "lat", "lon").alias("m"), seconds_between("x.a.datetime", "datetime").alias("t")).filter("t > 0")
    v = F.greatest(F.lit(0.0), F.col("m") - 50) / F.col("t") * 3.6
    top = s.createDataFrame(list(_TOP_KMH.items()), "mode string, top double")
    rows = rows.withColumn("v", v).join(top, "mode", "left")
    q = F.percentile("v", F.array(*map(F.lit, (0.5, 0.95, 0.99, 0.999))))
    return rows.groupBy("k", "mode").agg(_n().alias("n"), *[r(n, of=F.get(q, i)) for i, n in enumerate(("p50", "p95", "p99", "p99_9"))], r("over_pct", 6, 100 * F.avg((F.col("v") > F.col("top")).cast("int"))))


@query("SELECT user_id, strftime(datetime, '%M:%S') IN ('00:00', '30:00') AS round_clock, count(*) AS n FROM dec WHERE valid_spread_m > 200 GROUP BY ALL")
def dup_round_time(s: SparkSession, d: str) -> DataFrame:
    """Repeated seconds with positions far apart: on the full or half hour, by user."""
    rows = cleaning.decide(cleaning.dup_candidates(base.gated(s, d)).filter("is_candidate")).filter("valid_spread_m > 200")
    return rows.groupBy("user_id", F.date_format("datetime", "mm:ss").isin("00:00", "30:00").alias("round_clock")).agg(_n().alias("n"))


def _at(limit: int) -> str:
    return f"CASE WHEN inv THEN 'invalid_anchors' WHEN n_valid = 0 THEN 'no_valid' WHEN n_valid = 1 THEN 'single_valid' WHEN valid_spread_m > {limit} THEN 'ambiguous' ELSE 'tie_break' END AS at_{limit}"


@query(
    f"""SELECT at_200, at_500, count(*) AS n, CAST(grouping_id(at_200, at_500) AS BIGINT) AS gid, {rnd('quantile_cont(moved, 0.5)', 3)} AS moved_p50, {rnd('quantile_cont(moved, 0.9)', 3)} AS moved_p90 FROM (
      SELECT d.*, {_at(200)}, {_at(500)}, p.moved FROM dec d LEFT JOIN (
        SELECT user_id, source_file, datetime, {hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS moved FROM (
          SELECT user_id, source_file, datetime, arg_min({{'lat': lat, 'lon': lon}}, (score, bad_altitude, ord)) AS x, arg_min({{'lat': lat, 'lon': lon}}, (bad_altitude, ord)) AS y
          FROM cand WHERE valid GROUP BY ALL)) p USING (user_id, source_file, datetime)) GROUP BY CUBE (at_200, at_500)"""
)
def decision_transition(s: SparkSession, d: str) -> DataFrame:
    """Decisions under two limits with margins, and how far apart the points are that two rules would keep."""
    judged = cleaning.dup_candidates(base.gated(s, d)).filter("is_candidate")
    key = [*FILE, "datetime"]
    spot = F.struct("lat", "lon")
    picks = judged.filter("valid").groupBy(*key).agg(F.min_by(spot, F.struct("score", "bad_altitude", "ord")).alias("x"), F.min_by(spot, F.struct("bad_altitude", "ord")).alias("y"))
    moved = picks.select(*key, haversine_m("x.lat", "x.lon", "y.lat", "y.lon").alias("moved"))
    rows = cleaning.decide(judged).join(moved, key, "left")

    def at(limit: int) -> Column:
        several = F.col("n_valid") > 1
        return F.when(several & (F.col("decision") != "invalid_anchors"), F.when(F.col("valid_spread_m") > limit, "ambiguous").otherwise("tie_break")).otherwise(F.col("decision")).alias(f"at_{limit}")

    q = F.percentile("moved", F.array(F.lit(0.5), F.lit(0.9)))
    return rows.select(at(200), at(500), "moved").cube("at_200", "at_500").agg(_n().alias("n"), F.grouping_id().cast("long").alias("gid"), r("moved_p50", of=F.get(q, 0)), r("moved_p90", of=F.get(q, 1)))


@query(
    f"""SELECT count(*) FILTER (WHERE altitude = -777) AS no_altitude, count(*) FILTER (WHERE NOT (lat BETWEEN 18 AND 54 AND lon BETWEEN 73 AND 135)) AS outside, count(*) AS n,
      count(*) - count(DISTINCT (user_id, source_file, datetime)) AS repeated, {rnd('avg(CAST(coalesce(v > 180, FALSE) AS INT))', 8)} AS drift_share, {rnd('max(g)', 3)} AS largest_gap_s FROM (
      SELECT *, {secs('p.datetime', 'datetime')} AS g, {kmh(hav('p.lat', 'p.lon', 'lat', 'lon'), secs('p.datetime', 'datetime'))} AS v FROM (SELECT *, lag({{'datetime': datetime, 'lat': lat, 'lon': lon}}) OVER ({_IN}) AS p FROM pts))"""
)
def eda_quality(s: SparkSession, d: str) -> DataFrame:
    """Raw points at a glance: missing altitudes, positions out of the country, repeated seconds, steps over 180 km/h, the longest gap in a recording."""
    rows = cleaning.with_steps(base.points(s, d))
    home = F.col("lat").between(18, 54) & F.col("lon").between(73, 135)
    return rows.agg(
        F.count_if(F.col("altitude") == -777).alias("no_altitude"), F.count_if(~home).alias("outside"), _n().alias("n"), (_n() - F.count_distinct(*FILE, "datetime")).alias("repeated"),
        r("drift_share", 8, F.avg(F.coalesce(F.col("step_kmh") > 180, F.lit(False)).cast("int"))), r("largest_gap_s", of=F.max("step_s")),
    )


@query(
    f"""SELECT user_id, source_file, ord, {rnd('altitude_m', 6)} AS altitude_m FROM (
      SELECT *, CASE WHEN altitude <> -777 THEN altitude * 0.3048::DOUBLE END AS altitude_m, {kmh(hav('p.lat', 'p.lon', 'lat', 'lon'), secs('p.datetime', 'datetime'))} AS v FROM (
        SELECT *, lag({{'datetime': datetime, 'lat': lat, 'lon': lon}}) OVER ({_IN}) AS p FROM (
          SELECT * FROM pts WHERE lat BETWEEN 18 AND 54 AND lon BETWEEN 73 AND 135 QUALIFY row_number() OVER (PARTITION BY user_id, source_file, datetime ORDER BY ord) = 1))) WHERE v IS NULL OR v <= 180"""
)
def naive_cleaning(s: SparkSession, d: str) -> DataFrame:
    """The first, simple cleaning: a box, one point a second, metres of altitude, steps of at most 180 km/h."""
    rows = base.points(s, d).filter(F.col("lat").between(18, 54) & F.col("lon").between(73, 135))
    first = Window.partitionBy(*FILE, "datetime").orderBy("ord")
    rows = cleaning.with_steps(rows.withColumn("rk", F.row_number().over(first)).filter("rk = 1")).filter("step_kmh IS NULL OR step_kmh <= 180")
    return rows.select(*KEY, r("altitude_m", 6, F.when(F.col("altitude") != -777, F.col("altitude") * cleaning.FEET)))


# --- windows ---


@query(
    f"""SELECT event_id, ntile(4) OVER w AS quarter, {rnd('percent_rank() OVER w', 6)} AS percent_rank, {rnd('cume_dist() OVER w', 6)} AS cume_dist,
      count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(date_trunc('second', ts)) // 1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS last_day
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def rank_frames(s: SparkSession, d: str) -> DataFrame:
    """Quarters, relative ranks and a frame by time: events of the user in the day before each."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    second = F.floor(seconds_between(F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))).cast("long")
    rows = table(s, d, "events").withColumn("second", second)
    day = Window.partitionBy("user_id").orderBy("second").rangeBetween(-86400, 0)
    return rows.select("event_id", F.ntile(4).over(w).alias("quarter"), r("percent_rank", 6, F.percent_rank().over(w)), r("cume_dist", 6, F.cume_dist().over(w)), F.count(F.lit(1)).over(day).alias("last_day"))


@query(f"SELECT event_id, {rnd('avg(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)', 6)} AS mean_so_far FROM events")
def streaming_mean(s: SparkSession, d: str) -> DataFrame:
    """The mean of a counter after each of its values."""
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(s, d, "events").select("event_id", r("mean_so_far", 6, F.avg("value").over(w)))


@query(
    """SELECT user_id, source_file, ord, count(*) AS around FROM (
      SELECT q.user_id, q.source_file, q.ord FROM quarantine q JOIN clean c ON c.user_id = q.user_id AND c.datetime BETWEEN q.datetime - INTERVAL 30 MINUTE AND q.datetime + INTERVAL 30 MINUTE
      WHERE q.reason = 'speed_spike') GROUP BY ALL"""
)
def time_context(s: SparkSession, d: str) -> DataFrame:
    """Clean points in the half hour before and after each spike."""
    good, bad = cleaning.clean(base.by_file(s, d))
    spikes = bad.filter("reason = 'speed_spike'")
    around = spikes.select(*KEY, times.plus_seconds(F.col("datetime"), F.lit(-1800)).alias("start"), times.plus_seconds(F.col("datetime"), F.lit(1800)).alias("end"))
    there = good.select("user_id", F.col("datetime").alias("start"), F.col("datetime").alias("end"))
    met = intervals.meeting(around, there, ["user_id"], touching=True)
    return met.groupBy("user_id", "l.source_file", "l.ord").agg(_n().alias("around"))


@query(
    f"""SELECT count(*) AS quarantined, count(q.user_id) AS with_stays FROM (SELECT DISTINCT user_id FROM quarantine) k LEFT JOIN (SELECT DISTINCT user_id FROM st) q ON q.user_id = k.user_id"""
)
def spikes_near_users(s: SparkSession, d: str) -> DataFrame:
    """Users with rejected points, and those of them with stays."""
    good, bad = cleaning.clean(base.by_file(s, d))
    found = stays.stay_points(good, pieces=base.pieces(s, d)).select("user_id").distinct().withColumn("has", F.lit(True))
    return bad.select("user_id").distinct().join(found, "user_id", "left").agg(_n().alias("quarantined"), F.count("has").alias("with_stays"))


@query("""SELECT count(*) AS spikes FROM quarantine q WHERE reason = 'speed_spike' AND EXISTS (
      SELECT 1 FROM st WHERE st.user_id = q.user_id AND q.datetime BETWEEN st.arrival - INTERVAL 30 MINUTE AND st.departure + INTERVAL 30 MINUTE)""")
def spikes_near_stays(s: SparkSession, d: str) -> DataFrame:
    good, bad = cleaning.clean(base.by_file(s, d))
    wide = stays.stay_points(good, pieces=base.pieces(s, d)).select("user_id", times.plus_seconds(F.col("arrival"), F.lit(-1800)).alias("start"), times.plus_seconds(F.col("departure"), F.lit(1800)).alias("end"))
    spikes = bad.filter("reason = 'speed_spike'").select(*KEY, F.col("datetime").alias("start"), F.col("datetime").alias("end"))
    met = intervals.meeting(spikes, wide, ["user_id"], touching=True).select("user_id", "l.source_file", "l.ord").distinct()
    return met.agg(_n().alias("spikes"))


@query(
    f"""SELECT user_id, chain, stay, {rnd('sum(m)', 3)} AS total, {rnd('max(m)', 3)} AS longest, count(*) AS labels FROM (
      SELECT s.user_id, s.chain, s.stay, (epoch_us(least(s.departure, l."end")) - epoch_us(greatest(s.arrival, l.start))) / 60e6::DOUBLE AS m
      FROM st s JOIN lab l ON s.user_id = l.user_id AND s.arrival < l."end" AND s.departure > l.start) GROUP BY ALL"""
)
def interval_overlap_sum(s: SparkSession, d: str) -> DataFrame:
    met = intervals.meeting(_spans(base.stay_table(s, d)), base.labels(s, d), ["user_id"], pieces=base.stay_pieces(s, d))
    minutes = intervals.shared_minutes()
    return met.groupBy("user_id", "l.chain", "l.stay").agg(r("total", of=F.sum(minutes)), r("longest", of=F.max(minutes)), _n().alias("labels"))


@query("""SELECT user_id, max(m) AS longest FROM (SELECT s.user_id, (epoch_us(least(s.departure, l."end")) - epoch_us(greatest(s.arrival, l.start))) / 60e6::DOUBLE AS m
      FROM st s JOIN lab l ON s.user_id = l.user_id AND s.arrival < l."end" AND s.departure > l.start) GROUP BY 1""")
def interval_overlap_max(s: SparkSession, d: str) -> DataFrame:
    met = intervals.meeting(_spans(base.stay_table(s, d)), base.labels(s, d), ["user_id"], pieces=base.stay_pieces(s, d))
    return met.groupBy("user_id").agg(F.max(intervals.shared_minutes()).alias("longest"))


# --- zones ---

#: Cities, their positions and zones, as atlases give them.
_ATLAS = [
    ("Beijing", 39.90, 116.40, "Asia/Shanghai"), ("Shanghai", 31.23, 121.47, "Asia/Shanghai"), ("Wuhan", 30.59, 114.31, "Asia/Shanghai"), ("Nanning", 22.82, 108.32, "Asia/Shanghai"),
    ("Tianjin", 39.13, 117.20, "Asia/Shanghai"), ("Hong Kong", 22.30, 114.17, "Asia/Hong_Kong"), ("Taipei", 25.03, 121.57, "Asia/Taipei"), ("Seoul", 37.57, 126.98, "Asia/Seoul"),
    ("Tokyo", 35.68, 139.69, "Asia/Tokyo"), ("Kyoto", 35.01, 135.77, "Asia/Tokyo"), ("Delhi", 28.66, 77.23, "Asia/Kolkata"), ("Agra", 27.18, 78.01, "Asia/Kolkata"), ("Pune", 18.52, 73.86, "Asia/Kolkata"),
    ("Kathmandu", 27.72, 85.32, "Asia/Kathmandu"), ("Bangkok", 13.76, 100.50, "Asia/Bangkok"), ("Phnom Penh", 11.56, 104.92, "Asia/Phnom_Penh"), ("Siem Reap", 13.36, 103.86, "Asia/Phnom_Penh"),
    ("Singapore", 1.35, 103.82, "Asia/Singapore"), ("Dubai", 25.20, 55.27, "Asia/Dubai"), ("Moscow", 55.76, 37.62, "Europe/Moscow"), ("Paris", 48.86, 2.35, "Europe/Paris"), ("Nice", 43.70, 7.27, "Europe/Paris"),
    ("Berlin", 52.52, 13.40, "Europe/Berlin"), ("Leipzig", 51.34, 12.37, "Europe/Berlin"), ("London", 51.51, -0.13, "Europe/London"), ("Leeds", 53.80, -1.55, "Europe/London"), ("Madrid", 40.42, -3.70, "Europe/Madrid"),
    ("Rome", 41.90, 12.50, "Europe/Rome"), ("Bologna", 44.49, 11.34, "Europe/Rome"), ("Cairo", 30.04, 31.24, "Africa/Cairo"), ("Nairobi", -1.29, 36.82, "Africa/Nairobi"), ("New York", 40.71, -74.01, "America/New_York"),
    ("Baltimore", 39.29, -76.61, "America/New_York"), ("Chicago", 41.88, -87.63, "America/Chicago"), ("San Antonio", 29.42, -98.49, "America/Chicago"), ("Denver", 39.74, -104.99, "America/Denver"),
    ("Phoenix", 33.45, -112.07, "America/Phoenix"), ("Los Angeles", 34.05, -118.24, "America/Los_Angeles"), ("Sacramento", 38.58, -121.49, "America/Los_Angeles"), ("Seattle", 47.61, -122.33, "America/Los_Angeles"),
    ("Sao Paulo", -23.55, -46.63, "America/Sao_Paulo"), ("Sydney", -33.87, 151.21, "Australia/Sydney"), ("Perth", -31.95, 115.86, "Australia/Perth"), ("Auckland", -36.85, 174.76, "Pacific/Auckland"),
]


@query(f"SELECT * FROM (VALUES {', '.join(f"('{c}', '{z}', timezone('{z}', timezone('UTC', TIMESTAMP '2024-07-01 12:00:00')))" for c, _, _, z in _ATLAS)}) t(city, zone, noon_gmt)")
def city_zones(s: SparkSession, d: str) -> DataFrame:
    """Zones of known cities by position, and the local time of one moment there, summer time included."""
    rows = s.createDataFrame([x[:3] for x in _ATLAS], "city string, lat double, lon double").withColumn("zone", times.zone_of(F.col("lat"), F.col("lon")))
    return rows.select("city", "zone", times.to_local(F.lit("2024-07-01 12:00:00").cast("timestamp_ntz"), F.col("zone")).alias("noon_gmt"))


# --- serving ---


def _metric_rows(s: SparkSession, d: str) -> DataFrame:
    """Answers as monitoring sees them: a number for the type, the sum of the position's degrees as value."""
    kind = F.when(F.col("type") == "home", 0).when(F.col("type") == "office", 1).otherwise(3)
    rows = classify.winners_v1(base.scores(s, d))
    return rows.select("user_id", kind.alias("kind"), (F.col("lat") + F.col("lon")).alias("value"), F.col("arrival").alias("seen"))


CTES["metric_rows"] = "SELECT user_id, CASE type WHEN 'home' THEN 0 WHEN 'office' THEN 1 ELSE 3 END AS kind, lat + lon AS value, arrival AS seen FROM win1"


@query(f"SELECT user_id, kind, {rnd('value', 9)} AS value, seen FROM metric_rows")
def drift_record(s: SparkSession, d: str) -> DataFrame:
    return _metric_rows(s, d).select("user_id", "kind", r("value", 9), "seen")


_WINDOW = 500
CTES["by_place"] = "SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events"
CTES["two_windows"] = f"""
  SELECT event_type, n, avg(value) FILTER (WHERE rn <= {_WINDOW}) AS b, count(*) FILTER (WHERE rn <= {_WINDOW}) AS nb, avg(value) FILTER (WHERE rn > greatest({_WINDOW}, n - {_WINDOW})) AS c,
         count(*) FILTER (WHERE rn > greatest({_WINDOW}, n - {_WINDOW})) AS nc FROM by_place GROUP BY ALL"""


def _two_windows(events: DataFrame) -> DataFrame:
    """Means and sizes of a metric's first ``_WINDOW`` values and of its last, which don't overlap."""
    placed = monitoring.positions(events, "event_type", ["ts", "event_id"])
    first, last = F.col("rn") <= _WINDOW, F.col("rn") > F.greatest(F.lit(_WINDOW), F.col("n") - _WINDOW)
    return placed.groupBy("event_type", "n").agg(
        F.avg(F.when(first, F.col("value"))).alias("b"), F.count_if(first).alias("nb"), F.avg(F.when(last, F.col("value"))).alias("c"), F.count_if(last).alias("nc")
    )


@query(f"SELECT event_type, {rnd('b', 6)} AS baseline, nb FROM two_windows WHERE nb >= {_WINDOW // 2}")
def drift_baseline(s: SparkSession, d: str) -> DataFrame:
    """The mean of a metric's first window, if half of it is there."""
    return _two_windows(table(s, d, "events")).filter(F.col("nb") >= _WINDOW // 2).select("event_type", r("baseline", 6, F.col("b")), "nb")


_CHANGE = "CASE WHEN b = 0 THEN abs(c) ELSE abs(c - b) / abs(b) END"


@query(
    f"""SELECT event_type, {rnd('ch', 6)} AS change, CASE WHEN ch IS NULL THEN 'insufficient' WHEN ch < 0.05 THEN 'none' WHEN ch < 0.1 THEN 'low' WHEN ch < 0.2 THEN 'medium' ELSE 'high' END AS severity,
      coalesce(ch >= 0.1, FALSE) AS detected FROM (SELECT event_type, CASE WHEN nb >= {_WINDOW // 2} AND nc >= {_WINDOW // 4} THEN {_CHANGE} END AS ch FROM two_windows)"""
)
def drift_check(s: SparkSession, d: str) -> DataFrame:
    """Change of the last window's mean against the first's; too few values give no verdict."""
    rows = _two_windows(table(s, d, "events"))
    enough = (F.col("nb") >= _WINDOW // 2) & (F.col("nc") >= _WINDOW // 4)
    found = F.when(enough, monitoring.drift(F.col("b"), F.col("c"), 0.1))
    rows = rows.select("event_type", found.alias("x"))
    return rows.select("event_type", r("change", 6, F.col("x.change")), F.coalesce("x.severity", F.lit("insufficient")).alias("severity"), F.coalesce("x.detected", F.lit(False)).alias("detected"))


@query(f"SELECT event_type, batch, count(*) AS n, {rnd('avg(value)', 4)} AS mean FROM (SELECT *, CAST(floor((rn - 1) / 1000) AS BIGINT) AS batch FROM by_place) GROUP BY ALL")
def drift_replay(s: SparkSession, d: str) -> DataFrame:
    rows = monitoring.positions(table(s, d, "events"), "event_type", ["ts", "event_id"])
    return rows.groupBy("event_type", F.floor((F.col("rn") - 1) / 1000).cast("long").alias("batch")).agg(_n().alias("n"), r("mean", 4, F.avg("value")))


@query(
    f"""SELECT event_type, day, {rnd('ch', 6)} AS change FROM (
      SELECT x.event_type, day, abs(m - b) / abs(b) AS ch FROM (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS m FROM events GROUP BY ALL) x JOIN two_windows w ON w.event_type = x.event_type)
      WHERE ch >= 0.1 AND day > (SELECT CAST(max(ts) AS DATE) FROM events) - 7"""
)
def recent_alerts(s: SparkSession, d: str) -> DataFrame:
    """Days of the last week on which a metric's mean is a tenth or more off its baseline."""
    events = table(s, d, "events")
    base_mean = _two_windows(events).select("event_type", "b")
    last = events.agg(F.to_date(F.max("ts")).alias("last"))
    days = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("m"))
    rows = days.join(base_mean, "event_type").crossJoin(last).withColumn("ch", F.abs(F.col("m") - F.col("b")) / F.abs("b"))  # last: one row
    return rows.filter((F.col("ch") >= 0.1) & (F.col("day") > F.date_sub("last", 7))).select("event_type", "day", r("change", 6, F.col("ch")))


@query(
    f"""SELECT event_type, count(*) AS n, {rnd('avg(value)', 4)} AS mean, quantile_cont(value, 0.5) AS p50, max(value) FILTER (WHERE rn = least(floor(c * 0.95::DOUBLE), c - 1)) AS p95,
      max(value) FILTER (WHERE rn = least(floor(c * 0.99::DOUBLE), c - 1)) AS p99, count(*) FILTER (WHERE value >= 100) AS errors
      FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS c FROM events) GROUP BY 1"""
)
def latency_stats(s: SparkSession, d: str) -> DataFrame:
    stats = monitoring.latency(table(s, d, "events"), ["event_type"], "value", failed=F.col("value") >= 100)
    return stats.select("event_type", F.col("count").alias("n"), r("mean", 4), "p50", "p95", "p99", "errors")


@query(
    """SELECT 'request_latency_p95{route="' || event_type || '"} ' || CAST(max(value) FILTER (WHERE rn = least(floor(c * 0.95::DOUBLE), c - 1)) AS DECIMAL(18, 3)) AS line
      FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS c FROM events) GROUP BY event_type"""
)
def metrics_exposition(s: SparkSession, d: str) -> DataFrame:
    stats = monitoring.latency(table(s, d, "events"), ["event_type"], "value").withColumnRenamed("event_type", "route")
    return monitoring.exposition(stats.withColumn("p95", F.col("p95").cast("decimal(18,3)")), "request_latency_p95", "route", "p95")


_U = "((CAST('0x' || substr(md5('n|{0}|' || ord), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE - 0.5::DOUBLE)"
_NOISE = "-0.01::DOUBLE * sign({0}) * ln(1 - 2 * abs({0}))"


@query(
    f"SELECT {', '.join(KEY)}, {rnd('least(90.0, greatest(-90.0, lat + ' + _NOISE.format(_U.format('lat')) + '))', 8)} AS lat, "
    f"{rnd('least(180.0, greatest(-180.0, lon + ' + _NOISE.format(_U.format('lon')) + '))', 8)} AS lon FROM kept"
)
def dp_noise(s: SparkSession, d: str) -> DataFrame:
    """Positions with Laplace noise that follows from a hash of the point."""
    return privacy.noisy(base.kept(s, d), 1.0).select(*KEY, r("lat", 8), r("lon", 8))


@query(
    """SELECT user_id, '{"user_id":' || user_id || ',"type":"' || type || '","status":"' || status || '"' || CASE WHEN reason IS NOT NULL THEN ',"reason":"' || reason || '"' ELSE '' END || '}' AS line FROM win1"""
)
def answer_log(s: SparkSession, d: str) -> DataFrame:
    """A structured log line for each answer; what is missing is left out."""
    return classify.winners_v1(base.scores(s, d)).select("user_id", F.to_json(F.struct("user_id", "type", "status", "reason")).alias("line"))


@query(
    """SELECT rk // 100 AS chunk, state, count(*) AS users FROM (
      SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS rk, CASE WHEN user_id % 13 = 0 THEN 'failed' ELSE 'completed' END AS state FROM (SELECT DISTINCT user_id FROM sc)) GROUP BY ALL"""
)
def batch_classify(s: SparkSession, d: str) -> DataFrame:
    """Users in chunks of a hundred; one user's bad stay fails that user alone.  Every thirteenth user gets a stay that ends before it starts."""
    rows = base.scores(s, d)
    broken = F.col("user_id") % 13 == 0
    sent = rows.withColumn("sent_departure", F.when(broken, times.plus_seconds(F.col("arrival"), F.lit(-60))).otherwise(F.col("departure")))
    bad = sent.groupBy("user_id").agg(F.bool_or(F.col("sent_departure") <= F.col("arrival")).alias("bad"))
    answers = classify.winners_v1(rows.join(bad.filter("NOT bad").select("user_id"), "user_id", "left_semi")).select("user_id").distinct().withColumn("done", F.lit(True))
    users = bad.join(answers, "user_id", "left").withColumn("rk", F.dense_rank().over(_total().orderBy("user_id")) - 1)
    state = F.when(F.col("bad"), "failed").otherwise(F.when(F.col("done") | F.col("done").isNull(), "completed"))
    return users.groupBy(F.floor(F.col("rk") / 100).cast("long").alias("chunk"), state.alias("state")).agg(_n().alias("users"))


@query(
    f"""SELECT user_id, chain, stay, arrival, departure, {rnd('altitude_m', 3)} AS altitude_m FROM (
      SELECT user_id, chain, stay, arrival, departure, CASE WHEN stay % 3 = 0 THEN NULL ELSE altitude_m END AS altitude_m FROM st) WHERE departure > arrival"""
)
def coerced_stays(s: SparkSession, d: str) -> DataFrame:
    """Stays under either of two sets of names, times as text with a zone or without, NaN for missing numbers: one form comes out."""
    rows = base.stay_table(s, d)
    text = F.date_format(times.plus_seconds(F.col("arrival"), F.lit(8 * 3600)), "yyyy-MM-dd'T'HH:mm:ss")
    odd = F.col("stay") % 2 == 1
    sent = rows.select(
        *STAY, F.when(odd, F.concat(text, F.lit("+08:00"))).alias("arrival_time"), F.when(~odd, F.date_format("arrival", "yyyy-MM-dd'T'HH:mm:ss")).alias("arrival"),
        F.when(odd, F.date_format("departure", "yyyy-MM-dd'T'HH:mm:ss")).alias("departure_time"), F.when(~odd, F.date_format("departure", "yyyy-MM-dd'T'HH:mm:ss")).alias("departure"),
        F.when(F.col("stay") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("altitude_m")).alias("altitude_m"),
    )
    return classify.coerced(sent).select(*STAY, "arrival", "departure", r("altitude_m"))


@query("""SELECT 'v1' AS version, count(*) FILTER (WHERE status = 'found') AS found FROM win1 UNION ALL SELECT 'v2', count(*) FILTER (WHERE status = 'found') FROM win2""")
def model_versions(s: SparkSession, d: str) -> DataFrame:
    """Answers of every registered version of the classifier."""
    rows, out = base.scores(s, d), None
    for version, model in classify.MODELS.items():
        part = model(rows, base.stay_pieces(s, d)).agg(F.lit(version).alias("version"), F.count_if(F.col("status") == "found").alias("found"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """SELECT count(*) AS users, count(*) FILTER (WHERE same) AS same FROM (SELECT user_id, bool_and(n = 1) AS same FROM (
      SELECT user_id, place, count(DISTINCT place) AS n FROM placed GROUP BY ALL) GROUP BY 1)"""
)
def partition_equality(s: SparkSession, d: str) -> DataFrame:
    """Users whose stays two ways of clustering put together alike, whatever the clusters are called."""
    rows, n = base.stay_table(s, d).select("user_id", "arrival", "lat", "lon"), base.stay_pieces(s, d)
    a = places.dbscan(rows, 150.0, 2, pieces=n).select("user_id", "arrival", F.col("place").alias("a"))
    b = places.dbscan(rows.withColumn("day", F.col("arrival")), 150.0, 2, days="day", pieces=n).select("user_id", "arrival", F.col("place").alias("b"))
    both = a.join(b, ["user_id", "arrival"]).groupBy("user_id", "a", "b").agg(_n().alias("n"))
    sides = both.groupBy("user_id").agg(_n().alias("cells"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"))
    return sides.agg(_n().alias("users"), F.count_if((F.col("cells") == F.col("na")) & (F.col("cells") == F.col("nb"))).alias("same"))


@query(f"SELECT user_id, source_file, ord, reason, {rnd('lat', 6)} AS lat FROM quarantine")
def csv_scan(s: SparkSession, d: str) -> DataFrame:
    """Rejected points written as lines of a table and read by its columns."""
    bad = cleaning.clean(base.by_file(s, d))[1]
    line = F.to_csv(F.struct("user_id", "source_file", "ord", "reason", "lat"))
    kinds = "user_id LONG, source_file STRING, ord LONG, reason STRING, lat DOUBLE"
    return bad.select(F.from_csv(line, kinds).alias("x")).select("x.user_id", "x.source_file", "x.ord", "x.reason", r("lat", 6, F.col("x.lat")))


@query("SELECT event_type, k, count(*) AS n FROM ev GROUP BY ALL")
def json_scan(s: SparkSession, d: str) -> DataFrame:
    """The properties of events, parsed from their JSON."""
    props = F.from_json("props", "k LONG")
    return table(s, d, "events").groupBy("event_type", F.coalesce(props["k"], F.lit(0).cast("long")).alias("k")).agg(_n().alias("n"))


@query("SELECT a.user_id AS user_a, b.user_id AS user_b, count(*) AS minutes FROM mins a JOIN mins b ON a.m = b.m AND a.user_id < b.user_id WHERE " + mean_m("a.lat", "a.lon", "b.lat", "b.lon") + " <= 200 GROUP BY ALL")
def colocation(s: SparkSession, d: str) -> DataFrame:
    """Minutes that two users spend within 200 m: users of a minute meet by cells of the grid, not all with all."""
    minute = F.date_format("datetime", "yyyy-MM-dd HH:mm")
    one = base.kept(s, d).groupBy("user_id", minute.alias("minute")).agg(F.min_by(F.struct("lat", "lon"), F.struct("datetime", "ord")).alias("at"))
    one = one.select("minute", F.col("user_id").alias("id"), "at.lat", "at.lon")
    met = places.radius_pairs(one, one, ["minute"], 200.0).filter("a < b")
    return met.groupBy(F.col("a").alias("user_a"), F.col("b").alias("user_b")).agg(_n().alias("minutes"))
