"""Named queries that evaluate the operators: detection against labels, jumps, shared recordings, rules and their stability.

Each stands beside its DuckDB SQL, which is written from the definitions and shares no step with the DataFrame code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.functions import geo, times
from driftline.functions.geo import haversine_m, mean_haversine_m, seconds_between
from driftline.operators import classify, cleaning, excursions, graphs, intervals, places, stays
from driftline.operators.grouped import in_pieces
from driftline.plans import catalogue as base
from driftline.plans.catalogue import KEY, r, table
from driftline.plans.sqlbase import _IN, CTES, _minutes, geohash, hav, kmh, mean_m, rnd, secs
from driftline.plans.sqlbase import query as assembled
from driftline.sources import traces

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FILE = cleaning.FILE
STAY = ["user_id", "chain", "stay"]


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = assembled(sql)
        return f

    return register


def _values(xs: tuple | list) -> Column:
    return F.explode(F.array(*map(F.lit, xs)))


def _median(c: str | Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def _ladder(value: Column, edges: list[float], names: list[str]) -> Column:
    """The name of the first edge that the value doesn't reach; the last name beyond all."""
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names[:-1], strict=True))):
        out = F.when(value < edge, name).otherwise(out)
    return out


def _sql_ladder(value: str, edges: list[float], names: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {value} < {e} THEN '{n}'" for e, n in zip(edges, names[:-1], strict=True)) + f" ELSE '{names[-1]}' END"


# --- sources ---

CTES["log_lines"] = """
  SELECT *, 6 + row_number() OVER (PARTITION BY user_id, source_file ORDER BY datetime, ord) - 1 AS line_no FROM pts"""


@query(
    f"""SELECT CAST(user_id AS VARCHAR) AS user_id, source_file || '.plt' AS source_file, line_no AS ord, datetime, {rnd('lat', 6)} AS lat, {rnd('lon', 6)} AS lon,
      CASE WHEN ord % 89 <> 0 THEN altitude END AS altitude FROM log_lines WHERE ord % 97 <> 0"""
)
def plt_scan(s: SparkSession, d: str) -> DataFrame:
    """Points written as log lines, header and broken lines included, and parsed again."""
    order = Window.partitionBy(*FILE).orderBy("datetime", "ord")
    rows = base.points(s, d).withColumn("n", F.row_number().over(order) + traces.HEADER_LINES - 1)
    day = F.when(F.col("ord") % 97 == 0, "no day").otherwise(F.date_format("datetime", "yyyy-MM-dd"))
    line = F.concat_ws(
        ",", F.format_string("%.6f", "lat"), F.format_string("%.6f", "lon"), F.lit("0"),
        F.when(F.col("ord") % 89 == 0, "?").otherwise(F.col("altitude").cast("string")), F.lit("40000"), day, F.date_format("datetime", "HH:mm:ss"),
    )
    name = F.concat(F.lit("/logs/"), "user_id", F.lit("/Trajectory/"), "source_file", F.lit(".plt"))
    lines = rows.select(name.alias("file"), F.col("n").cast("int").alias("ord"), line.alias("line"))
    head = rows.groupBy(*FILE).agg(F.count(F.lit(1))).select(name.alias("file"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("ord"), F.lit("39.9,116.3,0,1,1,2024-01-01,00:00:00").alias("line"))
    return traces.parse_plt(lines.unionByName(head)).select("user_id", "source_file", "ord", "datetime", r("lat", 6), r("lon", 6), "altitude")


# --- detection against labelled trips ---

CTES["stops"] = """
  SELECT user_id, label_id, "end" AS s0, nx AS s1, (epoch_us(nx) - epoch_us("end")) / 60e6::DOUBLE AS minutes
  FROM (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY start, label_id) AS nx FROM lab)
  WHERE (epoch_us(nx) - epoch_us("end")) / 60e6::DOUBLE BETWEEN 15 AND 1080"""
CTES["stop_cover"] = """
  SELECT p.user_id, p.label_id, any_value(p.minutes) AS minutes,
         coalesce(sum(CASE WHEN st.arrival IS NOT NULL THEN (epoch_us(least(st.departure, p.s1)) - epoch_us(greatest(st.arrival, p.s0))) / 60e6::DOUBLE END), 0.0)
           / any_value(p.minutes) AS covered
  FROM stops p LEFT JOIN st ON st.user_id = p.user_id AND st.arrival < p.s1 AND st.departure > p.s0 GROUP BY p.user_id, p.label_id"""
CTES["stay_trips"] = """
  SELECT st.user_id, st.chain, st.stay, st.duration_minutes, l.label_id, l.mode, (epoch_us(l."end") - epoch_us(l.start)) / 3600e6::DOUBLE AS trip_h,
         (epoch_us(least(st.departure, l."end")) - epoch_us(greatest(st.arrival, l.start))) / 60e6::DOUBLE AS m
  FROM st JOIN lab l ON st.user_id = l.user_id AND st.arrival < l."end" AND st.departure > l.start"""
CTES["false_stays"] = """
  SELECT * FROM (SELECT * FROM stay_trips QUALIFY row_number() OVER (PARTITION BY user_id, chain, stay ORDER BY m DESC, label_id) = 1)
  WHERE m >= 0.8 * greatest(duration_minutes, 1e-9)"""


def _stops(s: SparkSession, d: str) -> DataFrame:
    nxt = F.lead("start").over(Window.partitionBy("user_id").orderBy("start", "label_id"))
    rows = in_pieces(base.labels(s, d), base.stay_pieces(s, d), "user_id").withColumn("nxt", nxt).withColumn("minutes", seconds_between("end", "nxt") / 60)
    return rows.filter("minutes BETWEEN 15 AND 1080").select("user_id", "label_id", F.col("end").alias("start"), F.col("nxt").alias("end"), "minutes")


def _spans(rows: DataFrame) -> DataFrame:
    return rows.select(*STAY, "duration_minutes", "lat", "lon", F.col("arrival").alias("start"), F.col("departure").alias("end"))


def _covered(spans: DataFrame, stops: DataFrame, pieces: int | None = None) -> DataFrame:
    met = intervals.meeting(stops, spans, ["user_id"], pieces=pieces).groupBy("user_id", F.col("l.label_id").alias("label_id")).agg(F.sum(intervals.shared_minutes()).alias("m"))
    return stops.join(met, ["user_id", "label_id"], "left").withColumn("covered", F.coalesce("m", F.lit(0.0)) / F.col("minutes"))


def _false_stays(spans: DataFrame, trips: DataFrame, pieces: int | None = None) -> DataFrame:
    """The trip that each stay overlaps most, if it holds four fifths of the stay."""
    met = intervals.meeting(spans, trips, ["user_id"], pieces=pieces).withColumn("m", intervals.shared_minutes())
    best = in_pieces(met, pieces, "user_id").groupBy("user_id", F.col("l.chain").alias("chain"), F.col("l.stay").alias("stay")).agg(
        F.max_by(F.struct("l", "r", "m"), F.struct("m", -F.col("r.label_id"))).alias("b")
    )
    rows = best.select(*STAY, "b.m", "b.r.mode", F.col("b.l.duration_minutes").alias("duration_minutes"), (seconds_between("b.r.start", "b.r.end") / 3600).alias("trip_h"))
    return rows.withColumn("is_false", F.col("m") >= 0.8 * F.greatest(F.col("duration_minutes"), F.lit(1e-9)))


@query(
    f"""SELECT (SELECT count(*) FROM st) AS stay_points, long_stops, {rnd('recall', 6)} AS stop_recall, {rnd('covered', 6)} AS time_covered, false_n AS false_stays,
      {rnd('100 * false_n / hours', 6)} AS false_per_100_h, {rnd('false_n / greatest(touched, 1)::DOUBLE', 6)} AS false_share
      FROM (SELECT count(*) AS long_stops, avg(CAST(covered >= 0.5 AS INT)) AS recall, avg(covered) AS covered FROM stop_cover WHERE minutes >= 60),
           (SELECT count(*) AS false_n FROM false_stays),
           (SELECT sum((epoch_us("end") - epoch_us(start)) / 3600e6::DOUBLE) AS hours FROM lab),
           (SELECT count(*) AS touched FROM st WHERE EXISTS (SELECT 1 FROM lab l WHERE l.user_id = st.user_id AND st.arrival < l."end" AND st.departure > l.start)
              OR EXISTS (SELECT 1 FROM stops p WHERE p.user_id = st.user_id AND st.arrival < p.s1 AND st.departure > p.s0))"""
)
def stay_evaluation(s: SparkSession, d: str) -> DataFrame:
    """Recall of labelled stops and stays inside one trip."""
    spans, trips = _spans(base.stay_table(s, d)), base.labels(s, d)
    marks = trips.select("user_id", "label_id", "start", "end", F.lit(None).cast("double").alias("minutes")).unionByName(_stops(s, d))
    # Stays meet trips and stops in one join, so they are found once; its rows are summed up by stay and by stop.
    met = intervals.meeting(spans, marks, ["user_id"], whole=True, pieces=base.stay_pieces(s, d)).withColumn("m", F.when(F.col("met"), intervals.shared_minutes()))
    in_stop = F.col("r.minutes").isNotNull()
    sides = F.array(
        F.when(F.col("l").isNotNull(), F.struct(F.lit(True).alias("is_stay"), F.col("l.chain").alias("a"), F.col("l.stay").alias("b"), F.col("l.duration_minutes").alias("minutes"))),
        F.when(in_stop, F.struct(F.lit(False).alias("is_stay"), F.col("r.label_id").alias("a"), F.lit(0).cast("long").alias("b"), F.col("r.minutes").alias("minutes"))),
    )
    rows = met.select("user_id", "m", in_stop.alias("in_stop"), F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("x"))
    rows = rows.groupBy("user_id", "x.is_stay", "x.a", "x.b").agg(
        F.first("x.minutes").alias("minutes"), F.sum("m").alias("total"), F.max(F.when(~F.col("in_stop"), F.col("m"))).alias("in_trip")
    )
    # A stay lies in the trip that it overlaps most, if that holds four fifths of it.
    stay, long_stop = F.col("is_stay"), ~F.col("is_stay") & (F.col("minutes") >= 60)
    share = F.when(long_stop, F.coalesce("total", F.lit(0.0)) / F.col("minutes"))
    counts = rows.agg(
        F.count_if(stay).alias("stay_points"), F.count_if(stay & (F.col("in_trip") >= 0.8 * F.greatest(F.col("minutes"), F.lit(1e-9)))).alias("false_stays"),
        F.count_if(stay & F.col("total").isNotNull()).alias("touched"), F.count_if(long_stop).alias("long_stops"),
        F.avg((share >= 0.5).cast("int")).alias("recall"), F.avg(share).alias("covered"),
    )
    hours = trips.agg(F.sum(seconds_between("start", "end") / 3600).alias("hours"))
    rows = counts.crossJoin(hours)  # a row each
    return rows.select(
        "stay_points", "long_stops", r("stop_recall", 6, F.col("recall")), r("time_covered", 6, F.col("covered")), "false_stays",
        r("false_per_100_h", 6, 100 * F.col("false_stays") / F.col("hours")), r("false_share", 6, F.col("false_stays") / F.greatest("touched", F.lit(1))),
    )


_STOP_EDGES, _STOP_NAMES = [30, 45, 60, 120], ["15-30", "30-45", "45-60", "60-120", "2-18h"]


@query(f"SELECT {_sql_ladder('minutes', _STOP_EDGES, _STOP_NAMES)} AS band, count(*) AS n, {rnd('avg(CAST(covered >= 0.5 AS INT))', 6)} AS recall FROM stop_cover GROUP BY 1")
def recall_by_length(s: SparkSession, d: str) -> DataFrame:
    rows = _covered(_spans(base.stay_table(s, d)), _stops(s, d), base.stay_pieces(s, d))
    band = _ladder(F.col("minutes"), _STOP_EDGES, _STOP_NAMES).alias("band")
    return rows.groupBy(band).agg(F.count(F.lit(1)).alias("n"), r("recall", 6, F.avg((F.col("covered") >= 0.5).cast("int"))))


_TRIP_EDGES, _TRIP_NAMES = [1, 3, 6], ["<1h", "1-3h", "3-6h", ">6h"]


@query(
    f"""SELECT mode, trip_length, count(*) AS n, CAST(grouping_id(mode, trip_length) AS BIGINT) AS gid
      FROM (SELECT mode, {_sql_ladder('trip_h', _TRIP_EDGES, _TRIP_NAMES)} AS trip_length FROM false_stays) GROUP BY CUBE (mode, trip_length)"""
)
def false_stay_modes(s: SparkSession, d: str) -> DataFrame:
    """Stays inside one trip by its mode and length, with margins."""
    rows = _false_stays(_spans(base.stay_table(s, d)), base.labels(s, d), base.stay_pieces(s, d)).filter("is_false")
    rows = rows.select("mode", _ladder(F.col("trip_h"), _TRIP_EDGES, _TRIP_NAMES).alias("trip_length"))
    return rows.cube("mode", "trip_length").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("gid"))


@query(
    f"""SELECT count(*) AS n, {rnd('quantile_cont(a, 0.5)', 6)} AS arrival_minutes, {rnd('quantile_cont(b, 0.5)', 6)} AS departure_minutes,
      {rnd('quantile_cont(abs(a), 0.5)', 6)} AS arrival_off, {rnd('quantile_cont(abs(b), 0.5)', 6)} AS departure_off FROM (
      SELECT (epoch_us(st.arrival) - epoch_us(p.s0)) / 60e6::DOUBLE AS a, (epoch_us(st.departure) - epoch_us(p.s1)) / 60e6::DOUBLE AS b
      FROM stops p JOIN st ON st.user_id = p.user_id AND st.arrival < p.s1 AND st.departure > p.s0 WHERE p.minutes >= 30
      QUALIFY row_number() OVER (PARTITION BY p.user_id, p.label_id
        ORDER BY epoch_us(least(st.departure, p.s1)) - epoch_us(greatest(st.arrival, p.s0)) DESC, st.arrival, st.chain, st.stay) = 1)"""
)
def boundary_errors(s: SparkSession, d: str) -> DataFrame:
    """How far arrival and departure of the stay that overlaps a stop most are from the stop's own."""
    n = base.stay_pieces(s, d)
    met = in_pieces(intervals.meeting(_stops(s, d).filter("minutes >= 30"), _spans(base.stay_table(s, d)), ["user_id"], pieces=n), n, "user_id")
    best = Window.partitionBy("user_id", "l.label_id").orderBy(F.desc(intervals.shared_minutes()), "r.start", "r.chain", "r.stay")
    rows = met.withColumn("rk", F.row_number().over(best)).filter("rk = 1")
    rows = rows.select((seconds_between("l.start", "r.start") / 60).alias("a"), (seconds_between("l.end", "r.end") / 60).alias("b"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), r("arrival_minutes", 6, _median("a")), r("departure_minutes", 6, _median("b")),
        r("arrival_off", 6, _median(F.abs("a"))), r("departure_off", 6, _median(F.abs("b"))),
    )


# --- jumps ---

CTES["jump_rows"] = f"""
  SELECT *, row_number() OVER (PARTITION BY user_id, source_file ORDER BY rn) AS j FROM (
    SELECT *, {hav('lat', 'lon', 'nx.lat', 'nx.lon')} AS m, {secs('datetime', 'nx.datetime')} AS dt FROM (
      SELECT user_id, source_file, ord, datetime, lat, lon, row_number() OVER ({_IN}) AS rn, count(*) OVER (PARTITION BY user_id, source_file) AS n,
             max(datetime) OVER (PARTITION BY user_id, source_file) AS t_last, lead({{'datetime': datetime, 'lat': lat, 'lon': lon}}) OVER ({_IN}) AS nx FROM kept))
  WHERE {kmh('m', 'dt')} > 1100"""
CTES["jump_reach"] = f"""
  SELECT a.user_id, a.source_file, a.j, any_value(a.c) AS c, coalesce(list(b.j ORDER BY b.j) FILTER (WHERE b.j IS NOT NULL), []) AS bs
  FROM (SELECT *, count(*) OVER (PARTITION BY user_id, source_file) AS c FROM jump_rows) a
  LEFT JOIN jump_rows b ON a.user_id = b.user_id AND a.source_file = b.source_file AND b.j > a.j
    AND {hav('a.lat', 'a.lon', 'b.nx.lat', 'b.nx.lon')} / greatest({secs('a.datetime', 'b.nx.datetime')}, 1e-9) * 3.6 <= 1100
  GROUP BY a.user_id, a.source_file, a.j"""
CTES["scan_jumps"] = """
  SELECT user_id, source_file, 0::BIGINT AS j, []::BIGINT[] AS used, FALSE AS made, CAST(NULL AS BIGINT) AS back FROM jump_reach WHERE j = 1
  UNION ALL
  SELECT s.user_id, s.source_file, x.j, CASE WHEN list_contains(s.used, x.j) THEN s.used WHEN f.b IS NULL THEN list_append(s.used, x.j) ELSE list_concat(s.used, [x.j, f.b]) END,
         NOT list_contains(s.used, x.j), CASE WHEN NOT list_contains(s.used, x.j) THEN f.b END
  FROM scan_jumps s JOIN jump_reach x ON x.user_id = s.user_id AND x.source_file = s.source_file AND x.j = s.j + 1,
  LATERAL (SELECT list_filter(x.bs, lambda b: NOT list_contains(s.used, b))[1] AS b) f"""
CTES["exc"] = """
  SELECT a.user_id, a.source_file, a.ord, CASE WHEN s.back IS NULL THEN 'one_sided' ELSE 'excursion' END AS kind, a.rn + 1 AS first_moved, coalesce(b.rn, a.n) AS last_moved,
         a.nx.datetime AS t0, coalesce(b.datetime, a.t_last) AS t1, coalesce(b.rn, a.n) - a.rn AS n_points,
         (epoch_us(coalesce(b.datetime, a.t_last)) - epoch_us(a.nx.datetime)) / 60e6::DOUBLE AS minutes, a.m / 1000 AS jump_km, a.dt AS jump_s
  FROM scan_jumps s JOIN jump_rows a USING (user_id, source_file, j)
  LEFT JOIN jump_rows b ON b.user_id = s.user_id AND b.source_file = s.source_file AND b.j = s.back WHERE s.made"""


def _excursions(s: SparkSession, d: str) -> DataFrame:
    return excursions.excursions(base.kept(s, d))


@query(f"SELECT user_id, source_file, ord, kind, n_points, {rnd('minutes', 3)} AS minutes, {rnd('jump_km', 6)} AS jump_km, {rnd('jump_s', 3)} AS jump_s FROM exc")
def jump_excursions(s: SparkSession, d: str) -> DataFrame:
    return _excursions(s, d).select(*KEY, "kind", "n_points", r("minutes"), r("jump_km", 6), r("jump_s"))


@query(
    f"""SELECT kind, count(*) AS cases, count(DISTINCT user_id) AS users, quantile_cont(n_points::DOUBLE, 0.5) AS median_points, max(n_points) AS max_points,
      {rnd('quantile_cont(minutes, 0.5)', 3)} AS median_minutes, {rnd('max(minutes)', 3)} AS max_minutes, {rnd('quantile_cont(jump_km, 0.5)', 6)} AS median_km,
      {rnd('max(jump_km)', 6)} AS max_km, {rnd('quantile_cont(jump_s, 0.5)', 3)} AS median_s FROM exc GROUP BY 1"""
)
def jump_overview(s: SparkSession, d: str) -> DataFrame:
    return _excursions(s, d).groupBy("kind").agg(
        F.count(F.lit(1)).alias("cases"), F.count_distinct("user_id").alias("users"), _median("n_points").alias("median_points"), F.max("n_points").alias("max_points"),
        r("median_minutes", of=_median("minutes")), r("max_minutes", of=F.max("minutes")), r("median_km", 6, _median("jump_km")), r("max_km", 6, F.max("jump_km")),
        r("median_s", of=_median("jump_s")),
    )


@query(
    f"""SELECT kind, count(*) AS stays_touched, {rnd('sum(st.duration_minutes) / 60', 6)} AS hours_touched,
      {rnd('sum(st.duration_minutes) / (SELECT sum(duration_minutes) FROM st)', 8)} AS share
      FROM exc JOIN st ON st.user_id = exc.user_id AND st.arrival <= exc.t1 AND st.departure >= exc.t0 GROUP BY 1"""
)
def jump_impact(s: SparkSession, d: str) -> DataFrame:
    """Stays that meet the time of moved points."""
    rows = base.stay_table(s, d)
    jumps = _excursions(s, d).select("user_id", "kind", "ord", "start", "end")
    met = intervals.meeting(jumps, _spans(rows), ["user_id"], touching=True)
    by_kind = met.groupBy(F.col("l.kind").alias("kind")).agg(F.count(F.lit(1)).alias("stays_touched"), F.sum("r.duration_minutes").alias("m"))
    total = rows.agg(F.sum("duration_minutes").alias("total"))
    return by_kind.crossJoin(total).select("kind", "stays_touched", r("hours_touched", 6, F.col("m") / 60), r("share", 8, F.col("m") / F.col("total")))


@query(
    """SELECT coalesce(mode, 'unlabelled') AS mode, kind, count(*) AS n FROM (
      SELECT e.user_id, e.source_file, e.ord, any_value(e.kind) AS kind, arg_min(l.mode, (l.start, l.label_id)) AS mode
      FROM exc e LEFT JOIN lab l ON l.user_id = e.user_id AND e.t0 BETWEEN l.start AND l."end" GROUP BY ALL) GROUP BY ALL"""
)
def mode_at_jump(s: SparkSession, d: str) -> DataFrame:
    """The first label that holds the time of a jump, by kind of jump."""
    jumps = _excursions(s, d).select(*KEY, "kind", F.col("start").alias("datetime"))
    hit = base._in_interval(jumps, base.labels(s, d)).groupBy(*KEY).agg(F.min_by("mode", F.struct("start", "label_id")).alias("mode"))
    return jumps.join(hit, KEY, "left").groupBy(F.coalesce("mode", F.lit("unlabelled")).alias("mode"), "kind").agg(F.count(F.lit(1)).alias("n"))


CTES["numbered"] = f"SELECT *, row_number() OVER ({_IN}) AS rn FROM kept"
CTES["moved"] = """
  SELECT e.user_id, e.source_file, e.ord, quantile_cont(k.lat, 0.5) AS lat, quantile_cont(k.lon, 0.5) AS lon
  FROM exc e JOIN numbered k ON k.user_id = e.user_id AND k.source_file = e.source_file AND k.rn BETWEEN e.first_moved AND e.last_moved GROUP BY ALL"""


@query(
    f"""SELECT m.user_id, m.source_file, m.ord, {rnd(f"min({hav('m.lat', 'm.lon', 'k.lat', 'k.lon')})", 3)} AS nearest_m, count(*) AS compared
      FROM moved m JOIN kept k ON k.user_id = m.user_id AND k.source_file <> m.source_file WHERE k.ord % 9 = 0 GROUP BY ALL"""
)
def nearest_other_file(s: SparkSession, d: str) -> DataFrame:
    """How near the middle of a jump's moved points is to any of the user's other recordings, of which each ninth point counts."""
    rows = base.kept(s, d)
    numbered = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*FILE).orderBy("datetime", "ord"))).select(*FILE, "rn", "lat", "lon")
    jumps = excursions.excursions(rows).select(*KEY, "first_moved", "last_moved")
    inside = jumps.join(numbered, FILE).filter("rn BETWEEN first_moved AND last_moved")
    moved = inside.groupBy(*KEY).agg(_median("lat").alias("lat"), _median("lon").alias("lon")).alias("m")
    other = rows.filter(F.col("ord") % 9 == 0).select("user_id", "source_file", "lat", "lon").alias("k")
    met = moved.join(other, (F.col("m.user_id") == F.col("k.user_id")) & (F.col("m.source_file") != F.col("k.source_file")))
    return met.groupBy(*[F.col(f"m.{c}").alias(c) for c in KEY]).agg(
        r("nearest_m", of=F.min(haversine_m("m.lat", "m.lon", "k.lat", "k.lon"))), F.count(F.lit(1)).alias("compared")
    )


# --- stays, trimmed and cut ---

CTES["stay_lists"] = """
  SELECT user_id, chain, stay, list(lat ORDER BY datetime, ord) AS la, list(lon ORDER BY datetime, ord) AS lo, list(datetime ORDER BY datetime, ord) AS ts, count(*) AS n
  FROM members GROUP BY ALL"""
CTES["scan_trim"] = f"""
  SELECT user_id, chain, stay, la, lo, 1::BIGINT AS a, n AS b, 0 AS round, FALSE AS done FROM stay_lists
  UNION ALL
  SELECT s.user_id, s.chain, s.stay, s.la, s.lo, coalesce(k.near[1], s.b), coalesce(k.near[-1], s.b), s.round + 1, coalesce(k.near[1], s.b) = s.a AND coalesce(k.near[-1], s.b) = s.b
  FROM scan_trim s, LATERAL (SELECT list_avg(s.la[s.a:s.b]) AS y, list_avg(s.lo[s.a:s.b]) AS x) c,
  LATERAL (SELECT list_filter(generate_series(s.a, s.b), lambda i: {hav('c.y', 'c.x', 's.la[i]', 's.lo[i]')} <= 200) AS near) k WHERE NOT s.done"""


@query(
    """SELECT o.user_id, o.chain, o.stay, t1.a AS once_first, t1.b AS once_last, t2.a AS first, t2.b AS last FROM stay_lists o
      JOIN (SELECT * FROM scan_trim WHERE round = 1) t1 USING (user_id, chain, stay) JOIN (SELECT * FROM scan_trim WHERE done) t2 USING (user_id, chain, stay)"""
)
def stay_tail_trim(s: SparkSession, d: str) -> DataFrame:
    """Which points of a stay are left when its ends beyond 200 m of the mean are cut once, and until none is left."""
    members = base.members(s, d)
    return excursions.trimmed(members)


_CUTS = (1200, 3600, 7200, 10800, 21600)


@query(
    f"""SELECT x // 60 AS cut_at_minutes, count(*) FILTER (WHERE m >= 30) AS pieces, {rnd('count(*) FILTER (WHERE m >= 30) * 100.0::DOUBLE / (SELECT count(*) FROM st)', 6)} AS pieces_pct,
      {rnd('sum(m) FILTER (WHERE m >= 30) * 100 / (SELECT sum(duration_minutes) FROM st)', 6)} AS dwell_pct,
      (SELECT count(*) FROM st) - count(DISTINCT (user_id, chain, stay)) FILTER (WHERE m >= 30) AS stays_lost FROM (
      SELECT x, user_id, chain, stay, part, (epoch_us(max(datetime)) - epoch_us(min(datetime))) / 60e6::DOUBLE AS m FROM (
        SELECT *, sum(CAST(coalesce(g > x, FALSE) AS INT)) OVER (PARTITION BY x, user_id, chain, stay ORDER BY datetime, ord ROWS UNBOUNDED PRECEDING) AS part FROM (
          SELECT *, {secs('lag(datetime) OVER (PARTITION BY user_id, chain, stay ORDER BY datetime, ord)', 'datetime')} AS g FROM members),
          (SELECT unnest({list(_CUTS)}) AS x)) GROUP BY ALL) GROUP BY x"""
)
def cut_simulation(s: SparkSession, d: str) -> DataFrame:
    """What is left of stays that are cut at longer gaps, of pieces of half an hour or more."""
    members = in_pieces(base.members(s, d).select(*STAY, "datetime", "ord"), base.pieces(s, d), *STAY)
    order = Window.partitionBy(*STAY).orderBy("datetime", "ord")
    rows = members.select(*STAY, "datetime", "ord", seconds_between(F.lag("datetime").over(order), F.col("datetime")).alias("g"))
    # Points between two gaps that any setting cuts at never part: they shrink to a row first.
    atom = F.sum(F.coalesce(F.col("g") > _CUTS[0], F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    atoms = rows.withColumn("atom", atom).groupBy(*STAY, "atom").agg(F.min("datetime").alias("t0"), F.max("datetime").alias("t1"))
    atoms = atoms.withColumn("g", seconds_between(F.lag("t1").over(Window.partitionBy(*STAY).orderBy("atom")), F.col("t0"))).withColumn("x", _values(_CUTS))
    part = F.sum(F.coalesce(F.col("g") > F.col("x"), F.lit(False)).cast("int")).over(Window.partitionBy("x", *STAY).orderBy("atom").rowsBetween(Window.unboundedPreceding, 0))
    pieces = atoms.withColumn("part", part).groupBy("x", *STAY, "part").agg((seconds_between(F.min("t0"), F.max("t1")) / 60).alias("m"))
    per_stay = pieces.groupBy("x", *STAY).agg(F.count_if(F.col("m") >= 30).alias("n"), F.sum(F.when(F.col("m") >= 30, F.col("m"))).alias("m"))
    whole = rows.groupBy(*STAY).agg((seconds_between(F.min("datetime"), F.max("datetime")) / 60).alias("d")).agg(F.count(F.lit(1)).alias("stays"), F.sum("d").alias("minutes"))
    out = per_stay.groupBy("x").agg(F.sum("n").alias("pieces"), F.sum("m").alias("m"), F.count_if(F.col("n") == 0).alias("stays_lost")).crossJoin(whole)
    return out.select(
        F.expr("x div 60").cast("int").alias("cut_at_minutes"), "pieces", r("pieces_pct", 6, F.col("pieces") * 100.0 / F.col("stays")),
        r("dwell_pct", 6, F.col("m") * 100 / F.col("minutes")), "stays_lost",
    )


# --- recordings that several users hold ---

CTES["shared"] = "SELECT * FROM hashed WHERE print IN (SELECT print FROM hashed GROUP BY print HAVING count(DISTINCT user_id) > 1)"


def _hashed(s: SparkSession, d: str) -> DataFrame:
    """Recordings with ``shared``: another user holds the same content."""
    rows = traces.content_hashes(base.points(s, d))
    owners = rows.groupBy("print").agg(F.count_distinct("user_id").alias("owners"))
    return rows.join(owners, "print").withColumn("shared", F.col("owners") > 1)


@query("SELECT print, count(DISTINCT user_id) AS users, count(*) AS copies, CAST(sum(n_points) - any_value(n_points) AS BIGINT) AS redundant_points FROM shared GROUP BY 1")
def shared_files(s: SparkSession, d: str) -> DataFrame:
    rows = traces.content_hashes(base.points(s, d)).groupBy("print")
    found = rows.agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("copies"), (F.sum("n_points") - F.first("n_points")).alias("redundant_points"))
    return found.filter("users > 1")


@query(
    f"""SELECT a.user_id AS user_a, b.user_id AS user_b, count(*) AS shared_files, CAST(sum(a.n_points) AS BIGINT) AS shared_points,
      {rnd('sum(a.n_points) / any_value(ta.n)', 6)} AS share_of_a, {rnd('sum(a.n_points) / any_value(tb.n)', 6)} AS share_of_b
      FROM shared a JOIN shared b ON a.print = b.print AND a.user_id < b.user_id
      JOIN (SELECT user_id, sum(n_points) AS n FROM hashed GROUP BY 1) ta ON ta.user_id = a.user_id JOIN (SELECT user_id, sum(n_points) AS n FROM hashed GROUP BY 1) tb ON tb.user_id = b.user_id
      GROUP BY a.user_id, b.user_id"""
)
def shared_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of users that hold the same recordings; pairs are made among the holders of one content only."""
    rows = _hashed(s, d)
    total = rows.groupBy("user_id").agg(F.sum("n_points").alias("total"))
    held = rows.filter("shared").select("print", "user_id", "n_points")
    met = held.alias("a").join(held.alias("b"), "print").filter("a.user_id < b.user_id")
    pairs = met.groupBy(F.col("a.user_id").alias("user_a"), F.col("b.user_id").alias("user_b")).agg(F.count(F.lit(1)).alias("shared_files"), F.sum("a.n_points").alias("shared_points"))
    for side in "ab":
        pairs = pairs.join(total.select(F.col("user_id").alias(f"user_{side}"), F.col("total").alias(f"of_{side}")), f"user_{side}")
    return pairs.select("user_a", "user_b", "shared_files", "shared_points", *[r(f"share_of_{x}", 6, F.col("shared_points") / F.col(f"of_{x}")) for x in "ab"])


@query(
    f"""SELECT user_id, count(*) AS files, count(*) FILTER (WHERE s) AS shared_files, CAST(sum(n_points) AS BIGINT) AS points,
      CAST(coalesce(sum(n_points) FILTER (WHERE s), 0) AS BIGINT) AS shared_points, {rnd('coalesce(sum(n_points) FILTER (WHERE s), 0) / sum(n_points)', 6)} AS shared_share
      FROM (SELECT *, print IN (SELECT print FROM shared) AS s FROM hashed) GROUP BY 1"""
)
def shared_by_user(s: SparkSession, d: str) -> DataFrame:
    mine = F.coalesce(F.sum(F.when(F.col("shared"), F.col("n_points"))), F.lit(0).cast("long"))
    rows = _hashed(s, d).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("shared").alias("shared_files"), F.sum("n_points").alias("points"), mine.alias("shared_points")
    )
    return rows.select("*", r("shared_share", 6, F.col("shared_points") / F.col("points")))


@query(
    f"""SELECT h.print, {rnd(hav('quantile_cont(p.lat, 0.5)', 'quantile_cont(p.lon, 0.5)', '39.99::DOUBLE', '116.33::DOUBLE') + ' / 1000', 6)} AS km,
      {rnd('(epoch_us(max(p.datetime)) - epoch_us(min(p.datetime))) / 3600e6::DOUBLE', 6)} AS hours
      FROM (SELECT * FROM shared QUALIFY row_number() OVER (PARTITION BY print ORDER BY user_id, source_file) = 1) h JOIN pts p USING (user_id, source_file) GROUP BY 1"""
)
def shared_location(s: SparkSession, d: str) -> DataFrame:
    """Where a shared recording lies, from its first holder's copy, and how long it is."""
    first = _hashed(s, d).filter("shared").groupBy("print").agg(F.min(F.struct("user_id", "source_file")).alias("f")).select("print", "f.*")
    rows = base.points(s, d).join(first, FILE).groupBy("print").agg(
        _median("lat").alias("lat"), _median("lon").alias("lon"), (seconds_between(F.min("datetime"), F.max("datetime")) / 3600).alias("h")
    )
    return rows.select("print", r("km", 6, haversine_m("lat", "lon", F.lit(39.99), F.lit(116.33)) / 1000), r("hours", 6, F.col("h")))


@query(
    f"""SELECT user_id, count(*) AS stays, count(*) FILTER (WHERE f) AS stays_from_shared, {rnd('sum(duration_minutes) / 60', 6)} AS dwell_h,
      {rnd('coalesce(sum(duration_minutes) FILTER (WHERE f), 0) / 60', 6)} AS dwell_h_from_shared FROM (
      SELECT st.*, coalesce((SELECT max(epoch_us(least(st.departure, x.s1)) - epoch_us(greatest(st.arrival, x.s0))) / 60e6::DOUBLE FROM shared x
        WHERE x.user_id = st.user_id AND x.s0 < st.departure AND x.s1 > st.arrival), 0) >= 0.5 * st.duration_minutes AS f FROM st) GROUP BY 1"""
)
def shared_stay_impact(s: SparkSession, d: str) -> DataFrame:
    """Stays of which half or more lies in the time of one shared recording of the user."""
    spans = _spans(base.stay_table(s, d))
    files = _hashed(s, d).filter("shared").select("user_id", "start", "end")
    inside = intervals.meeting(spans, files, ["user_id"]).groupBy("user_id", "l.chain", "l.stay").agg(F.max(intervals.shared_minutes()).alias("m"))
    rows = spans.join(inside, STAY, "left").withColumn("f", F.coalesce("m", F.lit(0.0)) >= 0.5 * F.col("duration_minutes"))
    minutes = F.coalesce(F.sum(F.when(F.col("f"), F.col("duration_minutes"))), F.lit(0.0))
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("stays"), F.count_if("f").alias("stays_from_shared"), r("dwell_h", 6, F.sum("duration_minutes") / 60), r("dwell_h_from_shared", 6, minutes / 60)
    )


CTES["user_edges"] = "SELECT DISTINCT a.user_id AS a, b.user_id AS b FROM shared a JOIN shared b ON a.print = b.print AND a.user_id <> b.user_id"
CTES["reach_users"] = "SELECT a, a AS b FROM user_edges UNION SELECT s.a, e.b FROM reach_users s JOIN user_edges e ON s.b = e.a AND s.a < e.b"
CTES["user_group"] = """
  SELECT u.user_id, coalesce(g.label, u.user_id) AS label FROM (SELECT DISTINCT user_id FROM pts) u
  LEFT JOIN (SELECT b AS user_id, min(a) AS label FROM reach_users GROUP BY 1) g USING (user_id)"""


def _user_groups(s: SparkSession, d: str) -> DataFrame:
    """``user_id, label``: users connected by shared recordings, the label being the smallest of them."""
    rows = _hashed(s, d)
    # A star per content, from its smallest holder, connects what all pairs of holders would.
    held = rows.filter("shared").withColumn("first", F.min("user_id").over(Window.partitionBy("print")))
    labels = graphs.components(held.select(F.col("user_id").alias("a"), F.col("first").alias("b"))).withColumnRenamed("node", "user_id")
    return rows.select("user_id").distinct().join(labels, "user_id", "left").select("user_id", F.coalesce("label", "user_id").alias("label"))


@query("SELECT label, count(*) AS users FROM user_group GROUP BY 1")
def user_groups(s: SparkSession, d: str) -> DataFrame:
    return _user_groups(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("users"))


CTES["own_spots"] = f"SELECT DISTINCT p.user_id, {rnd('p.lat', 4)} AS lat, {rnd('p.lon', 4)} AS lon FROM pts p JOIN hashed h USING (user_id, source_file) WHERE h.print NOT IN (SELECT print FROM shared)"
CTES["familiar"] = f"""
  SELECT x.print, x.user_id, avg(CAST(EXISTS (SELECT 1 FROM own_spots o WHERE o.user_id = x.user_id AND {mean_m('p.lat', 'p.lon', 'o.lat', 'o.lon')} <= 200) AS INT)) AS share,
         bool_or(x.user_id IN (SELECT user_id FROM own_spots)) AS measurable
  FROM shared x JOIN pts p USING (user_id, source_file) GROUP BY ALL"""


@query(
    """SELECT CASE WHEN m = 0 THEN 'no member has own files' WHEN f = m THEN 'familiar to all measurable members' WHEN f = 0 THEN 'familiar to no member'
      ELSE 'familiar to some members only' END AS pattern, count(*) AS files FROM (
      SELECT print, count(*) FILTER (WHERE measurable) AS m, count(*) FILTER (WHERE measurable AND share >= 0.5) AS f FROM familiar GROUP BY 1) GROUP BY 1"""
)
def familiarity(s: SparkSession, d: str) -> DataFrame:
    """Shared recordings by how many of their holders know the place: half of its points within 200 m of one of their own recordings."""
    files, rows = _hashed(s, d).select(*FILE, "print", "shared"), base.points(s, d)
    both = rows.join(files, FILE)
    own = both.filter("NOT shared").select("user_id", r("lat", 4), r("lon", 4)).distinct().withColumn("id", F.lit(0))
    ids = F.struct("source_file", "ord")
    there = both.filter("shared").select("user_id", ids.alias("id"), "print", "lat", "lon")
    known = places.radius_pairs(there.select("user_id", "id", "lat", "lon"), own, ["user_id"], 200.0).select("user_id", F.col("a").alias("id")).distinct()
    share = there.join(known.withColumn("near", F.lit(1)), ["user_id", "id"], "left").groupBy("print", "user_id").agg(F.avg(F.coalesce("near", F.lit(0))).alias("share"))
    share = share.join(own.select("user_id").distinct().withColumn("measurable", F.lit(True)), "user_id", "left")
    by_file = share.groupBy("print").agg(F.count_if("measurable").alias("m"), F.count_if(F.col("measurable") & (F.col("share") >= 0.5)).alias("f"))
    pattern = (
        F.when(F.col("m") == 0, "no member has own files").when(F.col("f") == F.col("m"), "familiar to all measurable members")
        .when(F.col("f") == 0, "familiar to no member").otherwise("familiar to some members only")
    )
    return by_file.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("files"))


# --- gaps between recordings ---

CTES["file_pairs"] = f"""
  SELECT user_id, source_file, e, ns, {secs('e', 'ns')} / 3600 AS gap_h, {hav('llat', 'llon', 'nlat', 'nlon')} AS m, llat, llon FROM (
    SELECT *, lead(s) OVER w AS ns, lead(flat) OVER w AS nlat, lead(flon) OVER w AS nlon FROM file_ends WINDOW w AS (PARTITION BY user_id ORDER BY s, source_file)) WHERE ns IS NOT NULL"""
CTES["file_ends"] = """
  SELECT user_id, source_file, min(datetime) AS s, max(datetime) AS e, arg_min(lat, (datetime, ord)) AS flat, arg_min(lon, (datetime, ord)) AS flon,
         arg_max(lat, (datetime, ord)) AS llat, arg_max(lon, (datetime, ord)) AS llon FROM clean GROUP BY ALL"""


def _file_ends(s: SparkSession, d: str) -> DataFrame:
    order = F.struct("datetime", "ord")
    return base.clean(s, d).groupBy(*FILE).agg(
        F.min("datetime").alias("start"), F.max("datetime").alias("end"), F.min_by(F.struct("lat", "lon"), order).alias("first"), F.max_by(F.struct("lat", "lon"), order).alias("last")
    )


def _file_pairs(files: DataFrame) -> DataFrame:
    """Each recording beside the user's next: hours between them and metres from its last point to the other's first."""
    nxt = F.lead(F.struct("start", "first")).over(Window.partitionBy("user_id").orderBy("start", "source_file"))
    rows = files.withColumn("next", nxt).filter("next IS NOT NULL")
    metres = haversine_m("last.lat", "last.lon", "next.first.lat", "next.first.lon")
    return rows.withColumns({"gap_h": seconds_between("end", "next.start") / 3600, "m": metres, "near": metres <= 200})


_BAND_EDGES = [1 / 3, 1, 3, 6, 12, 18, 24, 72, 720]
_BAND_NAMES = ["<=20min", "20min-1h", "1-3h", "3-6h", "6-12h", "12-18h", "18-24h", "1-3d", "3-30d", ">30d"]


def _band(hours: Column) -> Column:
    out = F.lit(_BAND_NAMES[-1])
    for edge, name in reversed(list(zip(_BAND_EDGES, _BAND_NAMES[:-1], strict=True))):
        out = F.when(hours <= edge, name).otherwise(out)
    return out


_SQL_BAND = "CASE " + " ".join(f"WHEN gap_h <= {e!r}::DOUBLE THEN '{n}'" for e, n in zip(_BAND_EDGES, _BAND_NAMES[:-1], strict=True)) + f" ELSE '{_BAND_NAMES[-1]}' END"


@query(
    f"""SELECT {_SQL_BAND} AS band, count(*) AS n_pairs, {rnd('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)', 6)} AS share, {rnd('avg(CAST(m <= 200 AS INT))', 6)} AS near_share,
      {rnd('quantile_cont(m, 0.5)', 3)} AS median_m FROM file_pairs WHERE gap_h >= 0 GROUP BY 1"""
)
def boundary_bands(s: SparkSession, d: str) -> DataFrame:
    rows = _file_pairs(_file_ends(s, d)).filter("gap_h >= 0").groupBy(_band(F.col("gap_h")).alias("band"))
    rows = rows.agg(F.count(F.lit(1)).alias("n_pairs"), r("near_share", 6, F.avg(F.col("near").cast("int"))), r("median_m", of=_median("m")))
    return rows.withColumn("share", r("share", 6, F.col("n_pairs") / F.sum("n_pairs").over(Window.partitionBy(F.lit(0)))))


_FAR_DAYS = 10
_PICK = "md5(p.source_file || '>' || f.source_file)"


@query(
    f"""SELECT count(*) AS pairs, count(near) AS with_other, {rnd('coalesce(avg(CAST(near AS INT)), 0.0)', 6)} AS near_share FROM (
      SELECT p.user_id, p.source_file, arg_min({hav('p.llat', 'p.llon', 'f.flat', 'f.flon')} <= 200, ({_PICK}, f.source_file)) FILTER (WHERE f.s IS NOT NULL) AS near
      FROM file_pairs p LEFT JOIN file_ends f ON f.user_id = p.user_id AND abs({secs('p.e', 'f.s')}) > {_FAR_DAYS * 86400} GROUP BY ALL)"""
)
def random_baseline(s: SparkSession, d: str) -> DataFrame:
    """How often a recording ends near the start of one of the user's others, drawn by hash from those ten days away or more."""
    files = _file_ends(s, d)
    pairs = _file_pairs(files).select(*FILE, "end", "last").alias("p")
    other = files.select(*FILE, "start", "first").alias("f")
    far = (F.col("p.user_id") == F.col("f.user_id")) & (F.abs(seconds_between("p.end", "f.start")) > _FAR_DAYS * 86400)
    pick = F.struct(F.md5(F.concat_ws(">", "p.source_file", "f.source_file").cast("binary")), "f.source_file")
    near = haversine_m("p.last.lat", "p.last.lon", "f.first.lat", "f.first.lon") <= 200
    rows = pairs.join(other, far, "left").groupBy("p.user_id", "p.source_file").agg(F.min_by(near, F.when(F.col("f.start").isNotNull(), pick)).alias("near"))
    return rows.agg(F.count(F.lit(1)).alias("pairs"), F.count("near").alias("with_other"), r("near_share", 6, F.coalesce(F.avg(F.col("near").cast("int")), F.lit(0.0))))


@query(
    f"""SELECT hour, n_pairs, {rnd('p', 6)} AS near_share, {rnd('ci', 6)} AS ci95, p - ci <= top AS touches, min(hour) FILTER (WHERE p - ci <= top) OVER () AS first_touch FROM (
      SELECT *, 1.96::DOUBLE * sqrt(p * (1 - p) / n_pairs) AS ci FROM (
        SELECT CAST(floor(gap_h) AS INT) AS hour, count(*) AS n_pairs, avg(CAST(m <= 200 AS INT)) AS p FROM file_pairs WHERE gap_h >= 0 AND gap_h < 48 GROUP BY 1)),
      (SELECT p + 1.96::DOUBLE * sqrt(p * (1 - p) / n) AS top FROM (SELECT avg(CAST(m <= 200 AS INT)) AS p, count(*) AS n FROM file_pairs WHERE gap_h > 24))"""
)
def resume_plateau(s: SparkSession, d: str) -> DataFrame:
    """Share of recordings that resume near the last end, by hours between them, and the first hour that touches the level of gaps over a day."""
    rows = _file_pairs(_file_ends(s, d)).select("gap_h", F.col("near").cast("int").alias("near"))

    def half(p: str, n: str) -> Column:
        return 1.96 * F.sqrt(F.col(p) * (1 - F.col(p)) / F.col(n))

    level = rows.filter("gap_h > 24").agg(F.avg("near").alias("p0"), F.count(F.lit(1)).alias("n0")).select((F.col("p0") + half("p0", "n0")).alias("top"))
    hours = rows.filter("gap_h >= 0 AND gap_h < 48").groupBy(F.floor("gap_h").cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("near").alias("p"))
    hours = hours.withColumn("ci", half("p", "n_pairs")).crossJoin(level).withColumn("touches", F.col("p") - F.col("ci") <= F.col("top"))
    first = F.min(F.when(F.col("touches"), F.col("hour"))).over(Window.partitionBy(F.lit(0)))
    return hours.select("hour", "n_pairs", r("near_share", 6, F.col("p")), r("ci95", 6, F.col("ci")), "touches", first.alias("first_touch"))


@query(
    f"""SELECT band, near, {rnd('100 * avg(CAST(inside AS INT))', 6)} AS trip_inside_pct, count(*) AS n_pairs FROM (
      SELECT {_SQL_BAND} AS band, m <= 200 AS near, EXISTS (SELECT 1 FROM lab l WHERE l.user_id = p.user_id AND l.start >= p.e AND l."end" <= p.ns) AS inside
      FROM file_pairs p JOIN (SELECT user_id, min(start) AS lo, max("end") AS hi FROM lab GROUP BY 1) b USING (user_id) WHERE gap_h >= 0 AND ns >= lo AND e <= hi) GROUP BY ALL"""
)
def label_check(s: SparkSession, d: str) -> DataFrame:
    """Pairs of recordings with a labelled trip wholly between them, within the user's labelled time."""
    trips = base.labels(s, d)
    period = trips.groupBy("user_id").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    rows = _file_pairs(_file_ends(s, d)).filter("gap_h >= 0").join(period, "user_id").filter("next.start >= lo AND end <= hi")
    rows = rows.select(*FILE, "gap_h", "near", F.col("end").alias("start"), F.col("next.start").alias("end"))
    met = intervals.meeting(rows.select(*FILE, "start", "end"), trips, ["user_id"]).filter("r.start >= l.start AND r.end <= l.end")
    inside = met.select("user_id", "l.source_file").distinct().withColumn("inside", F.lit(1))
    rows = rows.join(inside, FILE, "left").groupBy(_band(F.col("gap_h")).alias("band"), "near")
    return rows.agg(r("trip_inside_pct", 6, 100 * F.avg(F.coalesce("inside", F.lit(0)))), F.count(F.lit(1)).alias("n_pairs"))


_HOUR_EDGES, _HOUR_NAMES = [6, 9, 18, 22], ["00-06", "06-09", "09-18", "18-22", "22-24"]


@query(
    f"""SELECT coalesce(a.band, b.band) AS band, {rnd('coalesce(a.p, 0.0)', 6)} AS gap_pct, {rnd('coalesce(b.p, 0.0)', 6)} AS arrival_pct FROM (
      SELECT {_sql_ladder('hour(l)', _HOUR_EDGES, _HOUR_NAMES)} AS band, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS p FROM (
        SELECT timezone(tz_name, timezone('UTC', g0)) AS l, {secs('g0', 'datetime')} AS g FROM (
          SELECT m.*, lag(m.datetime) OVER (PARTITION BY m.user_id, m.chain, m.stay ORDER BY m.datetime, m.ord) AS g0 FROM members m)) WHERE g > 3600 AND g <= 21600 GROUP BY 1) a
      FULL JOIN (SELECT {_sql_ladder('hour(arr)', _HOUR_EDGES, _HOUR_NAMES)} AS band, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS p FROM stl GROUP BY 1) b ON a.band = b.band"""
)
def gap_start_hours(s: SparkSession, d: str) -> DataFrame:
    """Local hours at which gaps of one to six hours inside stays start, beside those at which stays start."""
    members = base.members(s, d)
    inside = in_pieces(members.select(*STAY, "datetime", "ord", "tz_name"), base.pieces(s, d), *STAY)
    inside = inside.withColumn("g0", F.lag("datetime").over(Window.partitionBy(*STAY).orderBy("datetime", "ord")))
    inside = inside.withColumn("g", seconds_between("g0", "datetime")).filter("g > 3600 AND g <= 21600")
    local = {"gap_pct": (inside, times.to_local(F.col("g0"), F.col("tz_name"))), "arrival_pct": (stays.localized(stays.stays_of(members, pieces=base.pieces(s, d))), F.col("arrival_local"))}
    out = None
    for name, (rows, when) in local.items():
        n = rows.groupBy(_ladder(F.hour(when), _HOUR_EDGES, _HOUR_NAMES).alias("band")).agg(F.count(F.lit(1)).alias("n"))
        part = n.select("band", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias(name))
        out = part if out is None else out.join(part, "band", "full")
    return out.select("band", *[r(name, 6, F.coalesce(name, F.lit(0.0))) for name in local])


@query(
    f"""SELECT category, count(*) AS n, {rnd('quantile_cont(g, 0.5)', 3)} AS median_s, {rnd('quantile_cont(g, 0.99)', 3)} AS p99_s FROM (
      SELECT CASE WHEN i = li THEN 'within_trip' ELSE 'cross_trip' END AS category, g FROM (
        SELECT i, lag(i) OVER ({_IN}) AS li, {secs(f'lag(datetime) OVER ({_IN})', 'datetime')} AS g FROM (
          SELECT k.user_id, k.source_file, k.ord, k.datetime, arg_max(l.label_id, (l.start, l.label_id)) AS i
          FROM kept k LEFT JOIN lab l ON l.user_id = k.user_id AND k.datetime BETWEEN l.start AND l."end" GROUP BY ALL)) WHERE i IS NOT NULL AND li IS NOT NULL AND g > 0) GROUP BY 1"""
)
def labelled_gaps(s: SparkSession, d: str) -> DataFrame:
    """Gaps of one recording between labelled points: within a trip or across two."""
    rows = base.kept(s, d).select(*KEY, "datetime")
    trip = base._in_interval(rows, base.labels(s, d)).groupBy(*KEY).agg(F.max_by("label_id", F.struct("start", "label_id")).alias("i"))
    order = Window.partitionBy(*FILE).orderBy("datetime", "ord")
    rows = rows.join(trip, KEY, "left").withColumns({"li": F.lag("i").over(order), "g": seconds_between(F.lag("datetime").over(order), F.col("datetime"))})
    rows = rows.filter("i IS NOT NULL AND li IS NOT NULL AND g > 0").groupBy(F.when(F.col("i") == F.col("li"), "within_trip").otherwise("cross_trip").alias("category"))
    q = F.percentile("g", F.array(F.lit(0.5), F.lit(0.99)))
    return rows.agg(F.count(F.lit(1)).alias("n"), r("median_s", of=F.get(q, 0)), r("p99_s", of=F.get(q, 1)))


# --- duplicates and speeds ---


CTES["suspects"] = f"""
  SELECT DISTINCT user_id, source_file, datetime FROM (SELECT *, lead(step_kmh) OVER ({_IN}) AS nx FROM kept_steps) WHERE step_kmh > 1100 OR nx > 1100"""


@query(
    """SELECT decision, count(*) AS n_groups, count(*) FILTER (WHERE sus) AS n_suspect FROM (
      SELECT d.decision, bool_or(EXISTS (SELECT 1 FROM suspects x WHERE x.user_id = c.user_id AND x.source_file = c.source_file AND x.datetime IN (c.prev.datetime, c.next.datetime))) AS sus
      FROM cand c JOIN dec d USING (user_id, source_file, datetime) GROUP BY c.user_id, c.source_file, c.datetime, d.decision) GROUP BY 1"""
)
def suspect_anchors(s: SparkSession, d: str) -> DataFrame:
    """Groups of a repeated second beside a point that an impossible step leads to or from."""
    judged = cleaning.dup_candidates(base.gated(s, d)).filter("is_candidate")
    bad = base.suspect_points(s, d).join(base.kept(s, d), KEY).select(*FILE, F.col("datetime").alias("t")).distinct().withColumn("sus", F.lit(1))
    ends = judged.select(*FILE, "datetime", F.explode(F.array("prev.datetime", "next.datetime")).alias("t")).distinct()
    found = ends.join(bad, [*FILE, "t"], "left").groupBy(*FILE, "datetime").agg(F.max("sus").alias("sus"))
    rows = cleaning.decide(judged).join(found, [*FILE, "datetime"], "left")
    return rows.groupBy("decision").agg(F.count(F.lit(1)).alias("n_groups"), F.count("sus").alias("n_suspect"))


@query(
    """SELECT count(*) AS n_groups, count(*) FILTER (WHERE kept_one) AS rescued, count(*) FILTER (WHERE still) AS still_invalid FROM (
      SELECT bool_or(survivor) AS kept_one, bool_or(reason = 'duplicate_invalid_anchors') AS still FROM rejudged_decided GROUP BY user_id, source_file, datetime)"""
)
def recheck_outcome(s: SparkSession, d: str) -> DataFrame:
    """Groups with bad anchors, judged again without spikes: rescued or still without good anchors."""
    again = _rechecked(s, d).groupBy(*FILE, "datetime").agg(F.max("survivor").alias("kept_one"), F.max(F.coalesce(F.col("reason") == "duplicate_invalid_anchors", F.lit(False))).alias("still"))
    return again.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if("kept_one").alias("rescued"), F.count_if("still").alias("still_invalid"))


def _rechecked(s: SparkSession, d: str) -> DataFrame:
    kept, out = cleaning.resolve_duplicates(base.gated(s, d))
    return cleaning.recheck(cleaning.speed_spikes(kept).filter("NOT is_spike").select(*cleaning.POINT), out)


@query("SELECT user_id, source_file, ord, decision, survivor FROM rejudged_decided")
def dup_recheck(s: SparkSession, d: str) -> DataFrame:
    return _rechecked(s, d).select(*KEY, "decision", "survivor")


# Kinds of movement with their usual and highest speeds in km/h; events stand for the kinds.
_KINDS = [("walk", 6.4, 8.0, "view"), ("run", 10.0, 20.0, "signup"), ("bike_bus", 22.0, 100.0, "click"), ("road", 60.0, 120.0, "none"), ("train", 160.0, 350.0, "purchase"), ("airplane", None, 1100.0, "error")]
_NOISE_M = 50.0


def _pick_sql(at: str, values: list) -> str:
    return f"([{', '.join(f'{v}::DOUBLE' for v in values)}])[{at} + 1]"


_TRIPLES = " UNION ALL ".join(
    f"""SELECT {k} AS k, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS across, {hav('a.lat', 'a.lon', 'lat', 'lon')} AS m_in, {hav('lat', 'lon', 'b.lat', 'b.lon')} AS m_out,
        {secs('a.datetime', 'datetime')} AS t_in, {secs('datetime', 'b.datetime')} AS t_out, mode
      FROM (SELECT *, lag({{'datetime': datetime, 'lat': lat, 'lon': lon}}, {k}) OVER ({_IN}) AS a, lead({{'datetime': datetime, 'lat': lat, 'lon': lon}}, {k}) OVER ({_IN}) AS b FROM moded)
      WHERE a IS NOT NULL AND b IS NOT NULL"""
    for k in (1, 5, 10)
)
CTES["moded"] = """
  SELECT k.user_id, k.source_file, k.ord, k.datetime, k.lat, k.lon, arg_max(l.mode, (l.start, l.label_id)) AS mode
  FROM kept k LEFT JOIN lab l ON l.user_id = k.user_id AND k.datetime BETWEEN l.start AND l."end" GROUP BY ALL"""


@query(
    f"""SELECT k, count(*) AS n, {rnd('100 * avg(CAST(rejected AS INT))', 6)} AS false_reject_pct, {rnd('100 * avg(CAST(g = truth AS INT))', 6)} AS accuracy_pct,
      {', '.join(f"{rnd(f'100 * avg(CAST(rejected AS INT)) FILTER (WHERE truth = {i})', 6)} AS {x[0]}" for i, x in enumerate(_KINDS))} FROM (
      SELECT *, m_in > {_pick_sql('g', [x[2] for x in _KINDS])} / 3.6 * t_in + 50 OR m_out > {_pick_sql('g', [x[2] for x in _KINDS])} / 3.6 * t_out + 50 AS rejected FROM (
        SELECT *, CAST({' + '.join(f'(v > {x[1]})::INT' for x in _KINDS[:-1])} AS INT) AS g, CASE mode {' '.join(f"WHEN '{x[3]}' THEN {i}" for i, x in enumerate(_KINDS))} END AS truth FROM (
          SELECT *, greatest(0.0, across - 50) / (t_in + t_out) * 3.6 AS v FROM ({_TRIPLES}) WHERE t_in > 0 AND t_out > 0))) WHERE truth IS NOT NULL GROUP BY k"""
)
def physical_rule(s: SparkSession, d: str) -> DataFrame:
    """How often a limit by the speed between the points around rejects a real point, for neighbours of three distances."""
    rows = base.kept(s, d).select(*KEY, "datetime", "lat", "lon")
    hit = base._in_interval(rows, base.labels(s, d)).groupBy(*KEY).agg(F.max_by("mode", F.struct("start", "label_id")).alias("mode"))
    rows = rows.join(hit, KEY, "left")
    order, spot = Window.partitionBy(*FILE).orderBy("datetime", "ord"), F.struct("datetime", "lat", "lon")
    ks = (1, 5, 10)
    rows = rows.withColumns({f"{n}{k}": f(spot, k).over(order) for k in ks for n, f in (("a", F.lag), ("b", F.lead))})
    rows = rows.select("mode", "datetime", "lat", "lon", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b")) for k in ks])).alias("x"))
    rows = rows.select("mode", "x.k", "x.a", "x.b", "datetime", "lat", "lon").filter("a IS NOT NULL AND b IS NOT NULL")
    rows = rows.select(
        "k", "mode", haversine_m("a.lat", "a.lon", "b.lat", "b.lon").alias("across"), haversine_m("a.lat", "a.lon", "lat", "lon").alias("m_in"),
        haversine_m("lat", "lon", "b.lat", "b.lon").alias("m_out"), seconds_between("a.datetime", "datetime").alias("t_in"), seconds_between("datetime", "b.datetime").alias("t_out"),
    ).filter("t_in > 0 AND t_out > 0")
    v = F.greatest(F.lit(0.0), F.col("across") - _NOISE_M) / (F.col("t_in") + F.col("t_out")) * 3.6
    rows = rows.withColumn("v", v)
    guess, truth = F.lit(len(_KINDS) - 1), F.lit(None).cast("int")
    for i in reversed(range(len(_KINDS))):
        name, usual, _, event = _KINDS[i]
        if usual is not None:
            guess = F.when(F.col("v") <= usual, i).otherwise(guess)
        truth = F.when(F.col("mode") == event, i).otherwise(truth)
    rows = rows.withColumns({"g": guess, "truth": truth}).filter("truth IS NOT NULL")
    limit = F.element_at(F.array(*[F.lit(x[2]) for x in _KINDS]), F.col("g") + 1) / 3.6
    rows = rows.withColumn("bad", ((F.col("m_in") > limit * F.col("t_in") + _NOISE_M) | (F.col("m_out") > limit * F.col("t_out") + _NOISE_M)).cast("int"))
    return rows.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), r("false_reject_pct", 6, 100 * F.avg("bad")), r("accuracy_pct", 6, 100 * F.avg((F.col("g") == F.col("truth")).cast("int"))),
        *[r(x[0], 6, 100 * F.avg(F.when(F.col("truth") == i, F.col("bad")))) for i, x in enumerate(_KINDS)],
    )


# --- rules for home and office ---


def _daily(rows: DataFrame) -> DataFrame:
    """Local stays by day, from the one before arrival."""
    return rows.withColumn("day", F.explode(F.sequence(F.date_sub(F.to_date("arrival_local"), 1), F.to_date("departure_local"))))


def _window(start: int, end: int, works: bool) -> Column:
    minutes = times.window_minutes(F.col("arrival_local"), F.col("departure_local"), F.col("day"), start, end)
    return F.when(F.weekday("day") < 5, minutes).otherwise(0.0) if works else minutes


def _sql_window(start: int, end: int, works: bool) -> str:
    return f"CASE WHEN isodow(d) <= 5 THEN {_minutes(start, end)} ELSE 0.0 END" if works else _minutes(start, end)


_CORE = {"home": (2, 5, False), "office": (12, 15, True)}
CTES["core_minutes"] = " UNION ALL ".join(f"SELECT user_id, chain, stay, '{k}' AS type, sum({_sql_window(*w)}) AS m FROM days GROUP BY ALL" for k, w in _CORE.items())
CTES["core_rows"] = f"""
  SELECT a.user_id, x.type, a.chain, a.stay, a.arrival, a.lat, a.lon, sum(y.m) AS m
  FROM core_minutes x JOIN sc a USING (user_id, chain, stay) JOIN sc b ON a.user_id = b.user_id AND {mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200
  JOIN core_minutes y ON y.user_id = b.user_id AND y.chain = b.chain AND y.stay = b.stay AND y.type = x.type GROUP BY ALL"""
CTES["core_top"] = f"""
  SELECT * FROM core_rows WHERE m > 0 QUALIFY row_number() OVER (PARTITION BY user_id, type ORDER BY {rnd('m', 6)} DESC, arrival, chain, stay) = 1"""


CTES["core_members"] = f"""
  SELECT t.user_id, t.type, s.chain, s.stay, t.m FROM core_top t JOIN sc s ON s.user_id = t.user_id AND {mean_m('t.lat', 't.lon', 's.lat', 's.lon')} <= 200"""


def _area(rows: DataFrame, by: list[str], value: str, keep: list[str]) -> DataFrame:
    """Per row the sum of ``value`` over rows of the same key within 200 m, itself included, as ``area`` beside ``by`` and ``keep``; rows have an ``id``."""
    rows = rows.withColumn("__v", F.col(value))
    pairs = places.radius_pairs(rows, rows, by, 200.0, keep_a=tuple(keep), keep_b=("__v",))
    return pairs.groupBy(*by, "a", *keep).agg(F.sum("__v").alias("area")).drop("a")


def _core_stays(rows: DataFrame) -> DataFrame:
    """``user_id, type, chain, stay, core, core_minutes``: stays within 200 m of the one around which most minutes of the core hours lie, ``core``."""
    kinds = [F.struct(F.lit(k).alias("type"), F.sum(_window(*w)).alias("m")) for k, w in _CORE.items()]
    sums = _daily(rows).groupBy(*STAY, "arrival", "lat", "lon").agg(F.array(*kinds).alias("k")).select("*", F.explode("k").alias("x")).select(*STAY, "arrival", "lat", "lon", "x.*")
    sums = sums.withColumn("id", F.struct("chain", "stay"))
    areas = _area(sums, ["user_id", "type"], "m", ["chain", "stay", "arrival", "lat", "lon"])
    best = Window.partitionBy("user_id", "type").orderBy(F.desc(geo.round_half_up(F.col("area"), 6)), "arrival", "chain", "stay")
    # The best stay is told to its user's others where they are: no join back.
    core = F.first(F.struct("chain", "stay", "lat", "lon", "area")).over(best.rowsBetween(Window.unboundedPreceding, 0))
    near = mean_haversine_m("core.lat", "core.lon", "lat", "lon") <= 200
    return areas.withColumn("core", core).filter("core.area > 0").filter(near).select("user_id", "type", "chain", "stay", "core", F.col("core.area").alias("core_minutes"))


def _core(rows: DataFrame) -> DataFrame:
    """``user_id, type, core_lat, core_lon``: the middle of the area with most minutes of the core hours."""
    middle = _core_stays(rows).filter("chain = core.chain AND stay = core.stay")
    return middle.select("user_id", "type", F.col("core.lat").alias("core_lat"), F.col("core.lon").alias("core_lon"))


@query(f"SELECT user_id, type, chain, stay, {rnd('m', 3)} AS core_minutes FROM core_members")
def core_place(s: SparkSession, d: str) -> DataFrame:
    """The stays of the area with most minutes of the core hours, by user and type."""
    return _core_stays(base.scores(s, d)).select("user_id", "type", "chain", "stay", r("core_minutes"))


def _judged_rules(rules: DataFrame, core: DataFrame, by: list[str]) -> DataFrame:
    """Winners ``(user_id, type, by, score, total, duration_minutes, arrival, lat, lon)`` of each rule beside the core places."""
    best = Window.partitionBy("user_id", "type", *by).orderBy(F.desc(geo.round_half_up(F.col("score"), 6)), F.desc("duration_minutes"), "arrival", "chain", "stay")
    top = rules.filter("score > 0").withColumn("rk", F.row_number().over(best)).filter("rk = 1").join(core.hint("merge"), ["user_id", "type"], "left")
    near = mean_haversine_m("lat", "lon", "core_lat", "core_lon") <= 200
    return top.groupBy("type", *by).agg(
        F.count(F.lit(1)).alias("found"), F.count("core_lat").alias("n_ref"), r("agree", 6, F.coalesce(F.avg(near.cast("int")), F.lit(0.0))), r("median_confidence", 6, _median(F.col("score") / F.col("total")))
    )


def _sql_judged(rules: str, by: str) -> str:
    return f"""SELECT w.type, {by}, count(*) AS found, count(c.lat) AS n_ref, {rnd(f"coalesce(avg(CAST({mean_m('w.lat', 'w.lon', 'c.lat', 'c.lon')} <= 200 AS INT)), 0.0)", 6)} AS agree,
      {rnd('quantile_cont(score / total, 0.5)', 6)} AS median_confidence
      FROM (SELECT * FROM {rules} WHERE score > 0
            QUALIFY row_number() OVER (PARTITION BY user_id, type, {by} ORDER BY {rnd('score', 6)} DESC, duration_minutes DESC, arrival, chain, stay) = 1) w
      LEFT JOIN core_top c ON c.user_id = w.user_id AND c.type = w.type GROUP BY ALL"""


_GRID = [("home", a, b, False) for a in (20, 21, 22, 23) for b in (5, 6, 7, 8, 9)] + [("office", a, b, True) for a in (8, 9, 10) for b in (17, 18, 19)]
CTES["grid_scores"] = f"""
  SELECT s.user_id, s.chain, s.stay, s.arrival, s.lat, s.lon, s.duration_minutes, g.x.type AS type, g.x.w0 AS start_hour, g.x.w1 AS end_hour, g.x.m AS score,
         sum(g.x.m) OVER (PARTITION BY s.user_id, g.x.type, g.x.w0, g.x.w1) AS total
  FROM sc s JOIN (SELECT user_id, chain, stay, unnest(xs) AS x FROM (
    SELECT user_id, chain, stay, [{', '.join(f"{{'type': '{k}', 'w0': {a}, 'w1': {b}, 'm': sum({_sql_window(a, b, w)})}}" for k, a, b, w in _GRID)}] AS xs
    FROM days GROUP BY user_id, chain, stay)) g USING (user_id, chain, stay)"""


@query(_sql_judged("grid_scores", "start_hour, end_hour"))
def window_grid(s: SparkSession, d: str) -> DataFrame:
    """Other window hours: users with an answer, agreement with the core place, confidence."""
    rows = base.scores(s, d)
    kinds = [F.struct(F.lit(k).alias("type"), F.lit(a).alias("start_hour"), F.lit(b).alias("end_hour"), F.sum(_window(a, b, w)).alias("score")) for k, a, b, w in _GRID]
    sums = _daily(rows).groupBy(*STAY, "arrival", "lat", "lon", "duration_minutes").agg(F.array(*kinds).alias("k")).withColumn("x", F.explode("k"))
    sums = sums.select(*STAY, "arrival", "lat", "lon", "duration_minutes", "x.*")
    by = ["start_hour", "end_hour"]
    return _judged_rules(sums.withColumn("total", F.sum("score").over(Window.partitionBy("user_id", "type", *by))), _core(rows), by)


_RULES = [("home", "minutes 22-06", 22, 6, False), ("home", "minutes 22-08", 22, 8, False), ("office", "minutes 09-18", 9, 18, True)]
_LATE = "hour(arr) >= 22 OR hour(arr) < 6"
_DAY = "hour(arr) >= 9 AND hour(arr) < 18 AND isodow(arr) <= 5"
CTES["rule_minutes"] = f"""
  SELECT s.*, g.x.type AS type, g.x.rule AS rule, g.x.m AS score FROM sc s JOIN (SELECT user_id, chain, stay, unnest(xs) AS x FROM (
    SELECT user_id, chain, stay, [{', '.join(f"{{'type': '{k}', 'rule': '{n}', 'm': sum({_sql_window(a, b, w)})}}" for k, n, a, b, w in _RULES)}] AS xs
    FROM days GROUP BY user_id, chain, stay)) g USING (user_id, chain, stay)"""
CTES["rule_scores"] = f"""
  SELECT user_id, chain, stay, arrival, lat, lon, duration_minutes, type, rule, score, sum(score) OVER (PARTITION BY user_id, type, rule) AS total FROM (
    SELECT user_id, chain, stay, arrival, lat, lon, duration_minutes, type, rule, score FROM rule_minutes
    UNION ALL SELECT user_id, chain, stay, arrival, lat, lon, duration_minutes, 'home', 'arrival', CASE WHEN {_LATE} THEN duration_minutes ELSE 0.0 END FROM sc
    UNION ALL SELECT user_id, chain, stay, arrival, lat, lon, duration_minutes, 'office', 'arrival', CASE WHEN {_DAY} THEN duration_minutes ELSE 0.0 END FROM sc)
  UNION ALL
  SELECT a.user_id, a.chain, a.stay, a.arrival, a.lat, a.lon, a.duration_minutes, a.type, 'area', sum(b.score), (SELECT sum(score) FROM rule_minutes t WHERE t.user_id = a.user_id AND t.type = a.type AND t.rule = a.rule)
  FROM rule_minutes a JOIN rule_minutes b ON a.user_id = b.user_id AND a.type = b.type AND a.rule = b.rule AND {mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200
  WHERE a.rule IN ('minutes 22-08', 'minutes 09-18') GROUP BY a.user_id, a.chain, a.stay, a.arrival, a.lat, a.lon, a.duration_minutes, a.type, a.rule"""


@query(_sql_judged("rule_scores", "rule"))
def rule_comparison(s: SparkSession, d: str) -> DataFrame:
    """Scoring by hour of arrival, by minutes in the window and by minutes of the area around."""
    rows = base.scores(s, d)
    keep = [*STAY, "arrival", "lat", "lon", "duration_minutes"]
    kinds = [F.struct(F.lit(k).alias("type"), F.lit(n).alias("rule"), F.sum(_window(a, b, w)).alias("score")) for k, n, a, b, w in _RULES]
    minutes = _daily(rows).groupBy(*keep).agg(F.array(*kinds).alias("k")).withColumn("x", F.explode("k")).select(*keep, "x.*")
    hour = F.hour("arrival_local")
    works = times.in_hours(hour, 9, 18) & (F.weekday("arrival_local") < 5)
    late = [F.struct(F.lit(k).alias("type"), F.lit("arrival").alias("rule"), F.when(c, F.col("duration_minutes")).otherwise(0.0).alias("score")) for k, c in (("home", times.in_hours(hour, 22, 6)), ("office", works))]
    arrival = rows.withColumn("x", F.explode(F.array(*late))).select(*keep, "x.*")
    both = minutes.unionByName(arrival)
    both = both.withColumn("total", F.sum("score").over(Window.partitionBy("user_id", "type", "rule")))
    wide = both.filter("rule IN ('minutes 22-08', 'minutes 09-18')").withColumn("id", F.struct("chain", "stay"))
    area = _area(wide, ["user_id", "type"], "score", [*(c for c in keep if c != "user_id"), "total"])
    area = area.select(*keep, "type", F.lit("area").alias("rule"), F.col("area").alias("score"), "total")
    return _judged_rules(both.unionByName(area), _core(rows), ["rule"])


# --- observed time ---

CTES["inner_gaps"] = f"""
  SELECT * FROM (SELECT user_id, chain, stay, lag(datetime) OVER w AS g0, datetime AS g1, lag(source_file) OVER w <> source_file AS between_files
    FROM members WINDOW w AS (PARTITION BY user_id, chain, stay ORDER BY datetime, ord)) WHERE {secs('g0', 'g1')} > 1200"""
CTES["gap_days"] = f"""
  SELECT user_id, chain, stay, d, g0, g1, between_files, {_minutes(22, 8)} AS home_min, CASE WHEN isodow(d) <= 5 THEN {_minutes(9, 18)} ELSE 0.0 END AS office_min FROM (
    SELECT *, unnest(generate_series(date_trunc('day', arr) - INTERVAL 1 DAY, date_trunc('day', dep), INTERVAL 1 DAY)) AS d FROM (
      SELECT g.*, timezone(l.tz_name, timezone('UTC', g.g0)) AS arr, timezone(l.tz_name, timezone('UTC', g.g1)) AS dep FROM inner_gaps g JOIN stl l USING (user_id, chain, stay)))"""
CTES["seen_minutes"] = """
  SELECT user_id, chain, stay, sum(greatest(0.0, round(h, 6))) AS home, sum(greatest(0.0, round(o, 6))) AS office FROM (
    SELECT user_id, chain, stay, d, sum(h) AS h, sum(o) AS o FROM (
      SELECT user_id, chain, stay, d, home_min AS h, office_min AS o FROM days UNION ALL SELECT user_id, chain, stay, d, -home_min, -office_min FROM gap_days) GROUP BY ALL) GROUP BY ALL"""
CTES["typed_seen"] = """
  SELECT * FROM (SELECT s.* EXCLUDE (home, office), m.home, m.office, 'home' AS type, m.home AS minutes FROM sc s JOIN seen_minutes m USING (user_id, chain, stay)) WHERE minutes > 0
  UNION ALL SELECT * FROM (SELECT s.* EXCLUDE (home, office), m.home, m.office, 'office' AS type, m.office AS minutes FROM sc s JOIN seen_minutes m USING (user_id, chain, stay)) WHERE minutes > 0"""
CTES["win_seen"] = CTES["win1"].replace("typed", "typed_seen")


def _local_gaps(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Gaps over 20 minutes inside stays, in local time, with whether they lie between two recordings."""
    order = Window.partitionBy(*STAY).orderBy("datetime", "ord")
    gaps = members.select(*STAY, F.lag("datetime").over(order).alias("g0"), F.col("datetime").alias("g1"), (F.lag("source_file").over(order) != F.col("source_file")).alias("between_files"))
    gaps = gaps.filter(seconds_between("g0", "g1") > 1200).join(rows.select(*STAY, "tz_name"), STAY)
    return gaps.withColumns({"arrival_local": times.to_local(F.col("g0"), F.col("tz_name")), "departure_local": times.to_local(F.col("g1"), F.col("tz_name"))})


def _observed(s: SparkSession, d: str) -> DataFrame:
    """Scores by the whole time of stays, ``home`` and ``office``, and by the time in which points were recorded, ``home_seen`` and ``office_seen``."""
    # Gaps come with their stay, and their minutes are taken from its days within the row: points are read and stays found once.
    rows = classify.scored(stays.stays_of(base.members(s, d), pieces=base.pieces(s, d), gaps=True), pieces=base.stay_pieces(s, d))

    def local(gap: Column) -> Column:
        return F.struct(*[times.to_local(gap[c], F.col("tz_name")).alias(c) for c in ("start", "end")])

    rows = rows.withColumn("gaps", F.transform("gaps", local))
    return rows.withColumns({f"{k}_seen": classify.window_total(k, without="gaps") for k in ("home", "office")}).drop("gaps")


def _seen(observed: DataFrame) -> DataFrame:
    """Scores by the recorded time alone."""
    return observed.withColumns({k: F.col(f"{k}_seen") for k in ("home", "office")}).drop("home_seen", "office_seen")


@query(f"SELECT user_id, type, arrival, {rnd('minutes', 3)} AS minutes, support, status, reason FROM win_seen")
def observed_classify(s: SparkSession, d: str) -> DataFrame:
    """Winners by the minutes in which points were recorded."""
    return classify.winners_v1(_seen(_observed(s, d))).select("user_id", "type", "arrival", r("minutes"), "support", "status", "reason")


@query(
    f"""SELECT type, CASE WHEN a = 'found' AND b <> 'found' THEN 'found -> unknown' WHEN a <> 'found' AND b = 'found' THEN 'unknown -> found'
      WHEN a = 'found' AND b = 'found' AND m > 200 THEN 'moved > 200 m' ELSE 'same' END AS change, count(*) AS n FROM (
      SELECT type, x.status AS a, y.status AS b, {mean_m('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS m FROM win1 x JOIN win_seen y USING (user_id, type)) GROUP BY ALL"""
)
def observed_vs_duration(s: SparkSession, d: str) -> DataFrame:
    """How answers change when only recorded time counts."""
    rows = _observed(s, d)
    whole, seen = (classify.winners_v1(x).select("user_id", "type", "status", "lat", "lon") for x in (rows, _seen(rows)))
    both = whole.alias("x").join(seen.alias("y"), ["user_id", "type"])
    a, b = F.col("x.status") == "found", F.col("y.status") == "found"
    change = (
        F.when(a & ~b, "found -> unknown").when(~a & b, "unknown -> found")
        .when(a & b & (mean_haversine_m("x.lat", "x.lon", "y.lat", "y.lon") > 200), "moved > 200 m").otherwise("same")
    )
    return both.groupBy("type", change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT between_files, count(*) AS gaps, {rnd('quantile_cont(h, 0.5)', 6)} AS median_hours, {rnd('sum(home)', 3)} AS home_minutes, {rnd('sum(office)', 3)} AS office_minutes,
      {rnd('sum(home) / sum(sum(home)) OVER ()', 6)} AS home_share, {rnd('sum(office) / sum(sum(office)) OVER ()', 6)} AS office_share FROM (
      SELECT user_id, chain, stay, g0, g1, between_files, {secs('g0', 'g1')} / 3600 AS h, sum(home_min) AS home, sum(office_min) AS office FROM gap_days GROUP BY ALL) GROUP BY 1"""
)
def unobserved_by_kind(s: SparkSession, d: str) -> DataFrame:
    """Unrecorded time inside stays: within one recording or between two."""
    members = base.members(s, d)
    gaps = _local_gaps(members, stays.localized(stays.stays_of(members, pieces=base.pieces(s, d))))
    per_gap = classify.daily_overlaps(gaps).groupBy(*STAY, "g0", "g1", "between_files").agg(F.sum("home_min").alias("home"), F.sum("office_min").alias("office"))
    rows = per_gap.groupBy("between_files").agg(
        F.count(F.lit(1)).alias("gaps"), r("median_hours", 6, _median(seconds_between("g0", "g1") / 3600)), F.sum("home").alias("home"), F.sum("office").alias("office")
    )
    share = {f"{k}_share": F.col(k) / F.sum(k).over(Window.partitionBy(F.lit(0))) for k in ("home", "office")}
    return rows.select("between_files", "gaps", "median_hours", r("home_minutes", of=F.col("home")), r("office_minutes", of=F.col("office")), *[r(n, 6, c) for n, c in share.items()])


@query(
    f"""SELECT user_id, type, count(DISTINCT d) AS days FROM (
      SELECT w.user_id, w.type, x.d FROM win1 w JOIN sc s ON s.user_id = w.user_id AND {mean_m('w.lat', 'w.lon', 's.lat', 's.lon')} <= 200
      JOIN days x ON x.user_id = s.user_id AND x.chain = s.chain AND x.stay = s.stay AND CASE w.type WHEN 'home' THEN x.home_min ELSE x.office_min END > 0) GROUP BY ALL"""
)
def v1_support_days(s: SparkSession, d: str) -> DataFrame:
    """Days on which the stays behind a winner's support touch its window."""
    rows = base.scores(s, d)
    days = classify.daily_overlaps(rows.drop("home", "office"))
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), F.col(f"{k}_min").alias("m")) for k in ("home", "office")])
    days = days.withColumn("x", F.explode(kinds)).filter("x.m > 0").select("user_id", "x.type", "day", "lat", "lon").alias("c")
    met = classify.winners_v1(rows).select("user_id", "type", "lat", "lon").alias("w").join(days, ["user_id", "type"])
    near = met.filter(mean_haversine_m("w.lat", "w.lon", "c.lat", "c.lon") <= 200)
    return near.groupBy("user_id", "type").agg(F.count_distinct("day").alias("days"))


# --- places of a user by hour ---


def _slots(rows: DataFrame) -> DataFrame:
    """Local stays by clock hour: ``slot`` and the ``minutes`` in it."""
    first = F.to_timestamp_ntz(F.date_format("arrival_local", "yyyy-MM-dd HH:00:00"))
    n = F.floor(seconds_between(first, F.col("departure_local")) / 3600).cast("int")
    rows = rows.withColumn("first", first).withColumn("i", F.explode(F.sequence(F.lit(0), n)))
    rows = rows.withColumn("slot", times.plus_seconds(F.col("first"), F.col("i") * 3600))
    end = F.least(F.col("departure_local"), times.plus_seconds(F.col("slot"), F.lit(3600)))
    return rows.withColumn("minutes", seconds_between(F.greatest("arrival_local", "slot"), end) / 60).drop("first", "i")


CTES["hour_slots"] = """
  SELECT user_id, chain, stay, slot, (epoch_us(least(dep, slot + INTERVAL 1 HOUR)) - epoch_us(greatest(arr, slot))) / 60e6::DOUBLE AS minutes
  FROM (SELECT *, unnest(generate_series(date_trunc('hour', arr), dep, INTERVAL 1 HOUR)) AS slot FROM sc)"""
CTES["busy_hours"] = "SELECT user_id, hour(slot) AS h FROM hour_slots GROUP BY ALL HAVING sum(minutes) >= 60"
CTES["hour_islands"] = """
  SELECT user_id, min(h) AS a, max(h) AS b FROM (SELECT user_id, h, h - row_number() OVER (PARTITION BY user_id ORDER BY h) AS g FROM busy_hours) GROUP BY user_id, g"""


@query(
    """SELECT user_id, CASE WHEN bool_or(a = 0 AND b = 23) THEN 'all day' ELSE string_agg(lpad(a::VARCHAR, 2, '0') || '-' || lpad(((e + 1) % 24)::VARCHAR, 2, '0') || ' h', ', ' ORDER BY a) END AS runs FROM (
      SELECT i.user_id, i.a, i.b, CASE WHEN i.b = 23 AND z.b IS NOT NULL THEN z.b ELSE i.b END AS e FROM hour_islands i
      LEFT JOIN (SELECT * FROM hour_islands WHERE a = 0) z ON z.user_id = i.user_id
      WHERE i.a > 0 OR i.b = 23 OR NOT EXISTS (SELECT 1 FROM hour_islands t WHERE t.user_id = i.user_id AND t.b = 23)) GROUP BY 1"""
)
def hour_runs(s: SparkSession, d: str) -> DataFrame:
    """Hours of the clock in which a user has an hour of stays or more, as runs across midnight."""
    busy = _slots(base.scores(s, d)).groupBy("user_id", F.hour("slot").alias("hour")).agg(F.sum("minutes").alias("m")).filter("m >= 60")
    return intervals.hour_runs(busy, ["user_id"])


CTES["pp_area"] = f"""
  SELECT a.user_id, a.chain, a.stay, a.arrival, a.lat, a.lon, sum(b.duration_minutes) AS area FROM sc a JOIN sc b ON a.user_id = b.user_id AND {mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200 GROUP BY ALL"""
CTES["pp_first"] = f"SELECT * FROM pp_area QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {rnd('area', 6)} DESC, arrival, chain, stay) = 1"
CTES["pp_rest"] = f"SELECT s.* FROM sc s JOIN pp_first f ON f.user_id = s.user_id WHERE {mean_m('f.lat', 'f.lon', 's.lat', 's.lon')} > 200"
CTES["pp_area2"] = CTES["pp_area"].replace("sc a", "pp_rest a").replace("sc b", "pp_rest b")
CTES["pp_second"] = CTES["pp_first"].replace("pp_area", "pp_area2")
CTES["pp_placed"] = f"""
  SELECT s.user_id, s.chain, s.stay, CASE WHEN {mean_m('f.lat', 'f.lon', 's.lat', 's.lon')} <= 200 THEN 'place1' WHEN {mean_m('g.lat', 'g.lon', 's.lat', 's.lon')} <= 200 THEN 'place2' ELSE 'other' END AS place
  FROM sc s JOIN pp_first f ON f.user_id = s.user_id LEFT JOIN pp_second g ON g.user_id = s.user_id"""


@query(
    f"""SELECT workday, hour, count(*) AS users, {', '.join(f"{rnd(f'avg({p} / t)', 6)} AS {p}" for p in ('place1', 'place2', 'other'))} FROM (
      SELECT user_id, isodow(slot) <= 5 AS workday, hour(slot) AS hour, sum(minutes) AS t, {', '.join(f"coalesce(sum(minutes) FILTER (WHERE place = '{p}'), 0.0) AS {p}" for p in ('place1', 'place2', 'other'))}
      FROM hour_slots JOIN pp_placed USING (user_id, chain, stay) GROUP BY 1, 2, 3) WHERE t > 0 GROUP BY ALL"""
)
def place_profile(s: SparkSession, d: str) -> DataFrame:
    """Share of a user's time at the place with most time, at the next and elsewhere, by hour, averaged over users."""
    rows = base.scores(s, d).withColumn("id", F.struct("chain", "stay"))

    def top(part: DataFrame) -> DataFrame:
        best = Window.partitionBy("user_id").orderBy(F.desc(geo.round_half_up(F.col("area"), 6)), "arrival", "chain", "stay")
        area = _area(part, ["user_id"], "duration_minutes", ["chain", "stay", "arrival", "lat", "lon"])
        return area.withColumn("rk", F.row_number().over(best)).filter("rk = 1").select("user_id", F.col("lat").alias("y"), F.col("lon").alias("x"))

    near = mean_haversine_m("y", "x", "lat", "lon") <= 200
    one = rows.join(top(rows).hint("merge"), "user_id").withColumn("in1", near).drop("y", "x")
    two = one.join(top(one.filter("NOT in1")).hint("merge"), "user_id", "left")
    place = F.when(F.col("in1"), "place1").when(F.coalesce(near, F.lit(False)), "place2").otherwise("other")
    slots = _slots(two.withColumn("place", place)).groupBy("user_id", (F.weekday("slot") < 5).alias("workday"), F.hour("slot").alias("hour"))
    names = ("place1", "place2", "other")
    shares = slots.agg(F.sum("minutes").alias("t"), *[F.coalesce(F.sum(F.when(F.col("place") == p, F.col("minutes"))), F.lit(0.0)).alias(p) for p in names]).filter("t > 0")
    return shares.groupBy("workday", "hour").agg(F.count(F.lit(1)).alias("users"), *[r(p, 6, F.avg(F.col(p) / F.col("t"))) for p in names])


@query(
    f"""SELECT a.user_id, a.type, {rnd(mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon'), 3)} AS metres,
      CASE WHEN {mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200 THEN 'same place' WHEN p.place = b.place THEN 'v1 stay inside v2 place' ELSE 'different place' END AS category,
      (SELECT count(*) FROM pl q WHERE q.user_id = a.user_id AND {rnd("CASE a.type WHEN 'home' THEN q.home ELSE q.office END", 6)}
         > {rnd("CASE a.type WHEN 'home' THEN m.home ELSE m.office END", 6)}) + 1 AS v1_place_rank
      FROM win1 a JOIN win2 b USING (user_id, type) JOIN placed p ON p.user_id = a.user_id AND p.chain = a.chain AND p.stay = a.stay
      JOIN pl m ON m.user_id = a.user_id AND m.place = p.place WHERE a.status = 'found' AND b.status = 'found'"""
)
def model_agreement(s: SparkSession, d: str) -> DataFrame:
    """Where both models answer: how far apart, whether the stay is in the place, and the place's rank."""
    rows = base.scores(s, d)
    n = base.stay_pieces(s, d)
    placed = places.dbscan(rows.select(*STAY, "arrival", "lat", "lon"), pieces=n).select("user_id", "arrival", "place")
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), geo.round_half_up(F.col(k), 6).alias("m")) for k in ("home", "office")])
    found = classify.place_scores(rows, pieces=n)
    ranked = found.withColumn("x", F.explode(kinds)).select("user_id", "place", "x.type", "x.m")
    ranked = ranked.withColumn("v1_place_rank", F.rank().over(Window.partitionBy("user_id", "type").orderBy(F.desc("m"))).cast("long"))
    one = classify.winners_v1(rows).filter("status = 'found'").select("user_id", "type", "lat", "lon", "arrival").join(placed, ["user_id", "arrival"])
    one = one.join(ranked.drop("m"), ["user_id", "type", "place"])
    # A place is known by its first stay.
    two = classify.winners_v2(found).filter("status = 'found'").select("user_id", "type", F.col("lat").alias("y"), F.col("lon").alias("x"), F.col("first_seen").alias("arrival"))
    two = two.join(placed.withColumnRenamed("place", "place2"), ["user_id", "arrival"]).drop("arrival")
    metres = mean_haversine_m("lat", "lon", "y", "x")
    category = F.when(metres <= 200, "same place").when(F.col("place") == F.col("place2"), "v1 stay inside v2 place").otherwise("different place")
    return one.join(two, ["user_id", "type"]).select("user_id", "type", r("metres", of=metres), category.alias("category"), "v1_place_rank")


# --- stability between halves of the days ---

CTES["half_dates"] = "SELECT user_id, list(DISTINCT CAST(arr AS DATE) ORDER BY CAST(arr AS DATE)) AS ds FROM sc GROUP BY 1 HAVING count(DISTINCT CAST(arr AS DATE)) >= 2"
CTES["halved"] = """
  SELECT t.*, x.split, x.half FROM typed t JOIN half_dates h USING (user_id),
  LATERAL (SELECT 'alt_day' AS split, CAST(date_diff('day', DATE '2000-01-01', CAST(t.arr AS DATE)) % 2 AS INT) AS half
    UNION ALL SELECT 'chrono', CAST(CAST(t.arr AS DATE) >= h.ds[len(h.ds) // 2 + 1] AS INT)) x"""
CTES["half_total"] = "SELECT *, sum(minutes) OVER (PARTITION BY user_id, type, split, half) AS total FROM halved"
CTES["half_top"] = "SELECT * FROM half_total QUALIFY row_number() OVER (PARTITION BY user_id, type, split, half ORDER BY minutes DESC, duration_minutes DESC, arrival) = 1"
CTES["half_pairs"] = f"""
  SELECT a.user_id, a.type, a.split, {mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200 AS same FROM half_top a JOIN half_top b USING (user_id, type, split) WHERE a.half = 0 AND b.half = 1"""


def _halved(rows: DataFrame) -> DataFrame:
    """Candidates of both types by two ways to split a user's days: alternating, and first against second half."""
    dates = rows.groupBy("user_id").agg(F.array_sort(F.collect_set(F.to_date("arrival_local"))).alias("ds")).filter("size(ds) >= 2")
    middle = dates.select("user_id", F.get("ds", F.floor(F.size("ds") / 2).cast("int")).alias("middle"))
    day = F.to_date("arrival_local")
    alternate = (F.date_diff(day, F.lit("2000-01-01").cast("date")) % 2).cast("int")
    ways = F.array(F.struct(F.lit("alt_day").alias("split"), alternate.alias("half")), F.struct(F.lit("chrono").alias("split"), (day >= F.col("middle")).cast("int").alias("half")))
    return classify.by_type(rows).join(middle, "user_id").withColumn("x", F.explode(ways)).select("*", "x.split", "x.half").drop("x", "middle")


def _half_winners(halved: DataFrame) -> DataFrame:
    by = ["user_id", "type", "split", "half"]
    best = Window.partitionBy(*by).orderBy(F.desc("minutes"), F.desc("duration_minutes"), "arrival")
    rows = halved.withColumns({"rk": F.row_number().over(best), "total": F.sum("minutes").over(Window.partitionBy(*by))})
    return rows.filter("rk = 1").select(*by, "lat", "lon", "minutes", "total")


def _half_pairs(winners: DataFrame) -> DataFrame:
    """Winners of both halves side by side: ``user_id, type, split, same`` and their rows as structs."""
    by = ["user_id", "type", "split"]
    a, b = (winners.filter(F.col("half") == h).select(*by, F.struct(*[c for c in winners.columns if c not in by]).alias(n)) for h, n in ((0, "a"), (1, "b")))
    return a.join(b, by).withColumn("same", mean_haversine_m("a.lat", "a.lon", "b.lat", "b.lon") <= 200)


@query("SELECT split, type, count(*) AS users, count(*) FILTER (WHERE same) AS stable FROM half_pairs GROUP BY ALL")
def split_half(s: SparkSession, d: str) -> DataFrame:
    pairs = _half_pairs(_half_winners(_halved(base.scores(s, d))))
    return pairs.groupBy("split", "type").agg(F.count(F.lit(1)).alias("users"), F.count_if("same").alias("stable"))


@query(
    f"""SELECT split, type, count(*) AS users, {rnd('avg(chance)', 6)} AS chance FROM (
      SELECT a.user_id, a.type, a.split, avg(CAST({mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200 AS INT)) AS chance
      FROM halved a JOIN halved b USING (user_id, type, split) WHERE a.half = 0 AND b.half = 1 GROUP BY ALL) GROUP BY ALL"""
)
def split_half_chance(s: SparkSession, d: str) -> DataFrame:
    """Of all pairs of candidates of two halves, the share within 200 m: near pairs come from a grid, the others are counted only."""
    by = ["user_id", "type", "split"]
    rows = _halved(base.scores(s, d)).select(*by, "half", F.struct("chain", "stay").alias("id"), "lat", "lon")
    sides = [rows.filter(F.col("half") == h).drop("half") for h in (0, 1)]
    near = places.radius_pairs(*sides, by, 200.0).groupBy(*by).agg(F.count(F.lit(1)).alias("near"))
    sizes = rows.groupBy(*by).agg(F.count_if(F.col("half") == 0).alias("n0"), F.count_if(F.col("half") == 1).alias("n1"))
    share = F.coalesce("near", F.lit(0)) / (F.col("n0") * F.col("n1"))
    both = sizes.filter("n0 > 0 AND n1 > 0").join(near, by, "left")
    return both.groupBy("split", "type").agg(F.count(F.lit(1)).alias("users"), r("chance", 6, F.avg(share)))


_BINS = {"minutes": [120, 240, 360, 480, 600], "support": [2, 3, 5, 8], "confidence": [0.1, 0.2, 0.3, 0.5, 0.7], "days": [2, 3, 5, 8, 13, 21]}
CTES["half_rich"] = f"""
  SELECT w.user_id, w.type, w.half, w.lat, w.lon, {rnd('w.minutes', 6)} AS minutes, {rnd('w.minutes / w.total', 9)} AS confidence,
         (SELECT count(*) FROM halved c WHERE c.user_id = w.user_id AND c.type = w.type AND c.split = 'alt_day' AND c.half = w.half AND {mean_m('w.lat', 'w.lon', 'c.lat', 'c.lon')} <= 200)::DOUBLE AS support,
         (SELECT count(DISTINCT x.d) FROM halved c JOIN days x ON x.user_id = c.user_id AND x.chain = c.chain AND x.stay = c.stay
          WHERE c.user_id = w.user_id AND c.type = w.type AND c.split = 'alt_day' AND c.half = w.half AND CASE c.type WHEN 'home' THEN x.home_min ELSE x.office_min END > 0)::DOUBLE AS days
  FROM half_top w WHERE w.split = 'alt_day'"""
_SQL_BIN = {m: " + ".join(f"(v >= {e})::INT" for e in edges) for m, edges in _BINS.items()}


@query(
    " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, type, CAST({_SQL_BIN[m]} AS INT) AS bin, count(*) AS pairs, {rnd('avg(CAST(same AS INT))', 6)} AS stable,
      {rnd('1.96::DOUBLE * sqrt(avg(CAST(same AS INT)) * (1 - avg(CAST(same AS INT))) / count(*))', 6)} AS ci95 FROM (
      SELECT a.type, least(a.{m}, b.{m}) AS v, {mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200 AS same FROM half_rich a JOIN half_rich b USING (user_id, type) WHERE a.half = 0 AND b.half = 1) GROUP BY ALL"""
        for m in _BINS
    )
)
def stability_curve(s: SparkSession, d: str) -> DataFrame:
    """Share of users whose halves agree, by bins of the weaker half's evidence."""
    scores = base.scores(s, d)
    halved = _halved(scores).filter("split = 'alt_day'")
    by = ["user_id", "type", "half"]
    winners = _half_winners(halved).drop("split")
    near = mean_haversine_m("lat", "lon", "y", "x") <= 200
    candidates = halved.select(*by, F.col("lat").alias("y"), F.col("lon").alias("x"))
    support = winners.select(*by, "lat", "lon").join(candidates, by).groupBy(*by).agg(F.count_if(near).cast("double").alias("support"))
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), F.col(f"{k}_min").alias("m")) for k in ("home", "office")])
    daily = classify.daily_overlaps(scores.drop("home", "office")).withColumn("k", F.explode(kinds)).filter("k.m > 0").select(*STAY, "k.type", "day")
    days = halved.select(*STAY, "type", "half").join(daily, [*STAY, "type"]).groupBy(*by).agg(F.count_distinct("day").cast("double").alias("days"))
    rich = winners.join(support, by).join(days, by).select(*by, F.lit("alt_day").alias("split"), "lat", "lon", "support", "days", r("minutes", 6), r("confidence", 9, F.col("minutes") / F.col("total")))
    pairs = _half_pairs(rich)
    cases = []
    for metric, edges in _BINS.items():
        weaker = F.least(f"a.{metric}", f"b.{metric}")
        number = F.lit(0)
        for e in edges:
            number = number + (weaker >= e).cast("int")
        cases.append(F.struct(F.lit(metric).alias("metric"), number.alias("bin")))
    rows = pairs.select("type", F.col("same").cast("int").alias("same"), F.explode(F.array(*cases)).alias("x")).groupBy("x.metric", "type", "x.bin")
    p = F.avg("same")
    return rows.agg(F.count(F.lit(1)).alias("pairs"), r("stable", 6, p), r("ci95", 6, 1.96 * F.sqrt(p * (1 - p) / F.count(F.lit(1)))))


_RESAMPLES = 2000
#: Cumulative probabilities of a Poisson count with mean 1.
_POISSON = [0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518]


@query(
    f"""SELECT t.type, t.pairs, {rnd('t.stable', 6)} AS stable, {rnd('quantile_cont(b.v, 0.025)', 6)} AS ci_low, {rnd('quantile_cont(b.v, 0.975)', 6)} AS ci_high FROM (
      SELECT type, count(*) AS pairs, avg(CAST(same AS INT)) AS stable FROM half_pairs WHERE split = 'alt_day' GROUP BY 1) t
      JOIN (SELECT type, i, sum(w * s) / sum(w * k) AS v FROM (
        SELECT type, i, s, k, {' + '.join(f'(u >= {x})::INT' for x in _POISSON)} AS w FROM (
          SELECT g.*, i, CAST('0x' || substr(md5(i || ':' || g.label || ':' || g.type), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM (
            SELECT type, label, sum(CAST(same AS INT))::DOUBLE AS s, count(*)::DOUBLE AS k FROM half_pairs JOIN user_group USING (user_id) WHERE split = 'alt_day' GROUP BY 1, 2) g,
            (SELECT unnest(range({_RESAMPLES})) AS i))) GROUP BY 1, 2 HAVING sum(w) > 0) b ON b.type = t.type GROUP BY ALL"""
)
def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    """Stable share with an interval from 2,000 Poisson resamples of groups of users that share recordings; draws are hashes, so reruns agree."""
    pairs = _half_pairs(_half_winners(_halved(base.scores(s, d)).filter("split = 'alt_day'"))).join(_user_groups(s, d), "user_id")
    groups = pairs.groupBy("type", "label").agg(F.sum(F.col("same").cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("k"))
    draws = groups.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(_RESAMPLES - 1))))
    digits = F.md5(F.concat_ws(":", F.col("i").cast("string"), F.col("label").cast("string"), "type").cast("binary"))
    u = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    w = F.lit(0)
    draws = draws.withColumn("u", u)
    for x in _POISSON:
        w = w + (F.col("u") >= x).cast("int")
    shares = draws.withColumn("w", w).groupBy("type", "i").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("k")), F.lit(0.0))).alias("v")).filter("v IS NOT NULL")
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    ci = shares.groupBy("type").agg(r("ci_low", 6, F.get(q, 0)), r("ci_high", 6, F.get(q, 1)))
    whole = groups.groupBy("type").agg(F.sum("k").cast("long").alias("pairs"), r("stable", 6, F.sum("s") / F.sum("k")))
    return whole.join(ci, "type").select("type", "pairs", "stable", "ci_low", "ci_high")


# --- ways to detect stays ---

CTES["stays_file"] = """
  SELECT c.user_id, c.chain, s.from_rn AS stay, min(c.datetime) AS arrival, max(c.datetime) AS departure, avg(c.lat) AS lat, avg(c.lon) AS lon, 1::BIGINT AS n_files,
         coalesce(sum(CASE WHEN c.rn > s.from_rn AND gap <= 1200 THEN gap END), 0) / 60.0 AS observed_minutes
  FROM scan_file s JOIN (SELECT *, (epoch_us(datetime) - epoch_us(lag(datetime) OVER (PARTITION BY user_id, chain ORDER BY rn))) / 1e6 AS gap FROM chained_file) c
    ON c.user_id = s.user_id AND c.chain = s.chain AND c.rn BETWEEN s.from_rn AND s.to_rn WHERE s.from_rn IS NOT NULL GROUP BY ALL"""
CTES["both_ways"] = """
  SELECT *, CASE WHEN t3 >= arr THEN t3 ELSE t3 + INTERVAL 1 DAY END <= dep AS night, (epoch_us(departure) - epoch_us(arrival)) / 60e6::DOUBLE AS m FROM (
    SELECT *, date_trunc('day', arr) + INTERVAL 3 HOUR AS t3 FROM (
      SELECT *, timezone('Asia/Shanghai', timezone('UTC', arrival)) AS arr, timezone('Asia/Shanghai', timezone('UTC', departure)) AS dep FROM (
        SELECT 'per_file' AS method, user_id, chain, stay, arrival, departure, lat, lon, n_files, observed_minutes FROM stays_file
        UNION ALL SELECT 'chained', st.user_id, st.chain, st.stay, arrival, departure, lat, lon, n.n_files, observed_minutes FROM st
          JOIN (SELECT user_id, chain, stay, count(DISTINCT source_file) AS n_files FROM members GROUP BY ALL) n USING (user_id, chain, stay))))"""


def _both_ways(s: SparkSession, d: str) -> DataFrame:
    """Stays found within single recordings and in chains of them, with ``method, n_files, night``."""
    clean = base.clean(s, d)
    number = F.dense_rank().over(Window.partitionBy("user_id").orderBy("source_file")) - 1
    out = None
    for method, chains in (("per_file", clean.withColumn("chain", number.cast("long"))), ("chained", stays.gap_chains(clean))):
        members = stays.stay_members(chains)
        files = members.groupBy(*STAY).agg(F.count_distinct("source_file").alias("n_files"))
        local = stays.stays_of(members).withColumn("tz_name", F.lit("Asia/Shanghai"))  # local time of the study's city
        local = local.withColumns({f"{c}_local": times.to_local(F.col(c), F.col("tz_name")) for c in ("arrival", "departure")})
        rows = stays.overnight(local).join(files, STAY).withColumn("method", F.lit(method)).withColumnRenamed("overnight", "night")
        out = rows if out is None else out.unionByName(rows)
    return out


_METRICS = {
    "stay_points": "count(*)::DOUBLE", "stays_spanning_files": "count(*) FILTER (WHERE n_files >= 2)::DOUBLE", "dwell_hours": "sum(m) / 60", "observed_share": "sum(observed_minutes) / sum(m)",
    "night_stays": "count(*) FILTER (WHERE night)::DOUBLE", "users_with_night_stay": "count(DISTINCT user_id) FILTER (WHERE night)::DOUBLE",
    "users_without_night_stay": "((SELECT count(DISTINCT user_id) FROM clean) - count(DISTINCT user_id) FILTER (WHERE night))::DOUBLE",
    "stays_over_24h": "count(*) FILTER (WHERE m > 1440)::DOUBLE", "max_duration_h": "max(m) / 60",
}


@query(
    f"""SELECT metric, {rnd("max(v) FILTER (WHERE method = 'per_file')", 6)} AS per_file, {rnd("max(v) FILTER (WHERE method = 'chained')", 6)} AS chained FROM (
      UNPIVOT (SELECT method, {', '.join(f'{sql} AS {n}' for n, sql in _METRICS.items())} FROM both_ways GROUP BY 1) ON {', '.join(_METRICS)} INTO NAME metric VALUE v) GROUP BY 1"""
)
def stay_comparison(s: SparkSession, d: str) -> DataFrame:
    """Nine figures of stays within recordings beside those of stays across them."""
    rows = _both_ways(s, d).withColumn("m", F.col("duration_minutes"))
    users = base.clean(s, d).agg(F.count_distinct("user_id").alias("users"))
    night = F.when(F.col("night"), F.col("user_id"))
    found = rows.groupBy("method").agg(
        F.count(F.lit(1)).alias("stay_points"), F.count_if(F.col("n_files") >= 2).alias("stays_spanning_files"), (F.sum("m") / 60).alias("dwell_hours"),
        (F.sum("observed_minutes") / F.sum("m")).alias("observed_share"), F.count_if("night").alias("night_stays"), F.count_distinct(night).alias("users_with_night_stay"),
        F.count_if(F.col("m") > 1440).alias("stays_over_24h"), (F.max("m") / 60).alias("max_duration_h"),
    ).crossJoin(users)
    found = found.withColumn("users_without_night_stay", F.col("users") - F.col("users_with_night_stay"))
    long = found.select("method", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in _METRICS])).alias("x")).select("method", "x.*")
    return long.groupBy("metric").agg(*[r(k, 6, F.max(F.when(F.col("method") == k, F.col("v")))) for k in ("per_file", "chained")])


CTES["night_kinds"] = """
  SELECT *, CASE WHEN method = 'per_file' THEN 'per_file_day' WHEN night THEN 'spanning_night' ELSE 'spanning_day' END AS kind FROM both_ways
  WHERE (method = 'per_file' AND NOT night) OR (method = 'chained' AND n_files >= 2)"""


@query(
    f"""SELECT kind, stay_points, users, near_share, median_m, users_5plus, median_top_share FROM (
      SELECT kind, count(*) AS stay_points, count(DISTINCT user_id) AS users, {rnd('avg(CAST(g <= 200 AS INT))', 6)} AS near_share, {rnd('quantile_cont(g, 0.5)', 3)} AS median_m FROM (
        SELECT a.kind, a.user_id, a.chain, a.stay, min({mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS g FROM night_kinds a
        JOIN (SELECT * FROM both_ways WHERE method = 'per_file' AND night) b ON a.user_id = b.user_id GROUP BY ALL) GROUP BY 1)
      FULL JOIN (SELECT kind, count(*) AS users_5plus, {rnd('quantile_cont(top, 0.5)', 6)} AS median_top_share FROM (
        SELECT kind, user_id, max(c) / count(*)::DOUBLE AS top FROM (
          SELECT a.kind, a.user_id, a.chain, a.stay, count(*) AS c FROM night_kinds a JOIN night_kinds b ON a.kind = b.kind AND a.user_id = b.user_id
            AND {mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200 GROUP BY ALL) GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY 1) USING (kind)"""
)
def night_recovery(s: SparkSession, d: str) -> DataFrame:
    """Are nights that only chains of recordings find where recorded nights are, and in one place?"""
    rows = _both_ways(s, d)
    kind = F.when(F.col("method") == "per_file", "per_file_day").when(F.col("night"), "spanning_night").otherwise("spanning_day")
    kinds = rows.filter("(method = 'per_file' AND NOT night) OR (method = 'chained' AND n_files >= 2)").select("user_id", kind.alias("kind"), F.struct("chain", "stay").alias("id"), "lat", "lon")
    seen = rows.filter("method = 'per_file' AND night").select("user_id", F.col("lat").alias("y"), F.col("lon").alias("x"))
    gap = kinds.join(seen, "user_id").groupBy("kind", "user_id", "id").agg(F.min(mean_haversine_m("lat", "lon", "y", "x")).alias("g"))
    near = gap.groupBy("kind").agg(
        F.count(F.lit(1)).alias("stay_points"), F.count_distinct("user_id").alias("users"), r("near_share", 6, F.avg((F.col("g") <= 200).cast("int"))), r("median_m", of=_median("g"))
    )
    around = places.radius_pairs(kinds, kinds, ["kind", "user_id"], 200.0).groupBy("kind", "user_id", "a").agg(F.count(F.lit(1)).alias("c"))
    top = around.groupBy("kind", "user_id").agg((F.max("c") / F.count(F.lit(1))).alias("top"), F.count(F.lit(1)).alias("n")).filter("n >= 5")
    return near.join(top.groupBy("kind").agg(F.count(F.lit(1)).alias("users_5plus"), r("median_top_share", 6, _median("top"))), "kind", "full")


# --- clusters in general ---

_CONFIGS = [(1, 100.0, 2, "stays"), (2, 150.0, 2, "stays"), (3, 200.0, 2, "stays"), (4, 150.0, 3, "stays"), (5, 150.0, 3, "days"), (6, 200.0, 3, "days")]


def _general_sql(name: str, source: str, keys: str, eps: str, least: str, mode: str) -> None:
    """CTEs ``<name>_placed``: rows of ``source`` (keys, node, day, lat, lon, ...) with their general cluster."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    CTES[f"{name}_near"] = f"""
  SELECT {', '.join(f'a.{k}' for k in keys.split(', '))}, a.node AS a, b.node AS b, b.day, {mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m FROM {source} a JOIN {source} b ON {same}
  WHERE abs(a.lat - b.lat) < 0.003 AND {mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= a.{eps}"""
    CTES[f"{name}_core"] = f"""
  SELECT {keys}, n.a AS node FROM {name}_near n JOIN (SELECT DISTINCT {keys}, {least} AS least, {mode} AS mode FROM {source}) USING ({keys})
  GROUP BY {keys}, n.a HAVING CASE any_value(mode) WHEN 'days' THEN count(DISTINCT n.day) ELSE count(*) END >= any_value(least)"""
    CTES[f"{name}_edges"] = f"""
  SELECT n.* FROM {name}_near n JOIN {name}_core x ON {' AND '.join(f'n.{k} = x.{k}' for k in keys.split(', '))} AND n.a = x.node
  JOIN {name}_core y ON {' AND '.join(f'n.{k} = y.{k}' for k in keys.split(', '))} AND n.b = y.node"""
    CTES[f"reach_{name}"] = f"""
  SELECT {keys}, node AS a, node AS b FROM {name}_core UNION
  SELECT {', '.join(f's.{k}' for k in keys.split(', '))}, s.a, e.b FROM reach_{name} s JOIN {name}_edges e ON {' AND '.join(f's.{k} = e.{k}' for k in keys.split(', '))} AND s.b = e.a AND s.a < e.b"""
    CTES[f"{name}_placed"] = f"""
  SELECT r.*, coalesce(c.place, z.place, r.node) AS place FROM {source} r
  LEFT JOIN (SELECT {keys}, b AS node, min(a) AS place FROM reach_{name} GROUP BY ALL) c USING ({keys}, node)
  LEFT JOIN (SELECT {', '.join(f'n.{k}' for k in keys.split(', '))}, n.a AS node, arg_min(t.place, (n.m, n.b)) AS place FROM {name}_near n
    JOIN (SELECT {keys}, b AS node, min(a) AS place FROM reach_{name} GROUP BY ALL) t ON {' AND '.join(f'n.{k} = t.{k}' for k in keys.split(', '))} AND n.b = t.node GROUP BY ALL) z USING ({keys}, node)"""


CTES["dg_rows"] = """
  SELECT user_id, chain, stay, lat, lon, CAST(arr AS DATE) AS day, 200.0::DOUBLE AS eps, 3 AS least, 'days' AS mode, row_number() OVER (PARTITION BY user_id ORDER BY arrival, lat, lon) - 1 AS node FROM stl"""
_general_sql("dg", "dg_rows", "user_id", "eps", "least", "mode")


@query("SELECT user_id, place, count(*) AS n FROM dg_placed GROUP BY ALL")
def dbscan_general(s: SparkSession, d: str) -> DataFrame:
    """Clusters of 200 m whose core stays have neighbours on three days or more; border stays join the nearest core."""
    rows = stays.localized(base.stay_table(s, d)).withColumn("day", F.to_date("arrival_local"))
    placed = places.dbscan(rows.select("user_id", "arrival", "lat", "lon", "day"), 200.0, 3, days="day", pieces=base.stay_pieces(s, d))
    return placed.groupBy("user_id", "place").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, min(place) AS label, count(*) AS n FROM placed GROUP BY user_id, place")
def connected_components(s: SparkSession, d: str) -> DataFrame:
    """Stays of a user connected by 150 m or less, by label propagation over all users at once."""
    order = Window.partitionBy("user_id").orderBy("arrival", "lat", "lon")
    rows = base.stay_table(s, d).withColumn("node", F.row_number().over(order) - 1).select("user_id", "node", "lat", "lon", F.struct("user_id", "node").alias("id"))
    pairs = places.radius_pairs(rows.select("user_id", "id", "lat", "lon"), rows.select("user_id", "id", "lat", "lon"), ["user_id"], 150.0)
    labels = graphs.components(pairs.select("a", "b"))
    found = rows.join(labels, rows["id"] == labels["node"], "left").select(rows["user_id"], F.coalesce("label", rows["id"]).alias("label"))
    return found.groupBy("user_id", F.col("label.node").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.col("label").cast("long"))


CTES["pg_rows"] = f"""
  SELECT s.user_id, s.chain, s.stay, s.arrival, s.lat, s.lon, s.duration_minutes, s.home, s.office, CAST(s.arr AS DATE) AS day, h.half, c.x.cfg AS cfg, c.x.eps AS eps, c.x.least AS least, c.x.mode AS mode,
         row_number() OVER (PARTITION BY c.x.cfg, h.half, s.user_id ORDER BY s.arrival, s.lat, s.lon) - 1 AS node
  FROM sc s, (SELECT unnest([{', '.join(f"{{'cfg': {c}, 'eps': {e}::DOUBLE, 'least': {m}, 'mode': '{k}'}}" for c, e, m, k in _CONFIGS)}]) AS x) c,
  LATERAL (SELECT 2 AS half UNION ALL SELECT CAST(date_diff('day', DATE '2000-01-01', CAST(s.arr AS DATE)) % 2 AS INT)) h"""
_general_sql("pg", "pg_rows", "cfg, half, user_id", "eps", "least", "mode")
CTES["pg_places"] = """
  SELECT cfg, half, user_id, place, sum(home) AS home, sum(office) AS office, sum(duration_minutes) AS dur, min(arrival) AS first_seen, count(*) AS n,
         sum(lat * duration_minutes) / sum(duration_minutes) AS lat, sum(lon * duration_minutes) / sum(duration_minutes) AS lon FROM pg_placed GROUP BY ALL"""
CTES["pg_top"] = f"""
  SELECT t.*, (SELECT max({mean_m('t.lat', 't.lon', 'p.lat', 'p.lon')}) FROM pg_placed p WHERE p.cfg = t.cfg AND p.half = t.half AND p.user_id = t.user_id AND p.place = t.place) AS radius FROM (
    SELECT * FROM (SELECT *, 'home' AS type, home AS minutes FROM pg_places WHERE home > 0 UNION ALL SELECT *, 'office', office FROM pg_places WHERE office > 0)
    QUALIFY row_number() OVER (PARTITION BY cfg, half, user_id, type ORDER BY {rnd('minutes', 6)} DESC, {rnd('dur', 6)} DESC, first_seen) = 1) t"""


@query(
    f"""SELECT f.cfg, f.type, found, radius_p50, radius_p90, radius_max, multi_stay, home_is_office, pairs, stable FROM (
      SELECT t.cfg, t.type, count(*) AS found, {rnd('quantile_cont(t.radius, 0.5)', 3)} AS radius_p50, {rnd('quantile_cont(t.radius, 0.9)', 3)} AS radius_p90, {rnd('max(t.radius)', 3)} AS radius_max,
        {rnd('avg(CAST(t.n > 1 AS INT))', 6)} AS multi_stay, {rnd('coalesce(avg(CAST(o.place = t.place AS INT)), 0.0)', 6)} AS home_is_office
      FROM pg_top t LEFT JOIN pg_top o ON o.cfg = t.cfg AND o.half = 2 AND o.user_id = t.user_id AND o.type <> t.type WHERE t.half = 2 GROUP BY ALL) f
      JOIN (SELECT a.cfg, a.type, count(*) AS pairs, {rnd(f"avg(CAST({mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200 AS INT))", 6)} AS stable
        FROM pg_top a JOIN pg_top b ON a.cfg = b.cfg AND a.user_id = b.user_id AND a.type = b.type WHERE a.half = 0 AND b.half = 1 GROUP BY ALL) p ON p.cfg = f.cfg AND p.type = f.type"""
)
def place_grid(s: SparkSession, d: str) -> DataFrame:
    """Settings of the clusters: answers, size of the winning place, home and office in one, agreement of halves of the days."""
    day = F.to_date("arrival_local")
    half = (F.date_diff(day, F.lit("2000-01-01").cast("date")) % 2).cast("int")
    rows = base.scores(s, d).select(*STAY, "arrival", "lat", "lon", "duration_minutes", "home", "office", day.alias("day"), F.explode(F.array(F.lit(2), half)).alias("half"))
    keys = ("cfg", "half", "user_id")
    placed = None
    for mode in ("stays", "days"):  # one pass each: settings are columns
        chosen = F.array(*[F.struct(F.lit(c).alias("cfg"), F.lit(e).alias("eps"), F.lit(m).alias("least")) for c, e, m, k in _CONFIGS if k == mode])
        part = places.dbscan(rows.withColumn("x", F.explode(chosen)).select("*", "x.*").drop("x"), "eps", "least", keys, "day" if mode == "days" else None, base.stay_pieces(s, d))
        placed = part if placed is None else placed.unionByName(part)
    weight = F.sum("duration_minutes")
    grouped = placed.groupBy(*keys, "place").agg(
        F.sum("home").alias("home"), F.sum("office").alias("office"), weight.alias("dur"), F.min("arrival").alias("first_seen"), F.count(F.lit(1)).alias("n"),
        (F.sum(F.col("lat") * F.col("duration_minutes")) / weight).alias("lat"), (F.sum(F.col("lon") * F.col("duration_minutes")) / weight).alias("lon"),
        F.collect_list(F.struct("lat", "lon")).alias("spots"),
    )
    far = F.array_max(F.transform("spots", lambda p: mean_haversine_m(F.col("lat"), F.col("lon"), p["lat"], p["lon"])))
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("minutes")) for k in ("home", "office")])
    best = Window.partitionBy(*keys, "type").orderBy(*[F.desc(geo.round_half_up(F.col(c), 6)) for c in ("minutes", "dur")], "first_seen")
    top = grouped.withColumn("radius", far).drop("spots").withColumn("k", F.explode(kinds)).select("*", "k.*").filter("minutes > 0").withColumn("rk", F.row_number().over(best)).filter("rk = 1")
    full = top.filter("half = 2")
    other = full.select("cfg", "user_id", F.when(F.col("type") == "home", "office").otherwise("home").alias("type"), F.col("place").alias("other"))
    q = F.percentile("radius", F.array(F.lit(0.5), F.lit(0.9)))
    found = full.join(other, ["cfg", "user_id", "type"], "left").groupBy("cfg", "type").agg(
        F.count(F.lit(1)).alias("found"), r("radius_p50", of=F.get(q, 0)), r("radius_p90", of=F.get(q, 1)), r("radius_max", of=F.max("radius")),
        r("multi_stay", 6, F.avg((F.col("n") > 1).cast("int"))), r("home_is_office", 6, F.coalesce(F.avg((F.col("other") == F.col("place")).cast("int")), F.lit(0.0))),
    )
    a, b = (top.filter(F.col("half") == h).select("cfg", "user_id", "type", "lat", "lon").alias(n) for h, n in ((0, "a"), (1, "b")))
    same = (mean_haversine_m("a.lat", "a.lon", "b.lat", "b.lon") <= 200).cast("int")
    stable = a.join(b, ["cfg", "user_id", "type"]).groupBy("cfg", "type").agg(F.count(F.lit(1)).alias("pairs"), r("stable", 6, F.avg(same)))
    return found.join(stable, ["cfg", "type"])


# --- cells, jobs ---


@query(
    " UNION ALL ".join(
        f"SELECT {p} AS precision, count(*) AS cells, min(n) AS least, {rnd('avg(CAST(n >= 5 AS INT))', 6)} AS ratio FROM (SELECT {geohash('lat', 'lon', p)} AS g, count(*) AS n FROM kept GROUP BY 1)"
        for p in (5, 6, 7)
    )
)
def k_anonymity(s: SparkSession, d: str) -> DataFrame:
    """Cells of three sizes: how many hold five points or more."""
    cells = F.array(*[F.struct(F.lit(p).alias("precision"), geo.geohash_encode("lat", "lon", p).alias("g")) for p in (5, 6, 7)])
    n = base.kept(s, d).select(F.explode(cells).alias("x")).groupBy("x.precision", "x.g").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("precision").agg(F.count(F.lit(1)).alias("cells"), F.min("n").alias("least"), r("ratio", 6, F.avg((F.col("n") >= 5).cast("int"))))


# Mean areas of hexagonal cells by resolution in square kilometres, as their documentation rounds them.
_HEX_KM2 = [4357500.0, 609788.0, 86554.0, 12264.0, 1773.0, 252.9, 36.13, 5.16, 0.74, 0.105, 0.015, 0.002, 0.0003]


@query(f"SELECT * FROM (VALUES {', '.join(f'({i}, {a}::DOUBLE)' for i, a in enumerate([*_HEX_KM2, 0.0, 0.0, 0.0]))}) t(resolution, km2)")
def h3_area(s: SparkSession, d: str) -> DataFrame:
    """Area of hexagonal cells by resolution; 0 where it isn't documented."""
    area = F.coalesce(F.get(F.array(*map(F.lit, _HEX_KM2)), F.col("id").cast("int")), F.lit(0.0))
    return s.range(16).select(F.col("id").cast("int").alias("resolution"), area.alias("km2"))


CTES["job_steps"] = """
  SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, event_type FROM events"""
CTES["scan_jobs"] = """
  SELECT job, 0::BIGINT AS rn, 'none' AS state, 0 AS attempts, 0 AS polls FROM (SELECT DISTINCT job FROM job_steps)
  UNION ALL
  SELECT j.job, e.rn, CASE WHEN e.event_type = 'signup' AND j.state IN ('none', 'failed') THEN 'pending' WHEN e.event_type = 'click' AND j.state = 'pending' THEN 'processing'
           WHEN e.event_type = 'purchase' AND j.state = 'processing' THEN 'completed' WHEN e.event_type = 'error' AND j.state = 'processing' THEN 'failed' ELSE j.state END,
         j.attempts + CASE WHEN e.event_type = 'click' AND j.state = 'pending' THEN 1 ELSE 0 END, j.polls + CASE WHEN e.event_type = 'view' AND j.state IN ('completed', 'failed') THEN 1 ELSE 0 END
  FROM scan_jobs j JOIN job_steps e ON e.job = j.job AND e.rn = j.rn + 1"""


@query("SELECT job, state, attempts, polls FROM scan_jobs QUALIFY row_number() OVER (PARTITION BY job ORDER BY rn DESC) = 1")
def job_states(s: SparkSession, d: str) -> DataFrame:
    """Life of a job from its events: signup queues, click starts, purchase completes, error fails, view polls."""
    steps = table(s, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("steps"))
    start = F.struct(F.lit("none").alias("state"), F.lit(0).alias("attempts"), F.lit(0).alias("polls"))

    def step(j: Column, e: Column) -> Column:
        kind, state = e["event_type"], j["state"]
        begins = (kind == "click") & (state == "pending")
        after = (
            F.when((kind == "signup") & state.isin("none", "failed"), "pending").when(begins, "processing")
            .when((kind == "purchase") & (state == "processing"), "completed").when((kind == "error") & (state == "processing"), "failed").otherwise(state)
        )
        seen = (kind == "view") & state.isin("completed", "failed")
        return F.struct(after.alias("state"), (j["attempts"] + begins.cast("int")).alias("attempts"), (j["polls"] + seen.cast("int")).alias("polls"))

    return steps.select("job", F.aggregate("steps", start, step).alias("j")).select("job", "j.*")
