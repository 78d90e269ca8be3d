"""Further named queries: scalar functions, gap, stage, zone and evidence analytics, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.functions import geo, times
from driftline.functions.geo import haversine_m, mean_haversine_m, seconds_between, speed_kmh
from driftline.operators import classify, cleaning, monitoring, places, privacy, stays
from driftline.operators.grouped import in_pieces
from driftline.plans import catalogue as base
from driftline.plans.catalogue import KEY, r, table
from driftline.plans.sqlbase import _IN, SWEEP, geohash, hav, kmh, mean_m, rnd, secs
from driftline.plans.sqlbase import query as assembled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_K = ", ".join(KEY)
_LL = f"{rnd('lat', 10)} AS lat, {rnd('lon', 10)} AS lon"


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = assembled(sql)
        return f

    return register


def _files() -> Window:
    return Window.partitionBy(*cleaning.FILE).orderBy("datetime", "ord")


def _total() -> Window:
    return Window.partitionBy(F.lit(0))


# --- scalar functions ---


@query(f"SELECT {_K}, {rnd(hav('lat', 'lon', '39.9847::DOUBLE', '116.3184::DOUBLE'), 3)} AS metres FROM kept")
def haversine_m_to_landmark(s: SparkSession, d: str) -> DataFrame:
    return base.kept(s, d).select(*KEY, r("metres", of=haversine_m("lat", "lon", F.lit(39.9847), F.lit(116.3184))))


QUERIES["haversine_m"] = QUERIES.pop("haversine_m_to_landmark")
ORACLE_SQL["haversine_m"] = ORACLE_SQL.pop("haversine_m_to_landmark")


@query(f"SELECT {_K}, {rnd(hav('lat', 'lon', '39.9847::DOUBLE', '116.3184::DOUBLE', '6371.0088::DOUBLE'), 6)} AS km FROM kept")
def haversine_km(s: SparkSession, d: str) -> DataFrame:
    km = geo.haversine("lat", "lon", F.lit(39.9847), F.lit(116.3184), geo.MEAN_RADIUS_KM)
    return base.kept(s, d).select(*KEY, r("km", 6, km))


def _mean_steps(s: SparkSession, d: str) -> DataFrame:
    rows = base.kept(s, d).withColumn("p", F.lag(F.struct("datetime", "lat", "lon")).over(_files()))
    return rows.withColumns({"m": mean_haversine_m("p.lat", "p.lon", "lat", "lon"), "dt": seconds_between("p.datetime", "datetime")})


_STEP_SQL = f"""(SELECT *, {mean_m('p.lat', 'p.lon', 'lat', 'lon')} AS m, {secs('p.datetime', 'datetime')} AS dt FROM kept_steps)"""


@query(f"SELECT {_K}, {rnd('m', 3)} AS metres FROM {_STEP_SQL}")
def step_distance(s: SparkSession, d: str) -> DataFrame:
    return _mean_steps(s, d).select(*KEY, r("metres", of=F.col("m")))


@query(f"SELECT {_K}, {rnd(kmh('m', 'dt'), 3)} AS kmh FROM {_STEP_SQL}")
def step_speed(s: SparkSession, d: str) -> DataFrame:
    return _mean_steps(s, d).select(*KEY, r("kmh", of=speed_kmh(F.col("m"), F.col("dt"))))


@query(f"SELECT {_K}, {rnd(f'coalesce({kmh("m", "dt")}, 0.0)', 3)} AS kmh FROM {_STEP_SQL}")
def calc_speed(s: SparkSession, d: str) -> DataFrame:
    return _mean_steps(s, d).select(*KEY, r("kmh", of=F.coalesce(speed_kmh(F.col("m"), F.col("dt")), F.lit(0.0))))


@query(f"SELECT user_id, {rnd('coalesce(avg(lat), 0)', 8)} AS lat, {rnd('coalesce(avg(lon), 0)', 8)} AS lon FROM kept GROUP BY 1")
def centroid(s: SparkSession, d: str) -> DataFrame:
    return base.kept(s, d).groupBy("user_id").agg(r("lat", 8, F.avg("lat")), r("lon", 8, F.avg("lon")))


@query(
    f"SELECT {_K}, {rnd('(lon - 116.3184::DOUBLE) * 111320.0::DOUBLE * cos(radians(39.9847::DOUBLE))', 3)} AS east_m, "
    f"{rnd('(lat - 39.9847::DOUBLE) * 110540.0::DOUBLE', 3)} AS north_m FROM kept"
)
def enu_offsets(s: SparkSession, d: str) -> DataFrame:
    rows = base.kept(s, d).withColumn("o", geo.enu_offsets("lat", "lon", F.lit(39.9847), F.lit(116.3184)))
    return rows.select(*KEY, r("east_m", of=F.col("o.east_m")), r("north_m", of=F.col("o.north_m")))


def _cells(s: SparkSession, d: str) -> DataFrame:
    rows = base.kept(s, d).select(geo.geohash_encode("lat", "lon", 6).alias("g")).distinct()
    return rows.withColumn("b", geo.geohash_bounds("g", 6))


_DY, _DX = 180.0 / (1 << 15), 360.0 / (1 << 15)
_CELL_SQL = f"""(SELECT DISTINCT {geohash('lat', 'lon', 6)} AS g, floor((lat + 90.0::DOUBLE) / 180.0 * 32768.0::DOUBLE) AS y,
  floor((lon + 180.0::DOUBLE) / 360.0 * 32768.0::DOUBLE) AS x FROM kept)"""


@query(f"SELECT g, {rnd(f'(y + 0.5) * {_DY!r}::DOUBLE - 90', 6)} AS lat, {rnd(f'(x + 0.5) * {_DX!r}::DOUBLE - 180', 6)} AS lon FROM {_CELL_SQL}")
def geohash_decode(s: SparkSession, d: str) -> DataFrame:
    rows = _cells(s, d)
    return rows.select("g", r("lat", 6, (F.col("b.lat_min") + F.col("b.lat_max")) / 2), r("lon", 6, (F.col("b.lon_min") + F.col("b.lon_max")) / 2))


@query(
    f"""SELECT g, string_agg(n, ',' ORDER BY n) AS around FROM (
      SELECT g, {geohash(f'((y + i + 0.5) * {_DY!r}::DOUBLE - 90)', f'((x + j + 0.5) * {_DX!r}::DOUBLE - 180)', 6)} AS n
      FROM {_CELL_SQL}, (SELECT unnest([-1, 0, 1]) AS i) a, (SELECT unnest([-1, 0, 1]) AS j) b WHERE i <> 0 OR j <> 0) GROUP BY 1"""
)
def geohash_neighbors(s: SparkSession, d: str) -> DataFrame:
    lat = (F.col("b.lat_min") + F.col("b.lat_max")) / 2
    lon = (F.col("b.lon_min") + F.col("b.lon_max")) / 2
    around = [geo.geohash_encode(lat + i * _DY, lon + j * _DX, 6) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    return _cells(s, d).select("g", F.array_join(F.array_sort(F.array(*around)), ",").alias("around"))


@query("SELECT event_id, try_strptime(CASE WHEN event_id % 3 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END, '%Y-%m-%d %H:%M:%S') AS parsed FROM events")
def parse_ts(s: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(s, d, "events").select("event_id", F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("parsed"))


@query("SELECT event_id, timezone('America/Los_Angeles', timezone('UTC', ts)) AS there FROM events")
def to_local(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", times.to_local(F.col("ts"), F.lit("America/Los_Angeles")).alias("there"))


@query("SELECT event_id, ts + INTERVAL 8 HOUR AS there FROM events")
def gmt_to_beijing(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", times.plus_seconds(F.col("ts"), F.lit(8 * 3600)).alias("there"))


@query(f"SELECT user_id, {rnd(secs('min(ts)', 'max(ts)') + ' / 3600', 6)} AS hours FROM events GROUP BY 1")
def hours_between(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("user_id").agg(r("hours", 6, seconds_between(F.min("ts"), F.max("ts")) / 3600))


@query("SELECT o_orderkey, TIMESTAMP '1899-12-30' + to_days(CAST(o_orderkey % 50000 AS INT)) AS day FROM orders")
def excel_date(s: SparkSession, d: str) -> DataFrame:
    start = F.lit("1899-12-30").cast("timestamp_ntz")
    return table(s, d, "orders").select("o_orderkey", times.plus_seconds(start, (F.col("o_orderkey") % 50000) * 86400).alias("day"))


@query("SELECT user_id || '|' || strftime(arrival, '%Y-%m-%dT%H:%M:%S') || '|' || strftime(departure, '%Y-%m-%dT%H:%M:%S') AS k FROM st")
def stay_key(s: SparkSession, d: str) -> DataFrame:
    t = "yyyy-MM-dd'T'HH:mm:ss"
    return base.stay_table(s, d).select(F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("arrival", t), F.date_format("departure", t)).alias("k"))


# --- privacy and monitoring ---


@query(f"SELECT {_K}, {geohash('lat', 'lon', 5)} AS geohash, 5 AS precision, 1 AS cluster_size FROM kept")
def anonymize_location(s: SparkSession, d: str) -> DataFrame:
    return base.kept(s, d).select(*KEY, geo.geohash_encode("lat", "lon", 5).alias("geohash"), F.lit(5).alias("precision"), F.lit(1).alias("cluster_size"))


@query(f"SELECT {geohash('lat', 'lon', 6)} AS geohash, count(*) AS cluster_size, min(ord) AS first_ord, 6 AS precision FROM kept GROUP BY 1")
def anonymize_batch(s: SparkSession, d: str) -> DataFrame:
    return privacy.anonymize(base.kept(s, d))


@query(f"SELECT coalesce(min(n), 0) >= 5 AS ok, coalesce(min(n), 0) AS least FROM (SELECT {geohash('lat', 'lon', 6)} AS g, count(*) AS n FROM kept GROUP BY 1)")
def k_anonymity_check(s: SparkSession, d: str) -> DataFrame:
    return privacy.k_anonymity(base.kept(s, d), 5).select((F.col("least") >= 5).alias("ok"), "least")


# --- aggregates, windows ---


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg_count(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def agg_distinct(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"))


@query(
    "SELECT o_orderpriority, "
    + ", ".join(f"{rnd(f'''coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = '{x}'), 0.0)''', 2)} AS {x.lower()}" for x in "FOP")
    + " FROM orders GROUP BY 1"
)
def pivot_sum(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).sum("o_totalprice")
    return rows.select("o_orderpriority", *[r(x.lower(), 2, F.coalesce(F.col(x), F.lit(0.0))) for x in "FOP"])


@query(f"SELECT {_K}, {rnd('avg(lat) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', 11)} AS lat FROM kept WINDOW w AS ({_IN})")
def running_centroid(s: SparkSession, d: str) -> DataFrame:
    w = _files().rowsBetween(Window.unboundedPreceding, -1)
    return base.kept(s, d).select(*KEY, r("lat", 11, F.avg("lat").over(w)))


@query(
    f"""SELECT user_id, source_file, c AS chain, count(*) AS n FROM (
      SELECT *, CAST(sum(CAST(coalesce(step_s > 64800, FALSE) AS BIGINT)) OVER ({_IN} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c FROM steps) GROUP BY ALL"""
)
def file_chains(s: SparkSession, d: str) -> DataFrame:
    rows = stays.gap_chains(base.clean(s, d), keys=("user_id", "source_file"))
    return rows.groupBy("user_id", "source_file", "chain").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT {_K}, {rnd(hav('b5lat', 'b5lon', 'lat', 'lon'), 3)} AS back_m, {rnd(hav('lat', 'lon', 'f5lat', 'f5lon'), 3)} AS on_m FROM (
      SELECT *, lag(lat, 5) OVER w AS b5lat, lag(lon, 5) OVER w AS b5lon, lead(lat, 5) OVER w AS f5lat, lead(lon, 5) OVER w AS f5lon FROM kept
      WINDOW w AS ({_IN})) WHERE b5lat IS NOT NULL AND f5lat IS NOT NULL"""
)
def speed_triples(s: SparkSession, d: str) -> DataFrame:
    spot = F.struct("lat", "lon")
    rows = base.kept(s, d).withColumns({"b": F.lag(spot, 5).over(_files()), "f": F.lead(spot, 5).over(_files())})
    rows = rows.filter("b IS NOT NULL AND f IS NOT NULL")
    return rows.select(*KEY, r("back_m", of=haversine_m("b.lat", "b.lon", "lat", "lon")), r("on_m", of=haversine_m("lat", "lon", "f.lat", "f.lon")))


@query(
    f"""SELECT event_type, count(*) AS n, {rnd('avg(g)', 3)} AS mean, {rnd('stddev_samp(g)', 3)} AS sd, {rnd('min(g)', 3)} AS low, {rnd('quantile_cont(g, 0.5)', 3)} AS p50,
      {rnd('quantile_cont(g, 0.99)', 3)} AS p99, {rnd('max(g)', 3)} AS high FROM (
      SELECT event_type, {secs('lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)', 'ts')} AS g FROM events) WHERE g IS NOT NULL GROUP BY 1"""
)
def gap_stats(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(s, d, "events").withColumn("g", seconds_between(F.lag("ts").over(w), F.col("ts"))).filter("g IS NOT NULL")
    q = F.percentile("g", F.array(F.lit(0.5), F.lit(0.99)))
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), r("mean", of=F.avg("g")), r("sd", of=F.stddev_samp("g")), r("low", of=F.min("g")),
        r("p50", of=F.get(q, 0)), r("p99", of=F.get(q, 1)), r("high", of=F.max("g")),
    )


@query(
    f"""SELECT {rnd('0.5 * sum(abs(p - q))', 6)} AS tvd FROM (
      SELECT h, count(*) FILTER (WHERE event_type = 'view') / CAST(sum(count(*) FILTER (WHERE event_type = 'view')) OVER () AS DOUBLE) AS p,
             count(*) FILTER (WHERE event_type = 'click') / CAST(sum(count(*) FILTER (WHERE event_type = 'click')) OVER () AS DOUBLE) AS q
      FROM (SELECT *, hour(ts) AS h FROM events) GROUP BY h)"""
)
def tvd_hours(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").groupBy(F.hour("ts").alias("h")).agg(
        *[F.count_if(F.col("event_type") == k).alias(k) for k in ("view", "click")]
    )
    share = [F.col(k) / F.sum(k).over(_total()) for k in ("view", "click")]
    return rows.select(F.abs(share[0] - share[1]).alias("gap")).agg(r("tvd", 6, 0.5 * F.sum("gap")))


@query(f"SELECT user_id, chain, stay, {rnd('duration_minutes / sum(duration_minutes) OVER (PARTITION BY user_id)', 8)} AS share FROM st")
def win_share(s: SparkSession, d: str) -> DataFrame:
    share = F.col("duration_minutes") / F.sum("duration_minutes").over(Window.partitionBy("user_id"))
    return base.stay_table(s, d).select("user_id", "chain", "stay", r("share", 8, share))


# --- modes, gaps, stages ---


@query(
    f"""SELECT l.mode, {rnd('avg(CAST(k.step_kmh > 180 AS INT))', 6)} AS share
      FROM kept_steps k JOIN lab l ON k.user_id = l.user_id AND k.datetime BETWEEN l.start AND l."end" WHERE k.step_kmh IS NOT NULL GROUP BY 1"""
)
def share_over_limit(s: SparkSession, d: str) -> DataFrame:
    hit = base._in_interval(cleaning.with_steps(base.kept(s, d)).filter("step_kmh IS NOT NULL"), base.labels(s, d))
    return hit.groupBy("mode").agg(r("share", 6, F.avg((F.col("step_kmh") > 180).cast("int"))))


@query(
    f"""SELECT limit_s, count(*) FILTER (WHERE g > limit_s) AS far, count(*) FILTER (WHERE (a IS NULL) <> (b IS NULL)) AS one_sided, count(*) FILTER (WHERE a IS NULL AND b IS NULL) AS alone
      FROM (SELECT *, least(a, b) AS g FROM (SELECT {secs('prev.datetime', 'datetime')} AS a, {secs('datetime', 'next.datetime')} AS b FROM cand)),
           (SELECT CAST(x AS DOUBLE) AS limit_s FROM (VALUES (60), (300), (1200)) t(x)) GROUP BY 1"""
)
def far_anchor_impact(s: SparkSession, d: str) -> DataFrame:
    rows = cleaning.dup_candidates(base.gated(s, d)).filter("is_candidate")
    rows = rows.select(seconds_between("prev.datetime", "datetime").alias("a"), seconds_between("datetime", "next.datetime").alias("b"))
    rows = rows.withColumn("g", F.least("a", "b")).withColumn("limit_s", F.explode(F.array(*[F.lit(float(x)) for x in (60, 300, 1200)])))
    return rows.groupBy("limit_s").agg(
        F.count_if(F.col("g") > F.col("limit_s")).alias("far"),
        F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("one_sided"),
        F.count_if(F.col("a").isNull() & F.col("b").isNull()).alias("alone"),
    )


@query(f"SELECT {_K}, prev.datetime AS before, next.datetime AS after FROM cand")
def asof_anchors(s: SparkSession, d: str) -> DataFrame:
    rows = cleaning.dup_candidates(base.gated(s, d)).filter("is_candidate")
    return rows.select(*KEY, F.col("prev.datetime").alias("before"), F.col("next.datetime").alias("after"))


@query(
    """SELECT count(*) AS n_groups, count(*) FILTER (WHERE by_score <> by_sum) AS differ FROM (
      SELECT arg_min(ord, (score, bad_altitude, ord)) AS by_score, arg_min(ord, (coalesce(v_in, 0) + coalesce(v_out, 0), bad_altitude, ord)) AS by_sum
      FROM cand WHERE valid GROUP BY user_id, source_file, datetime)"""
)
def pick_disagreement(s: SparkSession, d: str) -> DataFrame:
    rows = cleaning.dup_candidates(base.gated(s, d)).filter("is_candidate AND valid")
    total = F.coalesce("v_in", F.lit(0.0)) + F.coalesce("v_out", F.lit(0.0))
    picks = rows.groupBy(*cleaning.FILE, "datetime").agg(
        F.min_by("ord", F.struct("score", "bad_altitude", "ord")).alias("by_score"), F.min_by("ord", F.struct(total, "bad_altitude", "ord")).alias("by_sum")
    )
    return picks.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("by_score") != F.col("by_sum")).alias("differ"))


_GAP_SQL = f"""(SELECT *, {secs('p.datetime', 'datetime')} AS g, {hav('p.lat', 'p.lon', 'lat', 'lon')} AS m, p.f <> source_file AS crosses FROM (
  SELECT *, lag({{'datetime': datetime, 'lat': lat, 'lon': lon, 'f': source_file}}) OVER (PARTITION BY user_id ORDER BY datetime, ord) AS p FROM clean) WHERE p IS NOT NULL)"""


def _user_gaps(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("datetime", "ord")
    rows = base.clean(s, d).withColumn("p", F.lag(F.struct("datetime", "lat", "lon", "source_file")).over(w)).filter("p IS NOT NULL")
    return rows.withColumns(
        {"g": seconds_between("p.datetime", "datetime"), "m": haversine_m("p.lat", "p.lon", "lat", "lon"), "crosses": F.col("p.source_file") != F.col("source_file")}
    )


@query(f"SELECT {_K}, {rnd('g', 3)} AS gap_s, {rnd('m', 3)} AS metres, crosses FROM {_GAP_SQL}")
def user_gaps(s: SparkSession, d: str) -> DataFrame:
    return _user_gaps(s, d).select(*KEY, r("gap_s", of=F.col("g")), r("metres", of=F.col("m")), "crosses")


@query(
    f"""SELECT t AS minutes, {rnd("coalesce(avg(CAST(g > t * 60 AS INT)) FILTER (WHERE NOT crosses), 0.0)", 6)} AS within_over,
      {rnd("coalesce(avg(CAST(g <= t * 60 AS INT)) FILTER (WHERE crosses), 0.0)", 6)} AS cross_under
      FROM {_GAP_SQL}, (SELECT unnest([5, 10, 15, 20, 30, 60, 120, 360]) AS t) GROUP BY 1"""
)
def gap_candidates(s: SparkSession, d: str) -> DataFrame:
    rows = _user_gaps(s, d).select("g", "crosses", F.explode(F.array(*map(F.lit, (5, 10, 15, 20, 30, 60, 120, 360)))).alias("minutes"))
    over = (F.col("g") > F.col("minutes") * 60).cast("int")
    inside, across = F.avg(F.when(~F.col("crosses"), over)), F.avg(F.when(F.col("crosses"), 1 - over))
    zero = F.lit(0.0)
    return rows.groupBy("minutes").agg(r("within_over", 6, F.coalesce(inside, zero)), r("cross_under", 6, F.coalesce(across, zero)))


@query(
    f"""SELECT CASE WHEN g <= 3600 THEN 0 WHEN g <= 21600 THEN 1 WHEN g <= 64800 THEN 2 ELSE 3 END AS band, count(*) AS n, count(DISTINCT user_id) AS users,
      {rnd('quantile_cont(m, 0.5)', 3)} AS median_m, {rnd('quantile_cont(m, 0.9)', 3)} AS p90_m FROM {_GAP_SQL} WHERE g > 1200 GROUP BY 1"""
)
def jump_across_gap(s: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("g") <= 3600, 0).when(F.col("g") <= 21600, 1).when(F.col("g") <= 64800, 2).otherwise(3)
    q = F.percentile("m", F.array(F.lit(0.5), F.lit(0.9)))
    rows = _user_gaps(s, d).filter("g > 1200").groupBy(band.alias("band"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), r("median_m", of=F.get(q, 0)), r("p90_m", of=F.get(q, 1)))


@query("""SELECT (SELECT count(*) FROM (SELECT user_id, arrival, departure FROM st INTERSECT SELECT user_id, arrival, departure FROM st_anchor)) AS unchanged,
      (SELECT count(*) FROM (SELECT user_id, arrival, departure FROM st EXCEPT SELECT user_id, arrival, departure FROM st_anchor)) AS removed,
      (SELECT count(*) FROM (SELECT user_id, arrival, departure FROM st_anchor EXCEPT SELECT user_id, arrival, departure FROM st)) AS added""")
def stage_changes(s: SparkSession, d: str) -> DataFrame:
    k = ["user_id", "arrival", "departure"]
    a = base.stay_table(s, d).select(*k).withColumn("a", F.lit(True))
    b = stays.stay_points(base.clean(s, d), anchor=True, pieces=base.pieces(s, d)).select(*k).withColumn("b", F.lit(True))
    both = a.join(b, k, "full")
    return both.agg(
        F.count_if(F.col("a") & F.col("b")).alias("unchanged"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a").isNull()).alias("added")
    )


# --- zones, nights, places ---


@query("SELECT tz_name, date_diff('hour', datetime, timestamp_local) AS hours, count(*) AS n, count(DISTINCT user_id) AS users FROM clean GROUP BY ALL")
def tz_points(s: SparkSession, d: str) -> DataFrame:
    hours = F.round(seconds_between("datetime", "timestamp_local") / 3600).cast("long")
    return base.clean(s, d).groupBy("tz_name", hours.alias("hours")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT user_id, arg_max(tz_name, (n, tz_name)) AS main_tz, count(*) AS zones FROM (SELECT user_id, tz_name, count(*) AS n FROM clean GROUP BY ALL) GROUP BY 1")
def tz_users(s: SparkSession, d: str) -> DataFrame:
    n = base.clean(s, d).groupBy("user_id", "tz_name").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(F.max_by("tz_name", F.struct("n", "tz_name")).alias("main_tz"), F.count(F.lit(1)).alias("zones"))


@query("SELECT count(*) AS files, count(*) FILTER (WHERE z > 1) AS spanning FROM (SELECT count(DISTINCT tz_name) AS z FROM clean GROUP BY user_id, source_file)")
def tz_files(s: SparkSession, d: str) -> DataFrame:
    z = base.clean(s, d).groupBy(*cleaning.FILE).agg(F.count_distinct("tz_name").alias("z"))
    return z.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("z") > 1).alias("spanning"))


@query("""SELECT count(*) FILTER (WHERE hour(arr) >= 22 OR hour(arr) < 6) AS local_night, count(*) FILTER (WHERE hour(arrival) >= 22 OR hour(arrival) < 6) AS gmt_night,
      count(*) AS stays FROM stl""")
def night_impact(s: SparkSession, d: str) -> DataFrame:
    night = [F.count_if(times.in_hours(F.hour(c), 22, 6)).alias(n) for c, n in (("arrival_local", "local_night"), ("arrival", "gmt_night"))]
    return stays.localized(base.stay_table(s, d)).agg(*night, F.count(F.lit(1)).alias("stays"))


@query(f"SELECT user_id, chain, stay, slot, {rnd('(epoch_us(least(dep, slot + INTERVAL 1 HOUR)) - epoch_us(greatest(arr, slot))) / 60e6::DOUBLE', 3)} AS minutes "
       "FROM (SELECT *, unnest(generate_series(date_trunc('hour', arr), dep, INTERVAL 1 HOUR)) AS slot FROM stl)")  # fmt: skip
def hourly_slots(s: SparkSession, d: str) -> DataFrame:
    rows = stays.localized(base.stay_table(s, d))
    first = F.to_timestamp_ntz(F.date_format("arrival_local", "yyyy-MM-dd HH:00:00"))
    n = F.floor(seconds_between(first, F.col("departure_local")) / 3600).cast("int")
    rows = rows.withColumn("first", first).withColumn("i", F.explode(F.sequence(F.lit(0), n)))
    rows = rows.withColumn("slot", times.plus_seconds(F.col("first"), F.col("i") * 3600))
    end = F.least(F.col("departure_local"), times.plus_seconds(F.col("slot"), F.lit(3600)))
    return rows.select("user_id", "chain", "stay", "slot", r("minutes", of=seconds_between(F.greatest("arrival_local", "slot"), end) / 60))


@query(f"SELECT user_id, type, arrival, {rnd('minutes', 3)} AS minutes FROM win1")
def v1_winner(s: SparkSession, d: str) -> DataFrame:
    return classify.winners_v1(base.scores(s, d)).select("user_id", "type", "arrival", r("minutes"))


@query("SELECT type, status, reason, count(*) AS n FROM win1 GROUP BY ALL")
def v1_status(s: SparkSession, d: str) -> DataFrame:
    return classify.winners_v1(base.scores(s, d)).groupBy("type", "status", "reason").agg(F.count(F.lit(1)).alias("n"))


def _places(s: SparkSession, d: str) -> DataFrame:
    return classify.place_scores(base.scores(s, d), pieces=base.stay_pieces(s, d))


@query("SELECT type, status, reason, count(*) AS n FROM win2 GROUP BY ALL")
def v2_status(s: SparkSession, d: str) -> DataFrame:
    return classify.winners_v2(_places(s, d)).groupBy("type", "status", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT user_id, place, {rnd('home', 3)} AS home, {rnd('office', 3)} AS office, home_days, office_days FROM pl")
def place_scores(s: SparkSession, d: str) -> DataFrame:
    return _places(s, d).select("user_id", "place", r("home"), r("office"), "home_days", "office_days")


@query(f"SELECT user_id, place, {_LL}, visit_count, {rnd('duration_minutes', 3)} AS duration_minutes, first_seen FROM pl")
def place_locations(s: SparkSession, d: str) -> DataFrame:
    return _places(s, d).select("user_id", "place", r("lat", 10), r("lon", 10), "visit_count", r("duration_minutes"), "first_seen")


@query(f"""SELECT a.user_id, a.chain || '-' || a.stay AS id, {rnd('sum(b.duration_minutes)', 3)} AS minutes FROM st a JOIN st b ON a.user_id = b.user_id
      WHERE {mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200 GROUP BY ALL""")
def area_score(s: SparkSession, d: str) -> DataFrame:
    rows = base.stay_table(s, d).withColumn("id", F.concat_ws("-", "chain", "stay"))
    pairs = places.radius_pairs(rows, rows, ["user_id"], 200.0)
    other = rows.select("user_id", F.col("id").alias("b"), "duration_minutes")
    return pairs.join(other, ["user_id", "b"]).groupBy("user_id", F.col("a").alias("id")).agg(r("minutes", of=F.sum("duration_minutes")))


@query("SELECT user_id, place, rank() OVER (PARTITION BY user_id ORDER BY round(home, 3) DESC) AS rank FROM pl WHERE home > 0")
def place_rank(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc(F.round("home", 3)))
    return _places(s, d).filter("home > 0").select("user_id", "place", F.rank().over(w).alias("rank"))


@query("SELECT gate, type, count(*) FILTER (WHERE minutes >= gate) AS answered FROM win1, (SELECT unnest([60, 120, 240, 480]) AS gate) GROUP BY ALL")
def unknown_gates(s: SparkSession, d: str) -> DataFrame:
    rows = classify.winners_v1(base.scores(s, d)).select("type", "minutes", F.explode(F.array(*map(F.lit, (60, 120, 240, 480)))).alias("gate"))
    return rows.groupBy("gate", "type").agg(F.count_if(F.col("minutes") >= F.col("gate")).alias("answered"))


@query("""SELECT departure > arrival AND observed_minutes <= duration_minutes + 1e-6 AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS valid, count(*) AS n
      FROM st GROUP BY 1""")
def validate_stays(s: SparkSession, d: str) -> DataFrame:
    ok = (F.col("departure") > F.col("arrival")) & (F.col("observed_minutes") <= F.col("duration_minutes") + 1e-6)
    ok = ok & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    return base.stay_table(s, d).groupBy(ok.alias("valid")).agg(F.count(F.lit(1)).alias("n"))


# --- variants of the scan, halves, matches ---


@query("SELECT user_id, count(*) AS stays FROM scan_file WHERE from_rn IS NOT NULL GROUP BY 1")
def stay_per_file(s: SparkSession, d: str) -> DataFrame:
    number = F.dense_rank().over(Window.partitionBy("user_id").orderBy("source_file")) - 1
    found = stays.stays_of(stays.stay_members(base.clean(s, d).withColumn("chain", number.cast("long"))))
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("stays"))


@query(
    f"""SELECT user_id, chain, stay, {rnd('quantile_cont(m, 0.5)', 3)} AS p50, {rnd('quantile_cont(m, 0.9)', 3)} AS p90 FROM (
      SELECT a.user_id, a.chain, a.stay, {mean_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m FROM members a
      JOIN (SELECT user_id, chain, stay, quantile_cont(lat, 0.5) AS lat, quantile_cont(lon, 0.5) AS lon FROM members GROUP BY ALL) b USING (user_id, chain, stay))
      GROUP BY ALL"""
)
def stationary_footprint(s: SparkSession, d: str) -> DataFrame:
    key = ["user_id", "chain", "stay"]
    rows = base.members(s, d)
    centre = rows.groupBy(*key).agg(F.percentile("lat", F.lit(0.5)).alias("clat"), F.percentile("lon", F.lit(0.5)).alias("clon"))
    q = F.percentile("m", F.array(F.lit(0.5), F.lit(0.9)))
    gaps = rows.join(centre, key).withColumn("m", mean_haversine_m("lat", "lon", "clat", "clon"))
    return gaps.groupBy(*key).agg(r("p50", of=F.get(q, 0)), r("p90", of=F.get(q, 1)))


@query("SELECT user_id, round_minutes, count(*) AS stays FROM (SELECT user_id, CAST(floor(duration_minutes / 60) AS BIGINT) AS round_minutes FROM st) GROUP BY ALL")
def duration_histogram(s: SparkSession, d: str) -> DataFrame:
    hours = F.floor(F.col("duration_minutes") / 60).cast("long")
    rows = in_pieces(base.stay_table(s, d).select("user_id", hours.alias("round_minutes")), base.stay_pieces(s, d), "user_id")
    return rows.groupBy("user_id", "round_minutes").agg(F.count(F.lit(1)).alias("stays"))
