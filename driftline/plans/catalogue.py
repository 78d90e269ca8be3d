"""All named queries on the driver's tables; their DuckDB counterparts are in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.functions import geo, times
from driftline.functions.geo import haversine_m, mean_haversine_m, round_half_up, seconds_between
from driftline.operators import classify, cleaning, places, stays
from driftline.operators.grouped import in_pieces
from driftline.plans.oracle import ORACLE_SQL as ORACLE_SQL
from driftline.sources import traces

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FLAGSHIP = "classify_v1"
KEY = ["user_id", "source_file", "ord"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows that come in fewer pieces than there are cores, dealt to all of them: what follows makes many of each."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows._jdf.rdd().getNumPartitions() >= cores else rows.repartition(cores)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of all events, dealt to tasks before each becomes nine: a task that deals points to recordings holds all it has made."""
    events, n = table(spark, sf_dir, "events"), stay_pieces(spark, sf_dir)
    return traces.points_of_events(in_pieces(events, n, "event_id") if n else spread(events))


#: Events of one task in steps that hold rows of all their points; each makes nine points or more.
PIECE = 10_000
#: The same for steps that hold a row or so of each: events, labels, stays.
STAY_PIECE = 5 * PIECE


def pieces(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions for rows of points, so that a task's share doesn't grow with the table; None leaves a small table's to the engine.

    The engine puts partitions together by their bytes in shuffle files, where points
    take a fiftieth of their memory.  Rows are counted from the files' footers.
    """
    n = table(spark, sf_dir, "events").count()
    return max(spark.sparkContext.defaultParallelism, -(-n // PIECE)) if n > PIECE else None


def stay_pieces(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions for rows of events, labels or stays, as :func:`pieces`."""
    n = table(spark, sf_dir, "events").count()
    return max(spark.sparkContext.defaultParallelism, -(-n // STAY_PIECE)) if n > STAY_PIECE else None


def by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, those of a recording in one partition: the windows of cleaning stay there."""
    n, rows = pieces(spark, sf_dir), points(spark, sf_dir)
    return rows.repartition(n, *cleaning.FILE) if n else rows


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.min_points_gate(cleaning.physical_bounds(by_file(spark, sf_dir)))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.resolve_duplicates(gated(spark, sf_dir))[0]


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(by_file(spark, sf_dir))[0]


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stays.gap_chains(clean(spark, sf_dir), pieces=pieces(spark, sf_dir))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stays.stay_members(chained(spark, sf_dir), pieces=pieces(spark, sf_dir))


def stay_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stays.stay_points(clean(spark, sf_dir), pieces=pieces(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.scored(stay_table(spark, sf_dir), pieces=stay_pieces(spark, sf_dir))


def r(name: str, digits: int = 3, of: Column | None = None) -> Column:
    return round_half_up(F.col(name) if of is None else of, digits).alias(name)


# --- filters and cleaning ---


@query
def physical_bounds(s: SparkSession, d: str) -> DataFrame:
    return cleaning.physical_bounds(points(s, d)).select(*KEY, r("lat", 6), r("lon", 6))


@query
def min_points_gate(s: SparkSession, d: str) -> DataFrame:
    return gated(s, d).groupBy("user_id", "source_file").agg(F.count(F.lit(1)).alias("n"))


@query
def dedup_exact(s: SparkSession, d: str) -> DataFrame:
    return cleaning.dedup_exact(gated(s, d)).select(*KEY)


@query
def dup_candidates(s: SparkSession, d: str) -> DataFrame:
    rows = cleaning.dup_candidates(gated(s, d)).filter("is_candidate")
    return rows.select(*KEY, r("v_in"), r("v_out"), "valid", r("score"), "invalid_anchors")


@query
def dup_decisions(s: SparkSession, d: str) -> DataFrame:
    rows = cleaning.decide(cleaning.dup_candidates(gated(s, d)).filter("is_candidate"))
    return rows.select("user_id", "source_file", "datetime", "n_candidates", "n_valid", r("valid_spread_m"), "decision")


@query
def dup_valid_spread(s: SparkSession, d: str) -> DataFrame:
    rows = cleaning.dup_candidates(gated(s, d)).filter("is_candidate AND valid")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, [*cleaning.FILE, "datetime"]).filter("a.ord < b.ord")
    spread = F.max(haversine_m("a.lat", "a.lon", "b.lat", "b.lon")).alias("valid_spread_m")
    return pairs.groupBy(*cleaning.FILE, "datetime").agg(spread).select(*cleaning.FILE, "datetime", r("valid_spread_m"))


@query
def dup_survivors(s: SparkSession, d: str) -> DataFrame:
    rows = cleaning.with_decisions(cleaning.dup_candidates(gated(s, d)))
    return rows.filter("survivor").select(*KEY, "decision")


@query
def dup_quarantine(s: SparkSession, d: str) -> DataFrame:
    return cleaning.resolve_duplicates(gated(s, d))[1].select(*KEY, "reason")


@query
def resolve_duplicates(s: SparkSession, d: str) -> DataFrame:
    return kept(s, d).select(*KEY, r("lat", 6), r("lon", 6))


@query
def speed_spikes(s: SparkSession, d: str) -> DataFrame:
    return cleaning.speed_spikes(kept(s, d)).filter("is_spike").select(*KEY)


@query
def altitude_clean(s: SparkSession, d: str) -> DataFrame:
    return clean(s, d).select(*KEY, r("altitude_m"))


@query
def segment_trajectories(s: SparkSession, d: str) -> DataFrame:
    return clean(s, d).groupBy("sub_trip_id").agg(F.count(F.lit(1)).alias("n"), F.min("datetime").alias("first_seen"))


@query
def localize(s: SparkSession, d: str) -> DataFrame:
    return clean(s, d).select(*KEY, "tz_name", "timestamp_local")


@query
def clean_trajectory(s: SparkSession, d: str) -> DataFrame:
    return clean(s, d).select(*KEY, "datetime", r("lat", 6), r("lon", 6), r("altitude_m"), "sub_trip_id", "tz_name")


@query
def quarantine(s: SparkSession, d: str) -> DataFrame:
    return cleaning.clean(by_file(s, d))[1].select(*KEY, "reason")


@query
def pipeline_summary(s: SparkSession, d: str) -> DataFrame:
    good, bad = cleaning.clean(by_file(s, d))
    kept_n = good.agg(F.lit("clean").alias("part"), F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    return kept_n.unionByName(
        bad.groupBy(F.col("reason").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    )


@query
def point_speed(s: SparkSession, d: str) -> DataFrame:
    return cleaning.with_steps(kept(s, d)).select(*KEY, r("step_s"), r("step_m"), r("step_kmh"))


@query
def distance_filter(s: SparkSession, d: str) -> DataFrame:
    return cleaning.distance_filter(kept(s, d)).select(*KEY)


@query
def speed_filter(s: SparkSession, d: str) -> DataFrame:
    return cleaning.speed_filter(kept(s, d)).select(*KEY)


@query
def gps_clean_chain(s: SparkSession, d: str) -> DataFrame:
    return cleaning.simple_clean(points(s, d)).select(*KEY)


@query
def split_by_gaps(s: SparkSession, d: str) -> DataFrame:
    rows = cleaning.split_by_gaps(cleaning.dedup_exact(points(s, d)))
    return rows.groupBy("user_id", "source_file", "part").agg(F.count(F.lit(1)).alias("n"))


@query
def suspect_points(s: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy(*cleaning.FILE).orderBy("datetime", "ord")
    rows = cleaning.with_steps(kept(s, d)).withColumn("next_kmh", F.lead("step_kmh").over(order))
    return rows.filter("step_kmh > 1100 OR next_kmh > 1100").select(*KEY)


@query
def dup_cases(s: SparkSession, d: str) -> DataFrame:
    spot = F.struct(round_half_up(F.col("lat"), 6), round_half_up(F.col("lon"), 6))
    groups = gated(s, d).groupBy("user_id", "source_file", "datetime").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(spot).alias("spots")
    )
    case = F.when(F.col("spots") == 1, 1).when(F.col("spots") == F.col("n"), 2).otherwise(3)
    return groups.filter("n > 1").groupBy(case.alias("case")).agg(F.count(F.lit(1)).alias("n_groups"))


@query
def dup_sensitivity(s: SparkSession, d: str) -> DataFrame:
    rows = cleaning.decide(cleaning.dup_candidates(gated(s, d)).filter("is_candidate")).filter("n_valid > 1")
    return (
        rows.select("valid_spread_m").withColumn("limit_m", F.explode(F.array(*[F.lit(float(x)) for x in (10, 50, 100, 200, 300, 500, 1000, 2000)])))
        .groupBy("limit_m")
        .agg(F.count_if(F.col("valid_spread_m") > F.col("limit_m")).alias("ambiguous"), F.count_if(F.col("valid_spread_m") <= F.col("limit_m")).alias("tie_break"))
    )


@query
def dup_scope(s: SparkSession, d: str) -> DataFrame:
    groups = points(s, d).groupBy("user_id", "datetime").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_file").alias("files"))
    return groups.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("files") > 1).alias("across_files"))


@query
def decision_branches(s: SparkSession, d: str) -> DataFrame:
    rows = cleaning.decide(cleaning.dup_candidates(gated(s, d)).filter("is_candidate"))
    share = F.count(F.lit(1)) / F.sum(F.count(F.lit(1))).over(Window.partitionBy(F.lit(0)))
    return rows.groupBy("decision").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.percentile("n_candidates", F.lit(0.5)).alias("median_candidates"),
        r("median_spread", of=F.percentile("valid_spread_m", F.lit(0.5))),
        r("max_spread", of=F.max("valid_spread_m")),
        r("share", 6, share),
    )


# --- stays ---


@query
def gap_chains(s: SparkSession, d: str) -> DataFrame:
    return chained(s, d).groupBy("user_id", "chain").agg(F.count(F.lit(1)).alias("n"), F.min("datetime").alias("first_seen"))


def _stay_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "user_id", "chain", "stay", "arrival", "departure", r("lat", 10), r("lon", 10), "num_points", r("altitude_m"), r("observed_minutes"), r("duration_minutes")
    )


@query
def stay_points_centroid(s: SparkSession, d: str) -> DataFrame:
    return _stay_rows(stay_table(s, d))


@query
def stay_points_anchor(s: SparkSession, d: str) -> DataFrame:
    return _stay_rows(stays.stay_points(clean(s, d), anchor=True, pieces=pieces(s, d)))


@query
def observed_minutes(s: SparkSession, d: str) -> DataFrame:
    return stay_table(s, d).groupBy("user_id").agg(
        r("observed", of=F.sum("observed_minutes")), r("duration", of=F.sum("duration_minutes"))
    )


@query
def stay_points_local(s: SparkSession, d: str) -> DataFrame:
    return stays.localized(stay_table(s, d)).select("user_id", "chain", "stay", "tz_name", "arrival_local", "departure_local")


@query
def overnight_flag(s: SparkSession, d: str) -> DataFrame:
    rows = stays.overnight(stays.localized(stay_table(s, d)))
    return rows.groupBy("user_id").agg(F.count_if("overnight").alias("nights"), F.count(F.lit(1)).alias("stays"))


@query
def gaps_in_stays(s: SparkSession, d: str) -> DataFrame:
    rows = stays.gaps_in_stays(members(s, d))
    return rows.select("user_id", "chain", "stay", "gap_start", "gap_end", r("gap_s"), r("jump_m"))


@query
def session_18h(s: SparkSession, d: str) -> DataFrame:
    w = F.session_window("datetime", "18 hours")
    rows = clean(s, d).groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n"), F.min("datetime").alias("first_seen"))
    return rows.select("user_id", "first_seen", "n")


# --- classification ---


@query
def window_overlap_days(s: SparkSession, d: str) -> DataFrame:
    rows = classify.daily_overlaps(stays.localized(stay_table(s, d)))
    return rows.filter("home_min > 0 OR office_min > 0").select("user_id", "chain", "stay", "day", r("home_min"), r("office_min"))


@query
def window_minutes(s: SparkSession, d: str) -> DataFrame:
    return scores(s, d).select("user_id", "chain", "stay", r("home"), r("office"))


@query
def window_days(s: SparkSession, d: str) -> DataFrame:
    rows = classify.daily_overlaps(stays.localized(stay_table(s, d)))
    days = [F.count_distinct(F.when(F.col(f"{k}_min") > 0, F.col("day"))).alias(f"{k}_days") for k in ("home", "office")]
    return rows.groupBy("user_id").agg(*days)


@query
def classify_v1(s: SparkSession, d: str) -> DataFrame:
    return classify.winners_v1(scores(s, d)).select(
        "user_id", "type", r("lat", 10), r("lon", 10), r("minutes"), "support", r("confidence", 6), "status", "reason"
    )


@query
def v1_pois(s: SparkSession, d: str) -> DataFrame:
    return classify.pois_v1(scores(s, d)).select(
        "user_id", "geohash", r("lat", 10), r("lon", 10), "visit_count", r("duration_minutes"), r("confidence", 6), "rank"
    )


@query
def dbscan_places(s: SparkSession, d: str) -> DataFrame:
    placed = places.dbscan(stay_table(s, d), pieces=stay_pieces(s, d))
    return placed.groupBy("user_id", "place").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("places"), F.max("n").alias("largest")
    )


@query
def classify_v2(s: SparkSession, d: str) -> DataFrame:
    return classify.winners_v2(classify.place_scores(scores(s, d), pieces=stay_pieces(s, d))).select(
        "user_id", "type", r("lat", 10), r("lon", 10), "visit_count", r("minutes"), "days", r("confidence", 6), "status", "reason"
    )


@query
def v2_pois(s: SparkSession, d: str) -> DataFrame:
    return classify.pois_v2(classify.place_scores(scores(s, d), pieces=stay_pieces(s, d))).select(
        "user_id", "rank", r("lat", 10), r("lon", 10), "visit_count", r("duration_minutes"), r("confidence", 6)
    )


@query
def shadow_compare(s: SparkSession, d: str) -> DataFrame:
    base = scores(s, d)
    return classify.compare(classify.winners_v1(base), classify.winners_v2(classify.place_scores(base, pieces=stay_pieces(s, d))))


@query
def shadow_summary(s: SparkSession, d: str) -> DataFrame:
    rows = shadow_compare(s, d)
    return rows.groupBy("type").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("both_unknown", "shadow_only", "primary_only", "same_place", "different_place")]
    )


@query
def radius_support(s: SparkSession, d: str) -> DataFrame:
    rows = stay_table(s, d).withColumn("id", F.concat_ws("-", "chain", "stay")).select("user_id", "id", "lat", "lon")
    pairs = places.radius_pairs(rows, rows, ["user_id"], 200.0)
    return pairs.groupBy("user_id", F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("support"))


@query
def hourly_profile(s: SparkSession, d: str) -> DataFrame:
    rows = stays.localized(stay_table(s, d))
    first = F.to_timestamp_ntz(F.date_format("arrival_local", "yyyy-MM-dd HH:00:00"))
    n = F.floor(seconds_between(first, F.col("departure_local")) / 3600).cast("int")
    slots = rows.withColumn("slot", first).withColumn("i", F.explode(F.sequence(F.lit(0), n)))
    slot = times.plus_seconds(F.col("slot"), F.col("i") * 3600)
    slots = slots.withColumn("slot", slot)
    end = F.least(F.col("departure_local"), times.plus_seconds(F.col("slot"), F.lit(3600)))
    minutes = seconds_between(F.greatest("arrival_local", "slot"), end) / 60
    work = F.weekday("slot") < 5
    return slots.groupBy(F.hour("slot").alias("hour"), work.alias("workday")).agg(r("minutes", of=F.sum(minutes)))


# --- joins ---


def labels(s: SparkSession, d: str) -> DataFrame:
    return traces.labels_of_events(table(s, d, "events"))


def _in_interval(p: DataFrame, lab: DataFrame) -> DataFrame:
    """Points with the label intervals that hold them: joined by user and the hours an interval touches."""
    left = p.withColumn("h", F.floor(seconds_between(F.lit("1970-01-01").cast("timestamp_ntz"), F.col("datetime")) / 3600))
    lo, hi = (F.floor(seconds_between(F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c)) / 3600) for c in ("start", "end"))
    right = lab.withColumn("h", F.explode(F.sequence(lo, hi)))
    return left.join(right, ["user_id", "h"]).filter("datetime BETWEEN start AND end").drop("h")


@query
def interval_mode(s: SparkSession, d: str) -> DataFrame:
    hit = _in_interval(kept(s, d), labels(s, d))
    last = hit.groupBy("user_id", "ord").agg(F.max_by("mode", F.struct("start", "label_id")).alias("mode"))
    return last.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@query
def asof_label(s: SparkSession, d: str) -> DataFrame:
    p = kept(s, d).select("user_id", F.col("datetime").alias("t"), "ord", F.lit(1).alias("kind"), F.lit(None).cast("struct<start: timestamp_ntz, end: timestamp_ntz, mode: string>").alias("lab"))
    lab = labels(s, d).select("user_id", F.col("start").alias("t"), F.col("label_id").alias("ord"), F.lit(0).alias("kind"), F.struct("start", "end", "mode").alias("lab"))
    w = Window.partitionBy("user_id").orderBy("t", "kind", "ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = p.unionByName(lab).withColumn("last", F.last("lab", ignorenulls=True).over(w)).filter("kind = 1")
    mode = F.when(F.col("t") <= F.col("last.end"), F.col("last.mode"))
    return rows.groupBy(mode.alias("mode")).agg(F.count(F.lit(1)).alias("n"))


@query
def join_semi(s: SparkSession, d: str) -> DataFrame:
    judged = cleaning.dup_candidates(gated(s, d)).filter("is_candidate")
    ties = cleaning.decide(judged).filter("decision = 'tie_break'")
    return judged.join(ties, [*cleaning.FILE, "datetime"], "left_semi").select(*KEY)


@query
def join_anti(s: SparkSession, d: str) -> DataFrame:
    return kept(s, d).join(clean(s, d), KEY, "left_anti").select(*KEY)


@query
def join_left(s: SparkSession, d: str) -> DataFrame:
    files = points(s, d).groupBy(*cleaning.FILE).agg(F.count(F.lit(1)).alias("raw"))
    bad = cleaning.clean(by_file(s, d))[1].groupBy(*cleaning.FILE).agg(F.count(F.lit(1)).alias("bad"))
    return files.join(bad, cleaning.FILE, "left").select(*cleaning.FILE, "raw", F.coalesce("bad", F.lit(0).cast("long")).alias("bad"))


@query
def join_inner(s: SparkSession, d: str) -> DataFrame:
    o, c = table(s, d, "orders"), table(s, d, "customer")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), r("total", 2, F.sum("o_totalprice")))


@query
def join_broadcast_lookup(s: SparkSession, d: str) -> DataFrame:
    n, reg = table(s, d, "nation"), table(s, d, "region")
    rows = table(s, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.join(F.broadcast(reg), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query
def file_boundaries(s: SparkSession, d: str) -> DataFrame:
    order = F.struct("datetime", "ord")
    files = clean(s, d).groupBy(*cleaning.FILE).agg(
        F.min("datetime").alias("start"), F.max("datetime").alias("end"),
        F.min_by(F.struct("lat", "lon"), order).alias("first"), F.max_by(F.struct("lat", "lon"), order).alias("last"),
    )
    nxt = F.lead(F.struct("start", "first")).over(Window.partitionBy("user_id").orderBy("start", "source_file"))
    rows = files.withColumn("next", nxt).filter("next IS NOT NULL")
    return rows.select(
        *cleaning.FILE, r("gap_s", of=seconds_between("end", "next.start")), r("metres", of=haversine_m("last.lat", "last.lon", "next.first.lat", "next.first.lon"))
    )


# --- aggregates, windows, set operations ---


@query
def agg_quantiles(s: SparkSession, d: str) -> DataFrame:
    q = F.percentile("step_kmh", F.array(*map(F.lit, (0.5, 0.9, 0.99))))
    rows = cleaning.with_steps(kept(s, d)).filter("step_kmh IS NOT NULL").groupBy("source_file").agg(q.alias("q"))
    return rows.select("source_file", *[r(n, of=F.get("q", i)) for i, n in enumerate(("p50", "p90", "p99"))])


@query
def agg_basic(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), r("total", 2, F.sum("value")), r("mean", 4, F.avg("value")), F.min("value").alias("low"),
        F.max("value").alias("high"), F.count_distinct("user_id").alias("users"),
    )


@query
def agg_conditional(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("purchases"), r("share", 6, F.avg((F.col("event_type") == "view").cast("int")))
    )


@query
def agg_first_last(s: SparkSession, d: str) -> DataFrame:
    o = F.struct("ts", "event_id")
    return table(s, d, "events").groupBy("user_id").agg(F.min_by("event_type", o).alias("first_type"), F.max_by("event_type", o).alias("last_type"))


@query
def agg_weighted_mean(s: SparkSession, d: str) -> DataFrame:
    x = F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity")
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(r("mean", 4, x))


@query
def agg_argmax(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("top_order"))


@query
def agg_having(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 60")


@query
def agg_listagg(s: SparkSession, d: str) -> DataFrame:
    names = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    return table(s, d, "events").groupBy("user_id").agg(names.alias("types"))


@query
def hour_distribution(s: SparkSession, d: str) -> DataFrame:
    counted = clean(s, d).groupBy(F.hour("timestamp_local").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    hours = s.range(24).select(F.col("id").cast("int").alias("hour"))
    rows = hours.join(F.broadcast(counted), "hour", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return rows.select("hour", "n", r("share", 6, F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))


@query
def crosstab(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return rows.select("o_orderpriority", *[F.coalesce(c, F.lit(0).cast("long")).alias(c.lower()) for c in ("F", "O", "P")])


@query
def crosstab_margins(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").withColumn("odd", F.col("user_id") % 2)
    return rows.cube("event_type", "odd").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("gid"))


@query
def topk_longest(s: SparkSession, d: str) -> DataFrame:
    return stay_table(s, d).orderBy(F.desc("duration_minutes"), "user_id", "arrival").limit(20).select("user_id", "arrival", r("duration_minutes"))


@query
def trajectory_thinning(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    rows = clean(s, d).withColumns({"rn": F.row_number().over(w.orderBy("datetime", "ord")), "n": F.count(F.lit(1)).over(w)})
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 100)).cast("long")
    return rows.filter((F.col("rn") - 1) % step == 0).select(*KEY)


@query
def set_union(s: SparkSession, d: str) -> DataFrame:
    a, b = table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.union(b).distinct()


@query
def set_union_all(s: SparkSession, d: str) -> DataFrame:
    a, b = cleaning.clean(by_file(s, d))
    return a.select(*KEY).unionByName(b.select(*KEY)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query
def set_intersect(s: SparkSession, d: str) -> DataFrame:
    a, b = stay_table(s, d), stays.stay_points(clean(s, d), anchor=True, pieces=pieces(s, d))
    return a.select("user_id", "arrival", "departure").intersect(b.select("user_id", "arrival", "departure"))


@query
def set_except(s: SparkSession, d: str) -> DataFrame:
    return gated(s, d).select(*KEY).exceptAll(kept(s, d).select(*KEY))


@query
def set_symdiff(s: SparkSession, d: str) -> DataFrame:
    a, b = (x.select("user_id", "arrival", "departure") for x in (stay_table(s, d), stays.stay_points(clean(s, d), anchor=True, pieces=pieces(s, d))))
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


@query
def distinct_on(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(s, d, "events").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("user_id", "event_type", "event_id")


# --- scalar functions, privacy, monitoring ---


@query
def geohash_encode(s: SparkSession, d: str) -> DataFrame:
    rows = kept(s, d).select("lat", "lon")
    return rows.groupBy(geo.geohash_encode("lat", "lon", 6).alias("g6"), geo.geohash_encode("lat", "lon", 5).alias("g5")).agg(F.count(F.lit(1)).alias("n"))


@query
def hash_identifier(s: SparkSession, d: str) -> DataFrame:
    ids = table(s, d, "customer").select("c_custkey")
    text = F.concat_ws(":", F.col("c_custkey").cast("string"), F.lit("salt"))
    return ids.select("c_custkey", F.substring(F.sha2(text, 256), 1, 16).alias("pseudonym"))


@query
def make_sub_trip_id(s: SparkSession, d: str) -> DataFrame:
    return points(s, d).select(F.concat_ws("_", F.lpad(F.col("user_id").cast("string"), 6, "0"), "source_file").alias("id")).distinct()


@query
def time_parts(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.groupBy(F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


@query
def hour_in_range(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("h", F.hour("ts"))
    return e.agg(F.count_if(times.in_hours(F.col("h"), 22, 6)).alias("night"), F.count_if(times.in_hours(F.col("h"), 9, 18)).alias("day"))


@query
def k_anonymity_stats(s: SparkSession, d: str) -> DataFrame:
    cells = kept(s, d).groupBy(geo.geohash_encode("lat", "lon", 6).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    ok = F.col("n") >= 5
    return cells.agg(
        F.count(F.lit(1)).alias("cells"), F.sum("n").alias("total"), F.min("n").alias("least"),
        r("ratio", 6, F.coalesce(F.avg(ok.cast("int")), F.lit(0.0))), F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_ok"),
    )


@query
def k_generalize(s: SparkSession, d: str) -> DataFrame:
    p = kept(s, d)
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("p"), geo.geohash_encode("lat", "lon", n).alias("g")) for n in range(7, 1, -1)]))
    cells = p.select("source_file", levels.alias("x")).groupBy("source_file", "x.p", "x.g").agg(F.count(F.lit(1)).alias("n"))
    least = cells.groupBy("source_file", "p").agg(F.min("n").alias("least"))
    return least.groupBy("source_file").agg(F.coalesce(F.max(F.when(F.col("least") >= 5, F.col("p"))), F.lit(2)).alias("precision"))


@query
def psi(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select((F.col("user_id") % 2).alias("side"), F.least(F.col("value"), F.lit(150.0)).alias("v"))
    bucket = F.when((F.col("v") >= 0) & (F.col("v") <= 100), F.least(F.floor(F.col("v") / 10), F.lit(9)).cast("int"))
    n = e.groupBy("side", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    share = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("side"))).filter("b IS NOT NULL")
    grid = s.range(10).select(F.col("id").cast("int").alias("b"))
    for side, name in ((0, "e"), (1, "a")):
        part = share.filter(F.col("side") == side).select("b", F.col("p").alias(name))
        grid = grid.join(F.broadcast(part), "b", "left")
    e_p, a_p = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-4)) for c in ("e", "a"))
    return grid.agg(r("psi", 6, F.sum((a_p - e_p) * F.log(a_p / e_p))))


@query
def wilson_ci(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") > 50).cast("int")).alias("p"))
    z, n, p = 1.96, F.col("n"), F.col("p")
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return rows.select("event_type", r("low", 6, centre - half), r("high", 6, centre + half))


@query
def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.md5(F.col("event_id").cast("string").cast("binary")), "event_id")
    return table(s, d, "events").withColumn("rk", F.row_number().over(w)).filter("rk <= 50").select("event_type", "event_id")


@query
def content_fingerprint(s: SparkSession, d: str) -> DataFrame:
    return traces.content_hashes(points(s, d)).select(*cleaning.FILE, "n_points", "print")
