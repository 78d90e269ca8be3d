"""Cleaning of raw traces; every rejected point keeps its reason.

All operators work on all files at once: ``FILE`` identifies a recording, and
windows order it by time, then line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.functions.geo import haversine_m, mean_haversine_m, seconds_between, speed_kmh
from driftline.functions.times import to_local, zone_of

FILE = ["user_id", "source_file"]
FEET = 0.3048


@dataclass(frozen=True)
class Thresholds:
    """Limits of the cleaning operators."""

    impossible_kmh: float = 1100.0
    ambiguous_m: float = 200.0
    segment_gap_s: float = 1200.0
    altitude_invalid: float = -777.0
    min_points: int = 2


LIMITS = Thresholds()


#: Order of a file's points; where no second holds two points that matter, ``TIME`` alone is the same, and rows sorted once stay so.
ORDER, TIME = ("datetime", "ord"), ("datetime",)


def _in_order(order: tuple[str, ...] = ORDER) -> Window:
    return Window.partitionBy(*FILE).orderBy(*order)


def _around(rows: DataFrame, marked: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``prev`` and ``next``: the nearest non-null ``marked`` before and after each row of a file."""
    over = f"OVER (PARTITION BY {', '.join(FILE)} ORDER BY {', '.join(order)})"
    return rows.withColumns({n: F.expr(f"{f}({marked}, 1) IGNORE NULLS {over}") for n, f in (("prev", "lag"), ("next", "lead"))})


def physical_bounds(points: DataFrame) -> DataFrame:
    """Points on the globe and not exactly at the origin; null coordinates go."""
    return points.filter(
        F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    )


def min_points_gate(points: DataFrame, least: int = LIMITS.min_points) -> DataFrame:
    """Points of files that have enough of them."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*FILE))
    return points.withColumn("__n", n).filter(F.col("__n") >= least).drop("__n")


def dedup_exact(points: DataFrame, limits: Thresholds = LIMITS) -> DataFrame:
    """One point per file, second and position: a valid altitude first, then the earliest line."""
    return _marked(points, limits).filter("NOT __copy").drop("__copy")


def _marked(points: DataFrame, limits: Thresholds) -> DataFrame:
    bad = (F.col("altitude") == limits.altitude_invalid).cast("int")
    # Equal points are neighbours in this order; a window a file is cheaper than one a point.
    order = Window.partitionBy(*FILE).orderBy("datetime", "lat", "lon", bad, "ord")
    spot = F.struct("datetime", "lat", "lon")
    rows = points.withColumn("__before", F.lag(spot).over(order))
    return rows.withColumn("__copy", spot.eqNullSafe(F.col("__before"))).drop("__before")


def _judged(rows: DataFrame, limits: Thresholds, flag: str) -> DataFrame:
    """Evidence columns of candidates, rows with ``flag``, that carry their anchors ``prev`` and ``next`` (datetime, lat, lon)."""

    def speed(a: str, b: str) -> Column:
        kmh = speed_kmh(haversine_m(f"{a}lat", f"{a}lon", f"{b}lat", f"{b}lon"), seconds_between(f"{a}datetime", f"{b}datetime"))
        return F.when(F.col(flag), kmh)

    limit = limits.impossible_kmh
    over = {c: F.coalesce(F.col(c) > limit, F.lit(False)) for c in ("v_in", "v_out", "v_anchors")}
    return (
        rows.withColumns({"v_in": speed("prev.", ""), "v_out": speed("", "next."), "v_anchors": speed("prev.", "next.")})
        .withColumn("valid", ~over["v_in"] & ~over["v_out"])
        .withColumn("score", F.coalesce(F.greatest("v_in", "v_out"), F.lit(0.0)))
        .withColumn("invalid_anchors", over["v_anchors"])
    )


def dup_candidates(points: DataFrame, limits: Thresholds = LIMITS) -> DataFrame:
    """Deduplicated points; those that share a second with another position are candidates with evidence.

    Columns added: ``is_candidate``, ``bad_altitude`` and, for candidates, speeds
    from the nearest unshared point before and to the one after.
    """
    return _candidates(dedup_exact(points, limits), limits)


def _candidates(work: DataFrame, limits: Thresholds) -> DataFrame:
    work = work.withColumn("bad_altitude", (F.col("altitude") == limits.altitude_invalid).cast("int"))
    # Points of a shared second are no anchors, so their order doesn't matter.
    order = _in_order(TIME)
    shared = [F.coalesce(f("datetime").over(order) == F.col("datetime"), F.lit(False)) for f in (F.lag, F.lead)]
    work = work.withColumn("is_candidate", shared[0] | shared[1])
    work = work.withColumn("__anchor", F.when(~F.col("is_candidate"), F.struct("datetime", "lat", "lon")))
    return _judged(_around(work, "__anchor", TIME).drop("__anchor"), limits, "is_candidate")


def decide(candidates: DataFrame, limits: Thresholds = LIMITS) -> DataFrame:
    """One decision per file and second from candidate evidence: ``n_candidates, n_valid, valid_spread_m, decision``."""
    groups = candidates.groupBy(*FILE, "datetime").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.sum(F.col("valid").cast("long")).alias("n_valid"),
        F.max("invalid_anchors").alias("invalid_anchors"),
        F.collect_list(F.when(F.col("valid"), F.struct("lat", "lon"))).alias("spots"),
    )
    groups = groups.withColumn("valid_spread_m", _spread(F.col("spots")))
    return groups.withColumn("decision", _ladder(limits)).drop("spots", "invalid_anchors")


_REASONS = {
    "invalid_anchors": "duplicate_invalid_anchors",
    "no_valid": "duplicate_no_valid",
    "ambiguous": "duplicate_ambiguous",
    "rejected": "duplicate_rejected",
}


def _spread(spots: Column) -> Column:
    """The largest distance between any two of the few positions of one second."""
    pairs = F.transform(spots, lambda a: F.transform(spots, lambda b: haversine_m(a["lat"], a["lon"], b["lat"], b["lon"])))
    return F.aggregate(F.flatten(pairs), F.lit(0.0), lambda m, d: F.greatest(m, d))


def _ladder(limits: Thresholds) -> Column:
    return (
        F.when(F.col("invalid_anchors"), "invalid_anchors")
        .when(F.col("n_valid") == 0, "no_valid")
        .when(F.col("n_valid") == 1, "single_valid")
        .when(F.col("valid_spread_m") > limits.ambiguous_m, "ambiguous")
        .otherwise("tie_break")
    )


def with_decisions(rows: DataFrame, limits: Thresholds = LIMITS, flag: str = "is_candidate") -> DataFrame:
    """Rows with their second's ``decision``, ``survivor`` and quarantine ``reason`` (null: kept, or dropped silently).

    Only rows with ``flag`` are decided; the others keep nulls.  All figures are
    windows within the file, so the rows stay where they are.
    """
    # Rows in order of time are in order of their seconds, and the best row is a minimum: nothing is sorted again.
    mine = F.col(flag)
    group = Window.partitionBy(*FILE, "datetime")
    good = mine & F.col("valid")
    place = F.when(mine, F.struct((~good).cast("int").alias("bad"), "score", "bad_altitude", "ord", "lat", "lon"))
    rows = rows.withColumn("__place", place)
    rows = rows.withColumns(
        {
            "n_valid": F.sum(good.cast("long")).over(group),
            "invalid_anchors": F.max(mine & F.col("invalid_anchors")).over(group),
            "__spots": F.collect_list(F.when(good, F.struct("lat", "lon"))).over(group),
            "__best": F.min("__place").over(group),
        }
    )
    spread = F.when(F.col("n_valid") > 1, _spread(F.col("__spots"))).otherwise(0.0)
    rows = rows.withColumn("valid_spread_m", spread).withColumn("decision", F.when(mine, _ladder(limits)))
    resolved = F.coalesce(F.col("decision").isin("single_valid", "tie_break"), F.lit(False))
    reason = F.when(mine & ~resolved, F.col("decision")).when(mine & ~F.col("valid"), F.lit("rejected"))
    named = F.create_map(*[F.lit(x) for pair in _REASONS.items() for x in pair])
    return (
        rows.withColumn("survivor", resolved & F.col("__place").eqNullSafe(F.col("__best")))
        .withColumn("reason", F.try_element_at(named, reason))
        .drop("__place", "__best", "__spots")
    )


POINT = [*FILE, "ord", "datetime", "lat", "lon", "altitude"]


def _resolved(work: DataFrame, limits: Thresholds) -> DataFrame:
    """Deduplicated points with ``kept`` and ``reason`` after every shared second has been decided."""
    rows = with_decisions(_candidates(work, limits), limits)
    return rows.withColumn("kept", ~F.col("is_candidate") | F.col("survivor")).select(*POINT, "bad_altitude", "kept", "reason")


def resolve_duplicates(points: DataFrame, limits: Thresholds = LIMITS) -> tuple[DataFrame, DataFrame]:
    """``(kept, quarantined)`` after every shared second has been decided."""
    rows = _resolved(dedup_exact(points, limits), limits)
    return rows.filter("kept").select(*POINT), rows.filter("reason IS NOT NULL").select(*POINT, "reason")


def _with_spikes(rows: DataFrame, limits: Thresholds, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``is_spike`` among the rows with ``kept``: both steps around are impossible and the step past it isn't; one pass."""
    rows = rows.withColumn("__spot", F.when(F.col("kept"), F.struct("datetime", "lat", "lon")))
    rows = _around(rows, "__spot", order)

    def over(p: str, q: str) -> Column:
        seconds = seconds_between(f"{p}datetime", f"{q}datetime")
        metres = haversine_m(f"{p}lat", f"{p}lon", f"{q}lat", f"{q}lon")
        return F.coalesce(speed_kmh(metres, seconds) > limits.impossible_kmh, F.lit(False))

    whole = F.col("kept") & F.col("prev").isNotNull() & F.col("next").isNotNull()
    spike = whole & over("prev.", "") & over("", "next.") & ~over("prev.", "next.")
    return rows.withColumn("is_spike", spike).drop("__spot", "prev", "next")


def speed_spikes(points: DataFrame, limits: Thresholds = LIMITS) -> DataFrame:
    """All points with ``is_spike``."""
    return _with_spikes(points.withColumn("kept", F.lit(True)), limits).drop("kept")


def _rechecked(rows: DataFrame, limits: Thresholds, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Rows with ``again`` judged between their neighbours among the rows with ``base``.

    A group without both neighbours keeps its reason.
    """
    rows = rows.withColumn("__spot", F.when(F.col("base"), F.struct("datetime", "lat", "lon")))
    rows = _judged(_around(rows, "__spot", order).drop("__spot"), limits, "again")
    sided = F.col("prev").isNotNull() & F.col("next").isNotNull()
    rows = rows.withColumn("invalid_anchors", F.col("again") & (~sided | F.col("invalid_anchors")))
    return with_decisions(rows, limits, "again")


def recheck(base: DataFrame, quarantined: DataFrame, limits: Thresholds = LIMITS) -> DataFrame:
    """Seconds with invalid anchors, judged again between their neighbours in the spike-free ``base``."""
    again = quarantined.filter(F.col("reason") == _REASONS["invalid_anchors"]).select(*POINT)
    rows = base.select(*POINT).withColumn("base", F.lit(True)).unionByName(again.withColumn("base", F.lit(False)))
    rows = rows.withColumn("again", ~F.col("base"))
    rows = rows.withColumn("bad_altitude", (F.col("altitude") == limits.altitude_invalid).cast("int"))
    return _rechecked(rows, limits).filter("again").select(*POINT, "decision", "survivor", "reason")


def altitude_clean(points: DataFrame, limits: Thresholds = LIMITS, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``altitude`` without the invalid mark and ``altitude_m``, interpolated by row position, then carried outward."""
    raw = F.when(F.col("altitude") != limits.altitude_invalid, F.col("altitude"))
    rows = points.withColumn("altitude", raw).withColumn("__rn", F.row_number().over(_in_order(order)))
    known = F.when(F.col("altitude").isNotNull(), F.struct("__rn", (F.col("altitude") * FEET).alias("m")))
    rows = _around(rows.withColumn("__known", known), "__known", order)
    rows = rows.withColumns({"__p": F.coalesce("__known", "prev"), "__q": F.coalesce("__known", "next")}).drop("prev", "next")
    share = (F.col("__rn") - F.col("__p.__rn")) / (F.col("__q.__rn") - F.col("__p.__rn"))
    between = F.when(F.col("__p.__rn") == F.col("__q.__rn"), F.col("__p.m")).otherwise(
        F.col("__p.m") + (F.col("__q.m") - F.col("__p.m")) * share
    )
    return rows.withColumn("altitude_m", F.coalesce(between, F.col("__p.m"), F.col("__q.m"))).drop(
        "__rn", "__known", "__p", "__q"
    )


def with_steps(points: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``step_s``, ``step_m`` and ``step_kmh`` from the file's previous point."""
    rows = points.withColumn("__p", F.lag(F.struct("datetime", "lat", "lon")).over(_in_order(order)))
    seconds = seconds_between("__p.datetime", "datetime")
    metres = haversine_m("__p.lat", "__p.lon", "lat", "lon")
    return rows.withColumns({"step_s": seconds, "step_m": metres, "step_kmh": speed_kmh(metres, seconds)}).drop("__p")


def segment_trajectories(points: DataFrame, limits: Thresholds = LIMITS, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``sub_trip_id``: a new segment after a long gap or an impossible step."""
    cut = (F.col("step_s") > limits.segment_gap_s) | F.coalesce(F.col("step_kmh") > limits.impossible_kmh, F.lit(False))
    number = F.sum(F.coalesce(cut, F.lit(False)).cast("long")).over(_in_order(order).rowsBetween(Window.unboundedPreceding, 0))
    return (
        with_steps(points, order)
        .withColumn("sub_trip_id", F.concat_ws("_", F.col("user_id").cast("string"), "source_file", number.cast("string")))
        .drop("step_s", "step_m", "step_kmh")
    )


def localize(points: DataFrame) -> DataFrame:
    """``tz_name`` and ``timestamp_local`` by position."""
    zone = zone_of(F.col("lat"), F.col("lon"))
    return points.withColumn("tz_name", zone).withColumn("timestamp_local", to_local(F.col("datetime"), F.col("tz_name")))


def judged_points(points: DataFrame, limits: Thresholds = LIMITS) -> DataFrame:
    """All deduplicated points with ``accepted`` and ``reason``, before the last gate.

    Points move once, to their file, and are sorted once, by time; every later
    stage is a window there: it has one row of a second at most to look at.
    """
    # The gate counts after the copies are marked and before they go, in the order that they are found in.
    rows = min_points_gate(_marked(physical_bounds(points), limits), limits.min_points)
    rows = _with_spikes(_resolved(rows.filter("NOT __copy").drop("__copy"), limits), limits, TIME)
    rows = rows.withColumn("base", F.col("kept") & ~F.col("is_spike")).withColumnRenamed("reason", "before")
    rows = rows.withColumn("again", F.coalesce(F.col("before") == _REASONS["invalid_anchors"], F.lit(False)))
    rows = _rechecked(rows, limits, TIME)
    reason = F.when(F.col("again"), F.col("reason")).when(F.col("is_spike"), "speed_spike").otherwise(F.col("before"))
    return rows.select(*POINT, (F.col("base") | F.col("survivor")).alias("accepted"), reason.alias("reason"))


def clean(points: DataFrame, limits: Thresholds = LIMITS) -> tuple[DataFrame, DataFrame]:
    """``(clean, quarantined)``: all cleaning stages over all files."""
    rows = judged_points(points, limits)
    whole = min_points_gate(rows.filter("accepted").select(*POINT), limits.min_points)
    done = localize(segment_trajectories(altitude_clean(whole, limits, TIME), limits, TIME))
    return done, rows.filter("reason IS NOT NULL").select(*POINT, "reason")


# --- the simpler library chain: other limits, other conventions ---


def distance_filter(points: DataFrame, limit_km: float = 50.0) -> DataFrame:
    """The first point and those within ``limit_km`` of the previous input point."""
    order = _in_order()
    p = F.lag(F.struct("lat", "lon")).over(order)
    rows = points.withColumns({"__p": p, "__rn": F.row_number().over(order)})
    metres = mean_haversine_m("__p.lat", "__p.lon", "lat", "lon")
    return rows.filter((F.col("__rn") == 1) | (metres <= limit_km * 1000)).drop("__p", "__rn")


def speed_filter(points: DataFrame, limit_kmh: float = 300.0) -> DataFrame:
    """The first point and those reached at ``limit_kmh`` or less; steps without time forward go."""
    order = _in_order()
    rows = points.withColumns({"__p": F.lag(F.struct("datetime", "lat", "lon")).over(order), "__rn": F.row_number().over(order)})
    speed = speed_kmh(mean_haversine_m("__p.lat", "__p.lon", "lat", "lon"), seconds_between("__p.datetime", "datetime"))
    return rows.filter((F.col("__rn") == 1) | (speed <= limit_kmh)).drop("__p", "__rn")


def simple_clean(points: DataFrame) -> DataFrame:
    """Bounds, valid times, one point a second (the first), distance filter, then speed filter."""
    valid = points.filter(
        F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & F.col("datetime").isNotNull()
    )
    first = Window.partitionBy(*FILE, "datetime").orderBy("ord")
    once = valid.withColumn("__rank", F.row_number().over(first)).filter("__rank = 1").drop("__rank")
    return speed_filter(distance_filter(once))


def split_by_gaps(points: DataFrame, gap_hours: float = 6.0, least: int = 10) -> DataFrame:
    """``part``: a new part after a longer gap; parts of fewer points go."""
    order = _in_order()
    gap = seconds_between(F.lag("datetime").over(order), F.col("datetime")) > gap_hours * 3600
    rows = points.withColumn("__cut", F.coalesce(gap, F.lit(False)).cast("long"))
    rows = rows.withColumn("part", F.sum("__cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__cut")
    n = F.count(F.lit(1)).over(Window.partitionBy(*FILE, "part"))
    return rows.withColumn("__n", n).filter(F.col("__n") >= least).drop("__n")
