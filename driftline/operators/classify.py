"""Home, office and frequent places from stays, each with its evidence or an unknown outcome."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.functions.geo import geohash_encode, mean_haversine_m
from driftline.functions.times import window_minutes
from driftline.operators.grouped import in_pieces
from driftline.operators.places import dbscan
from driftline.operators.stays import localized


@dataclass(frozen=True)
class Rules:
    """Windows and gates of the classifiers."""

    home: tuple[int, int] = (22, 8)
    office: tuple[int, int] = (9, 18)
    work_days: int = 5
    min_stay_minutes: float = 30.0
    min_window_minutes: float = 240.0
    min_support: int = 2
    min_days: int = 2
    support_m: float = 200.0
    eps_m: float = 150.0
    poi_count: int = 5
    geohash_precision: int = 6


RULES = Rules()


def daily_overlaps(stays: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Stays by day, from the one before arrival, with ``home_min`` and ``office_min`` of that day's windows."""
    days = F.sequence(F.date_sub(F.to_date("arrival_local"), 1), F.to_date("departure_local"))
    rows = stays.withColumn("day", F.explode(days))
    home = window_minutes(F.col("arrival_local"), F.col("departure_local"), F.col("day"), *rules.home)
    office = window_minutes(F.col("arrival_local"), F.col("departure_local"), F.col("day"), *rules.office)
    works = F.weekday("day") < rules.work_days
    return rows.withColumns({"home_min": home, "office_min": F.when(works, office).otherwise(0.0)})


def _days(rules: Rules, kind: str) -> tuple[Column, Callable[..., Column]]:
    """The days that a stay may touch a window on, and the minutes of one of them, of the stay or between other times."""
    days = F.sequence(F.date_sub(F.to_date("arrival_local"), 1), F.to_date("departure_local"))
    hours = rules.home if kind == "home" else rules.office

    def minutes(day: Column, start: Column | None = None, end: Column | None = None) -> Column:
        times = [F.col(c) if x is None else x for c, x in (("arrival_local", start), ("departure_local", end))]
        inside = window_minutes(*times, day, *hours)
        return inside if kind == "home" else F.when(F.weekday(day) < rules.work_days, inside).otherwise(0.0)

    return days, minutes


def window_total(kind: str, rules: Rules = RULES, without: str | None = None) -> Column:
    """A local stay's minutes in all windows of a kind, summed up within the row: no explode, no join back.

    ``without`` names a column of (start, end), local times inside the stay; their minutes are taken from each day's.
    """
    days, minutes = _days(rules, kind)

    def of_day(day: Column) -> Column:
        if without is None:
            return minutes(day)
        missing = F.aggregate(F.col(without), F.lit(0.0), lambda total, gap: total + minutes(day, gap["start"], gap["end"]))
        return F.greatest(F.lit(0.0), F.round(minutes(day) - missing, 6))

    return F.aggregate(days, F.lit(0.0), lambda total, day: total + of_day(day))


def scored(stays: DataFrame, rules: Rules = RULES, pieces: int | None = None) -> DataFrame:
    """Local stays long enough, with their window minutes; a stay is known by user_id, chain and stay.

    ``pieces``, here and below: partitions that users are dealt to, where the engine shouldn't choose them.
    """
    rows = localized(in_pieces(stays.filter(F.col("duration_minutes") >= rules.min_stay_minutes), pieces, "user_id"))
    return rows.withColumns({kind: window_total(kind, rules) for kind in ("home", "office")})


def by_type(scores: DataFrame) -> DataFrame:
    """A row per stay and type with its minutes; only those that touch the type's window."""
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("minutes")) for k in ("home", "office")])
    return scores.withColumn("__k", F.explode(kinds)).select("*", "__k.type", "__k.minutes").drop("__k").filter("minutes > 0")


def _status(gate: Column, gate_least: int, rules: Rules) -> Column:
    return (
        F.when(F.col("minutes") < rules.min_window_minutes, "too_few_window_minutes").when(gate < gate_least, "one_off_place")
    )


def winners_v1(scores: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The stay with most window minutes per user and type: confidence, support, status and reason."""
    rows = by_type(scores)
    group = Window.partitionBy("user_id", "type")
    best = group.orderBy(F.desc("minutes"), F.desc("duration_minutes"), "arrival")
    first = F.first(F.struct("lat", "lon")).over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    top = rows.withColumns({"rank": F.row_number().over(best), "total": F.sum("minutes").over(group), "__first": first})
    # Support is counted where the candidates are: they don't meet the winner in a join.
    near = mean_haversine_m("__first.lat", "__first.lon", "lat", "lon") <= rules.support_m
    winner = top.withColumn("support", F.sum(near.cast("long")).over(group)).filter("rank = 1")
    reason = _status(F.col("support"), rules.min_support, rules)
    return winner.select(
        "user_id", "type", "lat", "lon", "arrival", "duration_minutes", "altitude_m", "minutes", "support",
        F.least(F.lit(1.0), F.col("minutes") / F.col("total")).alias("confidence"),
        F.when(reason.isNull(), "found").otherwise("unknown").alias("status"),
        reason.alias("reason"),
        geohash_encode("lat", "lon", rules.geohash_precision).alias("geohash"),
    )


def _top(rows: DataFrame, order: list[Column], rules: Rules) -> DataFrame:
    total = F.sum("duration_minutes").over(Window.partitionBy("user_id"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    return rows.withColumns({"confidence": F.least(F.lit(1.0), F.col("duration_minutes") / total), "rank": rank}).filter(
        F.col("rank") <= rules.poi_count
    )


def pois_v1(scores: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Top geohash cells of stays outside both windows, by time; a cell sits at its first stay."""
    cells = scores.filter("home = 0 AND office = 0").withColumn("geohash", geohash_encode("lat", "lon", rules.geohash_precision))
    first = F.struct("arrival", "chain", "stay")
    grouped = cells.groupBy("user_id", "geohash").agg(
        F.min_by("lat", first).alias("lat"),
        F.min_by("lon", first).alias("lon"),
        F.count(F.lit(1)).alias("visit_count"),
        F.sum("duration_minutes").alias("duration_minutes"),
        F.min("arrival").alias("first_seen"),
        F.max("arrival").alias("last_seen"),
        F.avg(F.nullif("altitude_m", F.lit(0.0))).alias("altitude_m"),
    )
    return _top(grouped, [F.desc("duration_minutes"), F.col("geohash")], rules)


def place_scores(scores: DataFrame, rules: Rules = RULES, pieces: int | None = None) -> DataFrame:
    """Clustered places: minutes and days in each window, weighted centre, visits and times."""
    rows = dbscan(scores, rules.eps_m, pieces=pieces)
    for kind in ("home", "office"):
        days, minutes = _days(rules, kind)
        rows = rows.withColumn(f"__{kind}", F.filter(days, lambda day: minutes(day) > 0))  # noqa: B023
    weight = F.sum("duration_minutes")
    return rows.groupBy("user_id", "place").agg(
        F.sum("home").alias("home"),
        F.sum("office").alias("office"),
        (F.sum(F.col("lat") * F.col("duration_minutes")) / weight).alias("lat"),
        (F.sum(F.col("lon") * F.col("duration_minutes")) / weight).alias("lon"),
        weight.alias("duration_minutes"),
        F.count(F.lit(1)).alias("visit_count"),
        F.avg(F.nullif("altitude_m", F.lit(0.0))).alias("altitude_m"),
        F.min("arrival").alias("first_seen"),
        F.max("arrival").alias("last_seen"),
        *[F.size(F.array_distinct(F.flatten(F.collect_list(f"__{kind}")))).cast("long").alias(f"{kind}_days") for kind in ("home", "office")],
    )


def winners_v2(places: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The place with most window minutes per user and type, gated by days."""
    kinds = F.array(
        *[F.struct(F.lit(k).alias("type"), F.col(k).alias("minutes"), F.col(f"{k}_days").alias("days")) for k in ("home", "office")]
    )
    rows = places.withColumn("__k", F.explode(kinds)).select("*", "__k.type", "__k.minutes", "__k.days").filter("minutes > 0")
    best = Window.partitionBy("user_id", "type").orderBy(F.desc("minutes"), F.desc("duration_minutes"), "first_seen")
    top = rows.withColumns(
        {"rank": F.row_number().over(best), "total": F.sum("minutes").over(Window.partitionBy("user_id", "type"))}
    ).filter("rank = 1")
    reason = _status(F.col("days"), rules.min_days, rules)
    return top.select(
        "user_id", "type", "lat", "lon", "visit_count", "duration_minutes", "altitude_m", "first_seen", "last_seen", "minutes", "days",
        F.least(F.lit(1.0), F.col("minutes") / F.col("total")).alias("confidence"),
        F.when(reason.isNull(), "found").otherwise("unknown").alias("status"),
        reason.alias("reason"),
    )


def pois_v2(places: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Top places that touch neither window, by time."""
    return _top(places.filter("home = 0 AND office = 0"), [F.desc("duration_minutes"), F.col("first_seen")], rules)


def compare(primary: DataFrame, shadow: DataFrame, same_m: float = 200.0) -> DataFrame:
    """Outcome of two models per user and type: both_unknown, shadow_only, primary_only, same_place or different_place."""

    def found(rows: DataFrame, tag: str) -> DataFrame:
        ok = F.col("status") == "found"
        return rows.select("user_id", "type", *[F.when(ok, F.col(c)).alias(f"{tag}_{c}") for c in ("lat", "lon")])

    both = found(primary, "p").join(found(shadow, "s"), ["user_id", "type"], "full")
    metres = mean_haversine_m("p_lat", "p_lon", "s_lat", "s_lon")
    outcome = (
        F.when(F.col("p_lat").isNull() & F.col("s_lat").isNull(), "both_unknown")
        .when(F.col("p_lat").isNull(), "shadow_only")
        .when(F.col("s_lat").isNull(), "primary_only")
        .when(metres <= same_m, "same_place")
        .otherwise("different_place")
    )
    return both.select("user_id", "type", outcome.alias("outcome"))


#: Versions of the classifier by name; each takes scored stays and their pieces.
MODELS: dict[str, Callable[[DataFrame, int | None], DataFrame]] = {
    "v1": lambda scores, pieces=None: winners_v1(scores),
    "v2": lambda scores, pieces=None: winners_v2(place_scores(scores, pieces=pieces)),
}


def coerced(sent: DataFrame) -> DataFrame:
    """Stays as clients send them in one form: ``arrival`` and ``departure`` in naive GMT, missing numbers null.

    A time may stand under ``arrival_time`` or ``arrival`` (``departure_time`` or
    ``departure``), as text with a zone or without, or as a timestamp.  Stays
    without both times, or that end before they start, are dropped; see
    ``validate_stays`` for counting them.
    """

    def when(*names: str) -> Column:
        found = F.coalesce(*[F.col(n).cast("string") for n in names if n in sent.columns])
        zoned = found.rlike(r"([+-]\d\d:?\d\d|Z)$")
        gmt = F.convert_timezone(None, F.lit("UTC"), F.try_to_timestamp(found).cast("timestamp_ntz"))
        return F.when(zoned, gmt).otherwise(F.to_timestamp_ntz(found))

    times = {"arrival": when("arrival_time", "arrival"), "departure": when("departure_time", "departure")}
    kinds = dict(sent.dtypes)
    numbers = {c: F.when(~F.isnan(c), F.col(c)) for c in ("altitude_m", "observed_minutes") if kinds.get(c) == "double"}
    rows = sent.select(*[F.col(c) for c in sent.columns if c not in {"arrival_time", "departure_time", "arrival", "departure", *numbers}], *[v.alias(n) for n, v in {**times, **numbers}.items()])
    return rows.filter("departure > arrival")
