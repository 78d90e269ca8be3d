"""Joins of intervals that meet, and runs of hours on the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.geo import seconds_between
from driftline.operators.grouped import in_pieces

#: Width of the time buckets that turn meeting intervals into an equality join.
BUCKET_S = 21_600


def _bucket(ts: Column, width: int) -> Column:
    return F.floor(seconds_between(F.lit("1970-01-01").cast("timestamp_ntz"), ts) / width)


def meeting(left: DataFrame, right: DataFrame, keys: list[str], width: int = BUCKET_S, touching: bool = False, whole: bool = False, pieces: int | None = None) -> DataFrame:
    """Pairs of rows of equal keys whose intervals ``start`` to ``end`` overlap: ``keys, l, r``, the rows as structs.

    Both sides are dealt to the buckets that their intervals touch, so a long
    history of one key isn't compared with itself whole; a pair is made in the
    first bucket that both touch.  ``touching`` also takes intervals that only
    share an end, and points (``start = end``).  ``whole`` keeps every row of both
    sides: rows of a bucket that make no pair are there with ``met`` false, any
    number of times; pairs have ``met`` true and are there once.
    ``pieces`` is the number of partitions, where the engine shouldn't choose it.
    """

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        buckets = F.sequence(_bucket(F.col("start"), width), _bucket(F.col("end"), width))
        known = rows.filter(F.col("start") <= F.col("end"))
        return in_pieces(known.select(*keys, F.struct(*rows.columns).alias(name), F.explode(buckets).alias("bucket")), pieces, *keys, "bucket")

    pairs = dealt(left, "l").join(dealt(right, "r"), [*keys, "bucket"], "full" if whole else "inner")
    first = F.col("bucket") == F.greatest(_bucket(F.col("l.start"), width), _bucket(F.col("r.start"), width))
    if touching:
        met = (F.col("l.start") <= F.col("r.end")) & (F.col("l.end") >= F.col("r.start"))
    else:
        met = (F.col("l.start") < F.col("r.end")) & (F.col("l.end") > F.col("r.start"))
    if whole:
        return pairs.withColumn("met", F.coalesce(first & met, F.lit(False))).drop("bucket")
    return pairs.filter(first & met).drop("bucket")


def shared_minutes() -> Column:
    """Minutes that the two rows of :func:`meeting` have in common."""
    return seconds_between(F.greatest("l.start", "r.start"), F.least("l.end", "r.end")) / 60


def hour_runs(hours: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, runs``: consecutive hours of the clock as text, across midnight, from distinct ``keys, hour`` rows.

    Runs are in order of their first hour ("06-09 h, 22-02 h"); all 24 hours are "all day".
    """
    sets = hours.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col("hour").cast("int"))).alias("hs"))
    clock = F.sequence(F.lit(0), F.lit(23))
    starts = F.filter("hs", lambda h: ~F.array_contains("hs", (h + 23) % 24))

    def run(h: Column) -> Column:
        # The first hour from here that isn't in the set ends the run.
        after = F.filter(F.transform(clock, lambda i: (h + i) % 24), lambda x: ~F.array_contains("hs", x))
        return F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit("-"), F.lpad(F.get(after, 0).cast("string"), 2, "0"), F.lit(" h"))

    text = F.when(F.size("hs") == 24, "all day").otherwise(F.array_join(F.transform(starts, run), ", "))
    return sets.select(*keys, text.alias("runs"))
