"""Mixing sources to target weights by systematic sampling.

Every source gets a share of all words by weight, capped at a multiple of its
own size.  Within a source, each document expects ``target / source size``
copies; the expected copies are summed along an order of the documents, one
random offset is added, and a copy is emitted for each whole number crossed.
Documents are ordered by size, so copies fall evenly on short and long ones
and a source's words miss its target by less than its longest document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.storage import staged

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
#: Documents of one source and size are ranked in so many independent runs, so a hot size needn't be one task's.
RUNS = 64


def size_of(text: Column) -> Column:
    """Words separated by ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _digits(text: Column) -> Column:
    """The first 32 bits of the text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    the total.  Let a source's level be ``cap * size / weight``.  Filling all
    sources in proportion to weight, those of the lowest level are full first;
    what is left is shared by those that aren't, so one pass in order of level
    finds the common fill.  Only a row per source takes part.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = by_source.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("long")).withColumn(
        "full", F.col("source_size") * cap
    )
    everything = Window.partitionBy(F.lit(0))
    # Ascending by full / weight; ties are full together and need no order.
    rising = everything.orderBy((F.col("full") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    fill = (
        weighed.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("spent", F.coalesce(F.sum("full").over(before), F.lit(0).cast("long")))
        .withColumn("open", F.sum("weight").over(onward))
        .withColumn("level", (F.col("total") - F.col("spent")) / F.col("open"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("full"))
    )
    common = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(
        rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return fill.withColumn("common", common).select(
        "source",
        "source_size",
        F.least(F.col("full").cast("double"), F.coalesce(F.col("common") * F.col("weight"), F.col("full"))).alias("target"),
    )


def _copies(sized: DataFrame, weights: Sequence[int], cap: int, seed: str) -> DataFrame:
    """``sized`` (source, size, order, ...) with ``source_size, target, copies`` added."""
    goals = targets(sized, weights, cap)
    keyed = sized.withColumn("run", (F.col("order") % RUNS).cast("int"))
    runs = keyed.groupBy("source", "size", "run").agg(F.count(F.lit(1)).alias("n"))
    # Ranks start where the smaller sizes and earlier runs of the source end.  First runs are summed
    # within each size, then sizes within each source: rows here are sizes, not documents.
    within = Window.partitionBy("source", "size").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    per_size = runs.groupBy("source", "size").agg(F.sum("n").alias("n_size"))
    per_size = per_size.withColumn("below", F.coalesce(F.sum("n_size").over(below), F.lit(0).cast("long")))
    starts = (
        runs.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0).cast("long")))
        .alias("r")
        .join(
            per_size.alias("p"),
            F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size")),
        )
        .select("r.source", "r.size", "r.run", (F.col("ahead") + F.col("below")).alias("start"))
    )
    starts = (
        starts.alias("s")
        .join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
        .select("s.source", "s.size", "s.run", "start", "source_size", "target")
    )
    place = Window.partitionBy("source", "size", "run").orderBy("order", "doc_id")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _digits(F.concat(F.lit(seed), F.coalesce("k.source", F.lit("")))) / F.lit(4294967296.0)
    rank = F.col("start") + F.col("place")
    crossed = F.floor(rate * rank + offset) - F.floor(rate * (rank - 1) + offset)
    return (
        keyed.withColumn("place", F.row_number().over(place))
        .alias("k")
        .join(
            starts.alias("s"),
            F.col("k.source").eqNullSafe(F.col("s.source"))
            & (F.col("k.size") == F.col("s.size"))
            & (F.col("k.run") == F.col("s.run")),
        )
        .select("k.*", "source_size", "target", F.least(F.lit(cap).cast("long"), crossed).alias("copies"))
        .drop("run", "place")
    )


def _sized(docs: DataFrame, seed: str, *more: Column) -> DataFrame:
    order = _digits(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), order.alias("order"), *more)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """How much of every document the mix takes.

    Returns ``doc_id, size, source_size, target, taken`` for each row: words of
    the document and of its source, the source's target and the words taken,
    repeats counted.  Reruns agree, whatever the partitions.  Null texts have
    size 0, a null source is a source of its own, null doc_ids are rows like
    any other, and rows that repeat may get different copies.  No rows give
    none; other columns are ignored.
    """
    sized = staged(_sized(docs, seed), "sizes")
    return _copies(sized, weights, cap, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: all columns of ``docs``, each row as often as it is taken.

    Documents without words add none, so they are left out.  Null doc_ids and
    sources, rows that repeat and clashing column names are handled as in :func:`mix`.
    """
    # Rows that share doc_id, source and text are told apart by number only, in an order that reruns repeat.
    key = F.struct("doc_id", "source", F.xxhash64("text").alias("print"))
    sized = staged(_sized(docs, seed, key.alias("key")), "sizes")
    numbered = F.row_number().over(Window.partitionBy("key").orderBy("copies"))
    dealt = _copies(sized, weights, cap, seed).select("key", "size", "copies", numbered.alias("nth")).filter("copies > 0 and size > 0")
    whole = F.struct(*[f"`{c}`" for c in docs.columns]).alias("row")
    print_of_row = F.xxhash64(*[f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind])
    rows = docs.select(key.alias("key"), whole, print_of_row.alias("order"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("order")))
    copies = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return rows.join(dealt, ["key", "nth"]).select("row", F.explode(copies)).select("row.*")
