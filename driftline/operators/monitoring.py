"""Drift and latency figures over metric and request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def positions(rows: DataFrame, key: str, order: list[str], parts: int = 64) -> DataFrame:
    """Rows with ``rn``, their place from 1 within ``key`` in ``order``, and ``n``, the rows of the key.

    A key may hold most rows, so it isn't sorted in one task: rows are cut at
    approximate quantiles of the first order column, numbered within each piece,
    and pieces start where the ones before them end.
    """
    first = F.col(order[0])
    number = F.unix_micros(first.cast("timestamp")).cast("double") if dict(rows.dtypes)[order[0]].startswith("timestamp") else first.cast("double")
    cuts = rows.groupBy(key).agg(F.percentile_approx(number, F.lit([i / parts for i in range(1, parts)]), F.lit(1000)).alias("__cuts"))
    piece = F.size(F.filter("__cuts", lambda c: c < number))
    dealt = rows.join(cuts, key).withColumn("__piece", piece).drop("__cuts")
    sizes = dealt.groupBy(key, "__piece").agg(F.count(F.lit(1)).alias("__m"))
    before = Window.partitionBy(key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumns({"__start": F.coalesce(F.sum("__m").over(before), F.lit(0).cast("long")), "n": F.sum("__m").over(Window.partitionBy(key))}).drop("__m")
    inside = F.row_number().over(Window.partitionBy(key, "__piece").orderBy(*order))
    numbered = dealt.withColumn("__in", inside).join(starts, [key, "__piece"])
    return numbered.withColumn("rn", F.col("__in") + F.col("__start")).drop("__in", "__start", "__piece")


def latency(requests: DataFrame, keys: list[str], value: str, failed: Column | None = None) -> DataFrame:
    """Per key: requests, mean, median, nearest-rank p95 and p99, and errors.

    Ranks come from the counts of equal values, so a key's requests are added up before they meet.
    """
    bad = F.count_if(failed if failed is not None else F.lit(False))
    counts = requests.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__m"), bad.alias("__bad"))
    upto = F.sum("__m").over(Window.partitionBy(*keys).orderBy(value))
    counts = counts.withColumns({"__to": upto, "__n": F.sum("__m").over(Window.partitionBy(*keys))})

    def ranked(q: float) -> Column:
        rank = F.least(F.floor(F.col("__n") * q), F.col("__n") - 1)
        return F.min(F.when(F.col("__to") > rank, F.col(value)))

    return counts.groupBy(*keys).agg(
        F.sum("__m").alias("count"),
        (F.sum(F.col(value) * F.col("__m")) / F.sum("__m")).alias("mean"),
        F.expr(f"percentile(`{value}`, 0.5, __m)").alias("p50"),
        ranked(0.95).alias("p95"),
        ranked(0.99).alias("p99"),
        F.sum("__bad").alias("errors"),
    )


def severity(change: Column, threshold: float) -> Column:
    return (
        F.when(change < threshold / 2, "none").when(change < threshold, "low").when(change < 2 * threshold, "medium").otherwise("high")
    )


def drift(baseline: Column, current: Column, threshold: float) -> Column:
    """``struct(change, severity, detected)`` of two means; from a zero baseline the change is the current mean."""
    change = F.when(baseline == 0, F.abs(current)).otherwise(F.abs(current - baseline) / F.abs(baseline))
    return F.struct(change.alias("change"), severity(change, threshold).alias("severity"), (change >= threshold).alias("detected"))


def exposition(stats: DataFrame, metric: str, key: str, value: str) -> DataFrame:
    """Lines of the text format that metric scrapers read."""
    line = F.concat(F.lit(f'{metric}{{{key}="'), F.col(key), F.lit('"} '), F.col(value).cast("string"))
    return stats.select(line.alias("line"))


def population_stability(expected: DataFrame, actual: DataFrame, value: str, buckets: int = 10, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Population stability index over equal buckets of [low, high]; values outside count in totals only."""
    width = (high - low) / buckets
    spark = expected.sparkSession

    def shares(df: DataFrame, name: str) -> DataFrame:
        inside = F.col(value).between(low, high)
        bucket = F.when(inside, F.least(F.floor((F.col(value) - low) / width), F.lit(buckets - 1)).cast("int"))
        counted = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
        total = F.sum("n").over(Window.partitionBy(F.lit(0)))
        return counted.withColumn(name, F.col("n") / total).filter("b IS NOT NULL").select("b", name)

    grid = spark.range(buckets).select(F.col("id").cast("int").alias("b"))
    rows = grid.join(F.broadcast(shares(expected, "e")), "b", "left").join(F.broadcast(shares(actual, "a")), "b", "left")
    e, a = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-4)) for c in ("e", "a"))
    return rows.agg(F.sum((a - e) * F.log(a / e)).alias("psi"))
