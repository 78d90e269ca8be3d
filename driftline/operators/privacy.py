"""Anonymisation of positions and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.geo import geohash_encode


def pseudonym(identifier: Column, salt: str, length: int = 16) -> Column:
    """The first hex digits of SHA-256 over ``identifier:salt``."""
    return F.substring(F.sha2(F.concat_ws(":", identifier.cast("string"), F.lit(salt)), 256), 1, length)


def anonymize(points: DataFrame, precision: int = 6) -> DataFrame:
    """``geohash, precision, cluster_size`` of every point's cell, in order of first appearance by ``ord``."""
    cells = points.groupBy(geohash_encode("lat", "lon", precision).alias("geohash")).agg(
        F.count(F.lit(1)).alias("cluster_size"), F.min("ord").alias("first_ord")
    )
    return cells.withColumn("precision", F.lit(precision))


def k_anonymity(points: DataFrame, k: int, precision: int = 6) -> DataFrame:
    """``cells, total, least, ratio, all_ok`` of the cells' sizes; an empty table has ratio 0 and passes."""
    cells = anonymize(points, precision)
    ok = F.col("cluster_size") >= k
    return cells.agg(
        F.count(F.lit(1)).alias("cells"),
        F.coalesce(F.sum("cluster_size"), F.lit(0)).alias("total"),
        F.coalesce(F.min("cluster_size"), F.lit(0)).alias("least"),
        F.coalesce(F.avg(ok.cast("int")), F.lit(0.0)).alias("ratio"),
        F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_ok"),
    )


def generalized_precision(points: DataFrame, k: int, keys: list[str], start: int = 7, floor: int = 2) -> DataFrame:
    """Per key the finest precision whose every cell has ``k`` points, ``floor`` if there is none."""
    levels = F.array(*[F.struct(F.lit(n).alias("p"), geohash_encode("lat", "lon", n).alias("g")) for n in range(start, floor - 1, -1)])
    cells = points.select(*keys, F.explode(levels).alias("x")).groupBy(*keys, "x.p", "x.g").agg(F.count(F.lit(1)).alias("n"))
    least = cells.groupBy(*keys, "p").agg(F.min("n").alias("least"))
    return least.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("least") >= k, F.col("p"))), F.lit(floor)).alias("precision"))


def noisy(points: DataFrame, epsilon: float, key: str = "ord", seed: str = "n") -> DataFrame:
    """Positions with Laplace noise of scale ``0.01 / epsilon`` degrees on each axis, kept on the globe.

    The noise follows from a hash of the row's key, so a task that runs again adds the same.
    """

    def laplace(axis: str) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(axis), F.col(key).cast("string")).cast("binary")), 1, 12), 16, 10)
        u = (bits.cast("double") + 0.5) / float(1 << 48) - 0.5
        return -0.01 / epsilon * F.signum(u) * F.log1p(-2 * F.abs(u))

    def bounded(x: Column, limit: float) -> Column:
        return F.least(F.lit(limit), F.greatest(F.lit(-limit), x))

    return points.withColumns(
        {"lat": bounded(F.col("lat") + laplace("lat"), 90.0), "lon": bounded(F.col("lon") + laplace("lon"), 180.0)}
    )
