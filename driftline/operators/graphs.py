"""Connected components of pairs, over shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _written(df: DataFrame) -> DataFrame:
    """The rows as a table in the session's shared folder, so rounds don't grow the plan; cached where none is set, as in tests."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/driftline-graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(pairs: DataFrame) -> DataFrame:
    """``(node, label)``: each node of undirected pairs ``(a, b)`` with the smallest node that it reaches.

    In every round a node takes the smallest label around it, then the label of
    that label, so long chains halve; the rounds end when no label falls.
    Nulls and loops are ignored; repeated pairs count once; no pairs give no rows.
    """
    edges = pairs.filter("a <> b").select("a", "b")
    both = _written(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = _written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        around = both.join(now, both.b == now.node).groupBy("a").agg(F.min("label").alias("low"))
        lower = now.join(around, F.col("node") == F.col("a")).select("node", "label", F.least("label", "low").alias("low"))
        above = now.select(F.col("node").alias("low"), F.col("label").alias("far"))
        moved = _written(lower.join(above, "low").select("node", "label", F.least("low", "far").alias("new")))
        if not moved.filter("new <> label").limit(1).count():
            return now
        now = moved.select("node", F.col("new").alias("label"))
