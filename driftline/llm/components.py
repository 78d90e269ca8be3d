"""Connected components by alternating large-star and small-star rounds.

Each round replaces the edges around a node by edges to the smallest node in
reach; hubs are pre-aggregated by ``min`` before they are joined, and every
round is written to shared storage, so lineage stays short and no part of the
graph visits the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.storage import fresh_path, scratch, staged


#: Graphs of so many edges or fewer are labelled by one task, without rounds.
IN_ONE_TASK = 500_000


def _columns(nodes: pa.Array) -> np.ndarray:
    """Rows of whole numbers that order as the nodes do."""
    parts = nodes.flatten() if pa.types.is_struct(nodes.type) else [nodes]
    return np.stack([p.to_numpy(zero_copy_only=False).astype(np.int64) for p in parts], axis=1)


def _numbers(kind: T.DataType) -> bool:
    """Whether nodes are whole numbers or structs of them."""
    if isinstance(kind, T.StructType):
        return all(isinstance(f.dataType, (T.IntegerType, T.LongType)) for f in kind.fields)
    return isinstance(kind, (T.IntegerType, T.LongType))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of a whole graph of edges (a, b): labels fall to the smallest in reach, halving paths."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    a, b = (table.column(c).chunk(0) for c in ("a", "b"))
    both = pa.concat_arrays([a, b])
    _, at, number = np.unique(_columns(both), axis=0, return_index=True, return_inverse=True)
    number = number.ravel()
    x, y = number[: len(a)], number[len(a) :]
    root = np.arange(len(at))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        for side in (root[x], root[y]):
            np.minimum.at(root, side, low)
        root = root[root]
    while (root[root] != root).any():
        root = root[root]
    yield pa.RecordBatch.from_arrays([both.take(pa.array(at)), both.take(pa.array(at[root]))], ["node", "label"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges ``(a > b)``; returns such edges again."""
    if large:
        around = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    lowest = around.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    linked = around.join(lowest, "a")
    if large:
        moved = linked.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = linked.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(
            lowest.select("a", F.col("low").alias("b"))
        )
    return moved.filter("a <> b").distinct()


def _round(edges: DataFrame) -> DataFrame:
    path = fresh_path(edges.sparkSession, "stars")
    with scratch(edges.sparkSession):
        rows = _star(staged(_star(edges, True), "stars"), False)
        rows.write.parquet(path)
    return edges.sparkSession.read.schema(rows.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """Label the nodes of undirected ``edges (a, b)`` with their component's smallest node.

    Returns ``(node, label)`` for every node that has an edge to another node.
    Nulls and loops are ignored, repeated edges count once, and no edges give
    no rows.  Nodes may have any orderable type.
    """
    now = staged(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    kind = now.schema["a"].dataType
    if _numbers(kind) and now.count() <= IN_ONE_TASK:
        schema = T.StructType([T.StructField("node", kind), T.StructField("label", kind)])
        return now.coalesce(1).mapInArrow(_labelled, schema)
    while now.limit(1).count():
        # Done when every edge is a leaf to its root: one edge a leaf, and no root is a leaf.
        roots = now.select(F.col("b").alias("a")).distinct()
        deep = now.join(roots, "a", "left_semi").limit(1).count()
        split = now.groupBy("a").count().filter("count > 1").limit(1).count()
        if not deep and not split:
            break
        now = _round(now)
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return leaves.unionAll(leaves.select(F.col("label").alias("node"), "label").distinct())
