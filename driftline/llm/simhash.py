"""SimHash near-duplicates through pivot distance tables.

A fingerprint sums up the word shingles of a whole text.  Distances of each
distinct fingerprint to a fixed set of reference fingerprints ("pivots") form
its row of the pivot table.  By the triangle inequality, two fingerprints at
distance ``r`` differ by at most ``r`` in every coordinate, so pairs with a
larger coordinate difference are discarded unseen and the rest are verified.

The pivots come in four groups; within a group they differ only inside one
quarter of the bits.  The differences between the coordinates of one group
therefore depend on that quarter alone.  Two differing bits spoil at most two
quarters, so any pair within the radius agrees in these differences for at
least two whole groups: they serve as an equality key, which the join needs to
avoid comparing everything with everything.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.components import connected_components
from driftline.llm.storage import staged
from driftline.llm.textbatch import lowered, runs, shingles, split_words, utf8, xxh64

RADIUS = 2
SHINGLE_WORDS = 3
QUARTERS = 4
PIVOTS_PER_QUARTER = 8

#: Bit i of a byte in lane i, so that byte lanes of sums are counts by bit.
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def pivots(seed: int = 11) -> list[list[int]]:
    """Reference fingerprints by quarter; a group's members agree outside its quarter."""
    rng = random.Random(seed)
    groups = []
    for quarter in range(QUARTERS):
        base = rng.getrandbits(64)
        # Masks of one half of the quarter's bits keep coordinates near the middle, where they vary most.
        masks = [sum(1 << bit for bit in rng.sample(range(16), 8)) for _ in range(PIVOTS_PER_QUARTER - 1)]
        groups.append([base] + [base ^ (m << (16 * quarter)) for m in masks])
    return groups


def majority_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A fingerprint per row: bit set if it is in over half of the row's hashes."""
    n = len(bounds) - 1
    counts = np.diff(bounds)
    totals = np.zeros((n, 64), dtype=np.int64)
    if len(hashes):
        # Byte lanes hold at most 255, so sums run over pieces of that length first.
        pieces = -(-counts // 255)
        row = np.repeat(np.arange(n), pieces)
        begin = np.cumsum(pieces) - pieces
        cut = bounds[:-1][row] + 255 * (np.arange(len(row)) - begin[row])
        octets = hashes.view(np.uint8).reshape(-1, 8)
        lanes = np.empty((len(cut), 8), dtype=np.uint64)
        for k in range(8):
            lanes[:, k] = np.add.reduceat(_SPREAD[octets[:, k]], cut)
        full = np.flatnonzero(counts)
        totals[full] = np.add.reduceat(lanes.view(np.uint8).reshape(len(cut), 64).astype(np.int64), begin[full], axis=0)
    bits = 2 * totals > counts[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = utf8(batch.column("text"))
        found = []
        for lo, hi in runs(offsets):
            part = lowered(buf[offsets[lo] : offsets[hi]])
            words = split_words(part, offsets[lo : hi + 1] - offsets[lo])
            starts, lens, bounds = shingles(words, size)
            found.append(majority_bits(xxh64(words.buf, starts, lens), bounds))
        bits = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("print"), pa.array(bits)], ["doc_id", "print", "bits"]
        )


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, print, bits)``: the 64-bit SimHash of every whole text, and a plain hash of it, as signed longs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("print"), "text").mapInArrow(
        lambda batches: _fingerprint_batches(batches, size), f"doc_id {kind}, print long, bits long"
    )


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def pivot_table(bits: DataFrame) -> DataFrame:
    """Distances of distinct ``bits`` to all pivots, packed eight to a long, and their group keys."""
    groups = pivots()
    packed, keys = [], []
    for g, group in enumerate(groups):
        row = [F.bit_count(F.col("bits").bitwiseXOR(_signed(p))) for p in group]
        lanes = [F.shiftleft(d.cast("long"), 8 * i) for i, d in enumerate(row)]
        total = lanes[0]
        for lane in lanes[1:]:
            total = total + lane
        packed.append(total.alias(f"d{g}"))
        keys.append(F.xxhash64(F.lit(g), *[d - row[0] for d in row[1:]]).alias(f"g{g}"))
    return bits.select("bits", *packed, *keys)


def near_pairs(bits: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints at ``radius`` or less (2 at most)."""
    if not 0 <= radius <= QUARTERS - 2:
        raise ValueError(f"the four groups of pivots serve radii up to {QUARTERS - 2}")
    table = pivot_table(bits)
    keyed = table.select(
        "bits",
        *[f"d{g}" for g in range(QUARTERS)],
        F.explode(
            F.array(*[F.xxhash64(f"g{i}", f"g{j}") for i, j in combinations(range(QUARTERS), 2)])
        ).alias("key"),
    )
    left, right = keyed.alias("x"), keyed.alias("y")
    # The largest coordinate difference over the pivot table, then the true distance.
    apart = F.greatest(
        *[
            F.abs(
                F.shiftright(f"x.d{g}", 8 * i).bitwiseAND(255) - F.shiftright(f"y.d{g}", 8 * i).bitwiseAND(255)
            )
            for g in range(QUARTERS)
            for i in range(PIVOTS_PER_QUARTER)
        ]
    )
    verified = F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits"))) <= radius
    return (
        left.join(
            right,
            (F.col("x.key") == F.col("y.key")) & (F.col("x.bits") < F.col("y.bits")) & (apart <= radius) & verified,
        )
        .select(F.col("x.bits").alias("a"), F.col("y.bits").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprint and near-duplicate class of every document.

    Returns ``doc_id, print, bits, fingerprint`` (16 hex digits) and ``component_id``,
    the smallest doc_id in reach over links between fingerprints that differ in
    ``radius`` bits or fewer.  Null and empty texts have fingerprint zero and
    link like any other.  Repeated rows are returned as often as they come; a
    null doc_id stays null and is never the smallest of a class that has
    others.  Columns other than doc_id and text are ignored; no rows give none.
    """
    marked = staged(fingerprints(docs, size), "simhash")
    # Equal fingerprints are one node: large groups of copies become a row before any join.
    nodes = staged(marked.groupBy("bits").agg(F.min("doc_id").alias("lowest")), "simhash-nodes")
    labels = connected_components(near_pairs(nodes.select("bits"), radius))
    reach = nodes.join(labels.withColumnRenamed("node", "bits"), "bits", "left").withColumn(
        "label", F.coalesce("label", "bits")
    )
    classes = reach.groupBy("label").agg(F.min("lowest").alias("component_id"))
    named = reach.select("bits", "label").join(classes, "label").select("bits", "component_id")
    return marked.join(named, "bits").select(
        "doc_id", "print", "bits", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each near-duplicate class of ``docs``, with all its columns.

    The smallest doc_id of the class stays, among its rows the one with the
    smallest text hash; null doc_ids stay only where a class has no other.
    """
    found = near_duplicates(docs, radius, size)
    # A class without any doc_id has no component_id and is known by its fingerprint.
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("bits")).alias("bits"))
    key = F.struct("doc_id", "print")
    stays = (
        found.withColumn("order", F.struct(F.col("doc_id").isNull().alias("last"), key.alias("key")))
        .groupBy(group)
        .agg(F.min("order").alias("first"))
        .select(F.col("first.key").alias("key"))
    )
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("print")).alias("key"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    # Rows that share doc_id and text differ at most in other columns; any one of them stays.
    return rows.join(stays, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
