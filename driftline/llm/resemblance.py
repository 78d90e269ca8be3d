"""Near-duplicate texts: SimHash pairs, completed to every pair of a given resemblance of word shingles.

SimHash finds the closest texts.  At a Jaccard similarity of 0.8, though, 64-bit
fingerprints of near-duplicates differ in about ten bits and some in twenty, as
many as those of strangers, so no radius finds them all and prunes.  The other
pairs are found exactly: two sets whose similarity reaches the threshold share
one of their first ``n - ceil(threshold * n) + 1`` elements under any common
order (prefix filter, Chaudhuri et al. 2006).  Shingles of very many texts come
last in the order: a passage that texts have in common then rarely brings them
together.

Texts that meet are compared by parity bitmaps first.  Bits that differ are no
more than elements that do (Sandes et al. 2017), so pairs that differ in too
many are discarded without a loss.  The rest are verified by their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm import simhash
from driftline.llm.components import connected_components
from driftline.llm.storage import settled, staged
from driftline.llm.textbatch import lowered, runs, shingles, split_words, utf8, xxh64

SHINGLE_WORDS = 5
#: Least similarity of near-duplicates, in fifths: 0.8.
FIFTHS = 4
#: Shingles of so many texts or more come last in the order, the most frequent ones up to a bound on what tasks are sent.
#: The order decides how many texts meet, not which pairs are found.
COMMON = 200
MOST_COMMON = 1_000_000
#: Where so many texts or more have a key, they are compared with ``HUBS`` of them in two rounds before those still apart
#: are compared with each other.
LARGE = 64
HUBS = 8
#: Texts that a task remembers, so copies in it count once; beyond, repeats cost rows, not results.
REMEMBERED = 200_000
#: Texts are cut into words and hashed in runs of about this many bytes, which bounds temporaries.
RUN_BYTES = 512 << 10
#: Pairs whose sets are in memory at once.
VERIFIED = 256
#: Keys that a task counts at once.
COUNTED = 500_000


def shingle_sets(column: pa.Array, common: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, shingles, bounds of the rows in them, fingerprints) of runs of texts; a row's shingles are distinct and in order."""
    buf, offsets = utf8(column)
    for lo, hi in runs(offsets, RUN_BYTES):
        words = split_words(lowered(buf[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo])
        starts, lens, bounds = shingles(words, SHINGLE_WORDS)
        hashed = xxh64(words.buf, starts, lens)
        prints = simhash.majority_bits(hashed, bounds).view(np.int64)
        value = (hashed >> np.uint64(1)).astype(np.int64)
        row = np.repeat(np.arange(hi - lo), np.diff(bounds))
        last = np.isin(value, common)
        order = np.lexsort((value, last, row))
        value, row = value[order], row[order]
        fresh = np.append(True, (np.diff(value) != 0) | (np.diff(row) != 0))[: len(value)]
        yield lo, value[fresh], np.searchsorted(row[fresh], np.arange(hi - lo + 1)), prints


def _prefix_sizes(n: np.ndarray) -> np.ndarray:
    return n - (FIFTHS * n + 4) // 5 + (n > 0)


def _each_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task whose text hasn't been seen in it."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        fresh = []
        for i, pair in enumerate(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)):
            if pair not in seen:
                seen.add(pair)
                fresh.append(i)
        if len(seen) > REMEMBERED:
            seen.clear()
        yield batch.take(pa.array(fresh, pa.int64()))


def _frequent_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): shingles that open, in twice the prefix, more than one text of a task."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, size = [keys], 0
    none = np.zeros(0, np.int64)

    def merged() -> tuple[np.ndarray, np.ndarray]:
        fresh, n = np.unique(np.concatenate(held), return_counts=True)
        both, at = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
        return both, np.bincount(at, weights=np.concatenate([counts, n])).astype(np.int64)

    for batch in _each_once(batches):
        for _, value, bounds, _ in shingle_sets(batch.column("text"), none):
            n = np.diff(bounds)
            many = np.minimum(2 * _prefix_sizes(n), n)
            row = np.repeat(np.arange(len(n)), many)
            held.append(value[bounds[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)])
            size += len(row)
        if size > COUNTED:
            keys, counts = merged()
            if len(keys) > 2 * COUNTED:  # rare ones so far are dropped: only the order depends on it
                keys, counts = keys[counts > 1], counts[counts > 1]
            held, size = [none], 0
    keys, counts = merged()
    often = counts > 1
    yield pa.RecordBatch.from_arrays([pa.array(keys[often]), pa.array(counts[often])], ["key", "n"])


def _parity(value: np.ndarray) -> np.ndarray:
    """Bit ``v mod size`` is the parity of the elements there; the size is a power of two, four bits an element or more."""
    size = 64
    while size < 4 * len(value):
        size *= 2
    odd = np.bincount(value & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _short_parity(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Four longs a row: the same for 256 places, whatever the size."""
    n = len(bounds) - 1
    place = np.repeat(np.arange(n), np.diff(bounds)) * 256 + (value & 255)
    odd = (np.bincount(place, minlength=256 * n) & 1).astype(bool)
    return np.packbits(odd.reshape(n, 256), axis=1, bitorder="little").view(np.int64)


SHORT = ["p0", "p1", "p2", "p3"]
_ROW = "kind tinyint, key long, h1 long, h2 long, n int, bits long, parity array<long>, " + ", ".join(f"{p} long" for p in SHORT)
_NAMES = ["kind", "key", "h1", "h2", "n", "bits", "parity", *SHORT]


def _key_batches(batches: Iterator[pa.RecordBatch], common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Kind 0: a row (key, h1, h2, n) for each element of a text's prefix; texts without words meet in key -1.

    Kind 1: a row (h1, h2, n, bits, parity) for each text, its fingerprint and bitmap.
    """
    for batch in _each_once(batches):
        h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
        for lo, value, bounds, prints in shingle_sets(batch.column("text"), common):
            n = np.diff(bounds)
            many = _prefix_sizes(n)
            row = np.repeat(np.arange(len(n)), many)
            key = value[bounds[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
            row = np.append(row, np.flatnonzero(n == 0))
            key = np.append(key, np.full(len(row) - len(key), -1))
            nothing = [pa.nulls(len(row), kind) for kind in (pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * 4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(row), np.int8)), pa.array(key), pa.array(h1[lo + row]), pa.array(h2[lo + row]), pa.array(n[row].astype(np.int32)), *nothing],
                _NAMES,
            )
            maps = [_parity(value[bounds[i] : bounds[i + 1]]) for i in range(len(n))]
            ends = np.cumsum([len(m) for m in maps])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.concatenate(maps)))
            mine = slice(lo, lo + len(n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(n), np.int8)), pa.array(h1[mine]), pa.array(h1[mine]), pa.array(h2[mine]), pa.array(n.astype(np.int32)), pa.array(prints), lists, *[pa.array(c) for c in _short_parity(value, bounds).T]],
                _NAMES,
            )


def _similar(a: str, b: str) -> Column:
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return 5 * F.least(n, m) >= FIFTHS * F.greatest(n, m)


def _few_enough(differ: Column, a: str, b: str) -> Column:
    return (5 + FIFTHS) * differ <= (5 - FIFTHS) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _shortly(a: str, b: str) -> Column:
    """Whether texts may be similar enough by their sizes and short bitmaps."""
    differ = sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in SHORT[1:]), F.bit_count(F.col(f"{a}.p0").bitwiseXOR(F.col(f"{b}.p0"))))
    return _similar(a, b) & _few_enough(differ, a, b)


def _may_be_near(a: str, b: str) -> Column:
    """Whether texts with columns n and parity under ``a`` and ``b`` may be similar enough, by size and differing bits."""
    size = F.least(F.size(f"{a}.parity"), F.size(f"{b}.parity"))

    def folded(name: str) -> Column:
        # Similar sizes differ by one doubling at most.
        whole = F.col(f"{name}.parity")
        halves = F.zip_with(F.slice(whole, F.lit(1), size), F.slice(whole, size + 1, size), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(whole) == size, whole).otherwise(halves)

    differ = F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return _similar(a, b) & _few_enough(F.aggregate(differ, F.lit(0), lambda s, x: s + x), a, b)


def _verified(met: DataFrame, maps: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of those met, once each, that are near-duplicates."""
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    x = maps.select(F.col("node").alias("a"), F.struct("n", "parity").alias("x"))
    y = maps.select(F.col("node").alias("b"), F.struct("n", "parity").alias("y"))
    met = staged(met.join(x, "a").join(y, "b").filter(_may_be_near("x", "y")).select("a", "b"), "text-pairs")
    wanted = met.select("a.*").unionAll(met.select("b.*")).distinct()
    found = texts.join(wanted, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    found = staged(found.select(F.struct("h1", "h2").alias("key"), "text"), "met-texts")
    none = np.zeros(0, np.int64)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, VERIFIED):
                batch = whole.slice(lo, VERIFIED)
                sets = []
                for name in ("x", "y"):
                    mine = []
                    for _, value, bounds, _ in shingle_sets(batch.column(name), none):
                        mine += [value[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1)]
                    sets.append(mine)
                near = []
                for x, y in zip(*sets, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    near.append(5 * both >= FIFTHS * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    kind = "struct<h1: bigint, h2: bigint>"
    x = found.select(F.col("key").alias("a"), F.col("text").alias("x"))
    y = found.select(F.col("key").alias("b"), F.col("text").alias("y"))
    return met.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(verify, f"a {kind}, b {kind}")


def _simhash_pairs(maps: DataFrame) -> DataFrame:
    """``(a, b)``: texts of equal fingerprints beside the first of them, and the first texts of near fingerprints."""
    firsts = staged(maps.groupBy("bits").agg(F.min("node").alias("first")), "first-of-print")
    same = maps.join(firsts, "bits").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = simhash.near_pairs(firsts.select("bits"))
    a = firsts.select(F.col("bits").alias("a"), F.col("first").alias("x"))
    b = firsts.select(F.col("bits").alias("b"), F.col("first").alias("y"))
    return same.unionByName(near.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))


def near_classes(texts: DataFrame, common: int = COMMON) -> DataFrame:
    """``(node, label)``: classes of texts connected by a similarity of 0.8 or more, of nodes with a near-duplicate.

    ``texts`` has columns h1, h2 (two hashes that stand for the text) and text,
    each text once or more.  Of a key all texts are compared with one of them
    first.  Where many have a key and are in several classes, they are compared
    with ``HUBS`` of them, drawn by hash, then with those that have most
    near-duplicates, and only after that with all that are still apart.  So a
    large group of near copies doesn't cost its square, and every near pair
    ends up in one class.
    """
    spark = texts.sparkSession
    texts = texts.select("h1", "h2", "text")
    often = texts.mapInArrow(_frequent_batches, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    often = often.filter(F.col("n") >= common).orderBy(F.desc("n"), "key").limit(MOST_COMMON).select("key").collect()
    last = spark.sparkContext.broadcast(np.array(sorted(r.key for r in often), np.int64))
    rows = texts.mapInArrow(lambda b: _key_batches(b, last.value), _ROW)
    # One shuffle by key; what only one text has goes no further.
    rows = rows.repartition("key", "kind").dropDuplicates(["key", "kind", "h1", "h2"]).withColumn("node", F.struct("h1", "h2"))
    key = Window.partitionBy("key", "kind")
    rows = rows.withColumns({"many": F.count(F.lit(1)).over(key), "first": F.min("node").over(key)})
    rows = staged(rows.filter("kind = 1 OR many > 1").select("kind", "key", "node", "n", "bits", "parity", *SHORT, "first", "many"), "text-keys")
    maps = rows.filter("kind = 1").select("node", "n", "bits", "parity", *SHORT)
    keyed = rows.filter("kind = 0").select("key", "node", "first", "many")
    star = keyed.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    pairs = settled(spark, "near-texts", lambda: _verified(star.unionByName(_simhash_pairs(maps)), maps, texts))
    large = keyed.filter(F.col("many") >= LARGE)
    rounds = [[], [F.desc("degree")]] if large.limit(1).count() else []
    for nth, place in enumerate([*rounds, None]):
        known = pairs
        left = settled(spark, "texts-apart", lambda: _apart(keyed if place is None else large, known, maps))  # noqa: B023
        if not left.limit(1).count():
            continue
        met = (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & _shortly("x", "y")
        if place is None:
            others, met = left, met & (F.col("x.node") < F.col("y.node"))
        else:
            order = Window.partitionBy("key").orderBy(*place, F.xxhash64(F.lit(nth), "node"), "node")
            others = left.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= HUBS)
        found = left.alias("x").join(others.alias("y"), met).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        pairs = settled(spark, "near-texts", lambda: known.unionByName(_verified(found, maps, texts)))  # noqa: B023
    return connected_components(pairs)


def _apart(keyed: DataFrame, pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """``key, node, label, degree, n`` and the short bitmap of texts of the keys whose texts are in several classes."""
    labels = connected_components(pairs)
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))
    labels = labels.join(ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "node")
    labelled = keyed.select("key", "node").join(labels, "node", "left")
    labelled = labelled.select("key", "node", F.coalesce("label", "node").alias("label"), F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
    several = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    left = labelled.join(several.select("key"), "key", "left_semi").join(maps.select("node", "n", *SHORT), "node")
    return left.select("key", "node", "label", "degree", "n", *SHORT)


def without_near_duplicates(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """One row of each class of near-duplicate ``docs``, with all its columns.

    The smallest doc_id of the class stays, among its rows the one with the
    smallest text hash; null doc_ids stay only where a class has no other.
    Null texts count as empty, and texts without words are one class.  Any other
    columns and empty tables are fine.
    """
    text = F.coalesce("text", F.lit(""))
    hashes = F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")
    named = docs.select("doc_id", *hashes, text.alias("text"))
    classes = near_classes(named, common)
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.struct("doc_id", "h1", "h2").alias("key"))
    # First row of each text, then of each class: large groups of copies shrink before they are joined.
    firsts = named.groupBy("h1", "h2").agg(F.min(order).alias("first")).withColumn("node", F.struct("h1", "h2"))
    stays = (
        firsts.join(classes, "node", "left")
        .groupBy(F.coalesce("label", "node").alias("label"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.key").alias("key"))
    )
    rows = docs.select(F.struct("doc_id", *hashes).alias("key"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    # Rows that share doc_id and text differ at most in other columns; any one of them stays.
    return rows.join(stays, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
