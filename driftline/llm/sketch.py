"""Bottom-k document fingerprints.

A fingerprint keeps the ``k`` smallest distinct XXH64 values of a text's word
shingles.  Sketches of parts merge into the sketch of the whole, and two of
them estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.textbatch import lowered, runs, shingles, split_words, utf8, xxh64

#: The standard error of a likeness is at most 0.5 / sqrt(K).
K = 128
SHINGLE_WORDS = 5


# --- sketches as sorted arrays of unsigned 64-bit hashes ---


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The ``k`` smallest distinct values in ascending order."""
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness; two empty sketches are alike, an empty and another aren't."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, shared, assume_unique=True).sum() / len(both))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    if len(a) < k:
        return float(len(a))
    return (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has too; 1 for an empty ``a``."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return float(min(1.0, shared / distinct_count(a, k)))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode("ascii")


def decode(text: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text or ""), "<u8")


def sketches(buf: np.ndarray, offsets: np.ndarray, k: int = K, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sketch of every row of a batch."""
    found: list[np.ndarray] = []
    for lo, hi in runs(offsets):
        part = lowered(buf[offsets[lo] : offsets[hi]])
        words = split_words(part, offsets[lo : hi + 1] - offsets[lo])
        starts, lens, bounds = shingles(words, size)
        hashes = xxh64(words.buf, starts, lens)
        cuts = bounds.tolist()
        found += [bottom(hashes[s:e], k) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
    return found


# --- Spark operators ---


def fingerprint(docs: DataFrame, k: int = K, size: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fingerprint)`` of every whole text; null and wordless texts have the empty sketch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [encode(s) for s in sketches(*utf8(batch.column("text")), k, size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "fingerprint"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, fingerprint string")


def merged(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """``(key, fingerprint, n_shingles)``: the sketches of each key's parts merged into one.

    Every task first merges what it holds, so a key sends one sketch a task at
    most, however many parts it has.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[name] = merge(held.get(name, np.zeros(0, np.uint64)), decode(text), k)
            if len(held) > 50_000:
                yield pack(held)
                held = {}
        yield pack(held)

    kind = parts.schema[key].dataType

    def pack(held: dict) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), to_arrow_type(kind)), pa.array([encode(s) for s in held.values()], pa.string())],
            ["key", "fingerprint"],
        )

    def final(table: pa.Table) -> pa.Table:
        whole = np.zeros(0, np.uint64)
        for text in table.column("fingerprint").to_pylist():
            whole = merge(whole, decode(text), k)
        return pa.table(
            {"key": table.column("key")[:1], "fingerprint": [encode(whole)], "n_shingles": [distinct_count(whole, k)]}
        )

    spelled = kind.simpleString()
    return (
        parts.select(F.col(key).alias("key"), "fingerprint")
        .mapInArrow(local, f"key {spelled}, fingerprint string")
        .groupBy("key")
        .applyInArrow(final, f"key {spelled}, fingerprint string, n_shingles double")
        .withColumnRenamed("key", key)
    )


# --- each document against its edited text and the next document ---


def _half_replaced(buf: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Edited texts of rows 0..n-2 from row i and row i + 1, and code points of all rows."""
    heads = np.flatnonzero((buf & 0xC0) != 0x80)
    first = np.searchsorted(heads, offsets)
    chars = np.diff(first)
    # Byte position of any code point; one past the last is the end of the buffer.
    at = np.append(heads, len(buf))
    raw = buf.tobytes()
    edited = []
    begin, start = offsets.tolist(), first.tolist()
    for i, n in enumerate(chars[:-1].tolist()):
        half = n // 2
        kept = raw[begin[i] : int(at[start[i] + n - half]) if half else begin[i + 1]]
        take = min(half, int(chars[i + 1]))
        stop = int(at[start[i + 1] + take]) if take < chars[i + 1] else begin[i + 2]
        edited.append(kept + raw[begin[i + 1] : stop])
    return edited, chars


def _compared(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (deal, guest, doc_id); the last row of a deal is a guest that closes it."""
    held: pa.Table | None = None
    names = ["deal", "guest", "doc_id", "text"]
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).select(names)
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        held = table.slice(table.num_rows - 1)
        buf, offsets = utf8(table.column("text"))
        n = table.num_rows
        for lo, hi in runs(offsets[:n]):  # rows but the last, each with its successor
            part, at = buf[offsets[lo] : offsets[hi + 1]], offsets[lo : hi + 2] - offsets[lo]
            edited, chars = _half_replaced(part, at)
            changed = np.frombuffer(b"".join(edited), np.uint8)
            changed_at = np.concatenate([[0], np.cumsum([len(e) for e in edited])]).astype(np.int64)
            own, other = sketches(part, at, k, size), sketches(changed, changed_at, k, size)
            keep = np.flatnonzero(np.asarray(table.column("guest").slice(lo, hi - lo)) == 0).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("doc_id").slice(lo, hi - lo).take(pa.array(keep, pa.int64())).combine_chunks(),
                    pa.array([int(chars[i]) for i in keep], pa.int64()),
                    pa.array([hashlib.sha256(edited[i]).hexdigest() for i in keep], pa.string()),
                    pa.array([encode(own[i]) for i in keep], pa.string()),
                    pa.array([encode(other[i]) for i in keep], pa.string()),
                    pa.array([resemblance(own[i], other[i], k) for i in keep], pa.float64()),
                    pa.array([resemblance(own[i], own[i + 1], k) for i in keep], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def edited_and_next(docs: DataFrame, k: int = K, size: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness.

    The edited text replaces the last half (rounded down) of the code points by
    the first as many, or all, of the next document in ascending doc_id; the
    last document is followed by the first.  Null doc_ids come first; rows that
    share a doc_id are ordered by text.  Null texts count as empty; an only
    document is its own successor; no rows give none.

    Documents are dealt to ranges of doc_id, and each range also gets the first
    document of the next as a guest, so texts move once and no range waits for
    another.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = [(i + 1) / parts for i in range(parts - 1)]
    cuts = (
        rows.select(F.percentile_approx("doc_id", F.array(*map(F.lit, points)), F.lit(20 * parts))).first()[0] or []
        if points
        else []
    )
    limits = np.unique(np.array(cuts, dtype=np.int64))

    def dealt_to(ids: pa.Array) -> np.ndarray:
        known = np.searchsorted(limits, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return np.where(ids.is_valid().to_numpy(zero_copy_only=False), known, 0)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            deal = pa.array(dealt_to(ids), pa.int32())
            yield pa.RecordBatch.from_arrays([deal, ids], ["deal", "doc_id"])

    # The first document of each range: at most a row a range, and as many nulls-first flags.
    heads = (
        rows.select("doc_id")
        .mapInArrow(ranges, f"deal int, doc_id {kind}")
        .groupBy("deal")
        .agg(F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("with_null"))
        .orderBy("deal")
        .collect()
    )
    guest_of: dict[int | None, int] = {}
    for before, row in zip([heads[-1], *heads[:-1]] if heads else [], heads, strict=True):
        guest_of[None if row.with_null else row.head] = before.deal

    def deals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([x for x in guest_of if x is not None], pa.int64())
        for batch in batches:
            ids = batch.column("doc_id")
            deal = pa.array(dealt_to(ids), pa.int32())
            host = pa.array(np.zeros(len(ids), np.int8))
            yield pa.RecordBatch.from_arrays([deal, host, ids, batch.column("text")], ["deal", "guest", "doc_id", "text"])
            mask = pc.is_in(ids, value_set=known.cast(ids.type))
            if None in guest_of:
                mask = pc.or_(mask, pc.is_null(ids))
            guests = batch.filter(mask)
            if guests.num_rows:
                to = [guest_of[x] for x in guests.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array([1] * len(to), pa.int8()), *guests.columns],
                    ["deal", "guest", "doc_id", "text"],
                )

    dealt = rows.mapInArrow(deals, f"deal int, guest tinyint, doc_id {kind}, text string")
    return (
        dealt.repartitionById(max(1, len(limits) + 1), "deal")
        .sortWithinPartitions("deal", "guest", "doc_id", "text")
        .mapInArrow(
            lambda batches: _compared(batches, k, size),
            f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double",
        )
    )
