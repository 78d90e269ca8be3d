"""Toxicity scores from character n-grams.

A linear classifier over which n-grams occur in a text.  Each feature is scaled
by its naive Bayes log-count ratio between toxic and clean training texts, and
a logistic regression is fitted on the scaled features (Wang and Manning 2012).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.holdout import held_out
from driftline.llm.storage import staged
from driftline.llm.textbatch import lowered, runs, split_words, utf8

#: Lengths of the n-grams, in characters of the text with A-Z lower-cased and white space made single.
SIZES = (3, 4, 5, 6)
#: N-grams are hashed to so many bits.
BUCKET_BITS = 20
#: Texts are processed in runs of about this many bytes, long ones in pieces: every character has several n-grams in memory.
RUN_BYTES = 256 << 10
#: Training sample: at most so many labelled texts of either label, the first by hash of doc_id.
ROWS_PER_LABEL = 2000
#: Tasks that extract the sample's features.
SAMPLE_TASKS = 16
#: A feature occurs in so many training texts and has a log-count ratio of so many standard errors.
LEAST_TEXTS = 3
LEAST_Z = 2.5
#: The most telling features are kept, this many at most: a bound on the model's size.
FEATURES = 12_000
PENALTY = 1e-3
STEPS = 200

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STIR = np.uint64(0xD1342543DE82EF95)


def _characters(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for every character of the normalised texts, and the row of each; every word ends in a space."""
    words = split_words(lowered(buf), offsets)
    text = words.buf
    # Row i is text[begin[i]:begin[i + 1]].
    begin = np.append(words.starts, len(text))[words.first]
    if (text < 128).all():
        value, bounds = text.astype(np.uint64), begin
    else:
        head = np.flatnonzero((text & 0xC0) != 0x80)
        size = np.diff(np.append(head, len(text)))
        padded = np.append(text, np.zeros(3, np.uint8)).astype(np.uint64)
        value = padded[head]
        for i in (1, 2, 3):
            value |= np.where(size > i, padded[head + i], np.uint64(0)) << np.uint64(8 * i)
        bounds = np.searchsorted(head, begin)
    return (value + np.uint64(1)) * _STIR, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))


@dataclass
class Model:
    """Weights by bucket; scores are ``sigmoid(bias + sum of the weights present)``."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        full = np.zeros(1 << BUCKET_BITS, dtype=np.float32)
        full[self.buckets] = self.weights
        return full


def _present(buf: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of all n-grams, of the wanted buckets only if given."""
    value, owner = _characters(buf, offsets)
    found = [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for lo in range(0, len(value), RUN_BYTES):
            # A piece goes on until the n-grams that start in it end.
            part, own = value[lo : lo + RUN_BYTES + max(SIZES) - 1], owner[lo : lo + RUN_BYTES + max(SIZES) - 1]
            acc, mine = np.zeros(len(part), np.uint64), [found[0]]
            for n in range(1, max(SIZES) + 1):
                m = len(part) - n + 1
                if m <= 0:
                    break
                acc = acc[:m] * _BASE + part[n - 1 :]
                if n in SIZES:
                    k = min(m, RUN_BYTES)
                    inside = own[:k] == own[n - 1 : n - 1 + k]
                    bucket = (((acc[:k] ^ (acc[:k] >> np.uint64(29))) * _BASE) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                    if wanted is not None:
                        inside &= wanted[bucket]
                    mine.append((own[:k][inside] << BUCKET_BITS) | bucket[inside])
            found.append(np.unique(np.concatenate(mine)))
    pairs = np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]
    return pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: np.ndarray, slots: np.ndarray, ratio: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the features and bias from the pairs (row, feature) that are present, by logistic regression.

    Features are scaled by ``ratio``; Adam runs over all rows, and both labels weigh the same in sum.
    """
    value = ratio[slots]
    n, size = len(toxic), len(ratio)
    share = np.where(toxic > 0, 0.5 / toxic.sum(), 0.5 / (n - toxic.sum()))
    w, bias = np.zeros(size), 0.0
    m1, m2, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        score = np.bincount(rows, weights=value * w[slots], minlength=n) + bias
        error = share * (_sigmoid(score) - toxic)
        grad = np.bincount(slots, weights=value * error[rows], minlength=size) + PENALTY * w
        slope = error.sum()
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        b1, b2 = 0.9 * b1 + 0.1 * slope, 0.999 * b2 + 0.001 * slope**2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.02 * (m1 / fix1) / (np.sqrt(m2 / fix2) + 1e-8)
        bias -= 0.02 * (b1 / fix1) / (np.sqrt(b2 / fix2) + 1e-8)
    return ratio * w, float(bias)


def scores(model: Model | None, texts: pa.Array, table: np.ndarray | None = None) -> np.ndarray:
    """Probability-like scores of whole texts; 0 for all without a model."""
    if model is None:
        return np.zeros(len(texts))
    table = model.table() if table is None else table
    wanted = table != 0
    buf, offsets = utf8(texts)
    out = []
    for lo, hi in runs(offsets, RUN_BYTES):
        rows, buckets = _present(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], wanted)
        out.append(np.bincount(rows, weights=table[buckets], minlength=hi - lo) + model.bias)
    return _sigmoid(np.concatenate(out)) if out else np.zeros(0)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, toxic, clean): in how many of a task's texts of either label each n-gram occurs."""
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        label = batch.column("toxic").to_numpy()
        buf, offsets = utf8(batch.column("text"))
        for lo, hi in runs(offsets, RUN_BYTES):
            rows, buckets = _present(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            for k in (0, 1):
                counts[k] += np.bincount(buckets[label[lo + rows] == k], minlength=1 << BUCKET_BITS)
    seen = np.flatnonzero(counts.any(axis=0))
    for lo in range(0, len(seen), 100_000):
        part = seen[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[1, part]), pa.array(counts[0, part])], ["bucket", "toxic", "clean"])


def features(sample: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """``(bucket, ratio)`` of the most telling n-grams of a sample (text, toxic): their log-count ratios."""
    counts = sample.select("text", "toxic").mapInArrow(_count_batches, "bucket long, toxic long, clean long")
    counts = counts.groupBy("bucket").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).filter(F.col("t") + F.col("c") >= LEAST_TEXTS)
    with_toxic, with_clean = F.col("t") + 1, F.col("c") + 1
    ratio = F.log(with_toxic / F.lit(n_toxic + 2)) - F.log(with_clean / F.lit(n_clean + 2))
    rows = counts.select("bucket", ratio.alias("ratio"), (F.abs(ratio) / F.sqrt(1 / with_toxic + 1 / with_clean)).alias("z"))
    return rows.filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket").limit(FEATURES).select("bucket", "ratio")


def learn(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> Model | None:
    """Fit on a bounded sample of the labelled texts outside the held-out part; None unless both labels occur.

    The sample has at most ``rows_per_label`` different texts of either label,
    of any length.  Rows with a null doc_id, label or text aren't learned from,
    rows that repeat a doc_id and text count once, and a doc_id with both
    labels counts as toxic.  Features are extracted in tasks; the driver gets
    ``FEATURES`` log-count ratios and a bit a feature and text.
    """
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    named = docs.filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("print"), "text")
    known = named.select("doc_id", "print").join(marked, "doc_id").filter("toxic IN (0, 1)").distinct()
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "print"))
    chosen = known.withColumn("rank", rank).filter(F.col("rank") <= rows_per_label).select("doc_id", "print", "toxic").collect()
    n_toxic = sum(r.toxic for r in chosen)
    if not 0 < n_toxic < len(chosen):
        return None
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], f"doc_id {kind}, print long, toxic int")
    sample = named.join(F.broadcast(wanted), ["doc_id", "print"]).dropDuplicates(["doc_id", "print"])
    sample = staged(sample.repartition(SAMPLE_TASKS), "labelled-sample")
    kept = sorted((r.bucket, r.ratio) for r in features(sample, n_toxic, len(chosen) - n_toxic).collect())
    buckets = np.array([b for b, _ in kept], np.int64)
    ratio = np.array([x for _, x in kept])
    slot = np.full(1 << BUCKET_BITS, -1)
    slot[buckets] = np.arange(len(buckets))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            found = np.zeros((batch.num_rows, len(buckets)), bool)
            for lo, hi in runs(offsets, RUN_BYTES):
                rows, here = _present(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], slot >= 0)
                found[lo + rows, slot[here]] = True
            packed = [np.packbits(x).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), batch.column("toxic"), pa.array(packed, pa.binary())], ["doc_id", "print", "toxic", "bits"])

    texts = sample.mapInArrow(bits, f"doc_id {kind}, print long, toxic int, bits binary").orderBy("doc_id", "print").collect()
    present = np.array([np.unpackbits(np.frombuffer(r.bits, np.uint8), count=len(buckets)) for r in texts], bool).reshape(len(texts), len(buckets))
    rows, slots = np.nonzero(present)
    weights, bias = fit(rows, slots, ratio, np.array([float(r.toxic) for r in texts]))
    return Model(buckets, weights.astype(np.float32), bias)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row.

    Null and empty texts get the score of a text without any feature; repeated
    rows are scored each; other columns are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table() if model else None
        for batch in batches:
            found = scores(model, batch.column("text"), table)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        each, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns.

    Each row is judged by its whole text, so repeated rows share a verdict; null
    and empty texts get the score of a text without any feature; null doc_ids,
    clashing column names and empty tables are fine.  Without a model all rows stay.
    """
    at = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table() if model else None
        for batch in batches:
            yield batch.filter(pa.array(scores(model, batch.column(at), table) < 0.5))

    return docs.mapInArrow(each, docs.schema)
