"""Language identification by a byte convolutional network.

Bytes are embedded, convolved by filters of several widths, max-pooled over a
fixed-length window and classified by a softmax.  A text is cut into windows
that cover it whole; its languages' log-probabilities are averaged.  Training
is plain numpy on labelled windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.holdout import held_out
from driftline.llm.textbatch import lowered, runs, utf8

WINDOW = 96
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
#: Training sample: at most so many different texts a language, the first by hash of doc_id, and so many windows of each.
TEXTS_PER_LANGUAGE = 300
WINDOWS_PER_TEXT = 8
EPOCHS = 5
BATCH = 128
RATE = 0.01
UNKNOWN = "und"


def windows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows (n, WINDOW) of a batch of texts and the row of each; the last of a text is zero-padded."""
    lens = np.diff(offsets)
    count = -(-lens // WINDOW)
    row = np.repeat(np.arange(len(lens)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = (offsets[:-1][row] + nth * WINDOW)[:, None] + np.arange(WINDOW)
    padded = np.append(lowered(buf), np.zeros(WINDOW, np.uint8))
    cells = padded[at]
    cells[at >= offsets[1:][row][:, None]] = 0
    return cells, row


@dataclass
class Network:
    """Parameters: embedding (256, E), per width a kernel (width * E, F) and bias, and the output layer."""

    languages: list[str]
    embedding: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.embedding, *self.kernels, *self.biases, self.out, self.out_bias]


def new_network(languages: list[str], seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)

    def normal(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    pooled = FILTERS * len(WIDTHS)
    return Network(
        languages,
        rng.standard_normal((256, EMBEDDING)).astype(np.float32),
        [normal(w * EMBEDDING, FILTERS) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        normal(pooled, len(languages)),
        np.zeros(len(languages), np.float32),
    )


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _step(net: Network, cells: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross-entropy over one batch of windows."""
    n = len(cells)
    vectors = net.embedding[cells]  # (n, WINDOW, E)
    columns, peaks, pooled = [], [], []
    for width, kernel, bias in zip(WIDTHS, net.kernels, net.biases, strict=True):
        spans = np.concatenate([vectors[:, i : WINDOW - width + 1 + i] for i in range(width)], axis=2)
        response = spans @ kernel + bias
        top = response.argmax(axis=1)  # (n, F)
        columns.append(spans)
        peaks.append(top)
        pooled.append(np.take_along_axis(response, top[:, None], axis=1)[:, 0])
    raw = np.concatenate(pooled, axis=1)
    hidden = np.maximum(raw, 0)
    wrong = _softmax(hidden @ net.out + net.out_bias)
    wrong[np.arange(n), target] -= 1
    wrong /= n
    back = (wrong @ net.out.T) * (raw > 0)
    embedding = np.zeros_like(net.embedding)
    kernels, biases = [], []
    for k, (width, kernel) in enumerate(zip(WIDTHS, net.kernels, strict=True)):
        part = back[:, k * FILTERS : (k + 1) * FILTERS]  # only the pooled position of each filter learns
        spans = np.take_along_axis(columns[k], peaks[k][:, :, None], axis=1)  # (n, F, width * E)
        kernels.append(np.einsum("nf,nfd->df", part, spans))
        biases.append(part.sum(axis=0))
        to_span = (part[:, :, None] * kernel.T[None]).reshape(n, FILTERS, width, EMBEDDING)
        at = peaks[k][:, :, None] + np.arange(width)
        which = np.take_along_axis(cells, at.reshape(n, -1), axis=1)
        np.add.at(embedding, which.ravel(), to_span.reshape(-1, EMBEDDING))
    return [embedding, *kernels, *biases, hidden.T @ wrong, wrong.sum(axis=0)]


def train(cells: np.ndarray, target: np.ndarray, languages: list[str], seed: int = 5) -> Network:
    """Fit a network to labelled windows by Adam."""
    net = new_network(languages, seed)
    rng = np.random.default_rng(seed + 1)
    params = net.params()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(cells))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            step += 1
            for p, g, a, b in zip(params, _step(net, cells[part], target[part]), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return net


class Classifier:
    """A trained network with its convolutions folded into tables of byte pairs.

    A filter's response is a sum over the bytes under it, so the part of two
    neighbouring bytes is looked up at once; results are those of the network.
    """

    def __init__(self, net: Network) -> None:
        self.net = net
        self.tables: list[list[tuple[int, bool, np.ndarray]]] = []
        for width, kernel in zip(WIDTHS, net.kernels, strict=True):
            single = [net.embedding @ kernel[i * EMBEDDING : (i + 1) * EMBEDDING] for i in range(width)]
            parts = []
            for i in range(0, width - 1, 2):
                # Index of a pair: first byte + 256 * second.
                parts.append((i, True, (single[i + 1][:, None] + single[i][None]).reshape(65536, FILTERS)))
            if width % 2:
                parts.append((width - 1, False, single[width - 1]))
            self.tables.append(parts)

    def log_probabilities(self, cells: np.ndarray) -> np.ndarray:
        """Log-probabilities (n, languages) of windows."""
        out = []
        for lo in range(0, len(cells), 256):
            part = cells[lo : lo + 256]
            ones = part.astype(np.intp)
            pairs = ones[:, :-1] + 256 * ones[:, 1:]
            pooled = []
            for width, bias, parts in zip(WIDTHS, self.net.biases, self.tables, strict=True):
                span = WINDOW - width + 1
                total = None
                for i, paired, table in parts:
                    got = table.take((pairs if paired else ones)[:, i : i + span], axis=0)
                    total = got if total is None else np.add(total, got, out=total)
                pooled.append(total.max(axis=1) + bias)
            z = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.net.out + self.net.out_bias
            z = z - z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.net.languages)), np.float32)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of whole texts; ``und`` and 0 where there is no letter."""
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        buf, offsets = utf8(texts)
        n = len(offsets) - 1
        best, score = np.zeros(n, dtype=int), np.zeros(n)
        for lo, hi in runs(offsets, 256 << 10):
            cells, row = windows(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            if not len(row):
                continue
            logs = self.log_probabilities(cells)
            total = np.zeros((hi - lo, logs.shape[1]))
            np.add.at(total, row, logs)
            mean = total / np.maximum(1, np.bincount(row, minlength=hi - lo))[:, None]
            found = _softmax(mean)
            best[lo:hi], score[lo:hi] = found.argmax(axis=1), found.max(axis=1)
        names = [self.net.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        return names, np.where(lettered, score, 0.0)


def learn(docs: DataFrame, texts_per_language: int = TEXTS_PER_LANGUAGE) -> Network | None:
    """Train on a sample, bounded for each language, of all documents with a language outside the held-out part; None if there are none.

    Rows that repeat a doc_id and text count once, in the first of their
    languages; null and empty texts and null doc_ids aren't learned from.
    """
    named = docs.select("doc_id", "lang", F.xxhash64("text").alias("print"), "text")
    known = named.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    # Equal rows share a rank, so repeats of a text don't take the place of others.
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy("spread", "doc_id", "print"))
    chosen = (
        known.select("doc_id", "print", "lang", F.xxhash64("doc_id").alias("spread"))
        .withColumn("rank", rank)
        .filter(F.col("rank") <= texts_per_language)
        .groupBy("doc_id", "print")
        .agg(F.min("lang").alias("lang"))
        .collect()
    )
    if not chosen:
        return None
    lang = {(r.doc_id, r.print): r.lang for r in chosen}
    languages = sorted(set(lang.values()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Only the windows that are learned from come to the driver: evenly spread ones of each text.
    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            at, parts = [], []
            for lo, hi in runs(offsets):
                cells, row = windows(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                count = np.bincount(row, minlength=hi - lo)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                every = -(-count[row] // WINDOWS_PER_TEXT)
                keep = np.flatnonzero(nth % every == 0)
                at += (lo + row[keep]).tolist()
                parts += [cells[i].tobytes() for i in keep]
            ids = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "print")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(parts, pa.binary())], ["doc_id", "print", "cells"])

    wanted = docs.sparkSession.createDataFrame(list(lang), f"doc_id {kind}, print long")
    # Of repeated rows one is taken, by a shuffle of the sample alone.
    texts = named.select("doc_id", "print", "text").join(F.broadcast(wanted), ["doc_id", "print"], "left_semi").dropDuplicates(["doc_id", "print"])
    rows = texts.mapInArrow(samples, f"doc_id {kind}, print long, cells binary").orderBy("doc_id", "print", "cells").collect()
    cells = np.frombuffer(b"".join(bytes(r.cells) for r in rows), np.uint8).reshape(-1, WINDOW)
    target = np.array([languages.index(lang[r.doc_id, r.print]) for r in rows])
    return train(cells, target, languages)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row; ``und`` and 0 if the text is null or has no letter.

    Without a network every text is ``und``.  Repeated rows are judged each;
    other columns than doc_id and text are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(net) if net else None
        for batch in batches:
            texts = batch.column("text")
            names, score = classifier.predict(texts) if classifier else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        each, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )
