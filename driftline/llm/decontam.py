"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text's words are hashed in k-grams; every window of ``WINDOW`` words keeps
its smallest k-gram hash, the window's fingerprint.  Equal windows have equal
fingerprints, so joining the fingerprints of documents and benchmark items
finds every shared span of ``WINDOW`` words or more.  A hit is then extended to
its whole window, word for word, and overlapping windows to the whole span.

Items of fewer words than a window are one window each; they are looked up by
the hash of all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.storage import staged

WINDOW = 13
GRAM = 5
#: Share of hit words from which a document counts as contaminated: hits * SHARE >= words.
SHARE = 20
#: Windows of the benchmark that are broadcast to the documents at most; beyond it both sides are shuffled.
BROADCAST_WINDOWS = 1_000_000
#: And so many bytes of their words and item ids.
BROADCAST_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased: runs of digits, letters a-z and non-ASCII characters."""
    text = F.coalesce(text, F.lit(""))
    # On pure ASCII, lower() does the same as the slower character map.
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER)
    )
    return F.array_remove(F.split(lowered, _BREAK), "")


def _grams() -> Column:
    """Hashes of all ``GRAM``-word runs of ``words``."""
    starts = F.sequence(F.lit(0), F.size("words") - GRAM)
    return F.when(
        F.size("words") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(GRAM)]))
    )


def _mark(length: int) -> Column:
    """Fingerprint of the window of ``length`` words at ``at``: the smallest gram of a full one, the hash of a shorter item."""
    if length == WINDOW:
        return F.least(*[F.get("grams", F.col("at") + i) for i in range(WINDOW - GRAM + 1)])
    return F.xxhash64(*[F.get("words", F.col("at") + j) for j in range(length)])


def _windows(rows: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """``(keys, words, at, length, mark)`` of all windows of these lengths, and a row at -1 without mark for each text.

    ``words`` is split once for all lengths.
    """
    marks = [
        F.struct(
            F.lit(n).alias("length"),
            F.when((F.col("at") >= 0) & (F.col("at") + n <= F.size("words")), _mark(n)).alias("mark"),
        )
        for n in lengths
    ]
    found = rows.select(*keys, "words", _grams().alias("grams")).select(
        *keys, "words", "grams", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("at")
    )
    if len(marks) == 1:
        found = found.select(*keys, "words", "at", marks[0].alias("window"))
    else:
        found = found.select(*keys, "words", "at", F.explode(F.array(*marks)).alias("window"))
    found = found.select(*keys, "words", "at", "window.length", "window.mark")
    return found.filter(F.col("mark").isNotNull() | ((F.col("at") < 0) & (F.col("length") == lengths[0])))


def _span(length: int | Column) -> Column:
    return F.array_join(F.slice("words", F.col("at") + 1, length), " ")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.print") == F.col(f"{b}.print"))


def _item_windows(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """``(item_id, mark, span, length)`` of the items' windows, and the lengths that occur besides full ones."""
    items = staged(benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter("size(words) > 0"), "items")
    short = items.filter(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct().collect()
    lengths = [WINDOW, *sorted(r.n for r in short)]  # thirteen at most
    windows = _windows(items, ["item_id"], lengths).filter("at >= 0")
    mine = F.col("length") == F.least(F.size("words"), F.lit(WINDOW))
    known = windows.filter(mine).select("item_id", "mark", _span(F.col("length")).alias("span"), "length")
    return staged(known.distinct(), "item-windows"), lengths


def _hits(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int) -> tuple[DataFrame, DataFrame]:
    """Documents ``(doc_id, print, n_words)``, a row for each, and what was found in those with a hit.

    The latter has ``doc_id, print, n_hit, full, n_items, items_sha256``; ``full``
    tells whether a window of ``WINDOW`` words is among the hits.
    """
    known, lengths = _item_windows(benchmark)
    marks = known.select("mark", "length").distinct().withColumn("known", F.lit(True))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("span") + F.octet_length(F.col("item_id").cast("string"))).alias("bytes")).first()
    small = size.n <= broadcast_windows and (size.bytes or 0) <= BROADCAST_BYTES

    # A row is known by its doc_id and text, so repeated doc_ids don't mix.
    texts = docs.select("doc_id", F.xxhash64("text").alias("print"), words_of(F.col("text")).alias("words"))
    keys = ["doc_id", "print"]
    found = [*keys, F.size("words").cast("long").alias("n_words"), "at", "length", "mark", F.when(F.col("at") >= 0, _span(F.col("length"))).alias("span")]
    windows = _windows(texts, keys, lengths)
    if small:
        # One scan: windows that the benchmark has, and each document's own row.
        seen = windows.join(F.broadcast(marks), ["mark", "length"], "left").filter("known OR at < 0").select(*found)
    else:
        # Fingerprints alone move first; texts follow only for documents that share one.
        wanted = marks.select("mark", "length")
        some = windows.filter("at >= 0").select(*keys, "mark", "length").distinct().join(wanted, ["mark", "length"], "left_semi")
        some = some.select(*keys).distinct()
        again = texts.alias("t").join(some.alias("s"), _same("t", "s"), "left_semi")
        hit = _windows(again, keys, lengths).filter("at >= 0").select(*found).join(wanted, ["mark", "length"], "left_semi")
        own = texts.select(*keys, F.size("words").cast("long").alias("n_words"), F.lit(-1).alias("at"))
        seen = hit.unionByName(own, allowMissingColumns=True)
    seen = staged(seen, "window-hits")
    rows = seen.filter("at < 0").select(*keys, "n_words")
    spans = known.select("mark", "span", "length").distinct()
    spans = F.broadcast(spans) if small else spans
    # Word-for-word agreement of the windows decides; the fingerprint only led here.
    hits = seen.filter("at >= 0").select(*keys, "at", "mark", "span", "length").distinct()
    hits = staged(hits.join(spans, ["mark", "span", "length"], "left_semi"), "true-hits")

    # Hit words are the union of the windows' word positions, gathered per document.
    covered = hits.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct(F.col("at").alias("lo"), (F.col("at") + F.col("length")).alias("hi")))).alias("runs"),
        F.max(F.col("length") == WINDOW).alias("full"),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    union = F.aggregate(
        "runs",
        start,
        lambda s, r: F.struct(
            (s["n"] + F.greatest(F.lit(0), r["hi"] - F.greatest(s["end"], r["lo"]))).alias("n"),
            F.greatest(s["end"], r["hi"]).alias("end"),
        ),
        lambda s: s["n"],
    )
    covered = covered.select(*keys, "full", union.cast("long").alias("n_hit"))
    names = known.filter(F.col("item_id").isNotNull()).select("span", "length", F.col("item_id").cast("string").alias("item"))
    names = F.broadcast(names) if small else names
    matched = (
        hits.select(*keys, "span", "length")
        .distinct()
        .join(names, ["span", "length"])
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select(
            *keys,
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        )
    )
    hits = covered.alias("c").join(matched.alias("m"), _same("c", "m"), "left").select(
        "c.doc_id",
        "c.print",
        "n_hit",
        "full",
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
    )
    return rows, hits


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Hit words and matching items of every document.

    Returns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for
    each row of ``docs``.  Null texts have no words; rows that repeat a doc_id
    are judged by their own text; null item_ids don't count as items but their
    windows hit; items without words have no window.  Empty tables are fine,
    and other columns are ignored.
    """
    rows, hits = _hits(docs, benchmark, broadcast_windows)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.alias("d").join(hits.alias("h"), _same("d", "h"), "left").select(
        F.col("d.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        _contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The documents without benchmark passages, with all their columns.

    A document goes if it holds a full window of ``WINDOW`` words of an item,
    however long it is itself, or if its hits, those of shorter items included,
    make up one in ``SHARE`` of its words; a short item alone may be a common phrase.
    The verdict goes by doc_id and text, so repeated rows share it, null doc_ids
    too; null and empty texts stay; empty tables and any other columns are fine.
    """
    rows, hits = _hits(docs, benchmark, broadcast_windows)
    bad = (
        rows.distinct()
        .alias("r")
        .join(hits.alias("h"), _same("r", "h"))
        .filter(F.col("full") | _contaminated(F.col("n_hit"), F.col("n_words")))
        .select("r.doc_id", "r.print")
    )
    met = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("d.text") == F.col("b.print"))
    return docs.alias("d").join(bad.alias("b"), met, "left_anti")
