"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import decontam, langid, licenses, linededup, mixing, simhash, sketch, tokens, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A public vocabulary; see the README of its folder.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every web page: its own notice, or that of the nearest directory of its URL."""
    return licenses.scan(licenses.page_files(_table(spark, sf_dir, "pages")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate class of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of every document, its edited text and the next document."""
    return sketch.edited_and_next(_table(spark, sf_dir, "documents"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count of every document."""
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), PIECES)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark spans in every document, found by winnowing."""
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systematic sampling of all documents to target weights by source."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class, links and verdict of every line of the documents that takes part."""
    found = linededup.line_classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_no", "n_chars", "links", "class_doc", "class_line", "kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived as dictionary-compressed WARC records and read back."""
    found = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels outside the held-out part."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the languages outside the held-out part."""
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_simhash": op2_simhash,
    "op3_fingerprints": op3_fingerprints,
    "op4_tokens": op4_tokens,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_linededup": op7_linededup,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
}
