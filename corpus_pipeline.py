"""The training-corpus pipeline: five stages, each over all rows that the one before kept.

Every stage is written as Parquet to the shared folder and read back as the
next one's documents, so a lost executor costs a stage's tasks, not the run.
What stages write in between is removed when they are done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import decontam, linededup, mixing, resemblance, toxicity
from driftline.llm.storage import fresh_path, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier (operator 9) doesn't reject; all of them without labels to learn from.

    Null and empty texts are judged like any text without features; equal texts share the verdict.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.learn(docs, labels))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one nearly or exactly (operator 7).

    Null texts stay null; a document whose lines all repeat others' stays with an empty text.
    """
    return linededup.without_repeated_lines(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, a similarity of 0.8 or more.

    Pairs come from SimHash and its pivot tables (operator 2) and, where fingerprints can't tell,
    from an exact set join.  Null, empty and blank texts are one group; rows that repeat are one document.
    """
    return resemblance.without_near_duplicates(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark (operator 5); null and empty texts stay."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them (operator 6).

    Documents without words go; a null source is a source of its own; rows that repeat are taken each.
    """
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
]

#: Training, edit distances and components aren't expressible in SQL; tests compare with plain Python instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        with scratch(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
    return docs
