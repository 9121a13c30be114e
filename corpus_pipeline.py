"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Language identification drops texts without a language; the n-gram Jaccard join keeps one
document of each group; decontamination drops documents that contain a benchmark item;
personal data is masked; packing turns what is left into sequences.

Every stage takes an empty table and further columns; each says what it makes of nulls and repeated rows.  A stage's table is deleted
when the next one is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import decontamination, jaccard_join, language_id, packing, pii
from emberlog.llm.common import forget, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null and empty texts, texts without a letter and texts foreign to the model; repeated rows are judged each on its own."""
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the first by id (null first), of repeated rows any one; null and empty texts are no group and stay."""
    return jaccard_join.keep_first(docs, jaccard_join.Settings(words=5, percent=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every row, repeated ones too, that contains an item; null and empty texts contain nothing and stay."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks spans in each row; null and empty texts stay as they are."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a row's tokens; null and empty texts are their end token, repeated rows are packed each on its own."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", personal_data),
    ("packing", pack),
]

#: The first stage's model and the last one's tokenizer have no SQL; tests hold each against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            forget(last)
        last = docs
    return docs
