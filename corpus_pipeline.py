"""From documents to a training mix: five stages, each one operator over what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.llm.common import table, written
from tableloom.llm.decontamination import clean, contaminated
from tableloom.llm.line_dedup import dedup_lines
from tableloom.llm.mixing import mix
from tableloom.llm.simhash import one_of_each
from tableloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    return without_toxic(docs, table(spark, folder, "labels"), reject=0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, each line with a letter or digit in one of them only; n_chars follows the text."""
    left = dedup_lines(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.char_length("text").cast(kind))
    return left


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs, shingle_words=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a benchmark item."""
    return clean(docs, contaminated(docs, table(spark, folder, "benchmark")))


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix(docs, weights=(5, 2, 1), percent=150, most_repeats=2).withColumnRenamed(
        "id", "doc_id"
    )


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# Learned scores, similarity components and seeded selection are not for SQL; the tests
# compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each result written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
