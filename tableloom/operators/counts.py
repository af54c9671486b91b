"""Counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.functions.strings import tokens


def row_count(df: DataFrame) -> DataFrame:
    """The number of rows, as a one-row frame with the column ``n``."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """How often each word occurs, as ``word`` and ``n``; case matters.

    Every task counts its own words before the shuffle, so a word that makes up a
    third of the text still arrives as one row per task. Words are sorted within
    each output partition; a total order would need another shuffle.
    """
    return (
        df.select(F.explode(tokens(text)).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .sortWithinPartitions("word")
    )
