"""Readers that set malformed records apart, and counts taken while rows are written."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tableloom.sources.memory import rows_to_frame

MALFORMED = "malformed"


def read_checked(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    *,
    format: str = "csv",
    column: str = MALFORMED,
    **options: str,
) -> DataFrame:
    """Delimited or JSON records with a declared schema, and the text of malformed ones.

    The last column, ``column``, is NULL for a good record. A record is malformed if a value
    does not fit its type or, in delimited text, if it has too few or too many values. All columns are
    parsed even where only some are used, so that what counts as malformed does not depend on
    the query.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if column.lower() in (name.lower() for name in schema.names):
        raise ValueError(f"the schema has a column {column}; name another for malformed records")
    full = StructType([*schema.fields, StructField(column, StringType())])
    settings = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": column}
    if format == "csv":
        settings |= {"columnPruning": "false", "enforceSchema": "true"}
    return spark.read.schema(full).options(**{**settings, **options}).format(format).load(path)


def good_rows(df: DataFrame, column: str = MALFORMED) -> DataFrame:
    """The well-formed records, without the column for the others."""
    return df.where(F.col(column).isNull() & _parsed(df, column)).drop(column)


def bad_rows(df: DataFrame, column: str = MALFORMED) -> DataFrame:
    """The text of the malformed records."""
    return df.where(F.col(column).isNotNull() & _parsed(df, column)).select(column)


def _parsed(df: DataFrame, column: str) -> Column:
    """True; it has all columns parsed, without which a text file does not tell what is malformed."""
    return F.xxhash64(*(F.col(f"`{n}`") for n in df.columns if n != column)) >= F.lit(-(2**63))


class Parted(NamedTuple):
    """Where good and bad rows were written, and how many there are."""

    good: DataFrame
    bad: DataFrame
    counts: dict[str, int]


def part_rows(df: DataFrame, path: str, column: str = MALFORMED) -> Parted:
    """Good and bad rows written to ``path`` as Parquet in one pass over the input, and counted.

    Each task writes both kinds it meets; nothing is shuffled and nothing parsed twice.
    """
    spark, seen = df.sparkSession, Observation()
    flag = "bad"
    while flag.lower() in (name.lower() for name in df.columns):
        flag = "_" + flag
    marked = df.withColumn(flag, F.col(column).isNotNull()).observe(
        seen, F.count(F.lit(1)).alias("all"), F.count(F.col(column)).alias("bad")
    )
    marked.write.partitionBy(flag).parquet(path)
    written = spark.read.schema(marked.schema).parquet(path)
    counts = seen.get
    return Parted(
        written.where(~F.col(flag)).drop(column, flag),
        written.where(F.col(flag)).select(column),
        {"good": counts["all"] - counts["bad"], "bad": counts["bad"]},
    )


class Counted:
    """Rows after each step of a job, counted in the pass that writes its result.

    ``step`` goes after a step; the counts are there once an action has run the frame, the write
    included. Every row of a step is counted where it is made, so nothing is read twice. A lost
    executor's tasks before a shuffle may run again, and then count again.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def step(self, df: DataFrame, name: str, **sums: Column) -> DataFrame:
        """``df``, whose rows are counted under ``name``, with further sums over them."""
        if name in self._seen:
            raise ValueError(f"two steps called {name}")
        self._seen[name] = Observation()
        more = [F.sum(value).alias(key) for key, value in sums.items()]
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("rows"), *more)

    def counts(self) -> Mapping[str, Mapping[str, int]]:
        """What each step counted, in the order of the steps; waits for the action."""
        return {name: dict(seen.get) for name, seen in self._seen.items()}

    def rows(self, spark: SparkSession) -> DataFrame:
        """``step, phase, rows_in, rows_out, dropped``: one row per step."""
        out, before = [], None
        for number, (name, found) in enumerate(self.counts().items()):
            rows = found["rows"]
            start = rows if before is None else before
            out.append((number, name, start, rows, start - rows))
            before = rows
        return rows_to_frame(
            spark, out, "step int, phase string, rows_in bigint, rows_out bigint, dropped bigint"
        )
