"""Appending to catalog tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import CharType, StringType, VarcharType

from tableloom.sinks.files import without_null_mark
from tableloom.sources.files import CSV_LOSSLESS
from tableloom.sources.memory import rows_to_frame


def insert_frame(df: DataFrame, table: str) -> None:
    """Append a frame to a table, matching columns by name and casting to its types.

    A column that the table does not have is an error, and so is a value that the table's text
    files would not give back; a column that the frame does not have is an error too.
    """
    spark = df.sparkSession
    target = spark.table(table).schema
    known = {f.name.lower() for f in target}
    surplus = [name for name in df.columns if name.lower() not in known]
    if surplus:
        raise ValueError(f"{table} has no column {', '.join(surplus)}")
    chosen = df.select(
        *(F.col(f"`{field.name}`").cast(field.dataType).alias(field.name) for field in target)
    )
    _kept(chosen, table).write.insertInto(table)


def insert_rows(spark: SparkSession, table: str, rows: Iterable[Sequence]) -> None:
    """Append literal rows, given in the table's column order."""
    given = rows_to_frame(spark, rows, spark.table(table).schema)
    _kept(given, table).write.insertInto(table)


def _kept(df: DataFrame, table: str) -> DataFrame:
    """``df`` for a table that gives every value back; texts that it would not are an error.

    Text tables keep texts as they are only with the lossless settings; with others an insert of text
    columns is refused, since blanks, quotes, separators and line breaks would change.
    """
    definition = df.sparkSession.sql(f"SHOW CREATE TABLE {table}").first()[0]
    texts = [f.name for f in df.schema if isinstance(f.dataType, (StringType, CharType, VarcharType))]
    if not re.search(r"USING csv\b", definition, re.IGNORECASE) or not texts:
        return df
    for key in ("ignoreLeadingWhiteSpace", "multiLine", "nullValue"):
        if not re.search(f"'{key}' = '{re.escape(CSV_LOSSLESS[key])}'", definition, re.IGNORECASE):
            raise ValueError(
                f"{table} is delimited text without the lossless settings and would change texts; "
                "create it without options of its own"
            )
    return without_null_mark(df, CSV_LOSSLESS["nullValue"])
