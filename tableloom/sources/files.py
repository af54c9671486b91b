"""File readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Plain CSV loses data on a write/read round trip: outer blanks are trimmed, NULL
# and "" become the same, line breaks inside a value start a new record and
# timestamps keep milliseconds only. With these settings on BOTH sides, and the
# same schema on the read, every scalar value comes back unchanged. The line end has
# to be named, or the reader guesses it from the first break it meets, which may be
# one inside a value; and the escape of the escape has to be named, or it is the NUL
# character, which then disappears from values. NULL is written as U+0001; writing a
# value of exactly that one character is an error. Instants carry their offset. Text that
# does not fit its column's type is an error instead of NULL.
CSV_LOSSLESS = {
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "mode": "FAILFAST",
    "multiLine": "true",
    "lineSep": "\n",
    "escape": '"',
    "charToEscapeQuoteEscaping": '"',
    "nullValue": "\u0001",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    header: bool = False,
    schema: StructType | str | None = None,
    infer: bool = False,
    lossless: bool = False,
    **options: str,
) -> DataFrame:
    """Read CSV files.

    Without a header the columns are ``_c0, _c1, ...`` and a header line, if the
    file has one, is an ordinary row. Without ``schema`` or ``infer`` every column
    is a string. ``infer`` reads all the data once more to find the types, so on
    large inputs declare ``schema`` instead. With both a header and a schema their
    names have to agree, in every file; the option ``enforceSchema="true"`` takes the
    columns by position whatever the header says.

    ``lossless`` allows line breaks inside values, which makes a file one task:
    write such files in moderate sizes (``write_csv(max_records_per_file=...)``).
    """
    reader = spark.read.options(**(CSV_LOSSLESS if lossless else {}))
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", "false")
    reader = reader.options(**options)
    return reader.csv(path, header=header, inferSchema=infer and schema is None)


def read_json(
    spark: SparkSession,
    path: str,
    *,
    schema: StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """Read JSON lines.

    A declared schema reads in one pass and parses only the fields it names; within
    a struct nothing else prunes them. Without a schema Spark scans everything
    first and widens numbers to bigint and double.
    """
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Read text files as one row per line, in the column ``value``."""
    return spark.read.text(path)
