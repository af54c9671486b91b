"""Text files of one record per line that give every value back, and files of equal size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tableloom.functions.records import SEPARATOR, check_types, fields, record


def write_records(
    df: DataFrame, path: str, *, sep: str = SEPARATOR, mode: str = "errorifexists", **options: str
) -> None:
    """Write each row as one line of escaped values, so that a file can be cut anywhere.

    Every plain value comes back unchanged from ``read_records``: NULL beside an empty text,
    line breaks, separators, backslashes, outer blanks, microseconds, bytes. Arrays, structs and maps
    are an error.
    """
    check_types(df.schema)
    lines = df.select(record(df.schema, sep).alias("value"))
    lines.write.options(lineSep="\n", **options).mode(mode).text(path)


def read_records(
    spark: SparkSession, path: str, schema: StructType | str, *, sep: str = SEPARATOR
) -> DataFrame:
    """Read what ``write_records`` wrote; large files are read by several tasks.

    A line with another number of values, or with a value that does not fit its type, is an error.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    check_types(schema)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(*fields(F.col("value"), schema, sep))


def text_bytes(df: DataFrame) -> Column:
    """How many bytes a row of plain values takes as a line of text, about."""
    values = [F.coalesce(F.octet_length(F.col(f"`{n}`").cast("string")), F.lit(2)) for n in df.columns]
    return sum(values, F.lit(0)) + len(values)


def spread_by_bytes(df: DataFrame, files: int, size: Column | None = None) -> DataFrame:
    """The rows dealt out to ``files`` tasks of about equally many bytes, not rows.

    Rows keep their order. The bytes before each row are a sum over the partitions before its own and
    one inside it; the file is the part of the total in which they fall, so a file is at
    most one row larger than its share. ``size`` is a row's bytes, as text if not given. The input
    is evaluated twice, so it should be read from files and give the same rows each time.
    """
    part, row, own = _free(df, "part"), _free(df, "row"), _free(df, "own")
    size = text_bytes(df) if size is None else size
    numbered = df.withColumns(
        {part: F.spark_partition_id(), row: F.monotonically_increasing_id(), own: size.cast("bigint")}
    )
    parts = numbered.groupBy(part).agg(F.sum(own).alias("bytes"))
    # One row per partition of the input.
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offset, total = _free(df, "offset"), _free(df, "total")
    parts = parts.select(
        part,
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias(offset),
        F.greatest(F.sum("bytes").over(everything), F.lit(1)).alias(total),
    )
    inside = Window.partitionBy(part).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.join(parts, part).withColumn(
        own, F.col(offset) + F.coalesce(F.sum(own).over(inside), F.lit(0)) + F.col(own) / 2
    )
    number = F.least(F.floor(F.col(own) * files / F.col(total)), F.lit(files - 1)).cast("int")
    return placed.repartitionById(files, number).select(*(F.col(f"`{n}`") for n in df.columns))


def _free(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it new among the columns."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name
