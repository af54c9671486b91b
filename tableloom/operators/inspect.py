"""Looking at frames: schema, preview, partitions, plan."""

from __future__ import annotations

import contextlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from tableloom.sources import rows_to_frame


def schema_json(df: DataFrame) -> str:
    """The schema as JSON text."""
    return df.schema.json()


def _fields(data_type: DataType, prefix: str = "") -> Iterator[tuple[str, str, bool]]:
    if isinstance(data_type, ArrayType):
        yield from _fields(data_type.elementType, prefix)
    elif isinstance(data_type, MapType):
        yield from _fields(data_type.keyType, f"{prefix}.key" if prefix else "key")
        yield from _fields(data_type.valueType, f"{prefix}.value" if prefix else "value")
    elif isinstance(data_type, StructType):
        for field in data_type:
            path = f"{prefix}.{field.name}" if prefix else field.name
            yield path, field.dataType.simpleString(), field.nullable
            yield from _fields(field.dataType, path)


def schema_rows(df: DataFrame) -> DataFrame:
    """The schema tree as a frame: ``position, field, type, nullable``, one row per field.

    Nested fields follow their parent under dotted names.
    """
    rows = [(i, *field) for i, field in enumerate(_fields(df.schema))]
    return rows_to_frame(
        df.sparkSession, rows, "position int, field string, type string, nullable boolean"
    )


def preview(df: DataFrame, count: int = 20) -> DataFrame:
    """Up to ``count`` rows, 20 as in ``show()``."""
    return df.limit(count)


def preview_pandas(df: DataFrame, count: int = 20) -> pd.DataFrame:
    """Up to ``count`` rows as pandas, for looking at; work on rows stays in Spark."""
    return df.limit(count).toPandas()


def partition_count(df: DataFrame) -> int:
    """The number of partitions; shuffles in the plan run first, as their sizes decide it."""
    return df.rdd.getNumPartitions()


def partition_sizes(df: DataFrame) -> DataFrame:
    """Rows per partition as ``partition, n``; empty partitions have no row."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(
        F.count(F.lit(1)).alias("n")
    )


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What ``explain`` prints, as text."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()
