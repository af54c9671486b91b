"""JSON lines without a declared schema: rows and types from one read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, DoubleType, StructField, StructType


def json_variants(spark: SparkSession, path: str, column: str = "record") -> DataFrame:
    """JSON lines as one VARIANT per record; nothing is read to find types."""
    return spark.read.option("singleVariantColumn", column).json(path)


def variant_schema(df: DataFrame, column: str = "record") -> StructType:
    """The least schema that holds all records, as an aggregate over them.

    The types meet in partial sums in each task, so only schemas are shuffled. Numbers with a
    fraction are doubles, as in schema inference. What is not an object in every record is an
    error.
    """
    found = df.agg(F.schema_of_variant_agg(F.col(column)).alias("found")).first()["found"]
    kind = DataType.fromDDL(found.replace("OBJECT<", "STRUCT<"))
    if not isinstance(kind, StructType):
        raise TypeError(f"records are {found}, not objects")
    return _doubles(kind)


def _doubles(kind: DataType) -> DataType:
    """The type with doubles for decimals that have a fraction."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _doubles(f.dataType)) for f in kind])
    if isinstance(kind, ArrayType):
        return ArrayType(_doubles(kind.elementType))
    return DoubleType() if isinstance(kind, DecimalType) and kind.scale > 0 else kind


def variant_fields(schema: StructType, column: str = "record") -> list[Column]:
    """The records' fields as columns of the schema's types; a missing one is NULL."""
    return [
        F.variant_get(F.col(column), f"$['{field.name}']", field.dataType.simpleString()).alias(
            field.name
        )
        for field in schema
    ]
