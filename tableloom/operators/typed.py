"""Union of frames whose columns have the same names but different types."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    ByteType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    NullType,
    NumericType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

_WHOLE = (ByteType, ShortType, IntegerType, LongType)  # each holds those before it
MOST_DIGITS = 38  # of a decimal
_DIGITS = dict(zip(_WHOLE, (3, 5, 10, 20)))
# What becomes text beside a text; any other type has to be converted by the caller.
_AS_TEXT = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)


class NoCommonType(TypeError):
    """Two types of one column that no type holds both of."""


def _numbers(one: DataType, other: DataType) -> DataType:
    kinds = {type(one), type(other)}
    if kinds <= set(_WHOLE):
        return max(one, other, key=lambda t: _WHOLE.index(type(t)))
    if kinds & {FloatType, DoubleType}:
        small = {ByteType, ShortType, FloatType}  # a float holds these whole numbers
        return FloatType() if kinds <= small else DoubleType()
    one, other = (
        t if isinstance(t, DecimalType) else DecimalType(_DIGITS[type(t)], 0) for t in (one, other)
    )
    scale = max(one.scale, other.scale)
    before = max(one.precision - one.scale, other.precision - other.scale)
    if before + scale > MOST_DIGITS:
        raise NoCommonType
    return DecimalType(before + scale, scale)


def common_type(one: DataType, other: DataType, at: str = "", exact: bool = False) -> DataType:
    """The least type that holds the values of both; ``NoCommonType`` if there is none.

    Numbers widen as far as needed, a date beside a timestamp becomes one, numbers,
    booleans, dates and timestamps beside a text become text, and NULL takes the other's
    type. Structs have the fields of both, in the order of the first; arrays and maps widen
    inside. ``at`` names the column in errors; ``exact`` tells field names apart by case.
    """
    if isinstance(one, NullType) or one == other:
        return other
    if isinstance(other, NullType):
        return one
    error = NoCommonType(f"{at or 'values'}: {one.simpleString()} and {other.simpleString()}")
    if isinstance(one, StructType) and isinstance(other, StructType):
        return common_schema([one, other], at, exact)
    if isinstance(one, ArrayType) and isinstance(other, ArrayType):
        item = common_type(one.elementType, other.elementType, f"{at}[]", exact)
        return ArrayType(item, one.containsNull or other.containsNull)
    if isinstance(one, MapType) and isinstance(other, MapType):
        key = common_type(one.keyType, other.keyType, f"{at}.key", exact)
        value = common_type(one.valueType, other.valueType, f"{at}.value", exact)
        return MapType(key, value, one.valueContainsNull or other.valueContainsNull)
    if isinstance(one, NumericType) and isinstance(other, NumericType):
        try:
            return _numbers(one, other)
        except NoCommonType:
            raise error from None
    for text, value in ((one, other), (other, one)):
        if isinstance(text, StringType) and isinstance(value, _AS_TEXT):
            return StringType()
    for moment, day in ((one, other), (other, one)):
        if isinstance(moment, (TimestampType, TimestampNTZType)) and isinstance(day, DateType):
            return moment
    raise error


def common_schema(
    schemas: Sequence[StructType], at: str = "", exact: bool = False
) -> StructType:
    """The columns of all schemas, each with its ``common_type``; all may be NULL."""
    fold = str if exact else str.lower
    fields: dict[str, StructField] = {}
    for schema in schemas:
        names = [fold(f.name) for f in schema]
        if len(set(names)) < len(names):
            raise ValueError(f"{at or 'a frame'} has two columns of one name: {schema.names}")
        for field in schema:
            place = f"{at}.{field.name}" if at else field.name
            known = fields.get(fold(field.name))
            kind = common_type(known.dataType, field.dataType, place, exact) if known else field.dataType
            fields[fold(field.name)] = StructField(known.name if known else field.name, kind)
    return StructType(list(fields.values()))


def _as_type(value: Column, have: DataType, want: DataType, exact: bool) -> Column:
    """``value`` of type ``have`` as ``want``, which holds it; fields it has not are NULL."""
    if have == want:
        return value
    if isinstance(have, NullType) or not isinstance(want, (StructType, ArrayType, MapType)):
        return value.cast(want)
    if isinstance(want, ArrayType):
        return F.transform(value, lambda v: _as_type(v, have.elementType, want.elementType, exact))
    if isinstance(want, MapType):
        keys = F.transform_keys(value, lambda k, _: _as_type(k, have.keyType, want.keyType, exact))
        return F.transform_values(
            keys, lambda _, v: _as_type(v, have.valueType, want.valueType, exact)
        )
    built = F.struct(*_columns(have, want, value.getField, exact))
    return F.when(value.isNotNull(), built)


def _columns(have: StructType, want: StructType, of, exact: bool) -> list[Column]:
    fold = str if exact else str.lower
    own = {fold(f.name): f for f in have}
    out = []
    for field in want:
        found = own.get(fold(field.name))
        value = (
            _as_type(of(found.name), found.dataType, field.dataType, exact)
            if found
            else F.lit(None).cast(field.dataType)
        )
        out.append(value.alias(field.name))
    return out


def union_typed(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, columns matched by name, types widened to one that holds them all.

    Columns or nested fields that a frame does not have are NULL in its rows; a NULL struct
    stays NULL. Types that nothing holds both of are an error that names the column. Each frame is
    one projection over its scan, and nothing is read to find the types.
    """
    spark = frames[0].sparkSession
    exact = spark.conf.get("spark.sql.caseSensitive") == "true"
    want = common_schema([df.schema for df in frames], exact=exact)

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(*_columns(df.schema, want, lambda name: df[f"`{name}`"], exact))

    return reduce(DataFrame.unionByName, map(shaped, frames))
