"""One record per line: values escaped so that no line break or separator is left in them.

A backslash begins an escape, and a letter after it says for what. The text NULL mark is an
escape of its own, so no value can be taken for it. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DataType,
    DateType,
    NumericType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

SEPARATOR = ","
ESCAPE = "\\"
NULL_MARK = ESCAPE + "N"
# What stands for what; the backslash comes first when writing and last when reading.
CODES = {ESCAPE: "e", "\n": "n", "\r": "r"}
SEPARATOR_CODE = "s"

# Instants are written in UTC, whatever the session's zone is.
_MOMENT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def check_types(schema: StructType) -> None:
    """Raise on columns that a text line cannot hold."""
    plain = (StringType, NumericType, BooleanType, DateType, TimestampType, TimestampNTZType, BinaryType)
    for field in schema:
        if not isinstance(field.dataType, plain):
            raise TypeError(f"{field.name}: {field.dataType.simpleString()} is no plain value")


def _text(value: Column, kind: DataType) -> Column:
    if isinstance(kind, BinaryType):
        return F.base64(value)
    if isinstance(kind, TimestampNTZType):
        return value.cast("string")
    if isinstance(kind, TimestampType):
        return F.unix_micros(value).cast("string")
    return value.cast("string")


def _value(text: Column, kind: DataType) -> Column:
    if isinstance(kind, BinaryType):
        return F.unbase64(text)
    if isinstance(kind, TimestampType):
        return F.timestamp_micros(text.cast("bigint"))
    return text.cast(kind)


def escaped(value: Column, kind: DataType, sep: str = SEPARATOR) -> Column:
    """A value as text without line breaks and separators; NULL as a mark of its own."""
    text = _text(value, kind)
    if isinstance(kind, StringType):
        for plain, code in {**CODES, sep: SEPARATOR_CODE}.items():
            text = F.replace(text, F.lit(plain), F.lit(ESCAPE + code))
    return F.coalesce(text, F.lit(NULL_MARK))


def unescaped(text: Column, kind: DataType, sep: str = SEPARATOR) -> Column:
    """The value that ``escaped`` made the text from; a text that is none of the type's fails."""
    value = text
    if isinstance(kind, StringType):
        for plain, code in reversed([*CODES.items(), (sep, SEPARATOR_CODE)]):
            value = F.replace(value, F.lit(ESCAPE + code), F.lit(plain))
    return F.when(text != NULL_MARK, _value(value, kind))


def record(schema: StructType, sep: str = SEPARATOR) -> Column:
    """All columns of a frame with this schema as one line."""
    values = [escaped(F.col(f"`{f.name}`"), f.dataType, sep) for f in schema]
    return F.concat_ws(sep, *values)


def fields(line: Column, schema: StructType, sep: str = SEPARATOR) -> list[Column]:
    """The columns of a line of ``record``; a line with another number of values fails."""
    parts = F.split(line, "\\Q" + sep + "\\E", -1)
    message = F.concat(F.lit(f"not {len(schema)} values: "), F.substring(line, 1, 100))
    whole = F.when(F.size(parts) == len(schema), parts).otherwise(
        F.raise_error(message).cast("array<string>")
    )
    return [
        unescaped(F.get(whole, F.lit(i)), f.dataType, sep).alias(f.name)
        for i, f in enumerate(schema)
    ]
