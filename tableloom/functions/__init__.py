"""Column functions: built-in expressions only, so they stay inside generated code."""

from tableloom.functions.arrays import item, nested_fields
from tableloom.functions.strings import (
    BLANKS,
    composite_id,
    join_text,
    split_item,
    split_words,
    strip_blanks,
    tokens,
)

__all__ = [
    "BLANKS",
    "composite_id",
    "item",
    "join_text",
    "nested_fields",
    "split_item",
    "split_words",
    "strip_blanks",
    "tokens",
]
