"""Array items and nested fields."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def item(array: Column | str, position: int) -> Column:
    """Array item by 0-based position; NULL beyond the end, also in ANSI mode."""
    return F.get(array, F.lit(position))


def nested_fields(struct: str, names: Mapping[str, str]) -> dict[str, Column]:
    """Top-level columns from a struct, as ``{new name: column}`` for ``{new name: field}``."""
    return {new: F.col(f"{struct}.{field}") for new, field in names.items()}
