"""DataFrame to DataFrame operations."""

from tableloom.operators.counts import row_count, word_counts
from tableloom.operators.filters import replace_values, where_equal, where_in, where_scalar
from tableloom.operators.inspect import (
    partition_count,
    partition_sizes,
    plan_text,
    preview,
    preview_pandas,
    schema_json,
    schema_rows,
)
from tableloom.operators.rows import first_rows, replicate, spread, union_by_name, union_rows
from tableloom.operators.shape import conform, midpoint_and_copies, rename_positional
from tableloom.operators.typed import NoCommonType, common_schema, common_type, union_typed

__all__ = [
    "NoCommonType",
    "common_schema",
    "common_type",
    "conform",
    "first_rows",
    "midpoint_and_copies",
    "partition_count",
    "partition_sizes",
    "plan_text",
    "preview",
    "preview_pandas",
    "rename_positional",
    "replace_values",
    "replicate",
    "row_count",
    "schema_json",
    "schema_rows",
    "spread",
    "union_by_name",
    "union_rows",
    "union_typed",
    "where_equal",
    "where_in",
    "where_scalar",
    "word_counts",
]
