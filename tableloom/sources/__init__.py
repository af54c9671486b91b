"""Readers: CSV, JSON lines, text lines, JDBC tables, generated and literal rows.

A path is any Hadoop URI and is passed through untouched, so the same call reads
``file:``, ``hdfs:`` or ``s3a:`` data.
"""

from tableloom.sources.checked import Counted, bad_rows, good_rows, part_rows, read_checked
from tableloom.sources.files import CSV_LOSSLESS, read_csv, read_json, read_lines
from tableloom.sources.jdbc import (
    frequent_keys,
    key_bounds,
    key_range_predicates,
    read_jdbc,
    read_jdbc_by_key,
)
from tableloom.sources.variants import json_variants, variant_fields, variant_schema
from tableloom.sources.memory import integer_range, rows_to_frame

__all__ = [
    "CSV_LOSSLESS",
    "Counted",
    "bad_rows",
    "frequent_keys",
    "good_rows",
    "integer_range",
    "key_bounds",
    "key_range_predicates",
    "part_rows",
    "read_checked",
    "read_csv",
    "read_jdbc",
    "read_jdbc_by_key",
    "read_json",
    "read_lines",
    "json_variants",
    "rows_to_frame",
    "variant_fields",
    "variant_schema",
]
