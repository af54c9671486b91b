"""Writers: CSV files, text files and catalog tables."""

from tableloom.sinks.files import write_csv, write_json, write_tab_separated
from tableloom.sinks.records import read_records, spread_by_bytes, text_bytes, write_records
from tableloom.sinks.tables import insert_frame, insert_rows

__all__ = [
    "insert_frame",
    "insert_rows",
    "read_records",
    "spread_by_bytes",
    "text_bytes",
    "write_csv",
    "write_json",
    "write_records",
    "write_tab_separated",
]
