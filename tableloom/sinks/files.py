"""File writers. All go through Spark's commit protocol, so a lost task leaves no half file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tableloom.sources.files import CSV_LOSSLESS

# Spark's own format stops at milliseconds; its reader takes these as they are.
JSON_TIMESTAMPS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def write_csv(
    df: DataFrame,
    path: str,
    *,
    header: bool = False,
    mode: str = "errorifexists",
    num_files: int | None = None,
    max_records_per_file: int | None = None,
    lossless: bool = False,
    **options: str,
) -> None:
    """Write CSV files; by default without a header and only into a new folder.

    ``num_files`` redistributes the rows evenly into that many tasks, at the price
    of a shuffle of everything; left out, each task writes what it holds.
    """
    if num_files is not None:
        df = df.repartition(num_files)
    settings = {**(CSV_LOSSLESS if lossless else {}), **options}
    if lossless:
        df = without_null_mark(df, settings["nullValue"])
    if max_records_per_file is not None:
        settings["maxRecordsPerFile"] = str(max_records_per_file)
    df.write.options(**settings).mode(mode).csv(path, header=header)


def without_null_mark(df: DataFrame, mark: str) -> DataFrame:
    """``df``, failing on a text that equals the mark for NULL."""
    message = F.lit("a value equals the mark for NULL of lossless CSV")
    return df.select(
        *(
            F.when(F.col(f"`{f.name}`") == mark, F.raise_error(message).cast("string"))
            .otherwise(F.col(f"`{f.name}`"))
            .alias(f.name)
            if isinstance(f.dataType, StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        )
    )


def write_json(df: DataFrame, path: str, *, mode: str = "errorifexists", **options: str) -> None:
    """Write JSON lines, timestamps with microseconds."""
    df.write.options(**{**JSON_TIMESTAMPS, **options}).mode(mode).json(path)


def write_tab_separated(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Write each row as its values joined by tabs, with no quoting at all.

    For values free of tabs and line breaks, such as words and counts; anything
    else belongs in ``write_csv``. NULL is written as an empty value.
    """
    values = [F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) for name in df.columns]
    df.select(F.concat_ws("\t", *values).alias("value")).write.mode(mode).text(path)
