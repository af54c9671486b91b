"""Databases, text tables and catalog listings.

Tables are declared ``USING csv``, which needs no metastore service of its own and
reads the same delimited files. ``text_table_options`` names the settings under
which it treats quotes and header lines as a classic delimited text table does.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableloom.sources import rows_to_frame
from tableloom.sources.files import CSV_LOSSLESS

# Quotes protect commas, and the first line of each file names the columns.
QUOTED_WITH_HEADER = {"header": "true"}

# Every comma separates, a header line is a row like any other, missing values and
# text that does not fit the column's type read as NULL, and so does the NULL mark of
# delimited text tables, \N. An empty value is NULL too, in string columns as well.
PLAIN_DELIMITED = {"header": "false", "quote": "", "mode": "PERMISSIVE", "nullValue": "\\N"}


_CHAR = re.compile(r"CHAR\s*\(\s*(\d+)\s*\)", re.IGNORECASE)

# Fixed value: the name of the partition of NULL.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def text_table_options(
    *, header: bool = True, quoted: bool = True, delimiter: str = ","
) -> dict[str, str]:
    """CSV settings for a table over delimited text."""
    options = dict(QUOTED_WITH_HEADER if quoted else PLAIN_DELIMITED)
    options["header"] = str(header).lower()
    options["sep"] = delimiter
    return options


def _literal(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create a database unless it exists; its managed tables live under ``location``."""
    place = f" LOCATION {_literal(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{place}")


def use_database(spark: SparkSession, name: str) -> str:
    """Make a database current and return the one that was."""
    before = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase(name)
    return before


def databases(spark: SparkSession) -> DataFrame:
    """One row per database, in the column ``namespace``."""
    return spark.sql("SHOW DATABASES")


def tables(spark: SparkSession, database: str) -> DataFrame:
    """One row per table of a database, views of the session left out: ``namespace, tableName``."""
    shown = spark.sql(f"SHOW TABLES IN `{database}`").where("NOT isTemporary")
    return shown.select("namespace", "tableName")


def columns(spark: SparkSession, table: str) -> DataFrame:
    """One row per column: ``position, column_name, type, nullable, is_partition, is_bucket``."""
    rows = [
        (i, c.name, c.dataType, c.nullable, c.isPartition, c.isBucket)
        for i, c in enumerate(spark.catalog.listColumns(table))
    ]
    return rows_to_frame(
        spark,
        rows,
        "position int, column_name string, type string, "
        "nullable boolean, is_partition boolean, is_bucket boolean",
    )


def partitions(spark: SparkSession, table: str) -> DataFrame:
    """One row per partition of a partitioned table, as ``key=value`` text."""
    return spark.sql(f"SHOW PARTITIONS {table}")


def partition_values(spark: SparkSession, table: str) -> DataFrame:
    """The listed partitions of a table, as ``partition_spec`` and one text column per partition column.

    Names and values in a listing are escaped, and NULL has a name of its own there; both are
    turned back.
    """
    names = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    # "/" only ever stands between two levels and "=" before a value: others are escaped.
    levels = F.split("partition", "/")

    def value(level: int) -> Column:
        written = F.regexp_extract(F.get(levels, F.lit(level)), "(?s)^[^=]*=(.*)$", 1)
        # "+" is no escape in a listing, but url_decode takes it for a blank.
        plain = F.url_decode(F.regexp_replace(written, r"\+", "%2B"))
        return F.when(written != NO_VALUE, plain)

    return partitions(spark, table).select(
        F.col("partition").alias("partition_spec"),
        *(value(i).alias(name) for i, name in enumerate(names)),
    )


def partition_rows(spark: SparkSession, table: str, rows: DataFrame) -> DataFrame:
    """The listed partitions of a table, and the rows of each: ``partition_spec, n``.

    ``rows`` has the partition columns and ``n``. A partition that is listed or counted, but
    not both, is kept with NULL for the other.
    """
    listed = partition_values(spark, table)
    names = [name for name in listed.columns if name != "partition_spec"]
    if sorted(map(str.lower, names)) != sorted(n.lower() for n in rows.columns if n != "n"):
        raise ValueError(f"counted by {rows.columns}, partitioned by {names}")
    same = [
        listed[f"`{name}`"].eqNullSafe(rows[f"`{name}`"].cast("string")) for name in names
    ]
    return listed.join(rows, reduce(Column.__and__, same), "full_outer").select("partition_spec", "n")


def storage(spark: SparkSession, table: str) -> DataFrame:
    """Columns, location, provider, bucketing and properties: ``col_name, data_type, comment``."""
    return spark.sql(f"DESCRIBE FORMATTED {table}")


def storage_details(spark: SparkSession, table: str) -> DataFrame:
    """What the table is stored as: one row ``provider, kind, buckets, bucket_columns, sort_columns``.

    ``buckets`` is NULL for a table without them; the columns are arrays in the table's order.
    """
    value = lambda key: F.max(F.when(F.col("col_name") == key, F.col("data_type")))
    names = lambda key: F.regexp_extract_all(value(key), F.lit("`((?:[^`]|``)*)`"), F.lit(1))
    none = F.array().cast("array<string>")
    return storage(spark, table).agg(
        value("Provider").alias("provider"),
        value("Type").alias("kind"),
        value("Num Buckets").cast("int").alias("buckets"),
        F.coalesce(names("Bucket Columns"), none).alias("bucket_columns"),
        F.coalesce(names("Sort Columns"), none).alias("sort_columns"),
    )


def create_bucketed_table(
    df: DataFrame,
    table: str,
    buckets: int,
    columns: Sequence[str],
    *,
    sort: Sequence[str] = (),
    provider: str = "parquet",
) -> None:
    """Store a frame as a managed table whose rows lie in ``buckets`` by the hash of ``columns``.

    Joins, ``IN`` filters and groupings on these columns then need no shuffle of the table.
    The rows are dealt out by the same hash first, so that each bucket is one file.
    """
    writer = df.repartition(buckets, *(F.col(f"`{c}`") for c in columns)).write.format(provider)
    writer = writer.bucketBy(buckets, *columns)
    (writer.sortBy(*sort) if sort else writer).saveAsTable(table)


def create_partitioned_table(
    df: DataFrame, table: str, columns: Sequence[str], *, provider: str = "parquet"
) -> None:
    """Store a frame as a managed table with a folder level for each of ``columns``."""
    df.write.format(provider).partitionBy(*columns).saveAsTable(table)


# The relations of a metastore and their columns.
METASTORE = {
    "DBS": "db_id bigint, name string, db_location_uri string",
    "TBLS": "tbl_id bigint, db_id bigint, sd_id bigint, tbl_name string, tbl_type string",
    "SDS": "sd_id bigint, cd_id bigint, location string, provider string",
    "COLUMNS_V2": "cd_id bigint, column_name string, type_name string, integer_idx int",
    "PARTITIONS": "part_id bigint, tbl_id bigint, part_name string",
    "BUCKETING_COLS": "sd_id bigint, bucket_col_name string, integer_idx int",
}


def metastore(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """The catalog's listings of a database as relations with ids, to be joined and queried.

    ``DBS`` has all databases, the others what belongs to the tables of ``database``. An id is a
    hash of the full name, so relations of several databases can be united. Listings are
    metadata; no table is read.
    """
    own = spark.catalog.getDatabase(database)
    full = own.name.replace("`", "``")
    listed = [t for t in spark.catalog.listTables(database) if not t.isTemporary]
    names = [f"`{full}`.`{t.name.replace('`', '``')}`" for t in listed]
    db_id, table_id = F.xxhash64(F.lit("db"), F.col("name")), F.xxhash64(F.lit("tbl"), F.col("own"))
    sd_id, cd_id = (F.xxhash64(F.lit(kind), F.col("own")) for kind in ("sd", "cd"))

    all_databases = rows_to_frame(
        spark,
        [(d.name, d.locationUri) for d in spark.catalog.listDatabases()],
        "name string, db_location_uri string",
    )
    tables_of = rows_to_frame(
        spark,
        [(own.name, n, t.name, t.tableType) for n, t in zip(names, listed)],
        "name string, own string, tbl_name string, tbl_type string",
    )
    columns_of = rows_to_frame(
        spark,
        [
            (n, c.name, c.dataType, i, c.isBucket)
            for n in names
            for i, c in enumerate(spark.catalog.listColumns(n))
        ],
        "own string, column_name string, type_name string, integer_idx int, is_bucket boolean",
    )
    none = rows_to_frame(spark, [], "own string, col_name string, data_type string")
    described = reduce(
        DataFrame.unionByName,
        (
            spark.sql(f"DESCRIBE FORMATTED {n}").select(F.lit(n).alias("own"), "col_name", "data_type")
            for n in names
        ),
        none,
    )
    value = lambda key: F.max(F.when(F.col("col_name") == key, F.col("data_type")))
    stored = described.groupBy("own").agg(
        value("Location").alias("location"), value("Provider").alias("provider")
    )
    partitioned = [n for n in names if any(c.isPartition for c in spark.catalog.listColumns(n))]
    parts = reduce(
        DataFrame.unionByName,
        (partitions(spark, n).select(F.lit(n).alias("own"), F.col("partition").alias("part_name")) for n in partitioned),
        rows_to_frame(spark, [], "own string, part_name string"),
    )
    buckets = columns_of.where("is_bucket")
    in_order = Window.partitionBy("own").orderBy("integer_idx")  # a table's columns
    return {
        "DBS": all_databases.select(db_id.alias("db_id"), "name", "db_location_uri"),
        "TBLS": tables_of.select(
            table_id.alias("tbl_id"), db_id.alias("db_id"), sd_id.alias("sd_id"), "tbl_name", "tbl_type"
        ),
        "SDS": stored.select(sd_id.alias("sd_id"), cd_id.alias("cd_id"), "location", "provider"),
        "COLUMNS_V2": columns_of.select(
            cd_id.alias("cd_id"), "column_name", "type_name", "integer_idx"
        ),
        "PARTITIONS": parts.select(
            F.xxhash64("own", "part_name").alias("part_id"), table_id.alias("tbl_id"), "part_name"
        ),
        "BUCKETING_COLS": buckets.select(
            sd_id.alias("sd_id"),
            F.col("column_name").alias("bucket_col_name"),
            (F.row_number().over(in_order) - 1).alias("integer_idx"),
        ),
    }


def register_metastore(spark: SparkSession, database: str, prefix: str = "") -> None:
    """Make the relations of ``metastore`` visible to SQL under their names after ``prefix``."""
    for name, relation in metastore(spark, database).items():
        relation.createOrReplaceTempView(prefix + name)


def register_view(df: DataFrame, name: str) -> None:
    """Make a frame visible to SQL for this session, replacing a view of the same name."""
    df.createOrReplaceTempView(name)


def create_text_table(
    spark: SparkSession,
    table: str,
    columns: Mapping[str, str],
    *,
    location: str | None = None,
    options: Mapping[str, str] | None = None,
) -> None:
    """Create a delimited text table unless it exists.

    With ``location`` it is external, over files already there, which dropping the
    table leaves alone; without, it is managed. ``CHAR(n)`` columns read padded with blanks to n
    characters and cut to n: an external table with such columns is a view of that name over a table
    ``<name>__text``, which has the values as they are in the files; ``drop_table`` drops both.
    A managed table keeps every value unless ``options`` say otherwise: outer blanks, ``''``
    beside NULL, and line breaks.
    """
    if options is None:
        options = text_table_options()
        if location is None:
            options = {**CSV_LOSSLESS, **options}
    fields = ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
    settings = ", ".join(
        f"{_literal(key)} {_literal(value)}"
        for key, value in options.items()
    )
    place = f" LOCATION {_literal(location)}" if location else ""
    cut = {name: found[1] for name, kind in columns.items() if (found := _CHAR.fullmatch(kind.strip()))}
    if not cut or location is None:
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({fields}) USING csv OPTIONS ({settings}){place}"
        )
        return
    text = _text_table(table)
    fields = ", ".join(
        f"`{name}` {'STRING' if name in cut else kind}" for name, kind in columns.items()
    )
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {text} ({fields}) USING csv OPTIONS ({settings}){place}"
    )
    values = ", ".join(
        f"rpad(`{name}`, {cut[name]}, ' ') AS `{name}`" if name in cut else f"`{name}`"
        for name in columns
    )
    spark.sql(f"CREATE VIEW IF NOT EXISTS {table} AS SELECT {values} FROM {text}")


def drop_table(spark: SparkSession, table: str) -> None:
    """Drop a table of ``create_text_table``; the files of an external one stay."""
    if spark.catalog.getTable(table).tableType == "VIEW":
        spark.sql(f"DROP VIEW {table}")
        table = _text_table(table)
    spark.sql(f"DROP TABLE {table}")


def _text_table(table: str) -> str:
    """The name of the table behind a view that cuts ``CHAR`` values."""
    return re.sub("`?$", lambda end: "__text" + end[0], table, count=1)


def create_file_table(spark: SparkSession, table: str, provider: str, location: str) -> None:
    """Create an external table over existing self-describing files such as Parquet."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} USING {provider} LOCATION {_literal(location)}"
    )
