"""Copies of the given Parquet tables in the other formats the readers are for.

Every copy is written by Spark tasks into the shared scratch folder, whole, and once
per session and state of the table's files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom import catalog
from tableloom.session import new_scratch
from tableloom.sinks import write_csv, write_json

# Files with line breaks inside values are read by one task each: keep them moderate.
TEXTS_PER_FILE = 20_000
ROWS_PER_FILE = 2_000_000

_written: dict[tuple, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(table_path(folder, name))


def table_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def state_of(df: DataFrame) -> tuple:
    """Names, sizes and times of the files a frame is read from; a new version differs.

    Taken from the file listing that the scan was planned with; no data is read.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def staged(
    spark: SparkSession, folder: str, name: str, label: str, write: Callable[[str], None]
) -> str:
    """Path of a copy of table ``name``, written by ``write(path)`` on first use.

    A table that was rewritten since is copied anew.
    """
    key = (spark.sparkContext.applicationId, folder, label, state_of(table(spark, folder, name)))
    if key not in _written:
        path = new_scratch(spark, label)
        write(path)
        _written[key] = path
    return _written[key]


def new_database(spark: SparkSession, label: str) -> str:
    """A new database whose managed tables lie in the scratch folder."""
    path = new_scratch(spark, label)
    name = "tableloom_" + path.rsplit("/", 1)[1].replace("-", "_")
    catalog.create_database(spark, name, path)
    return name


def csv_copy(spark: SparkSession, folder: str, name: str, *, header: bool) -> str:
    """A given table as plain CSV."""
    return staged(
        spark,
        folder,
        name,
        f"{name}-csv-{'header' if header else 'bare'}",
        lambda path: write_csv(table(spark, folder, name), path, header=header),
    )


def json_copy(spark: SparkSession, folder: str, name: str) -> str:
    """A given table as JSON lines."""
    return staged(
        spark,
        folder,
        name,
        f"{name}-json",
        lambda path: write_json(table(spark, folder, name), path),
    )


# The columns of a flat register of places and their names in the common shape.
FLAT_NAMES = {
    "HSISID": "datasetId",
    "NAME": "name",
    "ADDRESS1": "address1",
    "ADDRESS2": "address2",
    "CITY": "city",
    "STATE": "state",
    "POSTALCODE": "zip",
    "PHONENUMBER": "tel",
    "RESTAURANTOPENDATE": "dateStart",
    "FACILITYTYPE": "type",
    "X": "geoX",
    "Y": "geoY",
}


def flat_orders(spark: SparkSession, folder: str) -> tuple[str, str]:
    """The orders as a flat register: path of the CSV files, and their schema.

    Two thirds have no second address line; none has an end date.
    """
    register = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("OBJECTID"),
        F.concat(F.lit("H"), "o_orderkey").alias("HSISID"),
        F.concat(F.lit("Customer "), "o_custkey").alias("NAME"),
        F.concat("o_custkey", F.lit(" Main St, Side A")).alias("ADDRESS1"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Unit "), F.col("o_orderkey") % 10)).alias(
            "ADDRESS2"
        ),
        F.concat(F.lit("City "), F.col("o_custkey") % 7).alias("CITY"),
        F.col("o_orderstatus").alias("STATE"),
        (27000 + F.col("o_custkey") % 1000).cast("int").alias("POSTALCODE"),
        F.concat(F.lit("919-"), "o_custkey").alias("PHONENUMBER"),
        F.to_date("o_orderdate").alias("RESTAURANTOPENDATE"),
        F.col("o_orderpriority").alias("FACILITYTYPE"),
        F.col("o_custkey").alias("PERMITID"),
        F.col("o_totalprice").alias("X"),
        (-F.col("o_totalprice")).alias("Y"),
        F.lit("M").alias("GEOCODESTATUS"),
    )
    path = staged(
        spark, folder, "orders", "orders-flat", lambda path: write_csv(register, path, header=True)
    )
    return path, register.schema


def nested_events(spark: SparkSession, folder: str) -> str:
    """The events as a nested register: JSON lines with one ``fields`` struct.

    Errors have no location, and the type of a click has no code before it. A place closes up
    to 29 days after it opened.
    """
    events = table(spark, folder, "events")
    opened = F.to_date("ts")
    register = events.select(
        F.concat(F.lit("rec-"), "event_id").alias("recordid"),
        F.col("ts").alias("record_timestamp"),
        F.struct(
            F.col("event_id").alias("id"),
            F.concat(F.lit("User "), "user_id").alias("premise_name"),
            F.concat("user_id", F.lit(" Oak Ave")).alias("premise_address1"),
            F.when(F.col("event_id") % 2 == 0, F.lit("Rear")).alias("premise_address2"),
            F.concat(F.lit("Town "), F.col("user_id") % 5).alias("premise_city"),
            F.lit("NC").alias("premise_state"),
            F.concat(F.lit("0"), F.col("user_id") % 90 + 1000).alias("premise_zip"),
            F.concat(F.lit("(919) "), "user_id").alias("premise_phone"),
            opened.alias("opening_date"),
            F.date_add(opened, (F.col("event_id") % 29 + 1).cast("int")).alias("closing_date"),
            F.when(F.col("event_type") == "click", F.col("event_type"))
            .otherwise(F.concat("user_id", F.lit(" - "), "event_type"))
            .alias("type_description"),
            F.when(
                F.col("event_type") != "error",
                F.array("value", F.col("user_id").cast("double")),
            ).alias("geolocation"),
        ).alias("fields"),
    )
    return staged(
        spark, folder, "events", "events-nested", lambda path: write_json(register, path)
    )


# The fields of a nested register of places.
NESTED_NAMES = {
    "datasetId": "id",
    "name": "premise_name",
    "address1": "premise_address1",
    "address2": "premise_address2",
    "city": "premise_city",
    "state": "premise_state",
    "zip": "premise_zip",
    "tel": "premise_phone",
    "dateStart": "opening_date",
    "dateEnd": "closing_date",
}
NESTED_EVENTS = """
    recordid string,
    record_timestamp timestamp_ntz,
    fields struct<
        id: bigint,
        premise_name: string,
        premise_address1: string,
        premise_address2: string,
        premise_city: string,
        premise_state: string,
        premise_zip: string,
        premise_phone: string,
        opening_date: date,
        closing_date: date,
        type_description: string,
        geolocation: array<double>>
"""


def flawed_orders(spark: SparkSession, folder: str) -> str:
    """The orders as CSV lines, some of them spoilt: every seventh key is no number, every
    eleventh line ends early, every thirteenth has a value too many."""
    orders = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("string")
    number = F.when(key % 7 == 0, F.concat(F.lit("x"), key)).otherwise(key.cast("string"))
    whole = F.concat_ws(",", number, "o_orderstatus", price)
    line = (
        F.when(key % 11 == 0, F.concat_ws(",", number, "o_orderstatus"))
        .when(key % 13 == 0, F.concat(whole, F.lit(",more")))
        .otherwise(whole)
    )
    return staged(
        spark, folder, "orders", "orders-flawed",
        lambda path: orders.select(line.alias("value")).write.text(path),
    )
