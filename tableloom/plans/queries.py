"""The registered queries: each takes (session, folder of Parquet tables)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from tableloom import catalog
from tableloom.functions import (
    composite_id,
    item,
    join_text,
    nested_fields,
    split_item,
    split_words,
    strip_blanks,
)
from tableloom.operators import (
    conform,
    first_rows,
    midpoint_and_copies,
    partition_sizes,
    rename_positional,
    replace_values,
    replicate,
    row_count,
    schema_json,
    schema_rows,
    spread,
    union_by_name,
    union_rows,
    union_typed,
    where_equal,
    where_in,
    where_scalar,
    word_counts,
)
from tableloom.plans import county_union as counties
from tableloom.plans import json_to_csv, word_count
from tableloom.plans.phases import enlarge_and_derive
from tableloom.plans.staging import (
    FLAT_NAMES,
    NESTED_EVENTS,
    NESTED_NAMES,
    ROWS_PER_FILE,
    TEXTS_PER_FILE,
    csv_copy,
    flat_orders,
    flawed_orders,
    json_copy,
    nested_events,
    new_database,
    staged,
    table,
    table_path,
)
from tableloom.session import new_scratch
from tableloom.sinks import (
    insert_frame,
    insert_rows,
    read_records,
    spread_by_bytes,
    text_bytes,
    write_csv,
    write_records,
)
from tableloom.sources import (
    Counted,
    json_variants,
    part_rows,
    read_checked,
    read_csv,
    read_json,
    read_lines,
    rows_to_frame,
    variant_fields,
    variant_schema,
)

Query = Callable[[SparkSession, str], DataFrame]

GIVEN_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Query] = {}


def query(key: str) -> Callable[[Query], Query]:
    """Register a function under ``key``."""

    def register(function: Query) -> Query:
        QUERIES[key] = function
        return function

    return register


# --- projections ------------------------------------------------------------


@query("project_columns")
def project_columns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "lang")


@query("sql_over_view")
def sql_over_view(spark: SparkSession, folder: str) -> DataFrame:
    catalog.register_view(table(spark, folder, "customer"), "tableloom_customers")
    return spark.sql("SELECT * FROM tableloom_customers")


@query("sql_column_over_view")
def sql_column_over_view(spark: SparkSession, folder: str) -> DataFrame:
    catalog.register_view(table(spark, folder, "part"), "tableloom_parts")
    return spark.sql("SELECT p_name FROM tableloom_parts")


@query("conform_rename_derive")
def conform_rename_derive(spark: SparkSession, folder: str) -> DataFrame:
    return conform(
        table(spark, folder, "customer"),
        rename={"c_custkey": "datasetId", "c_name": "name", "not_there": "ignored"},
        constants={"county": "Wake"},
        drop=["c_acctbal", "c_nationkey", "not_there"],
    )


@query("composite_id")
def composite_id_of_parts(spark: SparkSession, folder: str) -> DataFrame:
    return conform(
        table(spark, folder, "customer"),
        rename={"c_custkey": "datasetId"},
        constants={"county": "Wake"},
        derive={"id": composite_id("c_mktsegment", "county", "datasetId")},
        drop=["c_acctbal"],
    )


@query("rename_positional")
def rename_by_position(spark: SparkSession, folder: str) -> DataFrame:
    return rename_positional(
        table(spark, folder, "supplier"), ["id", "name", "nation", "balance"]
    )


@query("nested_json_fields")
def nested_json_fields(spark: SparkSession, folder: str) -> DataFrame:
    # Only what the schema names is parsed, also within the struct.
    schema = "recordid string, fields struct<id: bigint, premise_name: string>"
    register = read_json(spark, nested_events(spark, folder), schema=schema)
    lifted = nested_fields("fields", {"datasetId": "id", "name": "premise_name"})
    return conform(register, derive=lifted, drop=["fields"])


@query("midpoint_and_copies")
def midpoints(spark: SparkSession, folder: str) -> DataFrame:
    limits = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_discount").alias("lcl"), F.col("l_tax").alias("ucl")
    )
    return midpoint_and_copies(limits, "lcl", "ucl")


@query("derive_then_drop")
def derive_then_drop(spark: SparkSession, folder: str) -> DataFrame:
    limits = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_discount").alias("lcl"), F.col("l_tax").alias("ucl")
    )
    return midpoint_and_copies(limits, "lcl", "ucl", mode="full")


# --- scalar functions -------------------------------------------------------


@query("concat_name")
def concat_name(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        "c_custkey", join_text("c_mktsegment", "c_name", sep=", ").alias("name")
    )


@query("split_take_item")
def split_take_item(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey", split_item("o_orderpriority", "-", 1).alias("priority")
    )


@query("split_take_missing_item")
def split_take_missing_item(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        "p_partkey",
        split_item("p_name", " ", 1).alias("second_word"),
        split_item("p_type", " - ", 1).alias("label"),
    )


@query("array_items")
def array_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        "vec_id",
        item("embedding", 0).alias("x"),
        item("embedding", 1).alias("y"),
        item("embedding", 1_000_000).alias("beyond"),
    )


@query("split_words")
def split_into_words(spark: SparkSession, folder: str) -> DataFrame:
    words = split_words("text")
    return table(spark, folder, "documents").select(
        "doc_id", F.size(words).alias("n_words"), F.array_join(words, "|").alias("words")
    )


@query("strip_whitespace")
def strip_whitespace(spark: SparkSession, folder: str) -> DataFrame:
    sentence = F.concat(F.lit("\t \n"), split_item("text", ".", 1), F.lit(" \r\n "))
    return table(spark, folder, "documents").select(
        "doc_id", strip_blanks(sentence).alias("sentence"), strip_blanks("text").alias("text")
    )


# --- filters, value edits, subqueries ---------------------------------------


@query("filter_equality")
def filter_equality(spark: SparkSession, folder: str) -> DataFrame:
    return where_equal(table(spark, folder, "orders"), o_orderstatus="O")


@query("filter_conjunction")
def filter_conjunction(spark: SparkSession, folder: str) -> DataFrame:
    return where_equal(
        table(spark, folder, "lineitem"), l_returnflag="R", l_linestatus="F", l_linenumber=1
    )


@query("replace_value")
def replace_value(spark: SparkSession, folder: str) -> DataFrame:
    return replace_values(table(spark, folder, "orders"), {"F": "FINAL"}, ["o_orderstatus"])


def _customers_of_region(spark: SparkSession, folder: str) -> DataFrame:
    nations = where_equal(table(spark, folder, "nation"), n_regionkey=1)
    customers = table(spark, folder, "customer")
    return where_in(customers, "c_nationkey", nations.select("n_nationkey"), unique=True)


def _orders_of_region(spark: SparkSession, folder: str) -> DataFrame:
    customers = _customers_of_region(spark, folder).select("c_custkey")
    orders = table(spark, folder, "orders")
    return where_in(orders, "o_custkey", customers, unique=True)


@query("in_subquery")
def in_subquery(spark: SparkSession, folder: str) -> DataFrame:
    return _customers_of_region(spark, folder)


@query("nested_in_subquery")
def nested_in_subquery(spark: SparkSession, folder: str) -> DataFrame:
    return _orders_of_region(spark, folder)


@query("deep_in_subquery")
def deep_in_subquery(spark: SparkSession, folder: str) -> DataFrame:
    orders = _orders_of_region(spark, folder).select("o_orderkey")
    lines = table(spark, folder, "lineitem")
    return where_in(lines, "l_orderkey", orders, unique=True)


@query("in_subquery_repeated_keys")
def in_subquery_repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    returned = where_equal(table(spark, folder, "lineitem"), l_returnflag="R")
    return where_in(table(spark, folder, "part"), "p_partkey", returned.select("l_partkey"))


@query("scalar_subquery_filter")
def scalar_subquery_filter(spark: SparkSession, folder: str) -> DataFrame:
    nation = where_equal(table(spark, folder, "nation"), n_name="NATION_3").select("n_nationkey")
    customers = where_scalar(table(spark, folder, "customer"), "c_nationkey", nation)
    return where_equal(customers, c_mktsegment="BUILDING")


@query("nested_scalar_subquery")
def nested_scalar_subquery(spark: SparkSession, folder: str) -> DataFrame:
    customer = where_scalar(
        table(spark, folder, "customer"),
        "c_nationkey",
        where_equal(table(spark, folder, "nation"), n_name="NATION_7").select("n_nationkey"),
    ).agg(F.max("c_custkey"))
    return where_scalar(table(spark, folder, "orders"), "o_custkey", customer)


@query("in_subquery_sql")
def in_subquery_sql(spark: SparkSession, folder: str) -> DataFrame:
    for name in ("nation", "customer", "orders"):
        catalog.register_view(table(spark, folder, name), f"tableloom_{name}")
    return spark.sql(
        """
        SELECT * FROM tableloom_orders WHERE o_custkey IN (
            SELECT c_custkey FROM tableloom_customer WHERE c_nationkey IN (
                SELECT n_nationkey FROM tableloom_nation WHERE n_regionkey = 1))
        """
    )


@query("scalar_subquery_sql")
def scalar_subquery_sql(spark: SparkSession, folder: str) -> DataFrame:
    for name in ("nation", "customer"):
        catalog.register_view(table(spark, folder, name), f"tableloom_{name}")
    return spark.sql(
        """
        SELECT c_custkey, c_name FROM tableloom_customer WHERE c_nationkey = (
            SELECT n_nationkey FROM tableloom_nation WHERE n_name = 'NATION_3')
        """
    )


# --- counts, limits, set operations -----------------------------------------


@query("row_count")
def count_rows(spark: SparkSession, folder: str) -> DataFrame:
    return row_count(table(spark, folder, "lineitem"))


@query("word_count")
def count_words(spark: SparkSession, folder: str) -> DataFrame:
    return word_counts(table(spark, folder, "documents"), "text")


@query("limit_rows")
def limit_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = first_rows(table(spark, folder, "orders"), 10, "o_orderkey")
    return orders.select("o_orderkey", "o_orderpriority")


@query("preview_limit")
def preview_limit(spark: SparkSession, folder: str) -> DataFrame:
    return first_rows(table(spark, folder, "lineitem"), 20, "l_orderkey", "l_linenumber").select(
        "l_orderkey", "l_linenumber"
    )


@query("union_by_name_conformed")
def union_by_name_conformed(spark: SparkSession, folder: str) -> DataFrame:
    target = StructType(
        [
            StructField("datasetId", LongType()),
            StructField("name", StringType()),
            StructField("bal", DoubleType()),
            StructField("dateEnd", StringType()),
        ]
    )
    customers = conform(
        table(spark, folder, "customer"),
        rename={"c_custkey": "datasetId", "c_name": "name", "c_acctbal": "bal"},
        target=target,
    )
    suppliers = conform(
        table(spark, folder, "supplier"),
        constants={"dateEnd": "2020-01-31"},
        rename={"s_suppkey": "datasetId", "s_name": "name", "s_acctbal": "bal"},
        target=target,
    )
    return union_by_name(customers, suppliers)


@query("union_self")
def union_self(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    return union_rows(customers, customers)


@query("replicate_rows")
def replicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return replicate(table(spark, folder, "supplier"), 61)


@query("enlarged_midpoints")
def enlarged_midpoints(spark: SparkSession, folder: str) -> DataFrame:
    limits = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    return enlarge_and_derive(limits, "p_size", "p_retailprice", copies=61, mode="col")


@query("repartition_rows")
def repartition_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "orders"), 16)


@query("partition_sizes")
def rows_of_all_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per partition after dealing by key: all rows of a key are in one partition."""
    dealt = table(spark, folder, "lineitem").repartition(6, "l_linenumber")
    sizes = partition_sizes(dealt)
    keys = dealt.groupBy(F.spark_partition_id().alias("partition"), "l_linenumber").count()
    summed = keys.groupBy("partition").agg(F.sum("count").alias("all"))
    held = keys.join(sizes, "partition").join(summed, "partition")
    exact = (sizes["n"] == F.col("all")).alias("held")
    return held.select("l_linenumber", F.col("count").alias("n"), exact)


@query("rows_to_frame")
def literal_rows_frame(spark: SparkSession, folder: str) -> DataFrame:
    wanted = rows_to_frame(
        spark, [["1-URGENT"], ["2-HIGH"]], StructType([StructField("name", StringType())])
    )
    return where_in(table(spark, folder, "orders"), "o_orderpriority", wanted)


# --- file sources and sinks -------------------------------------------------


@query("csv_scan_raw")
def csv_scan_raw(spark: SparkSession, folder: str) -> DataFrame:
    return read_csv(spark, csv_copy(spark, folder, "customer", header=False))


@query("csv_scan_header")
def csv_scan_header(spark: SparkSession, folder: str) -> DataFrame:
    return read_csv(spark, csv_copy(spark, folder, "orders", header=True), header=True)


@query("csv_scan_infer")
def csv_scan_infer(spark: SparkSession, folder: str) -> DataFrame:
    inferred = read_csv(
        spark, csv_copy(spark, folder, "orders", header=True), header=True, infer=True
    )
    return conform(inferred, target=table(spark, folder, "orders").schema)


@query("csv_scan_declared")
def csv_scan_declared(spark: SparkSession, folder: str) -> DataFrame:
    return read_csv(
        spark,
        csv_copy(spark, folder, "lineitem", header=True),
        header=True,
        schema=table(spark, folder, "lineitem").schema,
    )


@query("csv_sink_noheader")
def csv_sink_noheader(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    path = new_scratch(spark, "csv-sink")
    write_csv(parts, path)
    return read_csv(spark, path, schema=parts.schema)


@query("csv_lossless_texts")
def csv_lossless_texts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    path = new_scratch(spark, "csv-lossless-texts")
    write_csv(documents, path, lossless=True, max_records_per_file=TEXTS_PER_FILE)
    return read_csv(spark, path, schema=documents.schema, lossless=True)


@query("csv_lossless_timestamps")
def csv_lossless_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    path = new_scratch(spark, "csv-lossless-events")
    write_csv(events, path, header=True, lossless=True, max_records_per_file=ROWS_PER_FILE)
    return read_csv(spark, path, header=True, schema=events.schema, lossless=True)


@query("json_scan")
def json_scan(spark: SparkSession, folder: str) -> DataFrame:
    return read_json(
        spark,
        json_copy(spark, folder, "documents"),
        schema=table(spark, folder, "documents").schema,
    )


@query("json_scan_timestamps")
def json_scan_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    return read_json(
        spark, json_copy(spark, folder, "events"), schema=table(spark, folder, "events").schema
    )


@query("json_scan_infer")
def json_scan_infer(spark: SparkSession, folder: str) -> DataFrame:
    return read_json(spark, json_copy(spark, folder, "documents")).select("doc_id", "lang")


@query("json_project_csv")
def json_project_csv(spark: SparkSession, folder: str) -> DataFrame:
    source = json_copy(spark, folder, "documents")
    target = new_scratch(spark, "json-to-csv")
    schema = "doc_id bigint, lang string"
    json_to_csv.run(spark, source, target, ["doc_id", "lang"], schema=schema, num_files=5)
    return read_csv(spark, target, header=True, schema=schema)


@query("word_count_files")
def word_count_files(spark: SparkSession, folder: str) -> DataFrame:
    source = staged(
        spark,
        folder,
        "documents",
        "documents-text",
        lambda path: table(spark, folder, "documents").select("text").write.text(path),
    )
    target = new_scratch(spark, "word-count")
    word_count.run(spark, source, target)
    line = read_lines(spark, target)
    return line.select(
        split_item("value", "\t", 0).alias("word"),
        split_item("value", "\t", 1).cast("bigint").alias("n"),
    )


@query("county_union")
def county_union(spark: SparkSession, folder: str) -> DataFrame:
    path, schema = flat_orders(spark, folder)
    flat = counties.from_flat(
        read_csv(spark, path, header=True, schema=schema), "Wake", FLAT_NAMES, partitions=4
    )
    nested = counties.from_nested(
        read_json(spark, nested_events(spark, folder), schema=NESTED_EVENTS), "Durham", NESTED_NAMES
    )
    places = counties.county_union(flat, nested)
    return places.withColumns(
        {name: F.col(name).cast("string") for name in ("dateStart", "dateEnd")}
    )


@query("typed_union")
def typed_union(spark: SparkSession, folder: str) -> DataFrame:
    """Three registers with other types and other nested fields, united without a target."""
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("int").alias("key"),
        F.struct(
            F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
        ).alias("place"),
        F.array("c_nationkey").alias("codes"),
        F.col("c_nationkey").cast("smallint").alias("rank"),
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_acctbal").alias("rank"),
        F.concat(F.lit("S-"), "s_suppkey").alias("key"),
        F.when(
            F.col("s_suppkey") % 2 == 0,
            F.struct(F.col("s_nationkey").cast("bigint").alias("nation"), F.col("s_name").alias("label")),
        ).alias("place"),
    )
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("key"),
        F.array(F.col("p_partkey"), F.lit(None).cast("bigint")).alias("codes"),
        F.lit(None).alias("rank"),
    )
    united = union_typed(customers, suppliers, parts)
    return united.select(
        "key",
        F.col("place.nation").cast("string").alias("nation"),
        "place.segment",
        "place.label",
        "rank",
        F.array_join("codes", ",", "none").alias("codes"),
    )


@query("malformed_rows")
def malformed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Good orders and the text of bad ones, written apart in one pass, with their counts."""
    read = read_checked(
        spark,
        flawed_orders(spark, folder),
        "o_orderkey bigint, o_orderstatus string, o_totalprice double",
    )
    parted = part_rows(read, new_scratch(spark, "parted-orders"))
    counts = rows_to_frame(spark, list(parted.counts.items()), "kind string, n bigint")
    good = parted.good.select(
        F.lit("good").alias("kind"), F.col("o_orderkey").cast("string").alias("row"), "o_totalprice"
    )
    bad = parted.bad.select(F.lit("bad").alias("kind"), F.col("malformed").alias("row"))
    rows = good.unionByName(bad, allowMissingColumns=True)
    return rows.join(counts, "kind")


@query("record_texts")
def record_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents through text files of one record per line."""
    documents = table(spark, folder, "documents")
    path = new_scratch(spark, "record-texts")
    write_records(documents, path)
    return read_records(spark, path, documents.schema)


@query("record_timestamps")
def record_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    path = new_scratch(spark, "record-events")
    write_records(events, path, sep="|")
    return read_records(spark, path, events.schema, sep="|")


@query("json_schema_aggregate")
def json_schema_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """The fields of a nested register as all its records have them, and the values present."""
    records = json_variants(spark, nested_events(spark, folder))
    schema = variant_schema(records)
    found = schema_rows(spark.createDataFrame([], schema))
    rows = records.select(*variant_fields(schema))
    names = [r["field"] for r in found.select("field").toLocalIterator()]  # one per field
    present = rows.agg(*(F.count(F.col(name)).alias(name) for name in names))
    counted = present.unpivot([], [F.col(f"`{n}`") for n in names], "field", "n")
    return found.join(counted, "field").select("field", "type", "n")


@query("counts_while_writing")
def counts_while_writing(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in, out and dropped per step of a job, counted by the pass that writes its result."""
    counted = Counted()
    orders = counted.step(table(spark, folder, "orders"), "load")
    opened = counted.step(where_equal(orders, o_orderstatus="O"), "open")
    urgent = counted.step(where_equal(opened, o_orderpriority="1-URGENT"), "urgent")
    kept = counted.step(conform(urgent, drop=["o_orderstatus", "o_orderpriority"]), "write")
    write_records(kept, new_scratch(spark, "counted-orders"))
    return counted.rows(spark)


@query("files_of_equal_bytes")
def files_of_equal_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in five files of equal bytes: how many files and rows, and how even they are."""
    documents = table(spark, folder, "documents")
    path = new_scratch(spark, "equal-files")
    write_records(spread_by_bytes(documents, 5), path)
    written = read_records(spark, path, documents.schema)
    files = written.groupBy(F.input_file_name().alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(text_bytes(written)).alias("size"),
        F.max(text_bytes(written)).alias("widest"),
    )
    share = F.sum("size") / 5 + F.max("widest")
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("n").alias("rows"),
        (F.max("size") <= share).alias("within_a_row"),
    )


# --- catalog ----------------------------------------------------------------


@query("external_text_table")
def external_text_table(spark: SparkSession, folder: str) -> DataFrame:
    name = f"`{new_database(spark, 'external')}`.orders"
    orders = table(spark, folder, "orders")
    catalog.create_text_table(
        spark,
        name,
        {field.name: field.dataType.simpleString() for field in orders.schema},
        location=csv_copy(spark, folder, "orders", header=True),
    )
    return spark.table(name)


@query("external_text_table_char")
def external_text_table_char(spark: SparkSession, folder: str) -> DataFrame:
    name = f"`{new_database(spark, 'external_char')}`.customers"
    catalog.create_text_table(
        spark,
        name,
        {
            "num": "INT",
            "name": "CHAR(100)",
            "nation": "INT",
            "balance": "DOUBLE",
            "segment": "CHAR(100)",
        },
        location=csv_copy(spark, folder, "customer", header=False),
        options=catalog.text_table_options(header=False, quoted=False),
    )
    return spark.sql(f"SELECT num, name, segment FROM {name}")


@query("managed_table_insert")
def managed_table_insert(spark: SparkSession, folder: str) -> DataFrame:
    name = f"`{new_database(spark, 'staff')}`.employees"
    catalog.create_text_table(
        spark,
        name,
        {"emp_id": "INT", "name": "STRING", "position": "STRING", "salary": "FLOAT"},
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("emp_id"),
        F.col("s_name").alias("name"),
        F.lit("Supplier").alias("position"),
        F.col("s_acctbal").alias("salary"),
    )
    insert_frame(suppliers, name)
    insert_rows(
        spark,
        name,
        [
            (-1, "Ada Vale", "Analyst", 75000.0),
            (-2, "Bo, Tern", "Engineer", 95000.0),
            (-3, "Cy Wren", "Editor", 85000.0),
        ],
    )
    return spark.table(name)


@query("catalog_databases")
def catalog_databases(spark: SparkSession, folder: str) -> DataFrame:
    """Create a database, make it current and read a table of it by its bare name."""
    database = new_database(spark, "current")
    catalog.create_file_table(
        spark, f"`{database}`.tableloom_orders", "parquet", table_path(folder, "orders")
    )
    before = catalog.use_database(spark, database)
    try:
        return spark.sql("SELECT o_orderkey, o_orderstatus FROM tableloom_orders")
    finally:
        catalog.use_database(spark, before)


@query("list_databases")
def list_databases(spark: SparkSession, folder: str) -> DataFrame:
    """Five databases as the catalog lists them, with the nations of the region of that number."""
    label = "region_" + uuid.uuid4().hex
    nations = table(spark, folder, "nation").groupBy("n_regionkey").count()
    for number in range(5):
        path = new_scratch(spark, f"{label}_{number}")
        catalog.create_database(spark, f"{label}_{number}", path)
    listed = catalog.databases(spark).where(F.col("namespace").startswith(label))
    key = F.regexp_extract("namespace", "_([0-9]+)$", 1).cast("bigint").alias("n_regionkey")
    return listed.select(key).join(nations, "n_regionkey", "left")


@query("catalog_tables")
def catalog_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The tables a database lists, and the rows of each."""
    database = new_database(spark, "given")
    for name in GIVEN_TABLES:
        catalog.create_file_table(
            spark, f"`{database}`.{name}", "parquet", table_path(folder, name)
        )
    listed = [found.name for found in spark.catalog.listTables(database) if not found.isTemporary]
    return union_by_name(
        *(
            row_count(spark.table(f"`{database}`.{name}")).select(
                F.lit(name).alias("table_name"), "n"
            )
            for name in listed
        )
    )


@query("catalog_columns")
def catalog_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The columns the catalog lists for a table, and the values present in each."""
    name = f"`{new_database(spark, 'listed')}`.orders"
    catalog.create_file_table(spark, name, "parquet", table_path(folder, "orders"))
    listed = catalog.columns(spark, name)
    names = spark.table(name).columns
    present = (
        spark.table(name)
        .agg(*(F.count(column).alias(column) for column in names))
        .unpivot([], names, "column_name", "n")
    )
    return listed.join(present, "column_name").select("position", "column_name", "type", "n")


@query("catalog_storage")
def catalog_storage(spark: SparkSession, folder: str) -> DataFrame:
    """The partitions the catalog lists for a partitioned table, and the rows of each."""
    name = f"`{new_database(spark, 'partitioned')}`.orders"
    table(spark, folder, "orders").write.partitionBy("o_orderstatus").format(
        "parquet"
    ).saveAsTable(name)
    rows = spark.table(name).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return catalog.partition_rows(spark, name, rows)


@query("schema_as_rows")
def schema_as_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The field tree that schema inference finds by reading all of a nested JSON file."""
    return schema_rows(read_json(spark, nested_events(spark, folder)))


@query("schema_as_json")
def schema_as_json(spark: SparkSession, folder: str) -> DataFrame:
    """The columns that a frame's schema names as JSON, and the values present in each."""
    orders = table(spark, folder, "orders")
    kind = "fields array<struct<name string, type string, nullable boolean>>"
    read = spark.range(1).select(F.from_json(F.lit(schema_json(orders)), kind).alias("schema"))
    listed = read.select(F.inline("schema.fields"))
    present = orders.agg(*(F.count(c).alias(c) for c in orders.columns))
    counted = present.unpivot([], orders.columns, "name", "n")
    return listed.join(counted, "name").select("name", "type", "nullable", "n")


@query("partitions_two_levels")
def partitions_two_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The partitions listed for two levels, NULL and escaped names among them, and their rows."""
    name = f"`{new_database(spark, 'levels')}`.orders"
    orders = table(spark, folder, "orders").withColumns(
        {
            "state": F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
            "kind": F.concat(F.col("o_orderpriority"), F.lit("/=+% é")),
        }
    )
    catalog.create_partitioned_table(
        orders.select("o_orderkey", "o_totalprice", "state", "kind"), name, ["state", "kind"]
    )
    rows = spark.table(name).groupBy("state", "kind").agg(F.count(F.lit(1)).alias("n"))
    values = catalog.partition_values(spark, name)
    counted = catalog.partition_rows(spark, name, rows)
    return values.join(counted, "partition_spec").select("state", "kind", "n")


@query("partitions_pruned_by_subquery")
def partitions_pruned_by_subquery(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of the partitions that a subquery names; the other folders are not read."""
    database = new_database(spark, "pruned")
    orders = table(spark, folder, "orders")
    catalog.create_partitioned_table(
        orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"),
        f"`{database}`.orders",
        ["o_orderstatus", "o_orderpriority"],
    )
    urgent = orders.where("o_orderpriority LIKE '1%'").groupBy("o_orderpriority").count()
    catalog.register_view(urgent, "tableloom_urgent")
    return spark.sql(
        f"""
        SELECT o_orderkey, o_orderstatus, o_orderpriority FROM `{database}`.orders
        WHERE o_orderstatus = 'O'
          AND o_orderpriority IN (SELECT o_orderpriority FROM tableloom_urgent WHERE count > 0)
        """
    )


@query("bucketed_in_filter")
def bucketed_in_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of one region's customers, from a table in buckets by customer."""
    name = f"`{new_database(spark, 'bucketed')}`.orders"
    catalog.create_bucketed_table(
        table(spark, folder, "orders"), name, 8, ["o_custkey"], sort=["o_custkey"]
    )
    customers = _customers_of_region(spark, folder).select("c_custkey")
    return where_in(spark.table(name), "o_custkey", customers, unique=True)


@query("bucket_details")
def bucket_details(spark: SparkSession, folder: str) -> DataFrame:
    """How a bucketed table is stored, with its rows and the files they lie in."""
    name = f"`{new_database(spark, 'buckets')}`.lines"
    catalog.create_bucketed_table(
        table(spark, folder, "lineitem"), name, 4, ["l_orderkey", "l_linenumber"], sort=["l_orderkey"]
    )
    files = spark.table(name).groupBy(F.input_file_name().alias("file")).count()
    return catalog.storage_details(spark, name).select(
        "provider",
        "kind",
        "buckets",
        F.array_join("bucket_columns", ",").alias("bucket_columns"),
        F.array_join("sort_columns", ",").alias("sort_columns"),
        files.agg(F.sum("count")).scalar().alias("n"),
        files.agg(F.count(F.lit(1))).scalar().alias("files"),
    )


@query("metastore_sql")
def metastore_sql(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of a table, found by nested subqueries over the metastore's relations."""
    database = new_database(spark, "meta")
    for name in ("orders", "customer"):
        catalog.create_file_table(
            spark, f"`{database}`.{name}", "parquet", table_path(folder, name)
        )
    catalog.create_bucketed_table(
        table(spark, folder, "orders"), f"`{database}`.dealt", 4, ["o_custkey", "o_orderkey"]
    )
    catalog.register_metastore(spark, database, "tableloom_")
    names = spark.table(f"`{database}`.orders").columns
    present = spark.table(f"`{database}`.orders").agg(*(F.count(c).alias(c) for c in names))
    catalog.register_view(present.unpivot([], names, "column_name", "n"), "tableloom_present")
    return spark.sql(
        f"""
        SELECT c.integer_idx, c.column_name, c.type_name, p.n, coalesce(b.integer_idx, -1) AS bucket_idx
        FROM (
            SELECT * FROM tableloom_COLUMNS_V2 WHERE cd_id = (
                SELECT cd_id FROM tableloom_SDS WHERE sd_id = (
                    SELECT sd_id FROM tableloom_TBLS WHERE tbl_name = 'orders' AND db_id IN (
                        SELECT db_id FROM tableloom_DBS WHERE name = '{database}')))
        ) c
        JOIN tableloom_present p ON p.column_name = c.column_name
        LEFT JOIN (
            SELECT * FROM tableloom_BUCKETING_COLS WHERE sd_id IN (
                SELECT sd_id FROM tableloom_TBLS WHERE tbl_name = 'dealt')
        ) b ON b.bucket_col_name = c.column_name
        """
    )
