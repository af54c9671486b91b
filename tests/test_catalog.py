import itertools

import pytest
from pyspark.errors import AnalysisException

from tableloom import catalog
from tableloom.operators import plan_text, where_in
from tableloom.sinks import insert_frame, insert_rows
from tableloom.sources import CSV_LOSSLESS, rows_to_frame

numbers = itertools.count()


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


@pytest.fixture
def database(spark, tmp_path):
    name = f"shelf{next(numbers)}"
    catalog.create_database(spark, name, str(tmp_path / name))
    return name


SHOP_COLUMNS = {
    "NUM": "INT",
    "NAME": "CHAR(100)",
    "CITY": "CHAR(100)",
    "STATE": "CHAR(100)",
    "ID": "INT",
}


def test_databases(spark, database):
    assert {"default", database} <= {row.namespace for row in catalog.databases(spark).collect()}
    catalog.create_database(spark, database)
    before = catalog.use_database(spark, database)
    try:
        assert spark.catalog.currentDatabase() == database
    finally:
        assert catalog.use_database(spark, before) == database
    assert spark.catalog.currentDatabase() == before


def test_external_table_reads_quotes_and_skips_the_header(spark, database, shops):
    catalog.create_text_table(spark, f"{database}.shops", SHOP_COLUMNS, location=shops)
    frame = spark.table(f"{database}.shops")
    assert frame.count() == 4
    first = frame.where("NUM = 1").first()
    assert first.NAME == "Pot, Pan & Kettle".ljust(100)
    assert (first.STATE.strip(), first.ID) == ("FR", 1)


def test_plain_delimited_table_takes_every_comma_and_the_header_line(spark, database, shops):
    catalog.create_text_table(
        spark,
        f"{database}.shops",
        SHOP_COLUMNS,
        location=shops,
        options=catalog.text_table_options(header=False, quoted=False),
    )
    names = spark.sql(f"SELECT NAME FROM {database}.shops LIMIT 10").collect()
    assert [row.NAME for row in names[:2]] == ["name".ljust(100), "Green Mill".ljust(100)]
    assert len(names) == 5
    header = spark.table(f"{database}.shops").where("trim(NAME) = 'name'").first()
    assert (header.NUM, header.ID) == (None, None)
    shifted = spark.table(f"{database}.shops").where("NUM = 1").first()
    assert shifted.NAME.strip() == '"Pot'
    assert shifted.ID is None


def test_plain_delimited_table_with_missing_and_extra_values(spark, database, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text('1,a,5\n2,\\N,\\N\n3,"b\n4,c,7,8,9\nx,d,y\n5,,\n6, e ,1\n')
    catalog.create_text_table(
        spark,
        f"{database}.loose",
        {"i": "INT", "s": "STRING", "n": "INT"},
        location=str(tmp_path / "in"),
        options=catalog.text_table_options(header=False, quoted=False),
    )
    assert rows(spark.table(f"{database}.loose")) == [
        (1, "a", 5),
        (2, None, None),
        (3, '"b', None),
        (4, "c", 7),
        (5, None, None),
        (6, " e ", 1),
        (None, "d", None),
    ]


def test_dropping_an_external_table_leaves_its_files(spark, database, shops):
    catalog.create_text_table(spark, f"{database}.shops", SHOP_COLUMNS, location=shops)
    catalog.drop_table(spark, f"{database}.shops")
    assert spark.read.text(shops).count() == 5


STAFF = {"emp_id": "INT", "name": "STRING", "position": "STRING", "salary": "FLOAT"}


def test_managed_table_insert(spark, database):
    name = f"{database}.staff"
    catalog.create_text_table(spark, name, STAFF)
    staff = [(1, "Ada", "Analyst", 75000.0), (2, "Bo, Jr", "Cook", 95000.0), (3, None, "x", 0.1)]
    insert_rows(spark, name, staff)
    spark.sql(f"INSERT INTO {name} VALUES (4, 'Cy', 'Editor', 85000.00)")
    insert_frame(
        rows_to_frame(
            spark,
            [("Di", 5, 1.5, "Clerk")],
            "name string, emp_id bigint, salary double, position string",
        ),
        name,
    )
    found = {row.emp_id: row for row in spark.table(name).collect()}
    assert len(found) == 5
    assert [found[i].salary for i in (1, 2, 4, 5)] == [75000.0, 95000.0, 85000.0, 1.5]
    assert (found[2].name, found[3].name, found[5].name) == ("Bo, Jr", None, "Di")


def test_text_table_that_keeps_every_value(spark, database):
    name = f"{database}.notes"
    options = {**catalog.text_table_options(), **CSV_LOSSLESS}
    catalog.create_text_table(spark, name, {"i": "INT", "s": "STRING"}, options=options)
    notes = [(1, " a\nb "), (2, ""), (3, None), (4, 'say "hi", ok')]
    insert_rows(spark, name, notes[:2])
    insert_rows(spark, name, notes[2:])
    assert rows(spark.table(name)) == notes


def test_listings(spark, database):
    name = f"{database}.staff"
    catalog.create_text_table(spark, name, STAFF)
    catalog.register_view(spark.range(1), "not_a_table")
    assert rows(catalog.tables(spark, database)) == [(database, "staff")]
    assert [row[:3] for row in rows(catalog.columns(spark, name))] == [
        (0, "emp_id", "int"),
        (1, "name", "string"),
        (2, "position", "string"),
        (3, "salary", "float"),
    ]
    details = {row.col_name: row.data_type for row in catalog.storage(spark, name).collect()}
    assert details["Type"] == "MANAGED"
    assert details["Provider"] == "csv"


def test_partitions_and_buckets(spark, database):
    frame = rows_to_frame(spark, [(1, "a"), (2, "a"), (3, "b")], "n int, kind string")
    frame.write.partitionBy("kind").saveAsTable(f"{database}.parted")
    frame.write.bucketBy(4, "n").saveAsTable(f"{database}.bucketed")
    assert rows(catalog.partitions(spark, f"{database}.parted")) == [("kind=a",), ("kind=b",)]
    flags = {row.column_name: row for row in catalog.columns(spark, f"{database}.parted").collect()}
    assert flags["kind"].is_partition and not flags["n"].is_partition
    flags = {row.column_name: row for row in catalog.columns(spark, f"{database}.bucketed").collect()}
    assert flags["n"].is_bucket
    details = {
        row.col_name: row.data_type
        for row in catalog.storage(spark, f"{database}.bucketed").collect()
    }
    assert details["Num Buckets"] == "4"
    with pytest.raises(AnalysisException):
        catalog.partitions(spark, f"{database}.bucketed")


def test_view(spark):
    catalog.register_view(rows_to_frame(spark, [(1, "a")], "n int, s string"), "some_rows")
    assert rows(spark.sql("SELECT * FROM some_rows")) == [(1, "a")]
    assert rows(spark.sql("SELECT s FROM some_rows")) == [("a",)]


TEXTS = [" pad ", "", None, "x\ny", "\\N", "p,q", '"', "\r\n"]


def test_surplus_columns_are_refused(spark, database):
    catalog.create_text_table(spark, f"{database}.two", {"n": "INT", "t": "STRING"})
    frame = spark.createDataFrame([(1, "a", "LOST")], "n int, t string, u string")
    with pytest.raises(ValueError, match="no column u"):
        insert_frame(frame, f"{database}.two")
    insert_frame(frame.select("t", "n"), f"{database}.two")
    assert rows(spark.table(f"{database}.two")) == [(1, "a")]


def test_managed_tables_keep_texts_or_refuse_them(spark, database):
    name = f"{database}.texts"
    catalog.create_text_table(spark, name, {"n": "INT", "t": "STRING"})
    insert_rows(spark, name, list(enumerate(TEXTS)))
    assert rows(spark.table(name)) == sorted(enumerate(TEXTS), key=repr)
    with pytest.raises(Exception, match="mark for NULL"):
        insert_rows(spark, name, [(9, "\u0001")])
    with pytest.raises(Exception, match="mark for NULL"):
        insert_frame(spark.createDataFrame([(9, "\u0001")], "n int, t string"), name)
    assert spark.table(name).count() == len(TEXTS)


def test_plain_delimited_tables_refuse_texts(spark, database):
    options = catalog.text_table_options(header=False, quoted=False)
    catalog.create_text_table(spark, f"{database}.plain", {"n": "INT", "t": "STRING"}, options=options)
    with pytest.raises(ValueError, match="lossless"):
        insert_rows(spark, f"{database}.plain", [(1, " pad ")])
    catalog.create_text_table(spark, f"{database}.numbers", {"n": "INT"}, options=options)
    insert_rows(spark, f"{database}.numbers", [(1,), (2,)])
    assert rows(spark.table(f"{database}.numbers")) == [(1,), (2,)]


def test_char_columns_are_padded_and_cut(spark, database, tmp_path):
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "a.csv").write_text("1,{}\n2,ab\n3,\n".format("x" * 120))
    catalog.create_text_table(
        spark, f"`{database}`.`long`", {"n": "INT", "t": "CHAR(100)"}, location=str(tmp_path / "long"),
        options=catalog.text_table_options(header=False),
    )
    got = dict(map(tuple, spark.table(f"{database}.long").collect()))
    assert got == {1: "x" * 100, 2: "ab".ljust(100), 3: None}
    whole = dict(map(tuple, spark.table(f"{database}.long__text").collect()))
    assert whole[1] == "x" * 120


def test_partition_values_of_two_levels(spark, database):
    odd = [None, "a=b", "c/d", "e%f+g h", "é"]
    frame = spark.createDataFrame([(i, a, b) for i, a in enumerate(odd) for b in (None, "x/=")], "n int, p string, q string")
    catalog.create_partitioned_table(frame, f"{database}.levels", ["p", "q"])
    got = {tuple(r)[1:] for r in catalog.partition_values(spark, f"{database}.levels").collect()}
    assert got == {(a, b) for a in odd for b in (None, "x/=")}
    counts = spark.table(f"{database}.levels").groupBy("p", "q").count().withColumnRenamed("count", "n")
    both = catalog.partition_rows(spark, f"{database}.levels", counts).collect()
    assert len(both) == 10 and all(r["n"] == 1 and r["partition_spec"] for r in both)
    with pytest.raises(ValueError, match="partitioned by"):
        catalog.partition_rows(spark, f"{database}.levels", counts.drop("q"))


def test_bucketed_tables_are_filtered_without_a_shuffle(spark, database, tables, settings):
    settings(autoBroadcastJoinThreshold="-1", adaptive__enabled="false")
    orders = spark.read.parquet(f"{tables}/orders.parquet")
    catalog.create_bucketed_table(orders, f"{database}.dealt", 8, ["o_custkey"], sort=["o_custkey"])
    wanted = spark.read.parquet(f"{tables}/customer.parquet").where("c_nationkey = 3").select("c_custkey")
    found = where_in(spark.table(f"{database}.dealt"), "o_custkey", wanted, unique=True)
    plan = plan_text(found, "simple")
    join = plan.index("SortMergeJoin")
    left, right = plan[join:].split("FileScan")[1:3]
    assert "Bucketed: true" in left and plan[join:].split("FileScan")[0].count("Exchange") == 0
    assert "Exchange" in plan[join:].split("FileScan")[1]
    assert found.count() == where_in(orders, "o_custkey", wanted, unique=True).count()
    details = catalog.storage_details(spark, f"{database}.dealt").first()
    assert tuple(details) == ("parquet", "MANAGED", 8, ["o_custkey"], ["o_custkey"])
    plain = f"{database}.plain_orders"
    orders.limit(1).write.saveAsTable(plain)
    assert tuple(catalog.storage_details(spark, plain).first())[2:] == (None, [], [])


def test_partitions_are_pruned_by_a_subquery(spark, database, tables):
    orders = spark.read.parquet(f"{tables}/orders.parquet")
    catalog.create_partitioned_table(orders, f"{database}.parted", ["o_orderstatus", "o_orderpriority"])
    spark.createDataFrame([("1-URGENT", 1), ("none", 0)], "p string, w int").createOrReplaceTempView("wanted_kinds")
    found = spark.sql(
        f"SELECT o_orderkey FROM {database}.parted WHERE o_orderstatus = 'O' "
        "AND o_orderpriority IN (SELECT p FROM wanted_kinds WHERE w = 1)"
    )
    plan = plan_text(found, "simple")
    assert "dynamicpruning" in plan and "o_orderstatus" in plan.split("PartitionFilters")[1][:200]
    assert found.count() == orders.where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'").count()


def test_metastore_relations_join(spark, database):
    spark.range(3).write.saveAsTable(f"{database}.nums")
    catalog.create_bucketed_table(spark.range(9).selectExpr("id", "id % 3 AS g"), f"{database}.dealt", 2, ["g", "id"])
    catalog.create_partitioned_table(spark.range(4).selectExpr("id", "id % 2 AS p"), f"{database}.parted", ["p"])
    catalog.register_metastore(spark, database, "ms_")
    q = lambda text: rows(spark.sql(text))
    assert q("SELECT tbl_name FROM ms_TBLS WHERE db_id IN (SELECT db_id FROM ms_DBS WHERE name = '%s')" % database) == [
        ("dealt",), ("nums",), ("parted",)
    ]
    assert q(
        "SELECT column_name, type_name, integer_idx FROM ms_COLUMNS_V2 WHERE cd_id IN (SELECT cd_id FROM ms_SDS "
        "WHERE sd_id IN (SELECT sd_id FROM ms_TBLS WHERE tbl_name = 'dealt'))"
    ) == [("g", "bigint", 1), ("id", "bigint", 0)]
    assert q("SELECT part_name FROM ms_PARTITIONS WHERE tbl_id = (SELECT tbl_id FROM ms_TBLS WHERE tbl_name = 'parted')") == [
        ("p=0",), ("p=1",)
    ]
    assert q("SELECT count(*) FROM ms_BUCKETING_COLS") == [(2,)]
    assert {r[0] for r in q("SELECT provider FROM ms_SDS")} == {"parquet"}
    catalog.create_database(spark, f"{database}_empty")
    assert all(f.count() == 0 for n, f in catalog.metastore(spark, f"{database}_empty").items() if n != "DBS")


def test_where_in_takes_any_key_name(spark):
    keys = spark.createDataFrame([(1,), (1,)], "`__hash` int")
    assert where_in(spark.range(3), "id", keys).count() == 1
