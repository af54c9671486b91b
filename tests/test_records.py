import datetime
import os
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings as limits
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableloom.sinks import read_records, spread_by_bytes, text_bytes, write_records
from tableloom.sources import Counted, bad_rows, good_rows, json_variants, part_rows, read_checked, variant_schema

TEXTS = [
    " pad ", "", None, "x\ny", "\\N", "\\", "\\\\n", "\\n", "p,q", '"', '""', "\u0001", "\r\n", "\r", "\\s", "\\e",
    "\t", "a\x85b\u2028c", "é🙂", "\\eN", "trailing\\", "NULL", "\x00",
]


def test_every_text_comes_back(spark, tmp_path):
    for sep in (",", "|", "\t", "||"):
        rows = [(i, t, sep + (t or "") + sep) for i, t in enumerate(TEXTS)]
        df = spark.createDataFrame(rows, "id int, t string, u string")
        path = str(tmp_path / f"texts{ord(sep[0])}{len(sep)}")
        write_records(df.coalesce(1), path, sep=sep)
        lines = spark.read.option("lineSep", "\n").text(path)
        assert lines.count() == len(rows)
        assert sorted(map(tuple, read_records(spark, path, df.schema, sep=sep).collect())) == rows


def test_one_column_of_texts(spark, tmp_path):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    write_records(df, str(tmp_path / "one"))
    got = [r[0] for r in read_records(spark, str(tmp_path / "one"), "t string").collect()]
    assert sorted(got, key=repr) == sorted(TEXTS, key=repr)


def test_other_plain_types_come_back(spark, tmp_path):
    row = (
        2**63 - 1, -0.1, float("nan"), float("-inf"), Decimal("-12.340"), True, datetime.date(1, 1, 1),
        datetime.datetime(2024, 3, 31, 1, 30, 0, 123456), datetime.datetime(1969, 12, 31, 23, 59, 59, 999999),
        bytearray(b"\x00\xff,\n"),
    )
    ddl = "a bigint, b double, c double, d float, e decimal(9,3), f boolean, g date, h timestamp_ntz, i timestamp, j binary"
    df = spark.createDataFrame([row, (None,) * len(row)], ddl)
    write_records(df, str(tmp_path / "types"))
    got = read_records(spark, str(tmp_path / "types"), df.schema)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))


@limits(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.none() | st.text(alphabet="\\,\n\rNnes x", max_size=8), st.none() | st.integers(0, 9)), min_size=1, max_size=30))
def test_random_rows_come_back(spark, tmp_path_factory, rows):
    df = spark.createDataFrame(rows, "t string, n int")
    path = str(tmp_path_factory.mktemp("random") / "out")
    write_records(df, path)
    assert sorted(map(repr, read_records(spark, path, df.schema).collect())) == sorted(map(repr, df.collect()))


def test_what_a_line_cannot_hold_is_refused(spark, tmp_path):
    with pytest.raises(TypeError, match="plain value"):
        write_records(spark.sql("SELECT array(1) AS a"), str(tmp_path / "no"))


@pytest.mark.parametrize("line", ["1", "1,2,3", "x,2"])
def test_lines_of_another_shape_fail(spark, tmp_path, line):
    (tmp_path / "bad.txt").write_text(line + "\n")
    with pytest.raises(Exception, match="not 2 values|CAST_INVALID_INPUT"):
        read_records(spark, str(tmp_path / "bad.txt"), "a int, b int").collect()


def test_one_large_file_is_read_by_several_tasks(spark, tmp_path, settings):
    df = spark.range(20_000).select("id", F.concat(F.lit("line\nbreak "), "id").alias("t"))
    path = str(tmp_path / "large")
    write_records(df.coalesce(1), path)
    settings(files__maxPartitionBytes="64k", files__openCostInBytes="1k")
    got = read_records(spark, path, df.schema)
    assert got.rdd.getNumPartitions() > 4
    assert got.exceptAll(df).count() == 0 and got.count() == 20_000


def test_files_of_equal_bytes(spark, tmp_path):
    rows = [(i, "x" * (1 + 40 * (i % 50 == 0)) * (i % 17)) for i in range(3000)]
    rows += [(5000, None), (5001, "y" * 3000)]
    df = spark.createDataFrame(rows, "id int, own string").repartition(7)
    df.write.parquet(str(tmp_path / "given"))
    given_rows = spark.read.parquet(str(tmp_path / "given"))
    dealt = spread_by_bytes(given_rows, 6)
    assert dealt.columns == ["id", "own"] and dealt.rdd.getNumPartitions() == 6
    sizes = dealt.groupBy(F.spark_partition_id()).agg(F.sum(text_bytes(dealt)).alias("s")).collect()
    sizes = [r["s"] for r in sizes]
    widest = given_rows.agg(F.max(text_bytes(given_rows))).first()[0]
    assert len(sizes) == 6 and max(sizes) <= sum(sizes) / 6 + widest
    assert sorted(map(tuple, dealt.collect()), key=repr) == sorted(rows, key=repr)


def test_files_of_documents_are_within_a_fifth_of_the_mean(spark, tmp_path):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    write_records(spread_by_bytes(documents, 5), str(tmp_path / "out"))
    sizes = [p.stat().st_size for p in (tmp_path / "out").glob("part-*")]
    assert len(sizes) == 5 and max(sizes) <= 1.2 * sum(sizes) / 5


def test_empty_frames_spread_and_round_trip(spark, tmp_path):
    empty = spark.createDataFrame([], "a int, part string")
    assert spread_by_bytes(empty, 3).count() == 0
    write_records(empty, str(tmp_path / "none"))
    assert read_records(spark, str(tmp_path / "none"), empty.schema).count() == 0


FLAWED = "1,a,2.5\nx,b,1\n2,c\n3,d,4,5\n4,,\n\n5,e,zz\n"


def test_malformed_lines_are_set_apart(spark, tmp_path):
    (tmp_path / "in.csv").write_text(FLAWED)
    df = read_checked(spark, str(tmp_path / "in.csv"), "a int, b string, c double")
    good = sorted(map(tuple, good_rows(df).collect()))
    assert good == [(1, "a", 2.5), (4, None, None)]
    bad = sorted(r[0] for r in bad_rows(df).collect())
    assert bad == ["2,c", "3,d,4,5", "5,e,zz", "x,b,1"]
    # What is malformed does not depend on the columns that a query uses.
    assert good_rows(df).select("a").count() == 2
    parted = part_rows(df, str(tmp_path / "out"))
    assert parted.counts == {"good": 2, "bad": 4}
    assert sorted(map(tuple, parted.good.collect())) == good
    assert sorted(r[0] for r in parted.bad.collect()) == bad


def test_malformed_json(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"a":1}\n{"a":"x"}\n{"a":\n{"b":2}\n')
    df = read_checked(spark, str(tmp_path / "in.json"), "a int", format="json", column="broken")
    assert sorted(r[0] for r in bad_rows(df, "broken").collect()) == ['{"a":', '{"a":"x"}']
    assert sorted((r[0] for r in good_rows(df, "broken").collect()), key=repr) == [1, None]
    with pytest.raises(ValueError, match="name another"):
        read_checked(spark, "x", "Malformed int")


def test_counts_come_with_the_write(spark, tmp_path):
    counted = Counted()
    all_rows = counted.step(spark.range(100), "load", total=F.col("id"))
    some = counted.step(all_rows.where("id % 3 = 0"), "thirds")
    with pytest.raises(ValueError, match="two steps"):
        counted.step(some, "load")
    some.write.parquet(str(tmp_path / "out"))
    assert counted.counts() == {"load": {"rows": 100, "total": 4950}, "thirds": {"rows": 34}}
    got = [tuple(r) for r in counted.rows(spark).orderBy("step").collect()]
    assert got == [(0, "load", 100, 100, 0), (1, "thirds", 100, 34, 66)]


def test_schema_of_all_records(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"a":1,"s":{"x":1}}\n{"a":2.5,"s":{"y":"t"}}\n{"l":[1,null]}\n')
    schema = variant_schema(json_variants(spark, str(tmp_path / "in.json")))
    assert schema.simpleString() == "struct<a:double,l:array<bigint>,s:struct<x:bigint,y:string>>"
    (tmp_path / "list.json").write_text("[1]\n[2]\n")
    with pytest.raises(Exception):
        variant_schema(json_variants(spark, str(tmp_path / "list.json")))
