"""Readers and writers, on files with the usual traps."""

import datetime
import glob

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql.types import StringType

from tableloom.sinks import write_csv, write_json, write_tab_separated
from tableloom.sources import integer_range, read_csv, read_json, read_lines, rows_to_frame


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


def test_csv_without_header_keeps_the_header_line(spark, shops):
    raw = read_csv(spark, shops)
    assert raw.columns == ["_c0", "_c1", "_c2", "_c3", "_c4"]
    assert {field.dataType for field in raw.schema} == {StringType()}
    lines = raw.collect()
    assert lines[0][:] == (None, "name", "city", "state", "id")
    assert lines[1][:] == ("0", "Green Mill ", "Oslo", " NO", "0")
    assert lines[2][1] == "Pot, Pan & Kettle"
    assert lines[3][1] == "Käsehütte"


def test_csv_header_names_and_empty_header_cell(spark, shops):
    frame = read_csv(spark, shops, header=True)
    assert frame.columns == ["_c0", "name", "city", "state", "id"]
    assert {field.dataType for field in frame.schema} == {StringType()}
    assert frame.count() == 4


def test_csv_inferred_and_declared_types(spark, shops):
    inferred = read_csv(spark, shops, header=True, infer=True)
    assert [field.dataType.simpleString() for field in inferred.schema] == [
        "int",
        "string",
        "string",
        "string",
        "int",
    ]
    schema = "n int, name string, city string, state string, id bigint"
    declared = read_csv(spark, shops, header=True, schema=schema, enforceSchema="true")
    assert [tuple(row) for row in declared.collect()] == [
        tuple(row) for row in inferred.collect()
    ]


def test_csv_header_and_schema_must_agree(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n1,2\n")
    path = str(tmp_path / "in.csv")
    assert rows(read_csv(spark, path, header=True, schema="a int, b int")) == [(1, 2)]
    assert rows(read_csv(spark, path, header=True, schema="a int, b int").select("b")) == [(2,)]
    with pytest.raises(Exception, match="CSV header does not conform to the schema"):
        read_csv(spark, path, header=True, schema="b int, a int").collect()


def test_csv_writer_refuses_an_existing_folder(spark, tmp_path):
    target = str(tmp_path / "out")
    write_csv(spark.range(3), target)
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        write_csv(spark.range(3), target)
    write_csv(spark.range(4), target, mode="overwrite", header=True)
    assert read_csv(spark, target, header=True).count() == 4


def test_csv_writer_file_count(spark, tmp_path):
    target = str(tmp_path / "out")
    write_csv(spark.range(100), target, header=True, num_files=5)
    files = glob.glob(f"{target}/part-*.csv")
    assert len(files) == 5
    for file in files:
        with open(file) as lines:
            assert lines.readline() == "id\n"


def test_csv_writer_limits_records_per_file(spark, tmp_path):
    target = str(tmp_path / "out")
    write_csv(spark.range(0, 100, 1, 1), target, max_records_per_file=30)
    assert len(glob.glob(f"{target}/part-*.csv")) == 4


LOSSY_SCHEMA = "i int, s string, at timestamp_ntz, day date, x double, b boolean"
LOSSY = [
    (0, " outer blanks ", datetime.datetime(2024, 1, 2, 3, 4, 5, 678901), None, 0.1, True),
    (1, "line\nbreak", datetime.datetime(1999, 12, 31), datetime.date(1999, 12, 31), -0.0, None),
    (2, "carriage\r\nreturn", None, datetime.date(2024, 2, 29), 1e300, False),
    (3, 'quote " and ""', None, None, None, None),
    (4, "back\\slash \\N", None, None, 1 / 3, None),
    (5, "", None, None, None, None),
    (6, None, None, None, None, None),
    (7, "comma, tab\tand\vmore", None, None, None, None),
    (8, "\\", None, None, None, None),
    (9, '"', None, None, None, None),
    (10, "Käse 🧀", None, None, None, None),
    (11, "nul \x00 and \x02", None, None, None, None),
]


def test_lossless_csv_numbers(spark, tmp_path):
    frame = spark.sql(
        """
        SELECT * FROM VALUES
            (1, double('NaN'), float('-Infinity'), 9223372036854775807, 0.10BD,
             timestamp_ntz'0001-01-01 00:00:00.000001', date'9999-12-31'),
            (2, double('Infinity'), float('1e-45'), -9223372036854775807, 123.45BD,
             timestamp_ntz'9999-12-31 23:59:59.999999', date'0001-01-01'),
            (3, double('4.9e-324'), float('3.4028235e38'), 0, -0.01BD, NULL, NULL)
        AS rows(i, d, f, l, dec, at, day)
        """
    )
    target = str(tmp_path / "out")
    write_csv(frame, target, lossless=True)
    back = read_csv(spark, target, schema=frame.schema, lossless=True)
    assert [repr(row) for row in back.orderBy("i").collect()] == [
        repr(row) for row in frame.orderBy("i").collect()
    ]


@pytest.mark.parametrize("header", [True, False])
def test_lossless_csv_round_trip(spark, tmp_path, header):
    frame = rows_to_frame(spark, LOSSY, LOSSY_SCHEMA)
    target = str(tmp_path / "out")
    write_csv(frame, target, header=header, lossless=True)
    back = read_csv(spark, target, header=header, schema=frame.schema, lossless=True)
    assert rows(back) == rows(frame)


def test_plain_csv_loses_what_it_is_known_to_lose(spark, tmp_path):
    target = str(tmp_path / "out")
    write_csv(rows_to_frame(spark, [(1, " x "), (2, ""), (3, None)], "i int, s string"), target)
    assert rows(read_csv(spark, target, schema="i int, s string")) == [
        (1, "x"),
        (2, None),
        (3, None),
    ]


def test_lossless_csv_does_not_turn_bad_text_into_null(spark, tmp_path):
    (tmp_path / "in.csv").write_text("1,2\nx,3\n")
    path = str(tmp_path / "in.csv")
    assert rows(read_csv(spark, path, schema="a int, b int")) == [(1, 2), (None, 3)]
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING|FAILED_READ_FILE"):
        read_csv(spark, path, schema="a int, b int", lossless=True).collect()


awkward = st.text(
    alphabet=st.sampled_from(list("ab ,;#\"'\\\n\r\t\x00\x02\x0b\x85\u2028N|é😀")), max_size=10
)


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(values=st.lists(st.one_of(st.none(), awkward), min_size=1, max_size=60))
def test_lossless_csv_round_trip_of_any_text(spark, tmp_path_factory, values):
    frame = rows_to_frame(spark, list(enumerate(values)), "i int, s string")
    target = str(tmp_path_factory.mktemp("csv") / "out")
    write_csv(frame, target, lossless=True)
    back = read_csv(spark, target, schema=frame.schema, lossless=True)
    assert rows(back) == rows(frame)


def test_json_inference_and_declared_schema(spark, tmp_path):
    (tmp_path / "in.json").write_text(
        '{"b": 1, "a": {"y": [1, 2.5], "x": "t"}}\n{"b": 20000000000, "a": {"x": null}}\n'
    )
    inferred = read_json(spark, str(tmp_path / "in.json"))
    assert inferred.schema.simpleString() == "struct<a:struct<x:string,y:array<double>>,b:bigint>"
    declared = read_json(spark, str(tmp_path / "in.json"), schema="b bigint")
    assert rows(declared) == [(1,), (20000000000,)]


def test_json_round_trip(spark, tmp_path):
    frame = spark.sql(
        """
        SELECT * FROM VALUES
            (1, named_struct('t', 'a\n"b"\\ ', 'l', array(1.5D, NULL)),
             timestamp_ntz'2024-01-02 03:04:05.678901', timestamp'1999-12-31 23:59:59.000001'),
            (2, NULL, NULL, NULL),
            (3, named_struct('t', '', 'l', array()), timestamp_ntz'0001-01-01 00:00:00', NULL)
        AS rows(n, s, local, instant)
        """
    )
    target = str(tmp_path / "out")
    write_json(frame, target)
    assert rows(read_json(spark, target, schema=frame.schema)) == rows(frame)


def test_tab_separated_lines(spark, tmp_path):
    target = str(tmp_path / "out")
    write_tab_separated(
        rows_to_frame(spark, [('say "hi"', 2), ("a,b", 1), (None, 3)], "word string, n bigint"),
        target,
    )
    assert rows(read_lines(spark, target)) == [("\t3",), ("a,b\t1",), ('say "hi"\t2',)]


def test_generated_and_literal_rows(spark):
    assert rows(integer_range(spark, 5)) == [(i,) for i in range(5)]
    assert integer_range(spark, 1000, 4).count() == 1000
    frame = rows_to_frame(spark, [["Ann"], [None]], "name string")
    assert frame.schema.simpleString() == "struct<name:string>"
    assert rows(frame) == [("Ann",), (None,)]
