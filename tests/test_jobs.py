"""Whole jobs, from files to files."""

import collections
import glob
from unittest import mock

import pytest
from pyspark.errors import AnalysisException

from tableloom import session
from tableloom.plans import county_union, json_to_csv, phases, word_count
from tableloom.sources import read_csv, read_json, read_lines, rows_to_frame


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


USERS = '{"user_id": "u1", "friends": "u2, u3", "age": 3}\n{"user_id": "u2", "friends": "None"}\n'


def test_json_to_csv(spark, tmp_path):
    (tmp_path / "users.json").write_text(USERS)
    source, target = str(tmp_path / "users.json"), str(tmp_path / "out")
    for _ in range(2):
        json_to_csv.run(spark, source, target, ["user_id", "friends"])
        assert rows(read_csv(spark, target, header=True)) == [("u1", "u2, u3"), ("u2", "None")]
    json_to_csv.run(
        spark, source, target, ["user_id"], schema="user_id string", mode="overwrite"
    )
    assert rows(read_csv(spark, target, header=True)) == [("u1",), ("u2",)]
    with pytest.raises(AnalysisException):
        json_to_csv.run(spark, source, target, ["user_id"], mode="errorifexists")


def test_json_to_csv_writes_five_files(spark, tables, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.read.parquet(f"{tables}/documents.parquet").write.json(source)
    json_to_csv.run(spark, source, target, ["doc_id", "lang"], num_files=5)
    assert len(glob.glob(f"{target}/part-*.csv")) == 5
    assert read_csv(spark, target, header=True).count() == 200


def test_json_to_csv_command_line(spark, tmp_path):
    (tmp_path / "users.json").write_text(USERS)
    target = str(tmp_path / "out")
    with mock.patch.object(json_to_csv, "open_session", return_value=spark):
        json_to_csv.main(
            [str(tmp_path / "users.json"), target, "--columns", "friends", "--files", "2"]
        )
    assert rows(read_csv(spark, target, header=True)) == [("None",), ("u2, u3",)]


def test_word_count_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = ["to be or\tnot to be\n\nthat  is", 'the "question" To be\n']
    for i, text in enumerate(texts):
        (tmp_path / "in" / f"{i}.txt").write_text(text)
    target = str(tmp_path / "out")
    with mock.patch.object(word_count, "open_session", return_value=spark):
        word_count.main([str(tmp_path / "in"), target])
    expected = collections.Counter(" ".join(texts).split())
    lines = [line for (line,) in rows(read_lines(spark, target))]
    assert {word: int(n) for word, n in (line.split("\t") for line in lines)} == expected


COUNTY_A = """\
KEY,NAME,STREET,STATE,ZIP,OPENED,KIND,X,Y,SPARE
1,Inn,1 Main St,NC,27601,2001-05-06,Restaurant,-78.5,35.5,x
2,"Bar, The",,NC,27602,,Bar,,,x
"""
COUNTY_B = """\
{"recordid": "r1", "fields": {"id": "56060", "premise_name": "Cafe", "premise_state": "NC", \
"premise_zip": "27701-1", "opening_date": "1999-01-02", "closing_date": "2010-01-01", \
"type_description": "1 - Restaurant", "geolocation": [36.0, -78.9]}, "geometry": {}}
{"recordid": "r2", "fields": {"id": "58123", "premise_name": "Cart", \
"type_description": "Cart"}}
"""


def test_two_counties_in_one_shape(spark, tmp_path):
    (tmp_path / "a.csv").write_text(COUNTY_A)
    (tmp_path / "b.json").write_text(COUNTY_B)
    flat = county_union.from_flat(
        read_csv(spark, str(tmp_path / "a.csv"), header=True, infer=True),
        "Wake",
        {
            "KEY": "datasetId",
            "NAME": "name",
            "STREET": "address1",
            "STATE": "state",
            "ZIP": "zip",
            "OPENED": "dateStart",
            "KIND": "type",
            "X": "geoX",
            "Y": "geoY",
        },
    )
    nested = county_union.from_nested(
        read_json(spark, str(tmp_path / "b.json")),
        "Durham",
        {
            "datasetId": "id",
            "name": "premise_name",
            "state": "premise_state",
            "zip": "premise_zip",
            "dateStart": "opening_date",
            "dateEnd": "closing_date",
        },
    )
    both = county_union.county_union(flat, nested)
    assert both.schema.simpleString() == county_union.PLACES.simpleString()
    found = {row.datasetId: row for row in both.collect()}
    assert set(found) == {"1", "2", "56060", "58123"}
    assert found["1"].id == "NC_Wake_1"
    assert found["1"].zip == "27601" and str(found["1"].dateStart) == "2001-05-06"
    assert found["2"].name == "Bar, The" and found["2"].geoX is None
    assert found["56060"].id == "NC_Durham_56060"
    assert found["56060"].type == "Restaurant" and found["56060"].geoY == -78.9
    assert str(found["56060"].dateEnd) == "2010-01-01"
    assert found["58123"].type is None and found["58123"].geoX is None
    assert found["58123"].id is None and found["58123"].county == "Durham"
    assert both.count() == flat.count() + nested.count()


def test_phases(spark, tables):
    for mode in ("noop", "col", "full"):
        seconds = phases.run_phases(
            lambda: spark,
            lambda session: session.read.parquet(f"{tables}/part.parquet"),
            low="p_size",
            high="p_retailprice",
            copies=3,
            mode=mode,
        )
        assert list(seconds) == list(phases.PHASES)
        assert all(value >= 0 for value in seconds.values())


def test_phases_command_line(spark, tmp_path, capsys):
    (tmp_path / "rates.csv").write_text("County,Low Limit,High Limit\nA,1.5,2.5\nB,,4\n")
    with mock.patch.object(phases, "open_session", return_value=spark):
        phases.main(
            [str(tmp_path / "rates.csv"), "--low", "Low Limit", "--high", "High Limit"]
            + ["--mode", "full"]
        )
    lines = capsys.readouterr().out.splitlines()
    assert [line.split()[1] for line in lines] == list(phases.PHASES)


def test_enlarged_rows(spark):
    limits = rows_to_frame(spark, [(1.0, 2.0), (None, 4.0)], "`Low Limit` double, `High` double")
    result = phases.enlarge_and_derive(limits, "Low Limit", "High", 61, "col")
    assert result.columns == ["lcl", "ucl", "avg", "lcl2", "ucl2"]
    assert result.count() == 122
    assert rows(result.distinct()) == [(1.0, 2.0, 1.5, 1.0, 2.0), (None, 4.0, None, None, 4.0)]


def test_scratch_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_root(spark) == named
    first, second = session.new_scratch(spark, "x"), session.new_scratch(spark, "x")
    assert first.startswith(named) and first != second


def test_scratch_folder_is_never_machine_local_on_a_cluster():
    cluster = mock.Mock()
    cluster.conf.get.return_value = None
    cluster.sparkContext.getCheckpointDir.return_value = None
    cluster.sparkContext.master = "yarn"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(cluster)


def test_object_store_settings():
    conf = session.object_store_conf("http://store:9000", "key", "secret", ssl=False)
    assert all(name.startswith("spark.hadoop.fs.s3a.") for name in conf)
    assert conf["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"
    assert conf["spark.hadoop.fs.s3a.path.style.access"] == "true"


def test_local_cluster_is_a_cluster():
    cluster = mock.Mock()
    cluster.conf.get.return_value = None
    cluster.sparkContext.getCheckpointDir.return_value = None
    cluster.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(cluster)


def test_a_rewritten_table_is_copied_anew(spark, tables, tmp_path):
    from tableloom.plans import queries

    folder = str(tmp_path)
    given = spark.read.parquet(f"{tables}/customer.parquet")
    for count in (3, 9):
        given.limit(count).write.mode("overwrite").parquet(f"{folder}/customer.parquet")
        assert queries.csv_scan_raw(spark, folder).count() == count


def test_building_queries_leaves_the_settings_alone(spark, tables):
    from tableloom.plans.queries import QUERIES

    before = dict(spark.conf.getAll)
    for name in ("word_count", "deep_in_subquery", "word_count_files", "repartition_rows"):
        QUERIES[name](spark, tables)
    assert dict(spark.conf.getAll) == before


def test_rows_of_a_wrong_length_are_refused(spark):
    for row in ([1, "x", "EXTRA"], [1]):
        with pytest.raises(ValueError, match="values"):
            rows_to_frame(spark, [row], "a int, b string")


def test_lossless_csv_keeps_instants_and_refuses_the_mark(spark, tmp_path, settings):
    from pyspark.errors import PySparkException

    from tableloom.sinks import write_csv

    settings(session__timeZone="America/New_York")
    frame = spark.sql("SELECT timestamp_seconds(s) AS t FROM VALUES (1730613000), (1730616600) AS v(s)")
    write_csv(frame, str(tmp_path / "t"), lossless=True)
    back = read_csv(spark, str(tmp_path / "t"), schema=frame.schema, lossless=True)
    assert sorted(r[0] for r in back.selectExpr("unix_seconds(t)").collect()) == [1730613000, 1730616600]
    with pytest.raises(PySparkException):
        write_csv(rows_to_frame(spark, [["\x01"]], "a string"), str(tmp_path / "m"), lossless=True)


def test_managed_text_table_keeps_values(spark):
    from tableloom import catalog
    from tableloom.plans.staging import new_database
    from tableloom.sinks import insert_rows

    name = f"`{new_database(spark, 'kept')}`.t"
    catalog.create_text_table(spark, name, {"id": "INT", "v": "STRING"})
    given = [(1, " pad "), (2, ""), (3, "x\ny"), (4, None), (5, "\\N"), (6, "p,q"), (7, '"')]
    insert_rows(spark, name, given)
    assert sorted(map(tuple, spark.table(name).collect())) == given


def test_partitions_of_null_and_odd_values(spark, tmp_path):
    from tableloom import catalog
    from tableloom.plans.staging import new_database

    name = f"`{new_database(spark, 'odd')}`.t"
    values = [["O"], [None], ["a b/c"], ["1+1=2%"], ["O"]]
    frame = rows_to_frame(spark, values, "k string").selectExpr("1 AS x", "k")
    frame.write.partitionBy("k").saveAsTable(name)
    counted = spark.table(name).groupBy("k").count().withColumnRenamed("count", "n")
    found = catalog.partition_rows(spark, name, counted).collect()
    assert sorted(r["n"] for r in found) == [1, 1, 1, 2]
    assert all(r["partition_spec"] is not None for r in found)


def test_names_and_separators_that_look_like_syntax(spark):
    from tableloom.functions import split_item
    from tableloom.operators import replicate, schema_rows, where_equal, where_in

    frame = rows_to_frame(spark, [[1, "x\\Ey"]], "`a.b` int, copy string")
    assert replicate(frame, 3).columns == ["a.b", "copy"]
    assert where_equal(frame, **{"a.b": 1}).count() == 1
    assert where_in(frame, "a.b", frame.select("`a.b`")).count() == 1
    assert frame.select(split_item("copy", "\\E", 1)).first()[0] == "y"
    nested = spark.createDataFrame([], "m map<string, struct<inner: int>>")
    assert [r["field"] for r in schema_rows(nested).collect()] == ["m", "m.value.inner"]
