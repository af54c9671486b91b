import datetime
from decimal import Decimal

import pytest
from pyspark.sql.types import StructType

from tableloom.operators import NoCommonType, common_schema, plan_text, union_typed


def common(*ddl):
    return common_schema([StructType.fromDDL(d) for d in ddl]).simpleString()


@pytest.mark.parametrize(
    ("one", "other", "both"),
    [
        ("a int", "a bigint", "a:bigint"),
        ("a tinyint", "a smallint", "a:smallint"),
        ("a int", "a float", "a:double"),
        ("a smallint", "a float", "a:float"),
        ("a bigint", "a double", "a:double"),
        ("a decimal(10,2)", "a decimal(8,4)", "a:decimal(12,4)"),
        ("a int", "a decimal(5,2)", "a:decimal(12,2)"),
        ("a int", "a string", "a:string"),
        ("a string", "a date", "a:string"),
        ("a date", "a timestamp_ntz", "a:timestamp_ntz"),
        ("a void", "a boolean", "a:boolean"),
        ("a int", "b string", "a:int,b:string"),
        ("a int", "A bigint", "a:bigint"),
        ("a array<int>", "a array<string>", "a:array<string>"),
        ("a map<int,int>", "a map<bigint,void>", "a:map<bigint,int>"),
        ("a struct<x:int,y:struct<z:date>>", "a struct<y:struct<z:string,w:int>,v:int>",
         "a:struct<x:int,y:struct<z:string,w:int>,v:int>"),
    ],
)
def test_common_types(one, other, both):
    assert common(one, other) == f"struct<{both}>"
    again = common(other, one)
    assert sorted(again.lower()) == sorted(f"struct<{both}>")
    assert common(one, other, one) == f"struct<{both}>"


@pytest.mark.parametrize(
    ("one", "other"),
    [
        ("a int", "a boolean"),
        ("a int", "a struct<x:int>"),
        ("a array<int>", "a int"),
        ("a array<int>", "a array<array<int>>"),
        ("a binary", "a string"),
        ("a date", "a int"),
        ("a decimal(38,0)", "a decimal(38,10)"),
        ("a struct<x:struct<y:int>>", "a struct<x:string>"),
    ],
)
def test_pairs_without_a_common_type_name_the_column(one, other):
    with pytest.raises(NoCommonType, match=r"^a"):
        common(one, other)


def test_repeated_names_are_refused():
    with pytest.raises(ValueError, match="two columns"):
        common("a int, A int", "a int")


def test_values_keep_their_meaning(spark):
    one = spark.createDataFrame(
        [(1, (5, datetime.date(2020, 2, 29)), [(1,), None], {"k": 1}, Decimal("1.50"))],
        "id int, s struct<n:int,d:date>, l array<struct<x:int>>, m map<string,int>, c decimal(5,2)",
    )
    other = spark.createDataFrame(
        [("x", None, [(2**40, "t")], None, 7), (None, ("text", 1.5), None, {"z": 2**40}, None)],
        "id string, s struct<d:string,n:double>, l array<struct<x:bigint,y:string>>, m map<string,bigint>, c int",
    )
    got = [tuple(r) for r in union_typed(one, other).collect()]
    assert got[0] == ("1", (5.0, "2020-02-29"), [(1, None), None], {"k": 1}, Decimal("1.50"))
    assert got[1] == ("x", None, [(2**40, "t")], None, Decimal("7.00"))
    assert got[2] == (None, (1.5, "text"), None, {"z": 2**40}, None)


def test_one_scan_per_frame_and_no_shuffle(spark, tables):
    customers = spark.read.parquet(f"{tables}/customer.parquet")
    suppliers = spark.read.parquet(f"{tables}/supplier.parquet").withColumnRenamed("s_name", "c_name")
    plan = plan_text(union_typed(customers, suppliers).select("c_name"))
    assert plan.count("Scan parquet") == 4  # twice each: in the tree and in the details
    assert "Exchange" not in plan and "ReadSchema: struct<c_name:string>" in plan


def test_dotted_names(spark):
    one = spark.createDataFrame([(1,)], "`a.b` int")
    other = spark.createDataFrame([("x",)], "`a.b` string")
    assert [r[0] for r in union_typed(one, other).collect()] == ["1", "x"]
