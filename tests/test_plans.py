"""What Spark plans to do: pruning, pushdown, shuffles, and skewed keys."""

import re

import pytest
from pyspark.sql import functions as F

from tableloom.operators import (
    conform,
    first_rows,
    midpoint_and_copies,
    plan_text,
    replace_values,
    replicate,
    union_by_name,
    where_equal,
    where_in,
    where_scalar,
    word_counts,
)
from tableloom.plans import county_union
from tableloom.plans.queries import QUERIES
from tableloom.sources import read_json, rows_to_frame


@pytest.fixture
def table(spark, tables):
    return lambda name: spark.read.parquet(f"{tables}/{name}.parquet")


def read_columns(plan):
    schemas = re.findall(r"ReadSchema: struct<(.*)>", plan)
    return [set(re.findall(r"(\w+):", schema)) for schema in schemas]


def test_only_named_columns_are_read(spark, tables, table):
    assert read_columns(plan_text(QUERIES["project_columns"](spark, tables))) == [
        {"doc_id", "lang"}
    ]
    conformed = conform(table("customer"), rename={"c_name": "name"}, drop=["c_acctbal"])
    assert read_columns(plan_text(conformed.select("name"))) == [{"c_name"}]


def test_declared_json_reads_only_the_lifted_fields(spark, tables):
    plan = plan_text(QUERIES["nested_json_fields"](spark, tables))
    (columns,) = read_columns(plan)
    assert "geolocation" not in columns and "premise_name" in columns


def test_filters_reach_the_scan(table):
    plan = plan_text(where_equal(table("orders"), o_orderstatus="O", o_custkey=3))
    assert "EqualTo(o_orderstatus,O)" in plan and "EqualTo(o_custkey,3)" in plan


def test_row_work_has_no_shuffle(table):
    customers = table("customer")
    suppliers = table("supplier")
    target = county_union.PLACES
    for frame in (
        replicate(customers, 61),
        union_by_name(conform(customers, target=target), conform(suppliers, target=target)),
        replace_values(customers, {"BUILDING": "B"}, ["c_mktsegment"]),
        midpoint_and_copies(customers, "c_custkey", "c_acctbal"),
    ):
        plan = plan_text(frame)
        assert "Exchange" not in plan and "Join" not in plan


def test_replicate_scans_once_for_any_number_of_copies(table):
    few, many = (plan_text(replicate(table("region"), copies)) for copies in (2, 61))
    assert few.count("Location:") == many.count("Location:") == 1


def test_derived_then_dropped_columns_cost_nothing(table):
    limits = table("lineitem").select(F.col("l_tax").alias("lcl"), F.col("l_discount").alias("ucl"))
    full = plan_text(midpoint_and_copies(limits, "lcl", "ucl", "full"), "simple")
    assert re.sub(r"#\d+", "", full) == re.sub(r"#\d+", "", plan_text(limits, "simple"))


def test_first_rows_does_not_sort_everything(table):
    plan = plan_text(first_rows(table("orders"), 10, "o_orderkey"))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_words_are_counted_before_the_shuffle(table):
    plan = plan_text(word_counts(table("documents"), "text"), "simple")
    assert re.search(r"HashAggregate.*\n.*Exchange.*\n.*HashAggregate", plan)
    assert plan.count("Exchange") == 1
    assert read_columns(plan) in ([{"text"}], [])


def test_small_key_lists_are_broadcast(spark, table):
    wanted = rows_to_frame(spark, [("1-URGENT",)], "name string")
    plan = plan_text(where_in(table("orders"), "o_orderpriority", wanted, unique=True))
    assert "BroadcastHashJoin LeftSemi" in plan


def test_null_keys_never_reach_the_shuffle(spark, settings, table):
    settings(autoBroadcastJoinThreshold="-1")
    keys = table("customer").select("c_custkey")
    plan = plan_text(where_in(table("orders"), "o_custkey", keys, unique=True))
    assert "IsNotNull(o_custkey)" in plan and "IsNotNull(c_custkey)" in plan


def test_scalar_subquery_is_no_join(table):
    key = where_equal(table("nation"), n_name="NATION_3").select("n_nationkey")
    plan = plan_text(where_scalar(table("customer"), "c_nationkey", key))
    assert "Join" not in plan and "Subquery" in plan


def test_json_inference_is_avoided_by_a_schema(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"a": 1, "b": "x"}\n')
    frame = read_json(spark, str(tmp_path / "in.json"), schema="a int, b string").select("a")
    assert read_columns(plan_text(frame)) == [{"a"}]


@pytest.fixture
def skewed_orders(spark, table, tmp_path):
    """Orders in many files, a third of them of one customer."""
    key = F.when(F.col("o_orderkey") % 3 == 0, F.lit(7)).otherwise(F.col("o_custkey"))
    path = str(tmp_path / "orders")
    orders = table("orders")
    spread = orders.withColumn("o_custkey", key.cast("bigint")).repartition(16)
    spread.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("unique", [True, False])
def test_a_hot_key_is_cut_into_several_tasks(spark, settings, skewed_orders, table, unique):
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="2000",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
        adaptive__advisoryPartitionSizeInBytes="2000",
        files__openCostInBytes="1",
        files__maxPartitionBytes="20000",
    )
    keys = table("customer").select("c_custkey")
    if not unique:
        keys = keys.union(keys).union(rows_to_frame(spark, [(7,)] * 500, "c_custkey bigint"))
    kept = where_in(skewed_orders, "o_custkey", keys, unique=unique)
    rows = kept.collect()
    assert sorted(row.o_orderkey for row in rows) == sorted(
        row.o_orderkey for row in skewed_orders.select("o_orderkey").collect()
    )
    assert "SortMergeJoin(skew=true)" in plan_text(kept, "simple")


def test_a_hot_word_arrives_as_one_row_per_task(spark):
    texts = spark.range(0, 4000, 1, 8).select(
        F.concat(F.lit("hot hot "), F.col("id").cast("string")).alias("text")
    )
    counts = {row.word: row.n for row in word_counts(texts, "text").collect()}
    assert counts["hot"] == 8000 and len(counts) == 4001


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_needs_python_or_all_pairs(spark, tables, name):
    plan = plan_text(QUERIES[name](spark, tables), "simple")
    for costly in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas", "ExistingRDD"):
        assert costly not in plan
