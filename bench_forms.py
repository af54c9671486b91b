"""The same results computed two ways, timed on one machine.

``plain`` is the form a walkthrough would use: rows through the driver and pandas,
a union in a loop, inferred types, a map-reduce word count. ``ours`` is the form in
this library. Then the six phases of the enlarged midpoint job, for each mode.

Uses ``BENCH_SF_DIR`` and ``BENCH_CPUS`` like ``bench.py``; prints JSON lines.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from bench import CPUS, FOLDER, RUNS
from tableloom.functions import split_words, strip_blanks
from tableloom.operators import conform, midpoint_and_copies, replicate, word_counts
from tableloom.plans import json_to_csv
from tableloom.operators.shape import MODES
from tableloom.plans.phases import run_phases
from tableloom.plans.staging import csv_copy, dealt_table, json_copy, table
from tableloom.session import new_scratch, open_session
from tableloom.sources import read_csv, read_json


def compute(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def limits(spark: SparkSession) -> DataFrame:
    return table(spark, FOLDER, "lineitem")


def enlarge_plain(spark):
    once = limits(spark)
    df = once
    for _ in range(60):
        df = df.union(once)
    df = df.withColumnRenamed("l_tax", "lcl").withColumnRenamed("l_discount", "ucl")
    compute(midpoint_and_copies(df, "lcl", "ucl"))


def enlarge_ours(spark):
    df = replicate(limits(spark), 61, spread_to=spark.sparkContext.defaultParallelism)
    df = conform(df, rename={"l_tax": "lcl", "l_discount": "ucl"})
    compute(midpoint_and_copies(df, "lcl", "ucl"))


def strip_plain(spark):
    documents = table(spark, FOLDER, "documents").toPandas()
    documents["text"] = documents["text"].str.strip()
    compute(spark.createDataFrame(documents))


def strip_ours(spark):
    compute(table(spark, FOLDER, "documents").withColumns({"text": strip_blanks("text")}))


def split_plain(spark):
    table(spark, FOLDER, "documents").toPandas()["text"].str.split(" ")


def split_ours(spark):
    compute(dealt_table(spark, FOLDER, "documents").select(split_words("text").alias("words")))


def words_plain(spark):
    lines = table(spark, FOLDER, "documents").select("text").rdd.map(lambda row: row.text)
    pairs = lines.flatMap(lambda text: text.split()).map(lambda word: (word, 1))
    pairs.reduceByKey(lambda left, right: left + right).foreach(lambda pair: None)


def words_ours(spark):
    compute(word_counts(dealt_table(spark, FOLDER, "documents"), "text"))


def csv_plain(spark):
    path = csv_copy(spark, FOLDER, "lineitem", header=True)
    compute(read_csv(spark, path, header=True, infer=True))


def csv_ours(spark):
    path = csv_copy(spark, FOLDER, "lineitem", header=True)
    compute(read_csv(spark, path, header=True, schema=limits(spark).schema))


def json_plain(spark):
    users = read_json(spark, json_copy(spark, FOLDER, "documents")).select("doc_id", "lang")
    users.repartition(5).write.csv(new_scratch(spark, "plain-csv"), header=True)


def json_ours(spark):
    json_to_csv.run(
        spark,
        json_copy(spark, FOLDER, "documents"),
        new_scratch(spark, "our-csv"),
        ["doc_id", "lang"],
        schema="doc_id bigint, lang string",
    )


def replace_plain(spark):
    orders = table(spark, FOLDER, "orders").replace("F", "FINAL", subset=["o_orderstatus"])
    orders.rdd.collect()


def replace_ours(spark):
    compute(table(spark, FOLDER, "orders").replace({"F": "FINAL"}, subset=["o_orderstatus"]))


FORMS = {
    "61 copies with midpoints (lineitem)": (enlarge_plain, enlarge_ours),
    "strip texts": (strip_plain, strip_ours),
    "split texts into words": (split_plain, split_ours),
    "word count": (words_plain, words_ours),
    "CSV scan, inferred / declared (lineitem)": (csv_plain, csv_ours),
    "JSON to CSV job": (json_plain, json_ours),
    "replace a value, every row computed": (replace_plain, replace_ours),
}


def session() -> SparkSession:
    return open_session(
        "bench forms",
        {
            "spark.master": f"local[{CPUS}]",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.driver.maxResultSize": "0",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(run) -> float:
        def once() -> float:
            start = time.perf_counter()
            run(spark)
            return time.perf_counter() - start

        once()
        return round(statistics.median(once() for _ in range(RUNS)), 2)

    for label, (plain, ours) in FORMS.items():
        print(json.dumps({"form": label, "plain": seconds(plain), "ours": seconds(ours)}))
    for mode in MODES:
        SparkSession.getActiveSession().stop()
        phases = run_phases(
            session,
            limits,
            low="l_tax",
            high="l_discount",
            mode=mode,
            spread_to=int(CPUS),
        )
        print(json.dumps({"mode": mode, **{name: round(s, 3) for name, s in phases.items()}}))
    SparkSession.getActiveSession().stop()


if __name__ == "__main__":
    main()
