"""What several operators of this subpackage share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.session import new_scratch

# A word is a run of anything but the six ASCII blanks; bytes.split() cuts in the same places.
WORD = r"[^\x20\x09-\x0D]+"

# Largest side, in estimated bytes, that is sent to every executor; above it joins shuffle.
BROADCAST_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, no lineage behind it.

    A lost executor costs a later job nothing, since files are read again, not recomputed.
    """
    spark = df.sparkSession
    path = new_scratch(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing will read again, and what led to it."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if "/tableloom/" not in path.toString():
            raise ValueError(f"not a scratch table: {path.toString()}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    cleared(spark)


def cleared(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done.

    They go when the driver collects its garbage, which on its own may be much later.
    """
    gc.collect()
    spark._jvm.System.gc()


def sent_if_small(small: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``small`` marked for broadcasting if its counted rows fit ``BROADCAST_BYTES``.

    Beyond that it is returned as it is, and the join shuffles both sides. Hand in a
    written table, since it is counted here unless ``rows`` is known.
    """
    rows = small.count() if rows is None else rows
    return F.broadcast(small) if rows * row_bytes <= BROADCAST_BYTES else small


def word_count(text: Column) -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a NULL key counts as fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it new among the columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def components(links: DataFrame) -> DataFrame:
    """Connected components of the undirected edges in the first two columns.

    Gives (node, root) for every node of an edge between two different nodes; the root
    is the component's smallest node. Alternates the large-star and small-star steps,
    each a grouped minimum joined back, until the edges no longer change. A node with
    very many neighbours is grouped with partial sums and joined as a skewed key; no
    neighbourhood is gathered in one place. Each round is a written table.
    """
    a, b = links.columns[:2]
    edges = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct(),
        "edges",
    )
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u")
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = written(small, "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]
