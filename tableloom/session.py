"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults a launcher may override. The master, memory and executor counts are
# the launcher's business and are never set here.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}

# A join partition is cut into several tasks above this size, if it is also this many
# times the median; Spark's own settings wait for 256 MB and 5 times.
HOT_PARTITIONS = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2.0",
}

def open_session(app_name: str = "tableloom", conf: dict[str, str] | None = None) -> SparkSession:
    """Get or create a session with the defaults above, overlaid by ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **HOT_PARTITIONS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def object_store_conf(
    endpoint: str, access_key: str, secret_key: str, *, path_style: bool = True, ssl: bool = True
) -> dict[str, str]:
    """Session settings under which ``s3a:`` paths lead to an S3-compatible store.

    Pass the result to ``open_session``; keys come from the caller's secret store.
    """
    return {
        "spark.hadoop.fs.s3a.endpoint": endpoint,
        "spark.hadoop.fs.s3a.access.key": access_key,
        "spark.hadoop.fs.s3a.secret.key": secret_key,
        "spark.hadoop.fs.s3a.path.style.access": str(path_style).lower(),
        "spark.hadoop.fs.s3a.connection.ssl.enabled": str(ssl).lower(),
    }


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Taken from ``spark.checkpoint.dir`` (or a checkpoint folder already set on
    the context). Only a local master may fall back to a folder of its own; on a
    cluster an unset folder is an error, because a machine-local path would be
    invisible to the other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster is a cluster
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tableloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_scratch(spark: SparkSession, label: str) -> str:
    """A path under the scratch root that no earlier run has used."""
    return f"{scratch_root(spark)}/tableloom/{label}-{uuid.uuid4().hex}"
