"""Job: pick columns out of JSON lines and write them as CSV with a header."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tableloom.session import open_session
from tableloom.sinks import write_csv
from tableloom.sources import read_json


def pick(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns."""
    return df.select(*columns)


def run(
    spark: SparkSession,
    source: str,
    target: str,
    columns: Sequence[str],
    *,
    schema: StructType | str | None = None,
    num_files: int | None = None,
    mode: str = "overwrite",
) -> None:
    """Read ``source``, keep ``columns``, write ``num_files`` files to ``target``.

    Left out, each task writes its own file and nothing is shuffled.
    """
    picked = pick(read_json(spark, source, schema=schema), columns)
    write_csv(picked, target, header=True, mode=mode, num_files=num_files)


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--columns", nargs="+", required=True)
    parser.add_argument("--schema", help="DDL of the fields to read; saves a pass over the input")
    parser.add_argument("--files", type=int, help="left out: one per task")
    args = parser.parse_args(argv)
    run(
        open_session("json to csv"),
        args.source,
        args.target,
        args.columns,
        schema=args.schema,
        num_files=args.files,
    )


if __name__ == "__main__":
    main()
