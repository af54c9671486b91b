"""Job: count the words of text files into tab-separated ``word, count`` lines."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tableloom.operators import word_counts
from tableloom.session import open_session
from tableloom.sinks import write_tab_separated
from tableloom.sources import read_lines


def run(spark: SparkSession, source: str, target: str, *, mode: str = "errorifexists") -> None:
    """Count the words of every file under ``source``; words are sorted within each file."""
    write_tab_separated(word_counts(read_lines(spark, source), "value"), target, mode=mode)


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source")
    parser.add_argument("target")
    args = parser.parse_args(argv)
    spark = open_session("word count")
    run(spark, args.source, args.target)


if __name__ == "__main__":
    main()
