"""How long each step of a job takes: nothing but the last one does the work.

Steps: open the session, load, enlarge, clean up, transform, act. All but the
first and last only extend the plan (loading also reads types, if asked to).
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tableloom.operators import conform, midpoint_and_copies, replicate
from tableloom.operators.shape import MODES
from tableloom.session import open_session
from tableloom.sources import read_csv

PHASES = ("session", "load", "enlarge", "cleanup", "transform", "action")


def enlarge_and_derive(
    df: DataFrame, low: str, high: str, copies: int, mode: str, spread_to: int | None = None
) -> DataFrame:
    """``copies`` times the rows, limits renamed to ``lcl`` and ``ucl``, midpoint by ``mode``."""
    enlarged = replicate(df, copies, spread_to)
    cleaned = conform(enlarged, rename={low: "lcl", high: "ucl"})
    return midpoint_and_copies(cleaned, "lcl", "ucl", mode)


def run_phases(
    open_spark: Callable[[], SparkSession],
    load: Callable[[SparkSession], DataFrame],
    *,
    low: str,
    high: str,
    copies: int = 61,
    mode: str = "col",
    spread_to: int | None = None,
) -> dict[str, float]:
    """Seconds per phase; the action computes every row and keeps none."""
    marks = [time.perf_counter()]
    spark = open_spark()
    marks.append(time.perf_counter())
    df = load(spark)
    marks.append(time.perf_counter())
    df = replicate(df, copies, spread_to)
    marks.append(time.perf_counter())
    df = conform(df, rename={low: "lcl", high: "ucl"})
    marks.append(time.perf_counter())
    df = midpoint_and_copies(df, "lcl", "ucl", mode)
    marks.append(time.perf_counter())
    df.write.format("noop").mode("overwrite").save()
    marks.append(time.perf_counter())
    return {name: end - start for name, start, end in zip(PHASES, marks, marks[1:])}


def main(argv: Sequence[str] | None = None) -> None:
    """Time the phases on a CSV file with a header; types are inferred unless declared."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("source")
    parser.add_argument("--low", required=True, help="column of the lower limit")
    parser.add_argument("--high", required=True, help="column of the upper limit")
    parser.add_argument("--mode", choices=MODES, default="col")
    parser.add_argument("--copies", type=int, default=61)
    parser.add_argument("--schema", help="DDL of all columns; saves a pass over the input")
    args = parser.parse_args(argv)
    seconds = run_phases(
        lambda: open_session("phases"),
        lambda spark: read_csv(
            spark, args.source, header=True, infer=args.schema is None, schema=args.schema
        ),
        low=args.low,
        high=args.high,
        copies=args.copies,
        mode=args.mode,
    )
    for number, (phase, value) in enumerate(seconds.items(), 1):
        print(f"{number}. {phase:<10} {value * 1000:10.0f} ms")


if __name__ == "__main__":
    main()
