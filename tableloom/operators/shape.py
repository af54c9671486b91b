"""Column shape: rename, drop, derive, cast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# How far midpoint_and_copies goes.
MODES = ("noop", "col", "full")


def conform(
    df: DataFrame,
    *,
    constants: Mapping[str, object] | None = None,
    rename: Mapping[str, str] | None = None,
    derive: Mapping[str, Column] | None = None,
    drop: Sequence[str] = (),
    target: StructType | None = None,
) -> DataFrame:
    """Bring a frame into an agreed shape, as one projection over the input.

    In this order: rename columns (one after the other; absent ones are skipped), add
    constant columns, add derived columns (which see the new names), drop columns
    (absent ones are skipped), then, with ``target``, keep exactly its columns in its order, cast to
    its types, with typed NULLs for columns the input does not have. Frames
    conformed to one target can be united without any guessed type. A value that
    cannot be cast raises an error; derive it with ``try_cast`` to get NULL.
    """
    df = df.withColumnsRenamed(dict(rename or {}))
    added = {name: F.lit(value) for name, value in (constants or {}).items()}
    if added:
        df = df.withColumns(added)
    if derive:
        df = df.withColumns(dict(derive))
    df = df.drop(*drop)
    if target is None:
        return df
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    fold = str if exact else str.lower
    present = {fold(name) for name in df.columns}
    return df.select(
        *(
            (F.col(f"`{field.name}`") if fold(field.name) in present else F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for field in target
        )
    )


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All columns renamed by position."""
    return df.toDF(*names)


def midpoint_and_copies(df: DataFrame, low: str, high: str, mode: str = "col") -> DataFrame:
    """The midpoint of two columns as ``avg``, and a copy of each as ``<name>2``.

    Mode ``noop`` derives nothing, ``col`` derives, ``full`` derives and drops the
    derived columns again; the optimizer then removes the work altogether.
    """
    mode = mode.lower()
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "noop":
        return df
    derived = {
        "avg": F.expr(f"(`{low}` + `{high}`) / 2"),
        f"{low}2": F.col(f"`{low}`"),
        f"{high}2": F.col(f"`{high}`"),
    }
    df = df.withColumns(derived)
    return df.drop(*derived) if mode == "full" else df
