"""Near duplicates by SimHash, with a vantage-point tree over the fingerprints.

The tree is grown level by level with grouped aggregates: each node's vantage point is
one of its fingerprints, and the quartiles of the Hamming distances to it cut the node
into four shells. A fingerprint has one home leaf. It also visits each later leaf that
the triangle inequality cannot rule out: a fingerprint within ``r`` bits of one at
distance ``d`` lies at a distance from ``d - r`` to ``d + r``. So every pair within ``r``
bits meets in exactly one leaf, where it is compared exactly, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.llm.common import components, free_name, sent_if_small, written

SEED = 42
SHELLS = 4  # children of a tree node
LEAF_ROWS = 2048  # fingerprints that a leaf is to hold
CELLS = 1 << 20  # comparisons held at once in a leaf
GRAMS = 1 << 16  # shingles hashed at once


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """64-bit SimHash of a text as an unsigned number; 0 for a text without words.

    Words are lower-cased in A-Z only. Shingles count as often as they occur; a shorter
    text is one shingle. A bit is set if more than half of the shingle hashes have it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    total = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, total, GRAMS):
        part = words[start : min(start + GRAMS, total) + shingle_words - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(min(shingle_words, len(part))))))
        digests = map(xxhash.xxh64_intdigest, grams, repeat(SEED))
        hashes = np.fromiter(digests, np.uint64, min(GRAMS, total - start))
        octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3
) -> DataFrame:
    """(id, uid, fp) per row: fp as a signed 64-bit number, uid a hash of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t.as_py(), shingle_words) for t in batch.column(2)]
            marks = pa.array(np.array(marks, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), marks], names=["id", "uid", "fp"]
            )

    texts = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(id_col, text_col).alias("uid"),
        F.col(text_col).alias("text"),
    )
    return texts.mapInArrow(run, "id long, uid long, fp long")


def differing_bits(both: np.ndarray) -> np.ndarray:
    """Bits set in signed numbers, the sign among them (numpy counts those of the amount)."""
    return np.bitwise_count(both.view(np.uint64))


class Tree:
    """Vantage points and cuts by level; a node's children are 4n to 4n + 3 of the next."""

    def __init__(self, radius: int):
        self.radius = radius
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def distances(self, level: int, node: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return differing_bits(marks ^ self.levels[level][0][node]).astype(np.int64)

    def shell(self, level: int, node: np.ndarray, distance: np.ndarray) -> np.ndarray:
        return (distance[:, None] > self.levels[level][1][node]).sum(axis=1)

    def home(self, marks: np.ndarray) -> np.ndarray:
        node = np.zeros(len(marks), np.int64)
        for level in range(len(self.levels)):
            node = SHELLS * node + self.shell(level, node, self.distances(level, node, marks))
        return node

    def visits(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf after the row's home that may hold a neighbour."""
        row, node = np.arange(len(marks)), np.zeros(len(marks), np.int64)
        for level in range(len(self.levels)):
            distance = self.distances(level, node, marks[row])
            low = self.shell(level, node, distance - self.radius)
            high = self.shell(level, node, distance + self.radius)
            wide = high - low + 1
            first = np.repeat(np.cumsum(wide) - wide, wide)
            row = np.repeat(row, wide)
            node = np.repeat(SHELLS * node + low, wide) + np.arange(len(row)) - first
        later = node > self.home(marks)[row]
        return row[later], node[later]


def _home_of(tree: Tree):
    @F.pandas_udf("long")
    def home(fp: pd.Series) -> pd.Series:
        return pd.Series(tree.home(fp.to_numpy(np.int64)))

    return home


def _distance_to(points: np.ndarray):
    @F.pandas_udf("int")
    def distance(fp: pd.Series, node: pd.Series) -> pd.Series:
        differ = fp.to_numpy(np.int64) ^ points[node.to_numpy(np.int64)]
        return pd.Series(differing_bits(differ).astype(np.int32))

    return distance


def grow(marks: DataFrame, rows: int, radius: int, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree over the distinct fingerprints of ``marks`` (column fp).

    What reaches the driver is one vantage point and three cuts per node.
    """
    tree = Tree(radius)
    for level in range(max(0, math.ceil(math.log(max(1, rows) / leaf_rows, SHELLS)))):
        size = SHELLS**level

        placed = marks.select("fp", _home_of(tree)("fp").alias("node"))
        points = np.zeros(size, np.int64)
        chosen = placed.groupBy("node").agg(
            F.min_by("fp", F.xxhash64("fp", F.lit(level))).alias("point")
        )
        for r in chosen.toLocalIterator():
            points[r["node"]] = r["point"]

        cuts = np.full((size, SHELLS - 1), 64, np.int64)
        shares = [i / SHELLS for i in range(1, SHELLS)]
        measured = placed.select("node", _distance_to(points)("fp", "node").alias("d"))
        quartiles = measured.groupBy("node").agg(F.percentile_approx("d", shares).alias("cuts"))
        for r in quartiles.toLocalIterator():
            cuts[r["node"]] = r["cuts"]
        tree.levels.append((points, cuts))
    return tree


def close_sets(home: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, ...]:
    """(member, root) for each fingerprint linked here, root the least of its local group.

    Compares homes with homes and with visitors in blocks of ``CELLS``. Only links that
    join two groups are kept, so dense groups do not make all their pairs.
    """
    every = np.concatenate([home, visitors])
    label = np.arange(len(every))
    step = max(1, CELLS // max(1, len(home)))
    for start in range(0, len(every), step):
        stop = min(start + step, len(every))
        near = differing_bits(every[start:stop, None] ^ home[None, :]) <= radius
        left, right = np.nonzero(near)
        left += start
        while True:
            a, b = label[left], label[right]
            differ = a != b
            if not differ.any():
                break
            left, right, a, b = left[differ], right[differ], a[differ], b[differ]
            hook = np.arange(len(every))
            np.minimum.at(hook, np.maximum(a, b), np.minimum(a, b))
            while True:
                further = hook[hook]
                if (further == hook).all():
                    break
                hook = further
            label = hook[label]
    least = np.full(len(every), np.iinfo(np.int64).max)
    np.minimum.at(least, label, every)
    root = least[label]
    linked = root != every
    return every[linked], root[linked]


def near_links(marks: DataFrame, rows: int, max_bits: int) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints within ``max_bits`` of each other."""
    tree = grow(marks, rows, max_bits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            row, leaf = tree.visits(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([tree.home(own), leaf])),
                    pa.array(np.concatenate([own, own[row]])),
                    pa.array(np.arange(len(own) + len(row)) < len(own)),
                ],
                names=["leaf", "fp", "home"],
            )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        at_home = rows["home"].to_numpy(bool)
        own = rows["fp"].to_numpy(np.int64)
        u, v = close_sets(own[at_home], own[~at_home], max_bits)
        return pd.DataFrame({"u": u, "v": v})

    placed = marks.select("fp").mapInArrow(place, "leaf long, fp long, home boolean")
    return placed.groupBy("leaf").applyInPandas(compare, "u long, v long")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    max_bits: int = 2,
) -> DataFrame:
    """(id, uid, fp, root, component) per row of ``docs``.

    Two rows are linked if their fingerprints differ in at most ``max_bits`` bits;
    ``root`` is the least fingerprint reachable (signed), ``component`` the smallest id.
    NULL, empty and blank texts have fingerprint zero and are linked like any other.
    Repeated ids and rows are rows of their own. A NULL id is never a component; if all
    ids of a group are NULL, so is its component. No other column is read; an empty
    table gives an empty one.

    Copies fall together before the tree: it holds each distinct fingerprint once.
    """
    own = written(
        fingerprints(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words), "marks"
    )
    marks = written(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct-marks")
    found = components(near_links(marks, marks.count(), max_bits))
    rooted = marks.join(found, marks["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = rooted.select("fp", "root").join(least, "root")
    return own.join(classes, "fp").select("id", "uid", "fp", "root", "component")


def one_of_each(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    max_bits: int = 2,
) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest id.

    NULL ids come last; between equal ids the hash of id and text decides; of rows alike
    in id and text one stays. All columns stay as they are.
    """
    found = near_duplicates(
        docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words, max_bits=max_bits
    )
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")
    found = written(found.select("uid", "root", place.alias("place")), "near-duplicates")
    first = found.groupBy("root").agg(F.min("place").alias("first"))
    placed = found.join(first, "root")
    stays = F.col("place").eqNullSafe(F.col("first"))
    gone = written(placed.where(~stays).select(F.col("uid").alias("gone")).distinct(), "gone")
    often = written(
        placed.where(stays).groupBy(F.col("uid").alias("often")).count().where("count > 1"),
        "repeated-rows",
    ).drop("count")
    uid, key = free_name(docs, "uid"), free_name(docs, "key")
    marked = docs.withColumn(uid, F.xxhash64(id_col, text_col))
    same = F.col(uid) == F.col(key)
    gone = gone.withColumnRenamed("gone", key)
    left = marked.join(sent_if_small(gone, 24), same, "left_anti")
    rows = often.count()
    if rows:
        often = sent_if_small(often.withColumnRenamed("often", key), 24, rows)
        once = left.join(often, same, "left_semi").dropDuplicates([uid])
        left = left.join(often, same, "left_anti").unionByName(once)
    return left.select(*docs.columns)
