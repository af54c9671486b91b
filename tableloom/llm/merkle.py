"""A Merkle manifest of a table: a digest tree per group, one over the groups, proofs, folding.

Rows become leaves, in each group in the order of their id. While a group has several nodes,
every run of ``fan_out`` consecutive ones has a parent, whose digest is the SHA-256 of their
hexadecimal digests. The groups' roots are the leaves of one more such tree.

A parent keeps a copy of its hash state from before each child went in. To fold a changed
leaf up to the root, the state before its slot is resumed with the new digest and the right
siblings only; what lies left of the slot is never hashed again.

The tree is built by blocks of 2,187 (``Shape.block``) consecutive nodes, each one group of rows
in a task, so that no task holds more than a block whatever the size of a group. The roots of
the blocks are the nodes of the next pass. On the way down each block gets the siblings above it
as one short row. Positions come from a sorted table and the row counts of its partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableloom.llm.common import sent_if_small, written

FAN_OUT = 3
LEVELS = 7  # of a block: 2,187 nodes of fan-out 3


class Shape(NamedTuple):
    """Children of a parent, and the levels of a block."""

    fan_out: int = FAN_OUT
    levels: int = LEVELS

    @property
    def block(self) -> int:
        """Nodes of a block."""
        return self.fan_out**self.levels


NODES = "g string, pos bigint, levels int, digest binary"
PATHS = "g string, pos bigint, lefts array<binary>, rights array<binary>, subroot binary, root binary"


def field(value: Column) -> Column:
    """A value as its UTF-8 length, a colon and its text; ``-`` for NULL."""
    text = value.cast("string")
    length = F.octet_length(text).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(length, F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row's values, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def levels_of(size: Column, fan_out: int) -> Column:
    """How many levels of parents stand above so many nodes."""
    steps, reach = F.lit(0), 1
    while reach < 2**63:
        steps = steps + F.when(size > F.lit(reach), 1).otherwise(0)
        reach *= fan_out
    return steps.cast("int")


def placed(nodes: DataFrame, order: Sequence[str], fan_out: int) -> DataFrame:
    """A written table of ``nodes`` with ``pos``, from 0 within ``g``, and the group's ``levels``.

    Rows are sorted over the whole cluster by (g, order); ties are cut by where a row was
    read, so that many equal rows do not have to fit into one task. A row's place is its
    number in its partition and the group's rows in the partitions before.
    """
    keys = ["g", *order, "tie"]
    dealt = nodes.withColumn("tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    numbered = written(
        dealt.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}),
        "merkle-sorted",
    )
    counts = numbered.groupBy("g", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("g")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "g",
        "part",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        levels_of(F.sum("n").over(group), fan_out).alias("levels"),
    )
    counts = sent_if_small(written(counts, "merkle-offsets"), 64)
    joined = numbered.join(counts, ["g", "part"])
    return joined.withColumn("pos", F.col("row") + F.col("shift")).drop("part", "row", "shift")


class Parent:
    """A node above a run of children, with the hash state before each of them."""

    def __init__(self, children: list[bytes]):
        self.children = children
        state = hashlib.sha256()
        self.before = []
        for child in children:
            self.before.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return b"".join(self.children[:slot] + self.children[slot + 1 :])

    def folded(self, slot: int, child: bytes) -> bytes:
        """The digest with another child in a slot."""
        state = self.before[slot].copy()
        state.update(child + b"".join(self.children[slot + 1 :]))
        return state.hexdigest().encode()


class Step:
    """The slot of a path in a parent elsewhere, of which only the siblings are here."""

    def __init__(self, left: bytes, right: bytes):
        left, self.right = left.hex().encode(), right.hex().encode()
        self.before = hashlib.sha256(left)
        self.siblings = left + self.right

    def folded(self, child: bytes) -> bytes:
        state = self.before.copy()
        state.update(child + self.right)
        return state.hexdigest().encode()


def grown(digests: list[bytes], levels: int, fan_out: int) -> tuple[list[list[Parent]], bytes]:
    """The parents above a block, level by level, and the block's root."""
    rows = []
    for _ in range(levels):
        parents = [Parent(digests[i : i + fan_out]) for i in range(0, len(digests), fan_out)]
        rows.append(parents)
        digests = [p.digest for p in parents]
    return rows, digests[0]


def _block(frame: pd.DataFrame, shape: Shape) -> tuple[pd.DataFrame, list[list[Parent]], bytes]:
    frame = frame.sort_values("pos")
    levels = min(shape.levels, int(frame["levels"].iloc[0]))
    digests = [bytes(d).hex().encode() for d in frame["digest"]]
    return frame, *grown(digests, levels, shape.fan_out)


def block(shape: Shape) -> Column:
    """The number of a node's block in its group."""
    return F.floor(F.col("pos") / F.lit(shape.block)).cast("long")


def climbed(nodes: DataFrame, shape: Shape) -> DataFrame:
    """The roots of the blocks of ``nodes``, as the next pass's nodes."""

    def climb(frame: pd.DataFrame) -> pd.DataFrame:
        frame, rows, root = _block(frame, shape)
        first = frame.iloc[0]
        return pd.DataFrame(
            {
                "g": [first["g"]],
                "pos": [int(first["pos"]) // shape.block],
                "levels": [int(first["levels"]) - len(rows)],
                "digest": [bytes.fromhex(root.decode())],
            }
        )

    blocks = nodes.select("g", "pos", "levels", "digest", block(shape).alias("block"))
    return written(blocks.groupBy("g", "block").applyInPandas(climb, NODES), "merkle-nodes")


def passes(nodes: DataFrame, shape: Shape) -> list[DataFrame]:
    """``nodes`` and the nodes of each pass above, up to one root per group.

    The number of passes is the logarithm of the largest group's size; the driver learns only
    how many levels are left.
    """
    out = [nodes]
    while nodes.agg(F.max("levels")).first()[0]:
        nodes = climbed(nodes, shape)
        out.append(nodes)
    return out


def paths_below(nodes: DataFrame, above: DataFrame, shape: Shape) -> DataFrame:
    """The paths of ``nodes``, given those of their blocks' roots."""

    def descend(frame: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        frame, rows, _ = _block(frame, shape)
        top = upper.iloc[0]
        lefts, rights = [], []
        for at in range(len(frame)):
            left, right = [], []
            for parents in rows:
                at, slot = divmod(at, shape.fan_out)
                run = parents[at].children
                left.append(bytes.fromhex(b"".join(run[:slot]).decode()))
                right.append(bytes.fromhex(b"".join(run[slot + 1 :]).decode()))
            lefts.append(left + list(top["lefts"]))
            rights.append(right + list(top["rights"]))
        out = frame[["g", "pos"]].assign(subroot=top["subroot"], root=top["root"])
        return out.assign(lefts=lefts, rights=rights)[[c.split()[0] for c in PATHS.split(", ")]]

    met = _with_paths(nodes.select("g", "pos", "levels", "digest"), above, shape)
    return written(met.applyInPandas(descend, PATHS), "merkle-paths")


def _with_paths(nodes: DataFrame, above: DataFrame, shape: Shape):
    """Each block of ``nodes`` beside the path of its root."""
    blocks = nodes.withColumn("block", block(shape)).groupBy("g", "block")
    return blocks.cogroup(above.withColumn("block", F.col("pos")).groupBy("g", "block"))


def paths(trees: list[DataFrame], tops: DataFrame, shape: Shape, upto: int) -> DataFrame:
    """The paths of the nodes of pass ``upto``, given those of the groups' roots."""
    for nodes in reversed(trees[upto:-1]):
        tops = paths_below(nodes, tops, shape)
    return tops


def group_paths(roots: DataFrame, shape: Shape) -> DataFrame:
    """The path of each group's root through the tree over the groups, ordered by name."""
    members = roots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest")
    members = placed(members, ["name"], shape.fan_out)
    trees = passes(members, shape)
    no_steps = F.array().cast("array<binary>")
    tops = trees[-1].select(
        "g", "pos", no_steps.alias("lefts"), no_steps.alias("rights"),
        F.col("digest").alias("subroot"), F.col("digest").alias("root"),
    )
    found = paths(trees, tops, shape, 0).drop("g", "subroot")
    named = members.select("pos", F.col("name").alias("g"), F.col("digest").alias("subroot"))
    # One row per group on both sides.
    joined = named.join(found, "pos")
    return joined.select("g", F.lit(0).cast("long").alias("pos"), "lefts", "rights", "subroot", "root")


def folds(leaves: DataFrame, above: DataFrame, id_type: str, shape: Shape) -> DataFrame:
    """Each leaf's proof, and the root that its ``other`` digest folds up to."""
    schema = f"id {id_type}, leaf string, subroot string, root string, proof string, folded string"

    def fold(key: tuple, frame: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        frame, rows, _ = _block(frame, shape)
        top = upper.iloc[0]
        steps = [Step(a, b) for a, b in zip(top["lefts"], top["rights"])]
        rest = b"".join(step.siblings for step in steps)
        proofs, folded = [], []
        for at, other in enumerate(frame["other"]):
            digest, proof = bytes(other).hex().encode(), hashlib.sha256()
            for parents in rows:
                at, slot = divmod(at, shape.fan_out)
                proof.update(parents[at].siblings(slot))
                digest = parents[at].folded(slot, digest)
            for step in steps:
                digest = step.folded(digest)
            proof.update(rest)
            proofs.append(proof.hexdigest())
            folded.append(digest.decode())
        return pd.DataFrame(
            {
                "id": frame["id"],
                "leaf": [bytes(d).hex() for d in frame["digest"]],
                "subroot": bytes(top["subroot"]).hex(),
                "root": bytes(top["root"]).hex(),
                "proof": proofs,
                "folded": folded,
            }
        )

    return _with_paths(leaves, above, shape).applyInPandas(fold, schema)


def manifest(
    docs: DataFrame,
    fields: Sequence[str],
    *,
    id_col: str = "doc_id",
    group_col: str = "source",
    altered: Mapping[str, Column] | None = None,
    shape: Shape = Shape(),
) -> DataFrame:
    """Leaf, group root, root and proof of each row, and whether a second copy of it still fits.

    Gives one row per row: ``id``; ``leaf``, ``subroot`` and ``root`` of ``docs`` as hexadecimal
    text; ``proof``, the SHA-256 of all siblings from the leaf up to the root; ``folded``, the
    root that the row's second copy leads to with the siblings of the first; ``verified``,
    whether that is the root. The second copy is the row with the columns ``altered``.

    A leaf is the digest of ``fields``, NULL apart from any text. Groups are ordered by the
    bytes of their name, NULL first; within a group NULL ids come first, and rows with the same id
    are ordered by leaf. Rows alike in everything are leaves of their own with equal digests, and
    each has the proof of its own place. A group of one row has its leaf as its root; no
    sibling at all makes the proof the digest of nothing. Empty texts are values like others; an
    empty table gives an empty result. Other columns do not matter, whatever their names.
    """
    second = [(altered or {}).get(name, F.col(f"`{name}`")) for name in fields]
    # The sign before a name sets NULL apart and first.
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    leaves = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        group.alias("g"),
        leaf([F.col(f"`{name}`") for name in fields]).alias("digest"),
        leaf(second).alias("other"),
    )
    leaves = written(placed(leaves, ["id", "digest"], shape.fan_out), "merkle-leaves")
    trees = passes(leaves, shape)
    tops = group_paths(trees[-1].where("pos = 0").select("g", "digest"), shape)
    above = paths(trees, tops, shape, 1)
    id_type = docs.schema[id_col].dataType.simpleString()
    found = folds(leaves, above, id_type, shape)
    return found.withColumn("verified", F.col("folded") == F.col("root"))
