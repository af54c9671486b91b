"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source gets a target; the targets are counted in blocks and handed out by highest
quotients ``claim / (2 seats + 1)``: first to sources, then down a tree of at most
``FAN_OUT`` branches to the source's shards. A shard holds about ``SHARD_TOKENS`` tokens
of documents in a seeded order, laid end to end and cut into blocks of equal size. Its
quota is filled with whole rounds over its blocks and, for what remains, with a seeded
selection of blocks. A block is taken at most ``most_repeats`` times.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableloom.llm.common import word_count, written

BLOCK_TOKENS = 32
SHARD_TOKENS = 1 << 16
FAN_OUT = 1024


def sainte_lague(claims: np.ndarray, most: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients; nobody gets more than ``most``, ties go to the first.

    Starts from a divisor so large that rounding gives out too few seats, which is a
    stage every run of highest quotients passes through, and awards the rest one by one.
    """
    seats = min(seats, int(most.sum()))
    won = np.zeros(len(claims), np.int64)
    spare = seats - len(claims) / 2
    if spare > 0 and claims.sum() > 0:
        divisor = claims.sum() / spare
        won = np.minimum(np.floor(claims / divisor + 0.5).astype(np.int64), most)
    queue = [
        (-claims[i] / (2 * int(won[i]) + 1), i) for i in range(len(claims)) if won[i] < most[i]
    ]
    heapq.heapify(queue)
    for _ in range(seats - int(won.sum())):
        _, i = heapq.heappop(queue)
        won[i] += 1
        if won[i] < most[i]:
            heapq.heappush(queue, (-claims[i] / (2 * int(won[i]) + 1), i))
    return won


def targets(
    sizes: DataFrame, *, weights: tuple[int, ...], percent: int, most_repeats: int
) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, NULL last, take the weights in turn. They share ``percent`` of
    all tokens by weight, but a target stops at ``most_repeats`` times its source; what is
    over is shared again. That level is found in closed form: with the sources ordered by
    limit per weight, the capped ones come first. The windows see one row per source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn % len(weights) + 1)
    everything = Window.partitionBy()
    weighed = sizes.withColumns(
        {"weight": weight, "most": F.col("source_size") * float(most_repeats)}
    ).withColumn("total", F.sum("source_size").over(everything) * (percent / 100))
    ordered = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    from_here = ordered.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(from_here)
    # The first source that its level leaves below its limit sets the level of the rest.
    levelled = weighed.withColumn("level", level)
    free = F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("level"))
    levelled = levelled.withColumn("level", F.max(free).over(everything))
    target = F.least("most", F.coalesce(F.col("level") * F.col("weight"), "most"))
    return levelled.select("source", "source_size", target.alias("target"))


def _seats(rows: pd.DataFrame) -> pd.DataFrame:
    """Hands a parent's seats to its children; a group has at most ``FAN_OUT`` rows."""
    rows = rows.sort_values("child", kind="stable")
    won = sainte_lague(
        rows["claim"].to_numpy(float), rows["most"].to_numpy(np.int64), int(rows["seats"].iloc[0])
    )
    return pd.DataFrame({"source": rows["source"], "child": rows["child"], "quota": won})


def quotas(shards: DataFrame, levels: int) -> DataFrame:
    """(source, shard, blocks, quota) from (source, shard, tokens, blocks, claim, most).

    ``source`` is any key without NULLs. Claims are numbers of blocks. The tree over a
    source's shards joins ``FAN_OUT`` neighbours per level; seats go down it.
    """

    def joined(level: int) -> DataFrame:
        child = F.floor(F.col("shard") / FAN_OUT**level)
        return shards.groupBy("source", child.alias("child")).agg(
            F.sum("claim").alias("claim"), F.sum("most").alias("most")
        )

    top = shards.groupBy("source").agg(F.sum("claim").alias("claim"), F.sum("most").alias("most"))
    # The source table in one group: a row per source, not per shard or document.
    total = F.round(F.sum("claim").over(Window.partitionBy())).cast("long")
    rank = F.row_number().over(Window.orderBy("source")).cast("long")
    given = (
        top.withColumns({"seats": total, "child": rank})
        .groupBy("seats")
        .applyInPandas(_seats, "source string, child long, quota long")
        .select("source", F.lit(0).cast("long").alias("parent"), F.col("quota").alias("seats"))
    )
    for level in range(levels - 1, -1, -1):
        below = joined(level).withColumn("parent", F.floor(F.col("child") / FAN_OUT))
        won = (
            below.join(given, ["source", "parent"])
            .groupBy("source", "parent")
            .applyInPandas(_seats, "source string, child long, quota long")
        )
        given = won.select("source", F.col("child").alias("parent"), F.col("quota").alias("seats"))
    won = given.select("source", F.col("parent").alias("shard"), F.col("seats").alias("quota"))
    return shards.join(won, ["source", "shard"]).select("source", "shard", "blocks", "quota")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    percent: int = 150,
    most_repeats: int = 2,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 7,
) -> DataFrame:
    """(id, source, size, source_size, target, taken, pieces) per row of ``docs``.

    ``size`` is the number of words, ``taken`` how many of them the mix takes, repeats
    counted; ``pieces`` lists the parts taken as (start, stop, times) in words. NULL
    texts have size 0 and nothing is taken from them, nor from empty ones; NULL is a
    source of its own, the last. The same rows give the same mix in any order and
    partitioning; rows alike in id, source and text stand for each other. No other
    column is read; an empty table gives an empty one.

    A shard is one hash share of its source, so a source with most of the rows is spread
    over many tasks.
    """
    if min(weights) <= 0 or most_repeats < 1:
        raise ValueError("weights must be positive and most_repeats at least 1")
    sized = written(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(id_col, text_col).alias("mark"),
        ),
        "sizes",
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights=weights, percent=percent, most_repeats=most_repeats)
    goals = written(
        goals.withColumn("shards", F.ceil(F.col("source_size") / SHARD_TOKENS)).withColumn(
            "key",
            F.concat(
                F.when(F.col("source").isNull(), "n").otherwise("s"),
                F.coalesce("source", F.lit("")),
            ),
        ),
        "targets",
    )
    most_shards = goals.agg(F.max("shards")).first()[0] or 1
    levels = max(1, math.ceil(math.log(max(2, most_shards), FAN_OUT)))
    goal = goals.withColumnRenamed("source", "goal_source")
    place = F.pmod(F.xxhash64(F.lit(seed), "mark"), F.greatest("shards", F.lit(1)))
    placed = sized.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).select(
        "id", "source", "size", "source_size", "target", "key", "mark", place.alias("shard")
    )
    blocks = F.greatest(F.lit(1), F.round(F.col("tokens") / block_tokens)).cast("long")
    shards = (
        placed.groupBy(F.col("key").alias("source"), "shard")
        .agg(
            F.sum("size").alias("tokens"),
            F.max(F.col("target") / F.greatest("source_size", F.lit(1))).alias("rate"),
        )
        .where("tokens > 0")
        .withColumn("blocks", blocks)
        .withColumns({"claim": F.col("rate") * F.col("blocks")})
        .withColumn("most", F.col("blocks") * most_repeats)
    )
    shards = written(shards, "shards")
    given = quotas(shards, levels).join(
        shards.select("source", "shard", "tokens"), ["source", "shard"]
    )
    given = given.withColumn("stride", _stride("blocks")).withColumnRenamed("source", "key")
    order = Window.partitionBy("key", "shard").orderBy(
        F.xxhash64(F.lit(seed + 1), "mark"), "mark", "id", "size"
    )
    stop = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    laid = placed.withColumn("stop", stop).join(given, ["key", "shard"], "left")
    parts = F.when(
        (F.col("size") > 0) & F.col("quota").isNotNull(), F.expr(_PIECES.format(seed=seed))
    ).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint,times:bigint>>"))
    taken = "aggregate(pieces, 0L, (sum, p) -> sum + (p.stop - p.start) * p.times)"
    return (
        laid.withColumn("pieces", F.filter(parts, lambda p: p["times"] > 0))
        .withColumn("taken", F.expr(taken))
        .select("id", "source", "size", "source_size", "target", "taken", "pieces")
    )


def _step(n: int) -> int:
    """A number near the golden section of n that shares no divisor with n."""
    step = max(1, int(n * 0.6180339887498949))
    while math.gcd(step, n) > 1:
        step += 1
    return step


def _stride(blocks: str) -> Column:
    @F.pandas_udf("long")
    def stride(n: pd.Series) -> pd.Series:
        return n.map(_step)

    return stride(blocks)


# The blocks in which a document lies, cut to it, and how often each is taken. Block k of a
# shard's n blocks holds the tokens from ceil(k * tokens / n) on. Each is taken quota div n
# times. The step is a bijection of 0..n-1; blocks whose place comes below the remainder are
# taken once more.
_PIECES = """
    transform(
        sequence((stop - size) * blocks div tokens, (stop - 1) * blocks div tokens),
        k -> named_struct(
            'start', greatest((k * tokens + blocks - 1) div blocks - (stop - size), 0L),
            'stop', least(((k + 1) * tokens + blocks - 1) div blocks, stop) - (stop - size),
            'times', quota div blocks + cast(
                pmod(k * stride + xxhash64({seed}, key, shard) % blocks, blocks)
                < quota % blocks as bigint)))
"""
