"""URL filters: listed rules, and rules that FP-growth mines from the pages they decide.

The pages that a listed rule allows or blocks are the labelled ones. Their URLs become
sets of tokens, with the verdict as one more; frequent sets are mined, and those that
lead to "block" with enough confidence are rules. A rule is dropped if a part of it is
already one that is as sure. The rest are matched by an inverted index: a rule is filed
under its rarest token, a URL looks up its tokens there, and the rule's other tokens are
then checked. Everything is a DataFrame operation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.llm.common import written

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLOCK = "verdict=block"
LEAST_TOKENS = 2  # of a mined rule: a combination

Rule = tuple[str, str, str]  # verdict, host, path


def host(url: Column) -> Column:
    """What lies between ``://`` and the next ``/``, ``?``, ``#`` or the end; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, A_TO_Z, A_TO_Z.lower()), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(found, F.lit(""))


def listed(rules: Sequence[Rule], host_col: str, path_col: str) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, NULL if none does.

    A rule fits its host and every subdomain, if the path begins with the rule's. It is
    written as host and path together. ``rules`` is a list kept by hand; of equally long
    rules the first wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decided, name, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):
        own = F.col(host_col)
        fits = ((own == name) | own.endswith("." + name)) & F.col(path_col).startswith(begin)
        rule = F.when(fits, F.lit(name + begin)).otherwise(rule)
        verdict = F.when(fits, F.lit(decided)).otherwise(verdict)
    return rule, verdict


def tokens(host_col: str, path_col: str) -> Column:
    """The set of a URL's tokens: labels of its host, parts of its path."""

    def marked(mark: str, parts: Column) -> Column:
        kept = F.filter(parts, lambda p: p != "")
        return F.transform(kept, lambda p: F.concat(F.lit(mark), p))

    labels = marked("host=", F.split(host_col, r"\."))
    parts = marked("path=", F.split(F.translate(path_col, A_TO_Z, A_TO_Z.lower()), "/"))
    return F.array_distinct(F.concat(labels, parts))


def mine(labelled: DataFrame, *, least_support: float, least_confidence: float) -> DataFrame:
    """(items, support, confidence) of block rules from (tokens, verdict).

    Sets of ``LEAST_TOKENS`` tokens or more. A rule whose part is a rule of at least its
    confidence adds nothing and is dropped. There are at most as many frequent tokens as a
    URL's tokens over ``least_support``, which bounds the rules whatever the table's size.
    """
    baskets = labelled.select(
        F.when(F.col("verdict") == "block", F.array_append("tokens", F.lit(BLOCK)))
        .otherwise(F.col("tokens"))
        .alias("items")
    )
    model = FPGrowth(
        itemsCol="items", minSupport=least_support, minConfidence=least_confidence
    ).fit(baskets)
    found = (
        model.associationRules.where(F.array_contains("consequent", F.lit(BLOCK)))
        .where(F.size("antecedent") >= LEAST_TOKENS)
        .select(F.array_sort("antecedent").alias("items"), "support", "confidence")
    )
    found = written(found, "mined-rules")
    part = found.select(F.col("items").alias("part"), F.col("confidence").alias("sure"))
    # Parts share a first or later token with the rule: joined by token, not pair by pair.
    inside = (
        found.select("items", "confidence", F.explode("items").alias("token"))
        .join(part.withColumn("token", F.element_at("part", 1)), "token")
        .where(F.size("part") < F.size("items"))
        .where(F.size(F.array_except("part", "items")) == 0)
        .where("sure >= confidence")
        .select("items")
        .distinct()
    )
    return found.join(inside, "items", "left_anti")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, rule) for each mined rule that a URL has all tokens of.

    ``urls`` has tokens, ``rules`` has items. Rules are filed under their token of fewest
    URLs.
    """
    spread = urls.select("tokens", F.explode("tokens").alias("token"))
    listed_under = rules.select("items", F.explode("items").alias("token"))
    common = (
        spread.join(listed_under.select("token").distinct(), "token", "left_semi")
        .groupBy("token")
        .count()
    )
    index = (
        listed_under.join(common, "token")
        .groupBy("items")
        .agg(F.min(F.struct("count", "token"))["token"].alias("token"))
    )
    return (
        spread.join(index, "token")
        .where(F.size(F.array_except("items", "tokens")) == 0)
        .select("tokens", F.array_join("items", " ").alias("rule"))
    )


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    least_support: float = 0.005,
    least_confidence: float = 0.95,
) -> DataFrame:
    """(id, host, path, rule, mined, verdict) per row of ``pages``.

    ``verdict`` is the listed rule's; else "block" if a mined rule matches (``mined`` names
    the first by text), else "allow". A NULL URL or one without ``://`` has an empty host
    and path, no token, and is allowed unless a listed rule has an empty host. Repeated
    rows are judged alike, other columns are not read, an empty table gives an empty one;
    without labelled pages nothing is mined.

    Mining and matching run on distinct token sets, so a host with a third of all pages
    is one row per path; verdicts come back by a join on the set.
    """
    split = pages.select(
        F.col(id_col).cast("long").alias("id"),
        host(F.col(url_col)).alias("host"),
        path(F.col(url_col)).alias("path"),
    )
    rule, verdict = listed(rules, "host", "path")
    split = split.withColumns({"rule": rule, "given": verdict, "tokens": tokens("host", "path")})
    labelled = split.where(F.col("given").isNotNull()).select(
        "tokens", F.col("given").alias("verdict")
    )
    mined = mine(labelled, least_support=least_support, least_confidence=least_confidence)
    open_urls = split.where(F.col("given").isNull()).select("tokens").distinct()
    hits = matches(open_urls, mined)
    blocked = hits.groupBy("tokens").agg(F.min("rule").alias("mined"))
    blocked = written(blocked, "blocked")
    # Only what no listed rule decides is joined; the rest has no key that could pile up.
    undecided = split.where(F.col("given").isNull()).join(blocked, "tokens", "left")
    decided = split.where(F.col("given").isNotNull()).withColumn("mined", F.lit(None).cast("string"))
    return undecided.unionByName(decided).select(
        "id",
        "host",
        "path",
        "rule",
        "mined",
        F.coalesce("given", F.when(F.col("mined").isNotNull(), "block"), F.lit("allow")).alias(
            "verdict"
        ),
    )
