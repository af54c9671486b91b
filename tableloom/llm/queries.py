"""The registered queries of this subpackage: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.llm import quality_neighbours, suffix_tree, toxicity, url_rules
from tableloom.llm.common import fold_of, table
from tableloom.llm.decontamination import contaminated
from tableloom.llm.line_dedup import dedup_lines
from tableloom.llm.merkle import manifest
from tableloom.llm.mixing import mix
from tableloom.llm.oracles import ORACLES  # noqa: F401
from tableloom.llm.quality_rules import judge
from tableloom.llm.sanitise import KINDS, listing, sanitised
from tableloom.llm.simhash import near_duplicates
from tableloom.llm.token_counts import token_counts
from tableloom.llm.whitening import whitened

TOKENIZER = "byte_bpe_50k.json"


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in documents: a row per document and item."""
    found = contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "distance", "start", "stop")


def op2_token_counts(
    spark: SparkSession, folder: str, tokenizer: str | None = None
) -> DataFrame:
    """Bytes and tokens of every document."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    with open(tokenizer, encoding="utf-8") as file:  # a file of the driver, sent along
        definition = file.read()
    return token_counts(table(spark, folder, "documents"), definition, limit=512).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit"
    )


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of every document, and whether a learned decision list keeps it."""
    judged = judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.col("rule_text").alias("rule"),
    )


def op4_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document a mix of the sources takes."""
    mixed = mix(
        table(spark, folder, "documents"), weights=(5, 2, 1), percent=150, most_repeats=2
    )
    return mixed.select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken"
    )


def _scored(scores: DataFrame, least: float) -> DataFrame:
    return scores.select(
        F.col("id").alias("doc_id"),
        (fold_of(F.col("id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document."""
    return _scored(
        toxicity.score_texts(table(spark, folder, "documents"), table(spark, folder, "labels")),
        0.5,
    )


# Rules kept by hand: verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op6_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return url_rules.judge(table(spark, folder, "pages"), URL_RULES).withColumnRenamed(
        "id", "page_id"
    )


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, folder, "documents"), shingle_words=3, max_bits=2)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op8_quality_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document."""
    return _scored(
        quality_neighbours.score_texts(
            table(spark, folder, "documents"), table(spark, folder, "labels")
        ),
        0.3,
    )


def op9_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document under a suffix tree of the training fold."""
    return suffix_tree.score_texts(table(spark, folder, "documents")).withColumnRenamed(
        "id", "doc_id"
    )


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that another one, or an earlier line, has."""
    left = dedup_lines(table(spark, folder, "documents"))
    return left.select("doc_id", "text", "n_lines", "dropped")


LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots and proof of every document, checked against a copy that lost line breaks."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(
        table(spark, folder, "documents"), LEAF_FIELDS, altered={"text": tampered}
    )
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        "verified",
    )


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The first four whitened components of every usable embedding."""
    found = whitened(table(spark, folder, "embeddings"), components=4, scale=256)
    return found.withColumnRenamed("id", "vec_id")


def op13_private_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document, and the terms that give it away."""
    found = sanitised(table(spark, folder, "documents"))
    counts = [
        F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
        for kind in KINDS
    ]
    return found.select(
        F.col("id").alias("doc_id"),
        *counts,
        F.sha2(listing(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listing(F.concat("base", "related")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_source_mix": op4_source_mix,
    "op5_toxicity": op5_toxicity,
    "op6_url_rules": op6_url_rules,
    "op7_simhash": op7_simhash,
    "op8_quality_neighbours": op8_quality_neighbours,
    "op9_suffix_tree": op9_suffix_tree,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_private_data": op13_private_data,
}
