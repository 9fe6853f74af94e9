"""The registered queries of the corpus operators, and SQL where it can say
the same.  Each query is thin: it reads a whole table, applies its operator
with production parameters and keeps the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, kneser_ney, mixing, quality, simhash, substring_dedup, tool_calls, webp

RANKS = "byte_bpe_multi_50k.tiktoken"
COUNTED = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNTED), limit=1024)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("tag")


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(table(spark, sf_dir, "documents"), columns=["doc_id"], digest=True)


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Fitted on labels outside the held-out third."""
    return quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality.crc_of(F.col("doc_id")) % 3 != 1)


def op7_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(spark, sf_dir), columns=["doc_id"])
    return scored.select(
        "doc_id",
        (quality.crc_of(F.col("doc_id")) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = quality.crc_of(F.col("doc_id")) % 7 == 2
    return kneser_ney.score(docs, kneser_ney.train(docs, ~held_out), held_out)


def op1_webp_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.read_payloads(webp.store_payloads(table(spark, sf_dir, "documents")))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.from_turns(table(spark, sf_dir, "conversations"))
    linked = tool_calls.link(calls, results, {"reply": tool_calls.REPLY})
    return linked.select(
        "conv_id",
        "call_id",
        "status",
        "level",
        "n_calls",
        "n_results",
        "valid",
        F.array_join("errors", "; ").alias("errors"),
        F.sha2("canonical_json", 256).alias("canonical_sha256"),
    )


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", *mixing.COLUMNS)


QUERIES = {
    "op4_tool_calls": op4_tool_calls,
    "op6_pfair_mixing": op6_pfair_mixing,
    "op1_webp_lossless": op1_webp_lossless,
    "op7_quality_nbsvm": op7_quality_nbsvm,
    "op8_kneser_ney": op8_kneser_ney,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_simhash_golay": op3_simhash_golay,
    "op9_exact_dedup": op9_exact_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_tool_calls": tool_calls.ORACLE_SQL,
    "op6_pfair_mixing": mixing.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
}
