"""A corpus pipeline of five stages, each one of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, mixing, quality, simhash
from tessera.llm._common import materialise

#: Documents that score less are rejected.
LEAST_QUALITY = 0.5
SHINGLE, SIMILARITY = 5, 0.8
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bound of each of the encoder's memos, less than its default: workers also hold
#: what the stages before have left in their memory.
MEMO_BYTES = 72 << 20


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels
    outside the held-out third."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, quality.crc_of(F.col("doc_id")) % 3 != 1)
    return quality.keep_good(docs, model, least=LEAST_QUALITY)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs, shingle=SHINGLE, least=SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule that mixes their sources."""
    return mixing.interleaved(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to, in the
    order of the schedule.  Rows are read again in another order than they were
    written in, so the schedule, the same for the same rows, is made anew."""
    return bpe.round_trip(mixing.interleaved(docs), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, memo_bytes=MEMO_BYTES)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{k}")
    return docs


#: SQL can't express the classifier, so the pipeline is tested stage by stage.
ORACLE_SQL = None
