"""The index of documents as tables: postings, keyword weights, lengths.

Terms and tokens are dealt to buckets by hash, and the tables are partitioned by
bucket: a batch of questions joins the buckets that its terms are in (dynamic
partition pruning skips the others) and reads no text.  Each task writes its own
documents' rows, document by document, to all buckets: nothing is shuffled, and
ids are stored as runs.  Where documents come and go, postings are rows, of which
some die; where they stay as they are, blocks of many documents' postings are rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index

#: Of postings, and of blocks of keyword weights.
BUCKETS, WEIGHT_BUCKETS = 16, 4
FIELDS = ("title", "summary", "body")
LISTS = ("categories", "concepts", "fingerprint")


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    weights: DataFrame
    lengths: DataFrame

    def stats(self) -> DataFrame:
        """One row: n_docs, avgdl."""
        return stats(self.lengths)


def stats(lengths: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def packed(documents: DataFrame, *fields: Column, stemmed: bool = False) -> DataFrame:
    """Postings of documents that stay as they are, in blocks."""
    return index.posting_blocks(documents, "slug", *fields, buckets=BUCKETS, stemmed=stemmed)


def pooled(documents: DataFrame) -> list[Column]:
    """All fields of full text."""
    return [F.col(c) for c in FIELDS if c in documents.columns] + [F.array_join(c, " ") for c in LISTS if c in documents.columns]


def tables_of(documents: DataFrame, entries: DataFrame | None = None, stemmed: bool = True) -> dict[str, DataFrame]:
    """The tables of documents (slug, title, summary, body, categories, concepts,
    fingerprint): all fields pooled for full text, the index entry's for keywords."""
    fields = pooled(documents)
    if entries is None:
        entries = documents.select("slug", "title", F.coalesce("summary", F.lit("")).alias("synopsis"), "categories", "fingerprint")
    return {
        "postings": index.postings(documents, "slug", *fields, stemmed=stemmed),
        "weights": index.keyword_weights(entries),
        "lengths": index.lengths(documents, "slug", *fields),
    }


def write(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write the tables, and where each is."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder}/{name}"
        if name in ("postings", "weights"):
            term = "term" if name == "postings" else "token"
            if "bucket" not in df.columns:
                df = df.withColumn("bucket", F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int"))
            df.sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(paths[name], compression="zstd")
        else:
            df.write.parquet(paths[name], compression="zstd")
    return paths


def read(spark: SparkSession, folder: str) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "weights", "lengths")))


def build_one(name: str, tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """One of the tables, written and read."""
    (path,) = write({name: tables[name]}, folder).values()
    return tables[name].sparkSession.read.parquet(path)


def write_blocks(documents: DataFrame, folder: str) -> None:
    """Documents that stay as they are (slug, doc_id, title, text), described, and
    their postings and keyword weights in blocks, in one pass."""
    rows = index.described_blocks(documents, BUCKETS, WEIGHT_BUCKETS)
    rows.sortWithinPartitions("kind", "bucket").write.partitionBy("kind", "bucket").parquet(folder, compression="zstd")


def read_blocks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, postings and weights of ``write_blocks``."""
    block = ("block", "slugs", "terms", "ends", "counts", "at")
    columns = {
        index.DOCUMENT: ("slug", "doc_id", "title", "body", "summary", "categories", "concepts", "fingerprint", "is_long"),
        index.POSTINGS: ("bucket", *block, "dls", "tf"),
        index.WEIGHTS: ("bucket", *block, "weight"),
    }
    return tuple(spark.read.parquet(f"{folder}/kind={kind}").select(*names) for kind, names in columns.items())


def build(documents: DataFrame, folder: str, entries: DataFrame | None = None, stemmed: bool = True) -> Index:
    write(tables_of(documents, entries, stemmed), folder)
    return read(documents.sparkSession, folder)
