"""Export and import of a store as a Parquet tree with a one-row manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export(documents: DataFrame, folder: str, embeddings: DataFrame | None = None, version: str = "1") -> DataFrame:
    """Write the tables and return the manifest as written."""
    documents.write.mode("overwrite").parquet(f"{folder}/documents")
    if embeddings is not None:
        embeddings.write.mode("overwrite").parquet(f"{folder}/embeddings")
    written = documents.sparkSession.read.parquet(f"{folder}/documents")
    manifest = written.agg(
        F.lit(version).alias("format_version"),
        F.count(F.lit(1)).alias("document_count"),
        F.lit(embeddings is not None).alias("includes_embeddings"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories"),
        F.sum(F.octet_length("body")).alias("total_size_bytes"),
        F.current_timestamp().alias("created_at"),
    )
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return documents.sparkSession.read.parquet(f"{folder}/manifest")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    manifest = spark.read.parquet(f"{folder}/manifest")
    out = {"manifest": manifest, "documents": spark.read.parquet(f"{folder}/documents")}
    if manifest.first()["includes_embeddings"]:
        out["embeddings"] = spark.read.parquet(f"{folder}/embeddings")
    return out
