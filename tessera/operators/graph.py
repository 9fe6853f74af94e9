"""The link graph as an edge table (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def backlinks(links: DataFrame, of: DataFrame) -> DataFrame:
    """(slug, src) for each slug of ``of``."""
    return links.join(of.select(F.col("slug").alias("dst")), "dst").select(F.col("dst").alias("slug"), "src").distinct()


def forward_links(links: DataFrame, of: DataFrame) -> DataFrame:
    return links.join(of.select(F.col("slug").alias("src")), "src").select(F.col("src").alias("slug"), "dst").distinct()


def related(links: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(start, slug, hops): what is within ``depth`` links of each start in
    either direction, the start excluded."""
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = start.select(F.col("slug").alias("start"), "slug", F.lit(0).alias("hops"))
    edge = seen
    for hop in range(1, depth + 1):
        reached = edge.join(both, edge["slug"] == both["src"]).select("start", F.col("dst").alias("slug")).distinct()
        edge = reached.join(seen.select("start", "slug"), ["start", "slug"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(edge)
    return seen.where("hops > 0")


def remove(links: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without the out-edges of removed documents."""
    return links.join(gone.select(F.col("slug").alias("src")), "src", "left_anti")
