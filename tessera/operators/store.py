"""Keyed documents: upsert, cascading delete, slugs, duplicates, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import number_within
from ..functions import text as T


def upsert(old: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(docs: DataFrame, gone: DataFrame, key: str = "slug", children: str = "children") -> DataFrame:
    """Without the named documents and those that they list as children."""
    named = gone.select(key)
    below = docs.join(named, key, "left_semi").select(F.explode(children).alias(key))
    return docs.join(named.unionByName(below).distinct(), key, "left_anti")


def merge_metadata(docs: DataFrame, updates: DataFrame, key: str = "slug", column: str = "extra") -> DataFrame:
    """Shallow merge of a map column; the update wins."""
    both = docs.join(updates.select(key, F.col(column).alias("_new")), key, "left")
    kept = F.map_filter(column, lambda k, _: ~F.array_contains(F.map_keys("_new"), k))
    return both.withColumn(column, F.when(F.col("_new").isNull(), F.col(column)).otherwise(F.map_concat(kept, "_new"))).drop("_new")


def number_slugs(titles: DataFrame, existing: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """``titles`` (title, ord) plus slug: equal bases get -2, -3 ... in order,
    after those that exist already."""
    rows = number_within(titles.withColumn("_base", T.slug(F.col("title"))), "_base", [order], "_place")
    n = F.col("_place")
    if existing is not None:
        taken = existing.select(
            F.regexp_replace("slug", r"-[0-9]+$", "").alias("_base"),
            F.coalesce(F.expr("try_cast(regexp_extract(slug, '-([0-9]+)$', 1) AS int)"), F.lit(1)).alias("_k"),
        ).groupBy("_base").agg(F.max("_k").alias("_taken"))
        rows = rows.join(taken, "_base", "left")
        n = n + F.coalesce("_taken", F.lit(0))
    return rows.withColumn("slug", F.when(n == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), n))).drop("_base", "_taken", "_place")


def mark_duplicates(docs: DataFrame, key: str, text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(key, content_hash, status, original): the first of equal contents is
    created, others are duplicates; a null text counts as empty; ``known`` holds
    (content_hash, slug)."""
    rows = docs.select(key, T.content_hash(F.coalesce(text, F.lit(""))).alias("content_hash"))
    first = rows.groupBy("content_hash").agg(F.min(key).alias("original"))
    rows = rows.join(first, "content_hash")
    status = F.when(F.col(key) == F.col("original"), "created").otherwise("duplicate")
    if known is not None:
        rows = rows.join(known.select("content_hash", F.col("slug").alias("_known")), "content_hash", "left")
        status = F.when(F.col("_known").isNotNull(), "duplicate").otherwise(status)
    return rows.select(key, "content_hash", status.alias("status"), "original")


def page(docs: DataFrame, number: int, size: int, order: str = "slug") -> DataFrame:
    """One page; sizes are clamped to 1..100 and numbers to 1 or more."""
    size, number = max(1, min(100, size)), max(1, number)
    return docs.orderBy(order).offset((number - 1) * size).limit(size)


def bounded_k(k: int | None, default: int = 10) -> int:
    """How many answers are asked for: 1 to 100; none or 0 is the default."""
    return max(1, min(100, k or default))


def search(docs: DataFrame, filters: dict | None = None, k: int = 10) -> DataFrame:
    """Structured search: category, has_children, parent, min_word_count; other
    keys are ignored; newest first."""
    for name, value in (filters or {}).items():
        if name == "category":
            docs = docs.where(F.array_contains("categories", value))
        elif name == "has_children":
            docs = docs.where(F.col("has_children") == F.lit(bool(value)))
        elif name in ("parent", "parent_slug"):
            docs = docs.where(F.col("parent") == value)
        elif name == "min_word_count":
            docs = docs.where(F.col("word_count") >= value)
    return docs.orderBy(F.desc("updated"), "slug").limit(bounded_k(k))
