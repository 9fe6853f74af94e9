"""Ingest as one program: extracted texts to documents and their indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import materialise
from ..functions import text as T
from ..operators import fingerprint, index, split, store


def describe(docs: DataFrame, taxonomy=None, summarise=fingerprint.synopsis) -> DataFrame:
    """``docs`` (slug, title, text; existing_categories if known) plus
    fingerprint, categories, concepts and summary; a document without category is
    ``general``.  ``summarise`` is another way to make summaries, a function of
    the columns text and title: a language model's, for example."""
    whole = fingerprint.description(F.col("title"), F.col("text"), taxonomy, summarise is fingerprint.synopsis)
    out = docs.withColumn("_d", whole)
    found = F.col("_d.found")
    if "existing_categories" in docs.columns:
        found = fingerprint.merged_categories(F.col("existing_categories"), found)
    summary = F.col("_d.summary") if summarise is fingerprint.synopsis else summarise(F.col("text"), F.col("title"))
    return out.select(
        *[c for c in docs.columns if c not in ("existing_categories", "fingerprint", "categories", "concepts", "summary")],
        F.col("_d.fingerprint").alias("fingerprint"),
        fingerprint.let(found, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(F.lit("general")))).alias("categories"),
        F.col("_d.concepts").alias("concepts"),
        summary.alias("summary"),
    )


def ingest(
    extracted: DataFrame,
    threshold: int = 2000,
    existing: DataFrame | None = None,
    taxonomy=None,
    summarise=fingerprint.synopsis,
) -> tuple[DataFrame, DataFrame]:
    """(documents, results) of rows (ord, title, text): duplicates, slugs, split
    sections, fingerprints.  results: ord, slug, status; a duplicate has the slug
    of the document that it repeats."""
    titled = extracted.withColumn("title", F.coalesce("title", F.lit("untitled"))).withColumn("text", F.coalesce("text", F.lit("")))
    marked = store.mark_duplicates(titled, "ord")
    fresh = titled.join(marked.where("status = 'created'").select("ord", "content_hash"), "ord")
    fresh = materialise(store.number_slugs(fresh, existing), "fresh")
    parents, children = split.split(fresh.select("slug", "text"), threshold)
    whole = fresh.join(parents.select("slug", F.col("body").alias("_body"), "children", "section_map"), "slug", "left")
    empty = F.array().cast("array<string>")
    maps = F.array().cast("array<struct<slug:string,title:string,synopsis:string>>")
    top = whole.select(
        "slug",
        "title",
        F.coalesce("_body", "text").alias("text"),
        F.lit(None).cast("string").alias("parent"),
        F.coalesce("children", empty).alias("children"),
        F.coalesce("section_map", maps).alias("section_map"),
    )
    below = children.select("slug", "title", F.col("body").alias("text"), "parent", empty.alias("children"), maps.alias("section_map"))
    # the pieces are read by every part of the fingerprint
    documents = describe(
        materialise(top.unionByName(below), "ingested"),
        taxonomy,
        summarise,
    ).withColumn("word_count", T.word_count(F.col("text"))).withColumnRenamed("text", "body")
    slugs = fresh.select("ord", "slug").join(parents.select("slug", F.lit(True).alias("_split")), "slug", "left")
    results = marked.join(slugs.withColumnRenamed("ord", "original"), "original", "left").select(
        "ord",
        "slug",
        F.when(F.col("status") == "duplicate", "duplicate").when(F.col("_split"), "split").otherwise(F.col("status")).alias("status"),
    )
    return documents, results


def derive_indexes(documents: DataFrame) -> dict[str, DataFrame]:
    """All that is derived from documents: what an engine keeps beside them."""
    from .indexes import tables_of

    return tables_of(documents) | {
        "links": index.links(documents),
        "entries": documents.select(
            "slug",
            "title",
            "categories",
            "summary",
            "fingerprint",
            (F.size("children") > 0).alias("has_children"),
            "parent",
        ),
        "index_state": index.index_state(documents, "slug", "title", "body"),
    }
