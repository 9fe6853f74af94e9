"""Tiered retrieval of a batch of questions as one DataFrame program.

documents: slug, title, body, summary, categories, concepts, fingerprint,
parent, children, section_map (array of slug, title, synopsis).
questions: query_id, question.  index: the tables of ``plans.indexes``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import materialise, small
from ..functions import scoring as S
from ..functions import text as T
from ..operators import rank
from .indexes import Index


def ranked_sources(
    questions: DataFrame,
    tables: Index,
    k: int = 10,
    stemmed: bool = True,
    vectors: DataFrame | None = None,
    gate: float = 5.0,
) -> DataFrame:
    """(query_id, source, slug, rank) of every retriever that answers.  ``vectors``
    are (query_id, slug, score) of the vector source, which questions with few
    full-text answers, or none of a score of ``gate``, have besides."""
    tier0 = rank.tier0(questions, tables.weights, k=k)
    full_text = rank.bm25(questions, tables.postings, tables.stats(), "slug", k, stemmed)
    if vectors is not None:
        full_text = materialise(full_text, "full-text")
    out = tier0.select(
        "query_id",
        F.lit("master_index").alias("source"),
        "slug",
        "rank",
    ).unionByName(full_text.select("query_id", F.lit("fts5").alias("source"), "slug", "rank"))
    if vectors is not None:
        gated = rank.embedding_gate(questions, full_text, least=gate).where("use_embeddings").select("query_id")
        near = rank.top_k(vectors.join(gated, "query_id", "left_semi"), k, ["query_id"], [F.desc("score"), F.col("slug")])
        out = out.unionByName(near.select("query_id", F.lit("embeddings").alias("source"), "slug", "rank"))
    return out


def retrieve(
    questions: DataFrame,
    documents: DataFrame,
    links: DataFrame,
    ranked: DataFrame,
    k: int = 10,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """(query_id, rank, slug, title, snippet, score, tier, categories, source,
    n_bytes) of questions whose retrievers have given ``ranked``."""
    # k rows a question: what the rest of the program reads again and again
    fused = materialise(rank.fuse(ranked, weights, k), "fused")
    asked = questions.select(
        "query_id",
        F.array_distinct(T.tokenize_query(F.col("question"))).alias("kw"),
        T.classify(F.col("question")).alias("kind"),
    ).where(F.size("kw") > 0)  # no keywords, no answer
    rows = documents.join(small(fused), "slug").join(asked, "query_id")

    # what reading a document's header reads: its fields as text
    header = F.octet_length(F.concat_ws(" ", "title", "summary", F.array_join("categories", " "), F.array_join("concepts", " ")))
    # tier 1: metadata of the first five
    first = rows.where("rank <= 5").withColumn("t1", F.col("score") + 2.0 * S.jaccard(F.col("kw"), F.transform("concepts", F.lower)))
    # tier 2: the best section of a split document, if it matches and exists
    scored = F.transform(
        "section_map",
        lambda s, i: F.struct(
            S.jaccard(F.col("kw"), T.tokenize_query(F.concat_ws(" ", s["title"], s["synopsis"]))).alias("score"),
            (-i).alias("at"),
            s["slug"].alias("slug"),
            s["title"].alias("title"),
        ),
    )
    first = first.withColumn("sec", F.array_max(scored))
    wanted = F.when((F.col("kind") == "semantic") & (F.col("sec.score") > 0), F.col("sec.slug"))
    first = materialise(first.withColumn("want", wanted), "first-five")
    child = documents.select(F.col("slug").alias("c_slug"), F.col("body").alias("c_body"))
    named = materialise(first.where("want IS NOT NULL").select(F.col("want").alias("c_slug")).distinct(), "sections")
    first = first.join(child.join(small(named), "c_slug"), F.col("want") == F.col("c_slug"), "left")
    tier = F.when(F.col("kind") == "structured", 1).when(F.col("c_slug").isNotNull(), 2).otherwise(3)
    snippet = F.when(tier == 1, F.col("summary")).otherwise(T.strip(F.substring(F.coalesce("c_body", "body"), 1, 300)))
    answered = first.select(
        "query_id",
        F.coalesce("c_slug", "slug").alias("slug"),
        F.when(tier == 2, F.coalesce("sec.title", "c_slug")).otherwise(F.col("title")).alias("title"),
        snippet.alias("snippet"),
        F.when(tier == 2, F.col("t1") + F.col("sec.score")).otherwise(F.col("t1")).alias("score"),
        tier.alias("tier"),
        "categories",
        "source",
        F.when(tier == 2, F.lit(None)).otherwise(F.col("score")).alias("fused"),
        (header + F.when(tier == 1, 0).otherwise(F.octet_length(F.coalesce("c_body", "body")))).alias("n_bytes"),
    )
    answered = materialise(answered, "answered")
    # tier 0: the rest, from the index entry alone, but for sections given already
    rest = rows.where("rank > 5").select(
        "query_id",
        "slug",
        "title",
        F.col("summary").alias("snippet"),
        (0.5 * F.col("score")).alias("score"),
        F.lit(0).alias("tier"),
        "categories",
        "source",
        F.col("score").alias("fused"),
        F.lit(0).alias("n_bytes"),
    )
    rest = rest.join(answered.select("query_id", "slug").distinct(), ["query_id", "slug"], "left_anti")
    found = materialise(answered.unionByName(rest), "found")

    # what links to the best three, two each, unless it is there already
    best = rank.top_k(found, 3, ["query_id"], [F.desc("score"), F.col("slug")], "_r").select(
        "query_id",
        F.col("slug").alias("dst"),
        F.coalesce("fused", F.lit(0.1)).alias("near"),
        "_r",
    )
    sources = links.select("src", "dst").distinct().join(best, "dst")
    sources = rank.top_k(sources, 2, ["query_id", "dst"], [F.col("src")], "_n")
    sources = sources.groupBy("query_id", F.col("src").alias("slug")).agg(F.max_by("near", -F.col("_r")).alias("near")).join(
        found.select("query_id", "slug").distinct(),
        ["query_id", "slug"],
        "left_anti",
    )
    sources = materialise(sources, "backlinked")
    more = documents.join(small(sources), "slug").select(
        "query_id",
        "slug",
        "title",
        F.col("summary").alias("snippet"),
        (0.5 * F.col("near")).alias("score"),
        F.lit(1).alias("tier"),
        "categories",
        F.lit("backlinks").alias("source"),
        F.lit(None).cast("double").alias("fused"),
        header.alias("n_bytes"),
    )

    out = found.unionByName(more).withColumn("score", F.round("score", 6))
    return rank.top_k(out, k, ["query_id"], [F.desc("score"), F.col("slug"), F.col("tier")]).drop("fused")


ANSWERS = "query_id long, slug string, title string, snippet string, score double, tier int, categories array<string>, source string, n_bytes long, rank int"


def nothing(spark: SparkSession) -> DataFrame:
    """The answers of a store without documents."""
    return spark.createDataFrame([], ANSWERS)


def bytes_read(results: DataFrame) -> DataFrame:
    """(query_id, n_bytes, tier_max): what the tiers read for each question's
    answers, and the deepest of them."""
    return results.groupBy("query_id").agg(F.sum("n_bytes").alias("n_bytes"), F.coalesce(F.max("tier"), F.lit(0)).alias("tier_max"))
