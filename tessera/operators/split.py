"""Section splitting as array folds: no Python, one row in, rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import fingerprint

SECTION = "struct<heading:string,body:string>"


def _level_sections(text: Column, level: int) -> Column:
    """Sections at headings of exactly one level; the first is the preamble."""
    mark = "#" * level
    parts = F.split(text, rf"(?dm)(?=^{mark}\s+.+$)")
    first = F.array(F.struct(
        F.lit("").alias("heading"),
        F.when(F.get(parts, 0).rlike(rf"^{mark}\s+.+"), "").otherwise(T.strip(F.get(parts, 0))).alias("body"),
    ))
    headed = F.filter(parts, lambda p: p.rlike(rf"^{mark}\s+[^\n]+"))
    made = F.transform(
        headed,
        lambda p: F.struct(
            T.strip(F.substring_index(p, "\n", 1)).alias("heading"),
            T.strip(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 1, F.length(p))).alias("body"),
        ),
    )
    return F.concat(first, made).cast(f"array<{SECTION}>")


def pack_paragraphs(text: Column, threshold: int) -> Column:
    """Blank-line paragraphs packed greedily up to ``threshold`` words."""
    parts = F.filter(F.transform(F.split(text, r"\n{2,}"), T.strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        n = T.word_count(p)
        flush = (acc["n"] + n > threshold) & (acc["now"] != "")
        return F.struct(
            F.when(flush, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(flush | (acc["now"] == ""), p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p)).alias("now"),
            F.when(flush, n).otherwise(acc["n"] + n).alias("n"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n\n")


def merge_short(sections: Column, least: int = 50) -> Column:
    """Sections under ``least`` words are carried into the next, which keeps its
    heading; a short last one is appended to the one before."""
    none = F.lit(None).cast(SECTION)
    start = F.struct(F.array().cast(f"array<{SECTION}>").alias("done"), none.alias("carry"))

    def step(acc: Column, s: Column) -> Column:
        c = acc["carry"]
        body = F.when(c.isNull(), s["body"]).otherwise(T.strip(_joined(c["heading"], c["body"], s["body"])))
        now = F.struct(s["heading"].alias("heading"), body.alias("body"))
        short = T.word_count(F.concat_ws(" ", s["heading"], body)) < least
        return F.struct(
            F.when(short, acc["done"]).otherwise(F.concat(acc["done"], F.array(now))).alias("done"),
            F.when(short, now).otherwise(none).alias("carry"),
        )

    def finish(acc: Column) -> Column:
        done, c = acc["done"], acc["carry"]
        last = F.element_at(done, -1)
        grown = F.struct(last["heading"].alias("heading"), T.strip(_joined(last["body"], c["heading"], c["body"])).alias("body"))
        return F.when(c.isNull(), done).when(F.size(done) == 0, F.array(c)).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown)))

    return F.aggregate(sections, start, step, finish)


def sections(docs: DataFrame, threshold: int = 2000, least: int = 50) -> DataFrame:
    """``docs`` (slug, text) plus strategy (h2, h3, paragraphs, single), preamble
    and merged sections; texts up to ``threshold`` words are single."""
    h2, h3 = _level_sections(F.col("text"), 2), _level_sections(F.col("text"), 3)
    packed = F.transform(
        pack_paragraphs(F.col("text"), threshold),
        lambda p: F.struct(F.lit("").alias("heading"), p.alias("body")),
    ).cast(f"array<{SECTION}>")
    rows = docs.withColumn("_h2", h2).withColumn("_h3", h3).withColumn("_p", packed)
    strategy = F.when(T.word_count(F.col("text")) <= threshold, "single").when(F.size("_h2") > 2, "h2").when(F.size("_h3") > 2, "h3").when(F.size("_p") > 1, "paragraphs").otherwise("single")
    rows = rows.withColumn("strategy", strategy)
    tail = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    chosen = F.when(F.col("strategy") == "h2", tail(F.col("_h2"))).when(F.col("strategy") == "h3", tail(F.col("_h3"))).when(F.col("strategy") == "paragraphs", F.col("_p")).otherwise(F.array().cast(f"array<{SECTION}>"))
    preamble = F.when(F.col("strategy") == "h2", F.col("_h2")[0]["body"]).when(F.col("strategy") == "h3", F.col("_h3")[0]["body"]).otherwise("")
    rows = rows.withColumn("preamble", preamble).withColumn("sections", merge_short(chosen, least))
    # a document that merges into one section isn't split
    return rows.withColumn("strategy", F.when(F.size("sections") > 1, F.col("strategy")).otherwise("single")).drop("_h2", "_h3", "_p")


def split(docs: DataFrame, threshold: int = 2000, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """(parents, children): children (slug, parent, section_index, title, body),
    with unique slugs; parents (slug, body, children) link to them."""
    rows = sections(docs, threshold, least).where("strategy <> 'single'")
    each = rows.select("slug", "preamble", F.posexplode("sections").alias("i", "s"))
    own = T.heading_slug(F.col("s.heading"))
    child = F.when(
        (F.col("s.heading") != "") & (own != ""),
        F.concat_ws("-", "slug", own),
    ).otherwise(F.concat(F.col("slug"), F.lit("-section-"), F.col("i")))
    line = F.substring(T.strip(F.substring_index("s.body", "\n", 1)), 1, 60)
    title = F.when(
        F.col("s.heading") != "",
        T.strip(F.regexp_replace("s.heading", r"^#+\s*", "")),
    ).when(line != "", line).otherwise(F.concat(F.lit("Section "), F.col("i") + 1))
    each = each.select(
        F.col("slug").alias("parent"),
        "preamble",
        F.col("i").alias("section_index"),
        child.alias("base"),
        title.alias("title"),
        _joined(F.col("s.heading"), F.col("s.body")).alias("body"),
    )
    # a document's sections are as many as its headings
    twin = F.row_number().over(Window.partitionBy("parent", "base").orderBy("section_index"))
    each = each.withColumn("slug", F.when(twin == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), twin)))
    children = each.select("slug", "parent", "section_index", "title", "body")
    # what a section is about, in 150 characters, for the parent's map
    each = each.withColumn("synopsis", fingerprint.synopsis(F.col("body"), F.col("title"), 150))
    listed = each.groupBy("parent", "preamble").agg(F.array_sort(F.collect_list(F.struct("section_index", "slug", "title", "synopsis"))).alias("m"))
    links = F.array_join(F.transform("m", lambda x: F.concat(F.lit("- [["), x["slug"], F.lit("]]"))), "\n")
    parents = listed.select(
        F.col("parent").alias("slug"),
        T.strip(_joined(F.col("preamble"), F.lit("## Sections\n"), links)).alias("body"),
        F.transform("m", lambda x: x["slug"]).alias("children"),
        F.transform(
            "m",
            lambda x: F.struct(x["slug"].alias("slug"), x["title"].alias("title"), x["synopsis"].alias("synopsis")),
        ).alias("section_map"),
    )
    return parents, children
