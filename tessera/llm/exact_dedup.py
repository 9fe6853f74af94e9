"""Exact deduplication by deterministic block naming (operator 9), in DataFrame
operations alone.

A text without its white space is cut into fixed-size blocks.  The distinct
blocks are sorted and numbered: equal blocks, and only they, share an integer
name.  Then adjacent names are paired and the distinct pairs are named the same
way, halving the sequence until each document has one name.  Names of one level
are injective, so (level, name) is a collision-free identity: equal texts have
it in common and different texts do not.

The blocks themselves are shuffled once, after partial aggregation, to be
sorted; documents refer to them by a 64-bit mark.  Naming checks that each mark
stands for a single block and draws new marks in the (rare) other case, so a
hash collision can never join two texts.

Defined results: null text counts as empty, and empty texts are equal; a null
key sorts after all others, and keys of any type are ordered by it; repeated
rows are members of their group, of which one row stays; an empty table gives no
rows; columns of any other names are ignored by ``exact_groups`` and kept
untouched by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name, materialise, remove

WHITE = " \t\n\x0b\x0c\r"
#: Code points of a block.
BLOCK = 4096


def _blocks(normal: Column, size: int) -> Column:
    """A text's blocks; an empty text is one empty block."""
    return F.when(F.length(normal) <= size, F.array(normal)).otherwise(F.regexp_extract_all(normal, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Number distinct rows in sorted order within each range of names.  The
    table is written before use: a name, once given, stays."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _block_names(normal: DataFrame, size: int, seed: int) -> DataFrame | None:
    """(mark, name) of all distinct blocks; None if two blocks share a mark."""
    blocks = normal.select(F.explode(_blocks(F.col("_t"), size)).alias("block")).withColumn("mark", F.xxhash64("block", F.lit(seed)))
    distinct = blocks.groupBy("mark", "block").agg(F.count(F.lit(1)).alias("_n"))
    names = materialise(_named(distinct, ["mark", "block"]).select("mark", "name"), "block-names")
    shared = names.groupBy("mark").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).collect()
    return None if shared else names


def identities(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, spent: list[DataFrame] | None = None) -> DataFrame:
    """One row per input row: _key, tag (xxhash64 of the whole text), n_points
    (code points of the whole text), text_sha256 (of the normalised text), and
    the identity (level, name).  Tables written on the way are added to
    ``spent``: to be removed once the result has been written."""
    spent = [] if spent is None else spent
    whole = F.coalesce(F.col(text), F.lit(""))
    normal = docs.select(F.col(key).alias("_key"), whole.alias("_whole")).select("_key", "_whole", F.translate("_whole", WHITE, "").alias("_t"))
    seed = 0
    while (names := _block_names(normal, block, seed)) is None:
        seed += 1
    marks = F.transform(_blocks(F.col("_t"), block), lambda b: F.xxhash64(b, F.lit(seed)))
    rows = materialise(
        normal.select(
            F.monotonically_increasing_id().alias("_row"),
            "_key",
            F.xxhash64("_whole").alias("tag"),
            F.length("_whole").cast("long").alias("n_points"),
            F.unhex(F.sha2("_t", 256)).alias("sha"),
            marks.alias("marks"),
        ),
        "block-marks",
    )
    spent += [names, rows]
    first = rows.select(
        "_row",
        F.size("marks").alias("n"),
        F.posexplode("marks").alias("pos", "mark"),
    ).join(names, "mark").select("_row", "n", F.col("pos").cast("long").alias("pos"), "name")
    done = first.where("n = 1").select("_row", F.lit(0).alias("level"), "name")
    current, level = materialise(first.where("n > 1"), "names-0"), 0
    spent.append(current)
    widest = current.agg(F.max("n")).first()[0] or 1
    while widest > 1:
        level, widest = level + 1, (widest + 1) // 2
        pairs = current.groupBy("_row", F.shiftright("pos", 1).alias("pos")).agg(
            F.shiftright(F.max("n") + 1, 1).alias("n"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = materialise(pairs, f"pairs-{level}")
        of_pair = materialise(_named(pairs.select("a", "b").distinct(), ["a", "b"]), f"pair-names-{level}")
        spent += [pairs, of_pair]
        renamed = pairs.join(of_pair, ["a", "b"]).select("_row", "n", "pos", "name")
        done = done.unionByName(renamed.where("n = 1").select("_row", F.lit(level).alias("level"), "name"))
        current = renamed.where("n > 1")
        if widest > 1:
            current = materialise(current, f"names-{level}")
            spent.append(current)
    return rows.join(done, "_row").select("_row", "_key", "tag", "n_points", F.lower(F.hex("sha")).alias("text_sha256"), "level", "name")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: key, keep_id (key of the row that stays: most
    code points in the original text, then smallest key), group_size, kept,
    text_sha256, tag (xxhash64 of the original text)."""
    spent: list[DataFrame] = []
    members = materialise(identities(docs, key, text, block, spent), "identities")
    remove(*spent)
    rank = F.struct(-F.col("n_points"), F.col("_key").isNull(), F.col("_key").alias("id"), F.col("_row").alias("row"))
    # written first, so that the join reads plain exchanges, whose large partitions are split
    groups = materialise(members.groupBy("level", "name").agg(F.min(rank).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    return members.join(groups, ["level", "name"]).select(
        F.col("_key").alias(key),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("keep.row") == F.col("_row")).alias("kept"),
        "text_sha256",
        "tag",
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged."""
    own, tag, mark, copies = (free_name(n, docs) for n in ("_own", "_stay", "_mark", "_copies"))
    groups = exact_groups(docs.select(F.col(f"`{key}`").alias("_own"), F.col(f"`{text}`").alias("_text")), "_own", "_text", block)
    stay = groups.groupBy(F.col("_own").alias(own), F.col("tag").alias(tag)).agg(
        F.max("kept").alias("_kept"),
        F.count(F.lit(1)).alias(copies),
    ).where("_kept").drop("_kept")
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    found = marked.join(stay, F.col(f"`{key}`").eqNullSafe(F.col(own)) & (F.col(mark) == F.col(tag)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = found.where(F.col(copies) == 1).select(*columns)
    repeated = found.where(F.col(copies) > 1).dropDuplicates([key, mark]).select(*columns)
    return single.unionByName(repeated)


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS pts,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY pts DESC, doc_id)
"""
