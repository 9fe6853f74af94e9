"""Mixing sources to target weights by Pfair scheduling (operator 6), in
DataFrame operations.

Each source's rows, in the order of a hash of their key, are cut into blocks of
``block_chars`` code points (a row belongs to the block in which it begins).
Weights are rounded to q_i of ``slots`` slots.  Block j of source i is released
at floor(j * slots / q_i) and due at ceil((j + 1) * slots / q_i); in each slot
the released block that is due earliest runs (ties: by source).  The q_i sum to
``slots``, so every block meets its deadline, and at any time each source is
less than one block away from its share.  The schedule repeats after ``slots``
slots, so one period, computed once, places every block:

    slot(i, j) = (j div q_i) * slots + slot(i, j mod q_i)

All rows stay.  A source that has run out leaves its later slots empty, and the
others go on in their proportions.

A source's running length is computed in parts of about ``PART_ROWS`` rows, by
the leading bits of their hash, so a source with a third of all rows is no hot
group, and only the parts' sums are accumulated over a source.

The driver holds the sources' sizes and one period, at most ``slots`` blocks or
four for each source.  Sources are names that weights are given to; a table with
more than ``MOST_SOURCES`` is refused, as its schedule would outgrow the driver.

Defined results: a missing source is a source of its own, and a missing text
has length 0; rows of equal keys are ordered by their text's hash, and repeated
rows follow each other; sources without a stated weight get ``default``; weights
of 0 or less are refused; an empty table gives no rows; columns named ``mix_*``
are replaced, all others kept, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 1024
BLOCK_CHARS = 1 << 16
#: Rows of one source that a window holds, about.
PART_ROWS = 1024
MOST_SOURCES = 1 << 20
#: A period of more blocks is joined by shuffle instead of being broadcast.
BROADCAST_BLOCKS = 1 << 16
COLUMNS = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_start")


def shares(weights: Mapping[str, float], slots: int) -> dict[str, int]:
    """Whole slots for each source, at least one, in proportion to the weights
    (largest remainders; ties by source)."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights are positive")
    slots = max(slots, 4 * len(weights))
    total = math.fsum(weights.values())
    exact = {s: w / total * slots for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    over = sum(out.values()) - slots
    for s in sorted(out, key=lambda s: (out[s] - exact[s], s)):
        if over >= 0:
            break
        out[s] += 1
        over += 1
    while over > 0:
        s = max(out, key=lambda s: (out[s], s))
        out[s] -= 1
        over -= 1
    return out


def period(share: Mapping[str, int]) -> list[tuple[str, int, int, int, int, int]]:
    """(source, q, k, release, deadline, slot) of every block of one period,
    by earliest deadline first."""
    slots = sum(share.values())
    waiting = [(0, s, 0) for s in sorted(share)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * slots // share[s]), s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        out.append((s, share[s], k, release, deadline, t))
        if k + 1 < share[s]:
            heapq.heappush(waiting, ((k + 1) * slots // share[s], s, k + 1))
    return out


def tempered(sizes: Mapping[str, int], power: float = 0.5) -> dict[str, float]:
    """Weights between natural (power 1) and uniform (power 0) shares."""
    return {s: max(1, n) ** power for s, n in sizes.items()}


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    slots: int = SLOTS,
    block_chars: int = BLOCK_CHARS,
    default: float = 1.0,
) -> DataFrame:
    """``docs`` with the schedule: mix_block (number within the source),
    mix_release, mix_deadline, mix_slot, mix_start (offset within the source).
    Without ``weights``, sources are tempered by the square root of their size."""
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in COLUMNS]
    kept = [F.col(f"c{k}").alias(c) for k, c in enumerate(columns)]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)],
        F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source).cast("string"))).alias("_s"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("_n"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("_h"),
        F.xxhash64(text).alias("_t"),
    )
    # one row for each source comes to the driver, and not more than it can hold
    sizes = rows.groupBy("_s").agg(F.sum("_n").alias("chars"), F.count(F.lit(1)).alias("n"))
    found = {r["_s"]: (r["chars"], r["n"]) for r in sizes.limit(MOST_SOURCES + 1).collect()}
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if not found:
        return docs.select(*[F.col(f"`{c}`") for c in columns], *[F.lit(None).cast("long").alias(c) for c in COLUMNS])
    if weights is None:
        share = shares(tempered({s: c for s, (c, _) in found.items()}), slots)
    else:
        given = {"" if s is None else f"={s}": w for s, w in weights.items()}
        share = shares({s: given.get(s, default) for s in found}, slots)
    plan = period(share)
    slots = len(plan)
    send = F.broadcast if slots <= BROADCAST_BLOCKS else (lambda table: table)

    # a source's share of the period, and the parts that its rows are summed in
    each = _table(spark, [(s, q, -(-found[s][1] // PART_ROWS)) for s, q in share.items()], "_s string, _q long, _parts long")
    rows = rows.join(send(each), "_s")
    rows = rows.withColumn("_p", F.shiftright(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * F.col("_parts"), 32)).drop("_parts")
    parts = rows.groupBy("_s", "_p").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_s", "_p", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("_s", "_p").orderBy("_h", "_t").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inner", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(parts, ["_s", "_p"])
    placed = placed.withColumn("mix_start", F.col("_offset") + F.col("_inner")).withColumn(
        "mix_block",
        F.floor(F.col("mix_start") / F.lit(block_chars)).cast("long"),
    )

    schedule = _table(spark, [(s, k, r, d, t) for s, _, k, r, d, t in plan], "_s string, _k long, _release long, _deadline long, _slot long")
    placed = placed.withColumn("_k", F.col("mix_block") % F.col("_q")).join(send(schedule), ["_s", "_k"])
    turn = (F.floor(F.col("mix_block") / F.col("_q")) * slots).cast("long")
    return placed.select(
        *kept,
        "mix_block",
        (turn + F.col("_release")).alias("mix_release"),
        (turn + F.col("_deadline")).alias("mix_deadline"),
        (turn + F.col("_slot")).alias("mix_slot"),
        "mix_start",
    )


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows, as literals; of many, as Arrow batches."""
    if len(rows) > 8192:
        return spark.createDataFrame(rows, schema)
    values = ", ".join("(" + ", ".join(_quoted(x) if isinstance(x, str) else f"{x}L" for x in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(c.split()[0] for c in schema.split(', '))})")


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def interleaved(docs: DataFrame, weights: Mapping[str | None, float] | None = None, **options) -> DataFrame:
    """``docs``, columns unchanged, in the order of the schedule: range
    partitions by slot, sorted, so files written from it follow one another."""
    columns = [c for c in docs.columns if c not in COLUMNS]
    made = mix(docs, weights, **options)
    return made.repartitionByRange("mix_slot", "mix_start").sortWithinPartitions("mix_slot", "mix_start").select(*[F.col(f"`{c}`") for c in columns])


#: ``mix`` with its defaults (sources tempered; one period simulated slot by slot).
ORACLE_SQL = """
WITH RECURSIVE
d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s, length(coalesce(text, '')) AS n,
             md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
z AS (SELECT s, sqrt(greatest(1, sum(n))::DOUBLE) AS w FROM d GROUP BY 1),
e AS (SELECT s, w / sum(w) OVER () * 1024 AS x FROM z),
f AS (SELECT s, greatest(1, floor(x))::BIGINT AS q, greatest(1, floor(x)) - x AS r FROM e),
g AS (SELECT s, q + CASE WHEN row_number() OVER (ORDER BY r, s) <= 1024 - sum(q) OVER () THEN 1 ELSE 0 END AS q FROM f),
l AS (SELECT list(s ORDER BY s) AS ss, list(q::BIGINT ORDER BY s) AS qs FROM g),
p AS (
  SELECT 0::BIGINT AS t, ks, (list_min(list_transform(range(1, len(qs) + 1), lambda j: CASE WHEN ks[j] < qs[j] AND (ks[j] * 1024) // qs[j] <= 0 THEN (((ks[j] + 1) * 1024 + qs[j] - 1) // qs[j]) * 100000 + j ELSE 1000000000000000 END)) % 100000)::BIGINT AS pick
  FROM (SELECT qs, list_transform(qs, lambda q: 0::BIGINT) AS ks FROM l)
  UNION ALL
  SELECT t, ks, (list_min(list_transform(range(1, len(qs) + 1), lambda j: CASE WHEN ks[j] < qs[j] AND (ks[j] * 1024) // qs[j] <= t THEN (((ks[j] + 1) * 1024 + qs[j] - 1) // qs[j]) * 100000 + j ELSE 1000000000000000 END)) % 100000)::BIGINT
  FROM (SELECT qs, t + 1 AS t, list_transform(range(1, len(ks) + 1), lambda j: ks[j] + CASE WHEN j = pick THEN 1 ELSE 0 END) AS ks FROM p, l WHERE t < 1023)),
plan AS (SELECT ss[pick] AS s, qs[pick] AS q, ks[pick] AS k, t FROM p, l),
pos AS (SELECT doc_id, source, s, coalesce(sum(n) OVER (PARTITION BY s ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM d),
b AS (SELECT *, st // 65536 AS blk FROM pos)
SELECT doc_id, source, blk AS mix_block, (blk // q) * 1024 + (k * 1024) // q AS mix_release, (blk // q) * 1024 + ((k + 1) * 1024 + q - 1) // q AS mix_deadline,
       (blk // q) * 1024 + t AS mix_slot, st AS mix_start
FROM b JOIN plan ON plan.s = b.s AND blk % q = k
"""
