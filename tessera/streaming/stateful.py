"""Stateful streams: implicit signals and an exact rate limiter.

State holds what the rules need and no more: the last twenty queries of a
session, or the accepted calls of the last minute.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..durable import materialise
from ..functions.lexicon import STOP_WORDS
from ..operators.feedback import MEMORY, REFINEMENT, REPEAT, TOPIC_SWITCH


def keywords(question: str) -> list[str]:
    return sorted({w for w in re.findall("[a-z0-9]+", (question or "").lower()) if len(w) > 1 and w not in STOP_WORDS})


def signal(now: dict, prev: dict, scale: int = 1) -> tuple[float, str] | None:
    gap = now["ts"] - prev["ts"]
    if now["h"] == prev["h"] and gap <= REPEAT[1] * scale:
        return REPEAT[0], "repeat_query"
    a, b = set(now["kw"]), set(prev["kw"])
    if a and b:
        overlap = len(a & b) / len(a | b)
        if gap <= REFINEMENT[1] * scale and overlap > 0.6:
            return REFINEMENT[0], "refinement"
        if gap <= TOPIC_SWITCH[1] * scale and overlap < 0.2:
            return TOPIC_SWITCH[0], "topic_switch"
    return None


def signals(queries: DataFrame, scale: int = 1) -> DataFrame:
    """Stream of (session, query_id, by_query_id, score, signal_type) from a
    stream of (session, query_id, question, ts)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = json.loads(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "query_id"])
        for row in rows.itertuples():
            now = {
                "id": int(row.query_id),
                "ts": row.ts.timestamp(),
                "h": hashlib.sha256((row.question or "").encode()).hexdigest(),
                "kw": keywords(row.question),
            }
            for prev in reversed(memory):
                if found := signal(now, prev, scale):
                    out.append((key[0], prev["id"], now["id"], *found))
                    break
            memory = [*memory, now][-MEMORY:]
        state.update((json.dumps(memory),))
        yield pd.DataFrame(out, columns=["session", "query_id", "by_query_id", "score", "signal_type"])

    return queries.groupBy("session").applyInPandasWithState(
        run,
        "session string, query_id long, by_query_id long, score double, signal_type string",
        "memory string",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def rate_limiter(calls: DataFrame, most: int = 100, seconds: int = 60) -> DataFrame:
    """Stream of (key, call_id, ts, allowed): at most ``most`` accepted calls in
    any trailing window; refused calls don't count."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = json.loads(state.get[0]) if state.exists else []
        out = []
        for row in pd.concat(list(batches)).sort_values(["ts", "call_id"]).itertuples():
            now = row.ts.timestamp()
            recent = [t for t in recent if t > now - seconds]
            ok = len(recent) < most
            if ok:
                recent.append(now)
            out.append((key[0], row.call_id, row.ts, ok))
        state.update((json.dumps(recent),))
        yield pd.DataFrame(out, columns=["key", "call_id", "ts", "allowed"])

    return calls.groupBy("key").applyInPandasWithState(
        run,
        "key string, call_id long, ts timestamp, allowed boolean",
        "recent string",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def maintain(changes: DataFrame, apply, checkpoint: str):
    """Run ``apply(batch, number)`` on each batch of document changes; batches
    carry their number, so a repeated one can be recognised."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def keep(engine, changes: DataFrame, checkpoint: str, name: str = "changes"):
    """Keep a store's documents and index in step with a stream of changes (slug,
    title, body; a null body deletes): new slugs are ingested by their title,
    known ones replaced.  The store's manifest holds the number of the last batch
    that was applied, so a batch that comes again changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        key = f"stream:{name}"
        if engine.tables.now.values.get(key, -1) >= number:
            return
        # of several changes to one slug within a batch any may be the last
        last = materialise(
            batch.groupBy("slug").agg(F.max_by(
                F.struct("title", "body"),
                F.struct(F.col("body").isNotNull(), "body"),
            ).alias("c")).select("slug", "c.title", "c.body"),
            "batch",
        )
        known = last.limit(0).select("slug") if not engine.tables.has("documents") else engine.table("documents").select("slug").join(last.select("slug"), "slug", "left_semi")
        known = materialise(known, "known")
        fresh = last.where("body IS NOT NULL").join(known, "slug", "left_anti")
        if not fresh.isEmpty():
            engine.ingest_rows(fresh.select(F.col("slug").alias("ord"), F.coalesce("title", "slug").alias("title"), F.col("body").alias("text")))
        changed = last.where("body IS NOT NULL").join(known, "slug", "left_semi")
        if not changed.isEmpty():
            engine.update(changed.select("slug", "body"))
        gone = last.where("body IS NULL").join(known, "slug", "left_semi").select("slug")
        engine.tables.commit(gone=materialise(gone, "gone"), values={key: number})

    return maintain(changes, apply, checkpoint)
