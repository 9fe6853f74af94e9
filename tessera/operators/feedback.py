"""Feedback: query log statistics, implicit signals, weight tuning.

``log`` has query_id, session, question, ts, tier_max, result_sources,
feedback_score, signal_type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import number_within
from ..functions import scoring as S
from ..functions import text as T
from .rank import WEIGHTS

#: (score, seconds) of the implicit signals and bounds of overlap (fixed values).
REPEAT, REFINEMENT, TOPIC_SWITCH = (0.3, 60), (0.5, 300), (0.8, 30)
MEMORY = 20


def statistics(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("feedback_score").alias("with_feedback"),
        F.round(F.avg("feedback_score"), 6).alias("avg_score"),
    )


def win_rates(log: DataFrame, least: float = 0.7) -> DataFrame:
    """(source, wins, rate) of the first source of well-scored queries."""
    won = log.where(F.col("feedback_score") >= least).select(F.get("result_sources", F.lit(0)).alias("source")).where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("wins"))
    total = won.agg(F.sum("wins").alias("n"))
    return won.crossJoin(F.broadcast(total)).select("source", "wins", F.round(F.col("wins") / F.col("n"), 6).alias("rate"))  # one row


def tier_distribution(log: DataFrame) -> DataFrame:
    return log.groupBy("tier_max").agg(F.count(F.lit(1)).alias("n"))


def signals(log: DataFrame, scale: int = 1, memory: int = MEMORY) -> DataFrame:
    """(query_id, by_query_id, score, signal_type, feedback_at): what each query
    says about one of the ``memory`` queries before it in its session.

    Each query meets its predecessors by number, an equi-join per distance, so a
    session with very many queries costs 20 rows a query and no more."""
    rows = log.select(
        "session",
        "query_id",
        "ts",
        T.query_hash(F.col("question")).alias("h"),
        F.array_distinct(T.tokenize_query(F.col("question"))).alias("kw"),
    )
    rows = number_within(rows, "session", ["ts", "query_id"], "n")
    prev = rows.select(
        "session",
        F.col("query_id").alias("p_id"),
        F.col("ts").alias("p_ts"),
        F.col("h").alias("p_h"),
        F.col("kw").alias("p_kw"),
        F.col("n").alias("p_n"),
    )
    wide = rows.withColumn("p_n", F.explode(F.sequence(F.col("n") - 1, F.col("n") - memory, F.lit(-1)))).where("p_n >= 1")
    both = wide.join(prev, ["session", "p_n"])
    gap = F.col("ts").cast("timestamp").cast("double") - F.col("p_ts").cast("timestamp").cast("double")
    overlap = S.jaccard(F.col("kw"), F.col("p_kw"))
    words = (F.size("kw") > 0) & (F.size("p_kw") > 0)
    kind = (
        F.when((F.col("h") == F.col("p_h")) & (gap <= REPEAT[1] * scale), "repeat_query")
        .when(words & (gap <= REFINEMENT[1] * scale) & (overlap > 0.6), "refinement")
        .when(words & (gap <= TOPIC_SWITCH[1] * scale) & (overlap < 0.2), "topic_switch")
    )
    found = both.withColumn("signal_type", kind).where("signal_type IS NOT NULL")
    latest = found.groupBy("session", "query_id", "ts").agg(F.max_by(F.struct("p_id", "signal_type"), "p_n").alias("s"))
    score = F.when(F.col("s.signal_type") == "repeat_query", REPEAT[0]).when(F.col("s.signal_type") == "refinement", REFINEMENT[0]).otherwise(TOPIC_SWITCH[0])
    return latest.select(
        F.col("s.p_id").alias("query_id"),
        F.col("query_id").alias("by_query_id"),
        score.alias("score"),
        F.col("s.signal_type").alias("signal_type"),
        F.col("ts").alias("feedback_at"),
    )


def apply_signals(log: DataFrame, found: DataFrame) -> DataFrame:
    """The latest signal on a query overwrites its score."""
    last = found.groupBy("query_id").agg(F.max_by(
        F.struct("score", "signal_type", "feedback_at"),
        F.struct("feedback_at", "by_query_id"),
    ).alias("_s"))
    return log.join(last, "query_id", "left").withColumn("feedback_score", F.coalesce("_s.score", "feedback_score")).withColumn("signal_type", F.coalesce("_s.signal_type", "signal_type")).drop("_s")


def flagged(tier_events: DataFrame, least: int = 5, rate: float = 0.5, totals: DataFrame | None = None) -> DataFrame:
    """Documents often answered only by their full text: (slug, tier3, total,
    rate).  ``tier_events`` has slug and tier; only tier-3 events count as total
    unless ``totals`` (slug, total) is given."""
    hits = tier_events.where("tier = 3").groupBy("slug").agg(F.count(F.lit(1)).alias("tier3"))
    both = hits.withColumn("total", F.col("tier3")) if totals is None else hits.join(totals, "slug")
    return both.withColumn("rate", F.round(F.col("tier3") / F.col("total"), 6)).where((F.col("rate") > rate) & (F.col("total") >= least))


def tune(rates: DataFrame, previous: dict[str, float] | None = None, base: dict[str, float] | None = None, enough=None) -> DataFrame:
    """(source, weight): base weights moved by how far a source's win rate is
    from the mean, clamped to [0.1, 3], and smoothed with the previous ones."""
    base, previous = base or WEIGHTS, previous or base or WEIGHTS
    clamp = lambda c: F.least(F.lit(3.0), F.greatest(F.lit(0.1), c))
    rows = ", ".join(f"('{s}', {float(w)}D, {float(previous.get(s, w))}D)" for s, w in base.items())
    start = rates.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(source, base, prev)")
    mean = rates.agg(F.avg("rate").alias("mean"))
    both = start.join(rates.select("source", "rate"), "source", "left").crossJoin(F.broadcast(mean)).where("mean IS NOT NULL")  # one row
    moved = clamp(F.col("base") * (1 + 0.5 * (F.coalesce("rate", "mean") - F.col("mean"))))
    return both.select("source", F.round(clamp(0.7 * moved + 0.3 * F.col("prev")), 6).alias("weight"))


def tuning_gate(log: DataFrame, least: int = 50, score: float = 0.7) -> DataFrame:
    return log.agg(
        F.count_if(F.col("feedback_score") >= score).alias("data_points"),
        (F.count_if(F.col("feedback_score") >= score) >= least).alias("enough"),
    )


def rate_limit(calls: DataFrame, most: int = 100, seconds: int = 60) -> DataFrame:
    """Calls (key, ts) with the number in the trailing window and whether it is
    within ``most``; an upper bound, as refused calls count too (the exact form,
    in which they don't, is ``streaming.rate_limiter``).

    A window reaches into the stretch of ``seconds`` before its own and no
    further, so calls go to their own stretch and, to be counted, to the next: a
    key's calls are spread over as many groups as stretches."""
    length = seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = calls.withColumn("_at", at).withColumn("_own", F.floor(F.col("_at") / length))
    both = rows.withColumn("_stretch", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy("key", "_stretch").orderBy("_at").rangeBetween(-length, 0)
    counted = both.withColumn("recent", F.count(F.lit(1)).over(w)).where("_stretch = _own")
    return counted.withColumn("allowed", F.col("recent") <= most).drop("_at", "_own", "_stretch")
