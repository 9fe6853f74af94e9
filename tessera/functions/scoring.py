"""Scores between sets and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))), F.lit(0.0))


def partial_match(keywords: Column, target: Column) -> Column:
    """Share of keywords that contain, or are contained in, an entry of target."""
    hits = F.size(F.filter(keywords, lambda k: F.exists(target, lambda t: t.contains(k) | k.contains(t))))
    return F.when((F.size(keywords) > 0) & (F.size(target) > 0), hits / F.size(keywords)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def combined(tier0: Column, tier1: Column, tier2: Column) -> Column:
    return tier0 * 1.0 + tier1 * 0.8 + tier2 * 0.6


def bm25_idf(n: Column, df: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, 1e-6).otherwise(idf)


def bm25_weight(idf, tf, dl, avgdl, k1: float = 1.2, b: float = 0.75):
    """Of columns or of arrays."""
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25_term(tf: Column, dl: Column, avgdl: Column, n: Column, df: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return bm25_weight(bm25_idf(n, df), tf, dl, avgdl, k1, b)


def entry_score(keywords: Column, fingerprint: Column, categories: Column, title: Column, synopsis: Column) -> Column:
    """The richer tier-0 score: exact or 0.7 x partial overlap per field."""
    best = lambda target: F.greatest(jaccard(keywords, target), 0.7 * partial_match(keywords, target))
    return 3.0 * best(fingerprint) + 3.0 * best(title) + 2.0 * best(categories) + 1.5 * jaccard(keywords, synopsis)
