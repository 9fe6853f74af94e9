"""Keywords, categories, concepts and synopsis of documents (slug, title, text).

All of it is local to a document, so it is computed in the row, without a
shuffle, and in Arrow batches, where array functions are slow.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from ..functions import text as T
from ..functions.lexicon import COMMON_WORDS, STOP_WORDS, TAXONOMY
from ..functions.text import let
from ..functions.units import Units, listed

# Patterns and weights of the kinds of evidence for a concept.
CAPITALISED = r"\b([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){0,2})\b"
EMPHASISED = r"\*\*{0,2}([^*\n]+)\*{1,3}|__{0,2}([^_\n]+)_{1,3}"  # each begins with a letter of its own, which is fast
SHORT_HEADING, LONG_HEADING, EMPHASIS, PAIR, TITLE = 3.0, 2.5, 2.0, 1.5, 5.0
#: Factors of a keyword that is in the title, the first paragraph, a heading.
BOOSTS = (3.0, 2.0, 2.0)


def runs(ordered: Column, same: Callable[[Column, Column], Column], make: Callable[[Column, Column, Column], Column]) -> Column:
    """``make(array, first, end)`` of each run of like elements of a sorted array."""

    def of(a: Column) -> Column:
        places = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
        first = F.filter(places, lambda i: (i == 0) | ~same(F.get(a, i), F.get(a, i - 1)))
        end = lambda s, k: F.coalesce(F.get(s, k + 1), F.size(a))
        return let(first, lambda s: F.transform(s, lambda lo, k: let(end(s, k), lambda hi: make(a, lo, hi))))

    return let(ordered, of)


def counted(values: Column) -> Column:
    """Distinct strings of an array, sorted, with their numbers: value, n."""
    return runs(F.sort_array(values), lambda x, y: x == y, lambda a, lo, hi: F.struct(F.get(a, lo).alias("value"), (hi - lo).alias("n")))


def frequencies(text: Column, stop=STOP_WORDS) -> Column:
    """token, n, first, tf of a text's distinct tokens: raw and augmented
    frequency, first place."""
    placed = F.transform(T.tokenize(F.coalesce(text, F.lit("")), stop), lambda x, i: F.struct(x.alias("token"), i.alias("pos")))
    found = runs(
        F.sort_array(placed),
        lambda x, y: x["token"] == y["token"],
        lambda a, lo, hi: F.struct(F.get(a, lo)["token"].alias("token"), (hi - lo).cast("long").alias("n"), F.get(a, lo)["pos"].alias("first")),
    )

    def with_tf(rows: Column) -> Column:
        return let(
            F.array_max(F.transform(rows, lambda r: r["n"])),
            lambda most: F.transform(
                rows,
                lambda r: F.struct(r["token"].alias("token"), r["n"].alias("n"), r["first"].alias("first"), (0.5 + 0.5 * r["n"] / most).alias("tf")),
            ),
        )

    return let(found, with_tf)


def term_frequencies(docs: DataFrame, stop=STOP_WORDS) -> DataFrame:
    """(slug, token, n, first, tf)."""
    return docs.select("slug", F.explode(frequencies(F.col("text"), stop)).alias("r")).select("slug", "r.token", "r.n", "r.first", "r.tf")


#: Tokens of two or more characters.
_WORD = re.compile(T.TOKEN.split("|")[0])
#: White space of ASCII, as the first paragraph and headings see it.
_GAP = re.compile(r"\n[ \t\n\x0b\f\r]*\n")
_HEADING = re.compile(r"^#{1,6}[ \t\n\x0b\f\r]+(.+)$", re.MULTILINE)
SCORED = ArrayType(StructType().add("token", StringType()).add("score", DoubleType()))


def tokens_of(t: str, stop: frozenset) -> list[str]:
    """As ``T.tokenize``."""
    return [w for w in _WORD.findall(t.lower()) if w not in stop and len(w) <= 30]


def best_tokens(
    title: str,
    text: str,
    k: int,
    stop: frozenset,
    common: frozenset,
    known: Counter | None = None,
) -> list[tuple[str, float]]:
    """The ``k`` best of a text's tokens, first ones first among equals: TF x
    static IDF with boosts for the title, the first paragraph and headings.
    ``known`` counts the text's tokens, where they have been taken before."""
    tokens = lambda t: tokens_of(t, stop)
    counts = Counter(tokens(text)) if known is None else known  # in the order of first places
    if not counts:
        return []
    most = max(counts.values())
    parts = _GAP.split(text, 1) if "\n" in text else [text]
    where = [{*tokens(title)}, counts if len(parts) == 1 else {*tokens(parts[0])}, {*tokens("\n".join(_HEADING.findall(text)))} if "#" in text else ()]
    in_title, in_first, in_heading = where
    scores: dict[tuple, float] = {}  # many tokens have the same

    def score(w: str, n: int) -> float:
        key = (n, w in common, len(w) <= 3, w in in_title, w in in_first, w in in_heading)
        if key not in scores:
            idf = T.IDF_COMMON if key[1] else T.IDF_SHORT if key[2] else T.IDF_OTHER
            boost = math.prod((f for f, held in zip(BOOSTS, key[3:], strict=True) if held), start=1.0)
            scores[key] = -math.floor((0.5 + 0.5 * n / most) * idf * boost * 1e6 + 0.5) / 1e6  # half up, as SQL rounds
        return scores[key]

    # those that only some boosts are given to, and of the others, by number, no more than can be among the best
    boosted = {*in_title, *in_heading, *(in_first if len(parts) > 1 else ())}.intersection(counts)
    places = {w: i for i, w in enumerate(counts)}
    rows = [(score(w, counts[w]), places[w], w) for w in boosted]
    left = k if most < 1 << 20 else len(counts) + 1  # beyond, other numbers may round to equal scores
    for w, n in counts.most_common():
        if left <= 0:
            break
        if w not in boosted:
            rows.append((score(w, n), places[w], w))
            left -= w not in common and len(w) > 3
    rows.sort()
    return [(w, -minus) for minus, _, w in rows[:k]]


def keyword_array(title: Column, text: Column, k: int = 10, stop=STOP_WORDS, common=COMMON_WORDS) -> Column:
    """token, score of a text's best tokens, in Arrow batches: the same as array
    functions took 13 seconds for 10,000 documents (25 MB) on 8 cores."""
    stop, common = frozenset(stop), frozenset(common)

    @F.pandas_udf(SCORED)
    def best(titles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([best_tokens(a or "", b or "", k, stop, common) for a, b in zip(titles, texts, strict=True)])

    return best(F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))


def _listed(docs: DataFrame, rows: Column, *names: str) -> DataFrame:
    """(slug, names, rank) of an array of structs."""
    out = docs.select("slug", F.posexplode(rows).alias("i", "r"))
    return out.select("slug", *[F.col(f"r.{n}") for n in names], (F.col("i") + 1).alias("rank"))


def keywords(docs: DataFrame, k: int = 10, stop=STOP_WORDS, common=COMMON_WORDS) -> DataFrame:
    """(slug, token, score, rank)."""
    return _listed(docs, keyword_array(F.col("title"), F.col("text"), k, stop, common), "token", "score")


CATEGORISED = ArrayType(StructType().add("category", StringType()).add("score", DoubleType()))


def near_taxonomy(table: dict[str, tuple[str, ...]]) -> Callable[[str], bool]:
    """Whether a token contains, or is contained in, any word of a taxonomy."""
    words = [w for ws in table.values() for w in ws]
    size = min([3, *map(len, words)])
    text, starts = "\n".join(words), {w[:size] for w in words}

    def near(t: str) -> bool:
        return t in text or any(t[i : i + size] in starts for i in range(len(t) - size + 1)) and any(w in t for w in words)

    return near


def best_categories(tokens: list[str], table: dict[str, tuple[str, ...]], near: Callable[[str], bool], k: int) -> list[tuple[str, float]]:
    """The ``k`` best categories of a document's keywords: 1 for an exact taxonomy
    word, 0.5 for one that contains or is contained; scores of 1 or more."""
    tokens = [t for t in tokens if near(t)]
    if not tokens:
        return []
    scores = ((sum(1.0 if t == w else 0.5 for w in ws for t in tokens if t in w or w in t), c) for c, ws in table.items())
    return [(c, -minus) for minus, c in sorted((-score, c) for score, c in scores if score >= 1)[:k]]


def category_array(tokens: Column, taxonomy=None, k: int = 5) -> Column:
    """category, score by a document's keywords."""
    table = dict(taxonomy or TAXONOMY)

    @F.pandas_udf(CATEGORISED)
    def best(lists: pd.Series) -> pd.Series:
        near = near_taxonomy(table)
        return pd.Series([best_categories([] if x is None else [*x], table, near, k) for x in lists], dtype=object)

    return best(tokens)


def categories(docs: DataFrame, taxonomy=None, k: int = 5) -> DataFrame:
    """(slug, category, score, rank)."""
    tokens = F.transform(keyword_array(F.col("title"), F.col("text")), lambda r: r["token"])
    return _listed(docs, category_array(tokens, taxonomy, k), "category", "score")


def merged_categories(known: Column, found: Column, k: int = 5) -> Column:
    """Categories that a document has already, then those found, without repeats."""
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(F.coalesce(known, none), F.coalesce(found, none))), 1, k)


#: White space of Unicode (Python's own has four separators more).
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Patterns, what they become, and characters of which each match has one.
_MARKDOWN = [
    (re.compile(pattern, re.ASCII | re.MULTILINE), new, signs)
    for pattern, new, signs in (
        (r"\[([^\]]*)\]\([^)]*\)", r"\1", "["),
        (r"^#{1,6}\s+", "", "#"),
        (r"\*{1,3}|_{1,3}", "", "*_"),
        (r"`{1,3}", "", "`"),
        (r"^\s*[-*+]\s", "", "-*+"),
        (r"^\s*\d+\.\s", "", "0123456789"),
    )
]


def words_of(t: str, most: int | None = None) -> list[str]:
    """As ``T.words``, or the first ``most`` of them."""
    if any(c in t for c in _SEPARATORS):
        return [w for w in _SPACE.split(t) if w][:most]
    return t.split() if most is None else t.split(None, most)[:most]


def _truncated(t: str, most: int) -> str:
    """As ``T.truncate``."""
    if len(t) <= most:
        return t
    last = t.rfind(" ", 0, most)
    return t[: last if last > most // 2 else most].rstrip(" .,;:!?") + "..."


def _sentences(t: str) -> list[str]:
    """Cut at spaces between a mark that ends a sentence and a capital letter."""
    cuts = []
    for gap in (". ", "! ", "? "):
        i = t.find(gap)
        while i >= 0:
            if "A" <= t[i + 2 : i + 3] <= "Z":
                cuts.append(i + 1)
            i = t.find(gap, i + 2)
    cuts.sort()
    return [t[a + 1 : z] for a, z in zip([-1, *cuts], [*cuts, len(t)], strict=True)]


def best_sentence(title: str, text: str, most: int, stop: frozenset, own: set[str] | None = None) -> str:
    """The best sentence of the first 500 words, first of equals; a text of under
    50 words is its own synopsis.  ``own`` are the title's tokens, if known."""
    for pattern, new, signs in _MARKDOWN:
        for x in signs:
            if x in text:
                text = pattern.sub(new, text)
                break
    ws = words_of(text, 500)
    best, top = None, -1.0
    if len(ws) >= 50:
        own = {*tokens_of(title, stop)} if own is None else own
        for i, s in enumerate(_sentences(" ".join(ws))):
            n = len(s)
            size = 1.0 if 50 <= n <= 150 else n / 50.0 if n < 50 else max(0.3, 1.0 - (n - 150) / 300.0)
            place = 1.5 if i == 0 else 1.2 if i <= 2 else 1.0
            if size * place * (1.0 + len(own) * 2.0) <= top:
                continue
            low = s.lower()
            most_shared = len([w for w in own if w in low])
            if size * place * (1.0 + most_shared * 2.0) <= top:
                continue  # not even if all of these are tokens
            shared = len(own.intersection(tokens_of(s, stop))) if most_shared else 0
            score = size * place * (1.0 + shared * 2.0)
            if score > top:
                best, top = s, score
    return _truncated(" ".join(ws) if best is None else best, most)


def synopsis(text: Column, title: Column, most: int = 200, stop=STOP_WORDS) -> Column:
    """The best sentence of each text."""
    stop = frozenset(stop)

    @F.pandas_udf(StringType())
    def best(titles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([best_sentence(a or "", b or "", most, stop) for a, b in zip(titles, texts, strict=True)], dtype=object)

    return best(F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))


def bigram_array(text: Column, stop=STOP_WORDS) -> Column:
    """value, n of a text's pairs of adjacent tokens."""

    def pairs(t: Column) -> Column:
        most = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(F.slice(t, F.lit(1), most), F.slice(t, F.lit(2), most), lambda a, b: F.concat_ws(" ", a, b))

    return counted(let(T.tokenize(F.coalesce(text, F.lit("")), stop), pairs))


def bigrams(docs: DataFrame, stop=STOP_WORDS) -> DataFrame:
    """(slug, bigram, n) of adjacent tokens."""
    return docs.select("slug", F.explode(bigram_array(F.col("text"), stop)).alias("r")).select(
        "slug",
        F.col("r.value").alias("bigram"),
        F.col("r.n").cast("long").alias("n"),
    )


#: A combining mark belongs to the word of the letter before it.
_CAPITALISED = re.compile(CAPITALISED.replace(r"\b([A-Z]", r"([A-Z](?<![\w\u0300-\u036f][A-Z])", 1).replace(r"\b", r"(?![\w\u0300-\u036f])"))
_EMPHASISED = re.compile(EMPHASISED)
_MARKS = re.compile(r"^[*_]{1,3}|[*_]{1,3}$")
_NO_NAME = re.compile(r"[^a-zA-Z0-9 \-]")
_BLANK = re.compile(r"\s", re.ASCII)
_NUMBER = re.compile("[0-9]+")


def best_concepts(title: str, text: str, k: int, stop: frozenset, pairs: list[tuple[str, int]] | None = None) -> list[tuple[str, float]]:
    """The ``k`` best concepts: capitalised runs, headings, emphasised phrases,
    frequent bigrams and short titles, with additive scores.  ``pairs`` are the
    bigrams of two or more, where they have been counted before."""
    scores: dict[str, float] = {}

    def said(concept: str, w: float) -> None:
        scores[concept] = scores.get(concept, 0.0) + w

    for run, n in Counter(_CAPITALISED.findall(text)).items():
        if _BLANK.search(run) or n >= 2 and len(run) > 3 and run.lower() not in stop:
            said(run, n)
    for heading in _HEADING.findall(text) if "#" in text else ():
        h = _NO_NAME.sub("", heading).strip(" ")
        ws = h.split()
        if 0 < len(ws) <= 3:
            said(h, SHORT_HEADING)
        for n in (3, 2) if len(ws) > 3 else ():
            for i in range(len(ws) - n + 1):
                said(" ".join(ws[i : i + n]), LONG_HEADING)
    for m in _EMPHASISED.finditer(text) if "*" in text or "_" in text else ():
        phrase = _MARKS.sub("", m[0])
        ws = words_of(phrase)
        if 1 <= len(ws) <= 3:
            start = phrase.index(ws[0])
            phrase = phrase[start : phrase.rindex(ws[-1]) + len(ws[-1])]
            if len(phrase) <= 50:
                said(phrase, EMPHASIS)
    if pairs is None:
        tokens = tokens_of(text, stop)
        pairs = [(f"{a} {b}", n) for (a, b), n in Counter(zip(tokens, tokens[1:], strict=False)).items() if n >= 2]
    for pair, n in pairs:
        said(pair, n * PAIR)
    name = _NO_NAME.sub("", title).strip(" ")
    if 1 <= len(name.split()) <= 3:
        said(name, TITLE)
    kept = [(-w, c) for c, w in scores.items() if len(c) > 1 and (c[0] > "9" or not _NUMBER.fullmatch(c.replace(" ", "").replace("-", ""))) and c.lower() not in stop]
    kept.sort()
    return [(c, -minus) for minus, c in kept[:k]]


CONCEPTS = ArrayType(StructType().add("concept", StringType()).add("score", DoubleType()))


def concept_array(title: Column, text: Column, k: int = 10, stop=STOP_WORDS) -> Column:
    """concept, score of each text."""
    stop = frozenset(stop)

    @F.pandas_udf(CONCEPTS)
    def best(titles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([best_concepts(a or "", b or "", k, stop) for a, b in zip(titles, texts, strict=True)], dtype=object)

    return best(F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))


DESCRIPTION = StructType().add("fingerprint", ArrayType(StringType())).add("found", ArrayType(StringType())).add("concepts", ArrayType(StringType())).add("summary", StringType())


def describe(
    titles: list[str],
    texts: list[str],
    units: Units | None,
    table: dict[str, tuple[str, ...]],
    summaries: bool = True,
    stop: frozenset = frozenset(STOP_WORDS),
    common: frozenset = frozenset(COMMON_WORDS),
) -> tuple[list, list, list, list]:
    """fingerprints, categories found, concepts and summaries of texts and their
    units: what ``best_tokens`` and the others give, for many texts at once."""
    if units is None:
        return [], [], [], []
    kept = (units.size >= 2) & (units.size <= 30) & ~pc.is_in(units.names, value_set=pa.array(sorted(stop), pa.string())).to_numpy(zero_copy_only=False)

    def split(x: str) -> list[str]:
        if not x.isascii():
            return [w for w in _WORD.findall(x) if w not in stop and len(w) <= 30]
        w = x.lstrip("0123456789-").rstrip("-")
        return [w] if 2 <= len(w) <= 30 and w not in stop else []

    names, no, row, at = units.tokens(split, kept)
    own = [{*tokens_of(t, stop)} for t in titles]
    fingerprints = _best_of_each(texts, own, units, names, no, row, at, stop, common)
    pairs = _pairs_of_each(len(texts), names, no, row)
    near = _near_all({w for ws in fingerprints for w in ws}, table)
    found = [[c for c, _ in best_categories(ws, table, near, 5)] for ws in fingerprints]
    concepts = []
    for title, text, ws, two in zip(titles, texts, fingerprints, pairs, strict=True):
        best = [c for c, _ in best_concepts(title, text, 10, stop, pairs=two)]
        if len(best) < 3:
            lower = {c.lower() for c in best}
            best = (best + [w for w in ws if w not in lower])[:3]
        concepts.append(best)
    return fingerprints, found, concepts, [best_sentence(a, b, 200, stop, o) if summaries else None for a, b, o in zip(titles, texts, own, strict=True)]


def _best_of_each(texts, own, units, names, no, row, at, stop, common, k: int = 10) -> list[list[str]]:
    """``best_tokens`` of each text, by its tokens (numbers of names, rows, places)."""
    wide, bits = len(names), max(1, len(no).bit_length())
    if not len(no):
        return [[] for _ in texts]
    keys = np.sort(((row * wide + no) << bits) | np.arange(len(no)))
    key, place = keys >> bits, keys & ((1 << bits) - 1)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n, key, place = np.diff(np.append(first, len(key))), key[first], place[first]
    r, of = key // wide, key % wide
    starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    most = np.repeat(np.maximum.reduceat(n, starts), np.diff(np.append(starts, len(r))))
    gaps = np.full(len(texts), np.iinfo(np.int64).max)
    for i, t in enumerate(texts):
        if "\n" in t and (m := _GAP.search(t)):
            gaps[i] = units.offsets[i] + (m.start() if t.isascii() else len(t[: m.start()].lower().encode()))

    def among(sets: list) -> np.ndarray:
        """Whether a text's token is in its set."""
        flat = pa.array([w for ws in sets for w in ws], pa.string())
        known = pc.index_in(flat, value_set=names)
        wanted = np.repeat(np.arange(len(sets)), [*map(len, sets)])[known.is_valid().to_numpy(zero_copy_only=False)] * wide + known.drop_null().to_numpy()
        out, i = np.zeros(len(key), bool), np.searchsorted(key, wanted)
        i, wanted = i[i < len(key)], wanted[i < len(key)]
        out[i[key[i] == wanted]] = True
        return out

    usual = pc.is_in(names, value_set=pa.array(sorted(common), pa.string())).to_numpy(zero_copy_only=False)
    short = pc.utf8_length(names).to_numpy() <= 3
    idf = np.where(usual, T.IDF_COMMON, np.where(short, T.IDF_SHORT, T.IDF_OTHER))[of]
    headings = [{*tokens_of("\n".join(_HEADING.findall(t)), stop)} if "#" in t else () for t in texts]
    held = (among(own), at[place] < gaps[r], among(headings))
    boost = math.prod((np.where(h, f, 1.0) for f, h in zip(BOOSTS, held, strict=True)), start=1.0)
    score = np.floor((0.5 + 0.5 * n / most) * idf * boost * 1e6 + 0.5).astype(np.int64)  # half up, as SQL rounds
    order = np.lexsort((place, -score, r)) if len(texts).bit_length() + 26 + bits > 62 else np.argsort((r << (26 + bits)) | (((1 << 26) - 1 - score) << bits) | place)
    r = r[order]
    best = order[np.arange(len(r)) - np.searchsorted(r, r) < k]
    words = listed(names.take(pa.array(of[best])))
    ends = np.searchsorted(key[best] // wide, np.arange(len(texts) + 1)).tolist()
    return [words[a:z] for a, z in zip(ends, ends[1:], strict=False)]


def _pairs_of_each(size: int, names, no, row) -> list[list[tuple[str, int]]]:
    """Pairs of adjacent tokens that a text has more than once."""
    wide = len(names)
    same = np.flatnonzero(row[1:] == row[:-1])
    out: list[list[tuple[str, int]]] = [[] for _ in range(size)]
    if not len(same):
        return out
    two = np.sort(no[same] * wide + no[same + 1]) if size == 1 else np.sort((row[same] * wide + no[same]) * wide + no[same + 1])
    first = np.flatnonzero(np.concatenate([[True], two[1:] != two[:-1]]))
    n = np.diff(np.append(first, len(two)))
    two, n = two[first[n > 1]], n[n > 1]
    a, b = (listed(names.take(pa.array(x))) for x in (two // wide % wide, two % wide))
    for i, x, y, c in zip((two // wide // wide).tolist(), a, b, n.tolist(), strict=True):
        out[i].append((f"{x} {y}", c))
    return out


def _near_all(tokens: set[str], table: dict[str, tuple[str, ...]]) -> Callable[[str], bool]:
    """``near_taxonomy`` of these tokens."""
    words = [w for ws in table.values() for w in ws]
    text, flat = "\n".join(words), pa.array(sorted(tokens), pa.string())
    holds = pc.match_substring_regex(flat, "|".join(map(re.escape, words))).to_pylist() if words else [False] * len(flat)
    return {t for t, some in zip(flat.to_pylist(), holds, strict=True) if some or t in text}.__contains__


def description(title: Column, text: Column, taxonomy=None, summaries: bool = True, stop=STOP_WORDS, common=COMMON_WORDS) -> Column:
    """fingerprint, categories found, concepts and summary of each text, whose
    tokens are taken once; three concepts at least, if there are keywords to make
    them up."""
    stop, common, table = frozenset(stop), frozenset(common), dict(taxonomy or TAXONOMY)

    @F.arrow_udf(DESCRIPTION)
    def of(titles: pa.Array, texts: pa.Array) -> pa.Array:
        parts = []
        for lo in range(0, max(1, len(texts)), 512):  # few texts at a time are Python's own
            a, b = ([t or "" for t in x.slice(lo, 512).to_pylist()] for x in (titles, texts))
            columns = describe(a, b, Units(b) if b else None, table, summaries, stop, common)
            parts.append(pa.StructArray.from_arrays([pa.array(x, to_arrow_type(f.dataType)) for x, f in zip(columns, DESCRIPTION, strict=True)], DESCRIPTION.names))
        return pa.concat_arrays(parts)

    return of(F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))


def concepts(docs: DataFrame, k: int = 10, stop=STOP_WORDS) -> DataFrame:
    """(slug, concept, score, rank)."""
    return _listed(docs, concept_array(F.col("title"), F.col("text"), k, stop), "concept", "score")
