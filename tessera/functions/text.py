"""Text functions as Column builders.

White space and word characters follow Unicode (``(?U)``); ``^`` and ``$`` in
multi-line patterns break at line feeds only (``(?d)``).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import COMMON_WORDS, STOP_WORDS

SPACE = r"(?U)\s+"
TOKEN = r"[a-z][a-z0-9\-]*[a-z0-9]|[a-z]"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z])"
#: Phrases that ask for metadata rather than content (fixed values).
STRUCTURED = (
    r"\bwhich files?\b",
    r"\bhow many\b",
    r"\blist all\b",
    r"\bwhat categor",
    r"\bwhat type",
    r"\bcount\b",
    r"\bshow all\b",
    r"\bwhat are the\b",
)

#: Latin letters with marks, and the letters below the marks.
_MARKED = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def words(t: Column) -> Column:
    return F.filter(F.split(t, SPACE), lambda x: x != "")


def word_count(t: Column) -> Column:
    return F.size(words(t))


def strip(t: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def tokenize_query(q: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case ASCII words of two or more letters or digits, in order and with
    repeats, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(q), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: (F.length(x) > 1) & ~x.isin(*stop))


def tokenize(t: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Document tokens: start with a letter, may hold hyphens, 2 to 30 long."""
    return F.filter(F.regexp_extract_all(F.lower(t), F.lit(TOKEN), F.lit(0)), lambda x: F.length(x).between(2, 30) & ~x.isin(*stop))


def sanitize(q: Column) -> Column:
    """Terms of a full-text question: any word of two or more characters."""
    return F.filter(F.split(F.regexp_replace(q, r"(?U)[^\w\s]", " "), SPACE), lambda x: F.length(x) > 1)


def fold(t: Column) -> Column:
    """Lower case, Latin letters without their marks."""
    return F.translate(F.lower(t), "".join(m for m, _ in _MARKED), "".join(b for _, b in _MARKED))


def full_text_tokens(t: Column) -> Column:
    return F.regexp_extract_all(fold(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def clean(t: Column) -> Column:
    """No NUL, line feeds only, at most one blank line in a row, no white space
    at the end of lines or around the text."""
    out = F.regexp_replace(F.translate(t, "\0", ""), "\r\n?", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.array_join(F.transform(F.split(out, "\n"), lambda line: F.regexp_replace(line, r"(?U)\s+$", "")), "\n")
    return strip(out)


def strip_markdown(t: Column) -> Column:
    out = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?dm)^#{1,6}\s+", "")
    out = F.regexp_replace(out, r"\*{1,3}|_{1,3}", "")
    out = F.regexp_replace(out, r"`{1,3}", "")
    out = F.regexp_replace(out, r"(?dm)^\s*[-*+]\s", "")
    return F.regexp_replace(out, r"(?dm)^\s*\d+\.\s", "")


def sentences(t: Column) -> Column:
    flat = strip(F.regexp_replace(t, SPACE, " "))
    return F.filter(F.split(flat, SENTENCE_GAP), lambda x: x != "")


def truncate(t: Column, most: int) -> Column:
    """At most ``most`` characters, cut at a space of the second half, and dots."""
    head = F.substring(t, 1, most)
    last = F.lit(most) - F.locate(" ", F.reverse(head))  # 0-based place of the last space
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (last > most // 2), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(cut, r"[ .,;:!?]+$", ""), F.lit("...")))


def sentence_score(s: Column, position: Column, title_tokens: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    n = F.length(s)
    size = F.when(n.between(50, 150), 1.0).when(n < 50, n / 50.0).otherwise(F.greatest(F.lit(0.3), 1.0 - (n - 150) / 300.0))
    place = F.when(position == 0, 1.5).when(position <= 2, 1.2).otherwise(1.0)
    overlap = F.size(F.array_intersect(tokenize(s, stop), title_tokens))
    return size * place * (1.0 + overlap * 2.0)


#: Static IDF of common words, short tokens and all others (fixed values).
IDF_COMMON, IDF_SHORT, IDF_OTHER = 1.0, 2.45, 3.5


def static_idf(token: Column, stop: tuple[str, ...] = STOP_WORDS, common: tuple[str, ...] = COMMON_WORDS) -> Column:
    """0 for stop words (none, where they have been left out before), 1 for common
    ones, more for others."""
    known = F.when(token.isin(*common), IDF_COMMON).when(F.length(token) <= 3, IDF_SHORT).otherwise(IDF_OTHER)
    return F.when(token.isin(*stop), 0.0).otherwise(known) if stop else known


def _cut_at_hyphen(slug: Column, most: int) -> Column:
    head = F.substring(slug, 1, most)
    tail = F.locate("-", F.reverse(head))
    return F.when(F.length(slug) <= most, slug).otherwise(F.when(
        (tail > 0) & (F.lit(most) - tail > 0),
        F.substring(head, F.lit(1), F.lit(most) - tail),
    ).otherwise(head))


def slug(title: Column) -> Column:
    out = F.regexp_replace(strip(F.lower(title)), r"(?U)[\s_]+", "-")
    out = F.regexp_replace(out, "[^a-z0-9-]", "")
    out = F.regexp_replace(F.regexp_replace(out, "-{2,}", "-"), "^-+|-+$", "")
    out = _cut_at_hyphen(out, 60)
    return F.when(out == "", "untitled").otherwise(out)


def heading_slug(heading: Column) -> Column:
    out = F.regexp_replace(F.lower(F.regexp_replace(heading, r"^#+\s*", "")), "[^a-z0-9]+", "-")
    return _cut_at_hyphen(F.regexp_replace(out, "^-+|-+$", ""), 30)


def wikilinks(body: Column) -> Column:
    """Distinct targets of [[target]] and [[target|label]], in order, outside
    fenced code."""
    plain = F.regexp_replace(body, r"(?s)```.*?```", "")
    found = F.regexp_extract_all(plain, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda x: x != ""))


def content_hash(t: Column) -> Column:
    return F.sha2(F.lower(strip(t)), 256)


def query_hash(q: Column) -> Column:
    return F.sha2(q, 256)


def classify(q: Column) -> Column:
    return F.when(F.lower(q).rlike("|".join(STRUCTURED)), "structured").otherwise("semantic")


def headings(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"(?dm)^#{1,6}\s+(.+)$"), F.lit(1))


def first_paragraph(t: Column) -> Column:
    return F.get(F.split(t, r"\n\s*\n", 2), 0)


def first_words(t: Column, n: int) -> Column:
    return F.array_join(F.slice(words(t), 1, n), " ")


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(
        n < 1 << 20,
        F.format_string("%.1f KB", F.bround(n / 1024.0, 1)),
    ).otherwise(F.format_string("%.1f MB", F.bround(n / float(1 << 20), 1)))


def language_of(path: Column) -> Column:
    """Source language by extension."""
    names = {
        "py": "python",
        "js": "javascript",
        "ts": "typescript",
        "java": "java",
        "go": "go",
        "rs": "rust",
        "rb": "ruby",
        "c": "c",
        "h": "c",
        "cpp": "cpp",
        "cs": "csharp",
        "php": "php",
        "swift": "swift",
        "kt": "kotlin",
        "scala": "scala",
        "sh": "bash",
        "sql": "sql",
        "r": "r",
        "html": "html",
        "css": "css",
        "json": "json",
        "yaml": "yaml",
        "yml": "yaml",
        "toml": "toml",
        "md": "markdown",
        "xml": "xml",
    }
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("text"))


def snippet(body: Column, terms: Column, width: int = 48) -> Column:
    """The ``width`` words that hold most of the terms (the first of equals),
    hits in <b></b>, dots where the text goes on."""
    hit = lambda w: F.array_contains(terms, F.regexp_replace(fold(w), r"[^\p{L}\p{N}]", ""))

    def of(ws: Column, hits: Column) -> Column:
        last = F.greatest(F.size(ws) - width, F.lit(0))
        count = lambda i: F.aggregate(F.slice(hits, i + 1, F.lit(width)), F.lit(0), lambda n, h: n + h.cast("int"))
        scored = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(count(i).alias("n"), (-i).alias("at")))

        def shown(at: Column) -> Column:
            marked = lambda w, h: F.when(h, F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w)
            some = F.zip_with(F.slice(ws, at + 1, F.lit(width)), F.slice(hits, at + 1, F.lit(width)), marked)
            return F.concat(F.when(at > 0, "...").otherwise(""), F.array_join(some, " "), F.when(at + width < F.size(ws), "...").otherwise(""))

        return let(-F.array_max(scored)["at"], shown)

    return let(words(body), lambda ws: let(F.transform(ws, hit), lambda hits: of(ws, hits)))


def parse_keywords(answer: Column, least: int = 5, most: int = 10) -> Column:
    """Keywords of a language model's answer: a JSON list, fenced or not,
    lower-cased, distinct; null if there are fewer than ``least``."""
    plain = strip(F.regexp_replace(answer, r"^\s*```[a-z]*|```\s*$", ""))
    found = F.array_distinct(F.filter(
        F.transform(F.from_json(plain, "array<string>"), lambda x: strip(F.lower(x))),
        lambda x: x.isNotNull() & (x != ""),
    ))
    return F.when(F.size(found) >= least, F.slice(found, 1, most))
