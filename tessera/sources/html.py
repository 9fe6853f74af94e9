"""HTML to markdown: a chain of column expressions, and a parser-based form."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T


def title(html: Column) -> Column:
    found = T.strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.nullif(found, F.lit(""))


def to_markdown(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)\s*>", "")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}\b[^>]*>\s*(.*?)\s*</h{level}\s*>", "\n\n" + "#" * level + " $1\n\n")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?is)<p\b[^>]*>(.*?)</p\s*>", "\n\n$1\n\n")
    out = F.regexp_replace(out, r"(?is)<li\b[^>]*>\s*(.*?)\s*</li\s*>", "\n- $1")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]+>", "")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(mark))
    return T.clean(out)


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href=["']([^"'#]+)"""), F.lit(1)))


def meta(html: Column, name: str) -> Column:
    """Content of a meta tag, by name or property."""
    first = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*(?:name|property)=["']{re.escape(name)}["'][^>]*content=["']([^"']*)""", 1)
    other = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*content=["']([^"']*)["'][^>]*(?:name|property)=["']{re.escape(name)}["']""", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(other, F.lit("")))


def page_metadata(html: Column) -> Column:
    """title, description, canonical_url, publish_date."""
    canonical = F.nullif(F.regexp_extract(html, r"""(?is)<link\s[^>]*rel=["']canonical["'][^>]*href=["']([^"']+)""", 1), F.lit(""))
    time = F.nullif(F.regexp_extract(html, r"""(?is)<time\s[^>]*datetime=["']([^"']+)""", 1), F.lit(""))
    dates = [meta(html, n) for n in ("article:published_time", "date", "pubdate")]
    return F.struct(
        title(html).alias("title"),
        F.coalesce(meta(html, "description"), meta(html, "og:description")).alias("description"),
        canonical.alias("canonical_url"),
        F.coalesce(*dates, time).alias("publish_date"),
    )


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "p":
            self.out.append("\n\n")
        elif tag == "li":
            self.out.append("\n- ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif tag == "p" or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


@F.pandas_udf(StringType())
def parsed_markdown(pages: pd.Series) -> pd.Series:
    """The same by a real parser, for markup that patterns can't follow."""

    def one(page):
        if page is None:
            return None
        parser = _Text()
        parser.feed(page)
        lines = "".join(parser.out).replace("\0", "").replace("\r\n", "\n").replace("\r", "\n")
        lines = re.sub(r"\n{3,}", "\n\n", lines)
        return "\n".join(x.rstrip() for x in lines.split("\n")).strip()

    return pages.map(one)
