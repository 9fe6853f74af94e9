"""Notes as text: front matter and the index table, written and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Header keys in their order; others follow by name.
ORDER = (
    "title",
    "type",
    "summary",
    "categories",
    "concepts",
    "fingerprint",
    "parent",
    "children",
    "split_from",
    "section_index",
    "source",
    "created",
    "updated",
)


def scalar(value: Column) -> Column:
    """A YAML scalar, quoted where it could be read as anything else."""
    plain = value.rlike(r"^[A-Za-z0-9][A-Za-z0-9 _./-]*$") & ~F.lower(value).isin("true", "false", "null", "yes", "no", "on", "off") & ~value.rlike(r"^[0-9.+-]+$") & ~value.rlike(r"\s$")
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    return F.when(plain, value).otherwise(quoted)


def header(values: dict[str, Column], lists: dict[str, Column]) -> Column:
    """``---`` lines of the given scalar and list columns; empty ones are left out."""
    names = [n for n in ORDER if n in values or n in lists] + sorted((set(values) | set(lists)) - set(ORDER))
    lines = []
    for n in names:
        if n in values:
            v = values[n].cast("string")
            lines.append(F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{n}: "), scalar(v))))
        else:
            lines.append(F.when(F.size(lists[n]) > 0, F.concat(F.lit(f"{n}: ["), F.array_join(F.transform(lists[n], scalar), ", "), F.lit("]"))))
    return F.concat(F.lit("---\n"), F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"), F.lit("\n---\n"))


def render(documents: DataFrame) -> DataFrame:
    """(slug, note) of documents (slug, title, summary, categories, body)."""
    top = header({"title": F.col("title"), "summary": F.col("summary")}, {"categories": F.col("categories")})
    return documents.select("slug", F.concat(top, F.lit("\n"), "body").alias("note"))


def _cell(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit(r"\|"))


def index_rows(entries: DataFrame) -> DataFrame:
    """Lines of the index table of entries (slug, title, categories, synopsis,
    fingerprint)."""
    cells = [
        F.concat(F.lit("[["), "slug", F.lit("]]")),
        _cell(F.col("title")),
        _cell(F.array_join("categories", ", ")),
        _cell(F.col("synopsis")),
        _cell(F.array_join("fingerprint", ", ")),
    ]
    return entries.select("slug", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def read_index(lines: DataFrame) -> DataFrame:
    """Entries of index lines (column line or value); other lines are skipped,
    and an escaped bar is part of its cell."""
    line = F.col("line" if "line" in lines.columns else "value")
    cells = F.transform(F.split(line, r"(?<!\\)\|"), lambda x: F.replace(T.strip(x), F.lit(r"\|"), F.lit("|")))
    listed = lambda i: F.filter(F.split(F.get("_c", F.lit(i)), r",\s*"), lambda x: x != "")
    rows = lines.where(line.rlike(r"^\| \[\[.+\]\] \|")).select(cells.alias("_c"))
    return rows.select(
        F.regexp_replace(F.get("_c", F.lit(1)), r"^\[\[|\]\]$", "").alias("slug"),
        F.get("_c", F.lit(2)).alias("title"),
        listed(3).alias("categories"),
        F.get("_c", F.lit(4)).alias("synopsis"),
        listed(5).alias("fingerprint"),
    )


def read_index_file(spark: SparkSession, path: str) -> DataFrame:
    return read_index(spark.read.text(path))
