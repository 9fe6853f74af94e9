"""A directory of files as documents: one scan, one row a file, failures as rows.

Formats are column expressions where columns can say it; CSV, DOCX, TOML, YAML,
and the YAML headers of notes are parsed in Arrow-batched functions.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from ..functions import text as T
from . import html

CODE = ("py", "js", "ts", "java", "go", "rs", "rb", "c", "h", "cpp", "cs", "php", "swift", "kt", "scala", "sh", "sql", "r", "css")


def _extracted(text: Column, title: Column | None = None, metadata: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        text.alias("text"),
        (none if title is None else title).alias("title"),
        (_no_metadata() if metadata is None else metadata).alias("metadata"),
    )


def _no_metadata() -> Column:
    return F.create_map().cast("map<string,string>")


FRONT = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"


def _value(value) -> str:
    """A YAML value as text: strings as they are, all else as JSON."""
    if isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, sort_keys=True, default=str) if not hasattr(value, "isoformat") else value.isoformat()


def _simple_header(text: str) -> dict | None:
    """``key: value`` lines and lists, for where no YAML library is installed."""
    out: dict = {}
    key = None
    for line in text.splitlines():
        if item := re.match(r"\s*-\s+(.*)$", line):
            if key is None or not isinstance(out[key], (list, type(None))):
                return None
            out[key] = [*(out[key] or []), item[1].strip().strip("\"'")]
        elif pair := re.match(r"([\w-]+):\s*(.*)$", line):
            key, value = pair[1], pair[2].strip()
            listed = re.fullmatch(r"\[(.*)\]", value)
            out[key] = [x.strip().strip("\"'") for x in listed[1].split(",") if x.strip()] if listed else value.strip("\"'") or None
        elif line.strip() and not line.lstrip().startswith("#"):
            return None
    return out


def load_yaml(text: str):
    """What a YAML text holds; ``ValueError`` if it is none."""
    try:
        import yaml
    except ImportError:
        found = _simple_header(text)
        if found is None:
            raise ValueError("not YAML") from None
        return found
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


@F.pandas_udf(MapType(StringType(), StringType()))
def _header(texts: pd.Series) -> pd.Series:
    def one(text):
        found = re.match(FRONT.replace("\\z", "\\Z"), text or "")
        if not found:
            return {}
        try:
            held = load_yaml(found[1])
        except ValueError:
            return None  # no header after all: it is part of the body
        return {str(k): _value(v) for k, v in held.items() if v not in (None, "", [])} if isinstance(held, dict) else {}

    return texts.map(one)


def front_matter(text: Column) -> Column:
    """A YAML header as a map: strings as they are, lists and all else as JSON;
    null where the header is broken."""
    return _header(text)


def markdown(t: Column, header: Column | None = None) -> Column:
    meta = front_matter(t) if header is None else header
    body = F.when(meta.isNull(), t).otherwise(F.regexp_replace(t, FRONT, ""))
    return _extracted(T.clean(body), F.try_element_at(meta, F.lit("title")), F.coalesce(meta, _no_metadata()))


def plain(t: Column) -> Column:
    first = T.strip(F.substring_index(t, "\n", 1))
    shouted = (F.upper(first) == first) & (F.lower(first) != first)
    is_title = first.startswith("#") | shouted | ((F.length(first) < 120) & (first != "") & ~first.endswith("."))
    return _extracted(T.clean(t), F.when(is_title, F.regexp_replace(first, r"^[# ]+", "")))


def page(t: Column) -> Column:
    return _extracted(html.to_markdown(t), html.title(t))


def _fenced(t: Column, language: Column) -> Column:
    return F.concat(F.lit("```"), language, F.lit("\n"), t, F.lit("\n```"))


def docstring(t: Column) -> Column:
    """A leading docstring or comment block."""
    quoted = F.regexp_extract(t, r'(?s)\A\s*(?:#[^\n]*\n)*\s*[rR]?(?:"""(.*?)"""|\'\'\'(.*?)\'\'\')', 1)
    block = F.regexp_replace(F.regexp_extract(t, r"(?s)\A\s*/\*+(.*?)\*/", 1), r"(?m)^\s*\*\s?", "")
    lines = F.regexp_replace(F.regexp_extract(t, r"\A\s*((?:(?://+|#(?!!)|--)[^\n]*\n?)+)", 1), r"(?m)^\s*(//+|#|--)\s?", "")
    return F.nullif(T.strip(F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(block, F.lit("")), lines)), F.lit(""))


def code(t: Column, path: Column) -> Column:
    summary = docstring(t)
    meta = F.map_filter(F.create_map(F.lit("summary"), summary, F.lit("language"), T.language_of(path)), lambda _, v: v.isNotNull())
    return _extracted(_fenced(t, T.language_of(path)), metadata=meta)


def json_file(t: Column) -> Column:
    string = lambda k: F.try_variant_get(F.try_parse_json(t), f"$.{k}", "string")
    meta = F.map_filter(F.create_map(F.lit("description"), string("description")), lambda _, v: v.isNotNull())
    return _extracted(_fenced(T.clean(t), F.lit("json")), F.coalesce(string("title"), string("name")), meta)


def _table(rows: list[list[str]]) -> str:
    """Rows as a markdown table, the first its head; cells are cut or filled to
    its width."""
    width = len(rows[0])
    line = lambda r: "| " + " | ".join(c.strip() for c in (r + [""] * width)[:width]) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


def _clean(text: str) -> str:
    text = re.sub("\r\n?", "\n", text.replace("\0", ""))
    return "\n".join(x.rstrip() for x in re.sub("\n{3,}", "\n\n", text).split("\n")).strip()


def _csv(raw: bytes) -> tuple[str, str | None, dict]:
    """A markdown table; over 100 data rows, a summary and a preview come first."""
    text = raw.decode()
    try:
        delimiter = csv.Sniffer().sniff(text[:8192], delimiters=",\t;").delimiter
    except csv.Error:
        delimiter = ","
    rows = list(csv.reader(io.StringIO(text), delimiter=delimiter))
    if not rows:
        return "*Empty CSV file*", None, {"delimiter": delimiter}
    n = len(rows) - 1
    # fixed values: the words of the summary
    head = f"**CSV Summary**: {n} rows, {len(rows[0])} columns\n**Columns**: {', '.join(rows[0])}\n\n**Preview (first 5 rows)**:\n\n{_table(rows[:6])}\n\n---\n\n**Full data**:\n\n"
    meta = {"delimiter": delimiter, "columns": json.dumps(rows[0], ensure_ascii=False), "column_count": str(len(rows[0])), "row_count": str(n)}
    return _clean((head if n > 100 else "") + _table(rows)), None, meta


def _pdf(raw: bytes) -> tuple[str, str | None, dict]:
    """Pages joined by rules, where a PDF library is installed."""
    import pypdf  # an ImportError makes the file a failed row

    found = pypdf.PdfReader(io.BytesIO(raw))
    meta = {k: str(v) for k in ("title", "author", "subject") if (v := getattr(found.metadata, k, None))} if found.metadata else {}
    return "\n\n---\n\n".join(p.extract_text() or "" for p in found.pages), meta.get("title"), meta | {"page_count": str(len(found.pages))}


def _docx(raw: bytes) -> tuple[str, str | None, dict]:
    """Paragraphs, headings and tables in order; images are left out, with a word
    on that in the metadata."""
    w, dc = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://purl.org/dc/elements/1.1/}"
    held = zipfile.ZipFile(io.BytesIO(raw))
    body = ElementTree.fromstring(held.read("word/document.xml")).find(f"{w}body")
    meta: dict[str, str] = {}
    if "docProps/core.xml" in held.namelist():
        core = ElementTree.fromstring(held.read("docProps/core.xml"))
        named = {"title": "title", "creator": "author", "subject": "subject"}
        meta = {new: node.text for old, new in named.items() if (node := core.find(f"{dc}{old}")) is not None and node.text}
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t")).strip()
    out, title = [], meta.get("title")
    for node in body:
        if node.tag == f"{w}p":
            if any(x.tag.endswith(("}inline", "}anchor")) for x in node.iter()):
                meta["warnings"] = "embedded images skipped"
                continue
            text = said(node)
            style = node.find(f"{w}pPr/{w}pStyle")
            level = re.fullmatch(r"(?i)heading ?(\d+)?", style.get(f"{w}val", "") if style is not None else "")
            if text and level:
                out.append("#" * min(max(int(level[1] or 1), 1), 6) + " " + text)
                title = title or text
            elif text:
                out.append(text)
        elif node.tag == f"{w}tbl":
            rows = [[said(cell) for cell in row.findall(f"{w}tc")] for row in node.findall(f"{w}tr")]
            if rows and rows[0]:
                out.append(_table(rows))
    return _clean("\n\n".join(out)), title, meta


def _named(data, keys: tuple[str, ...]) -> dict:
    return {k: data[k] for k in keys if isinstance(data, dict) and isinstance(data.get(k), str)}


def _toml(raw: bytes) -> tuple[str, str | None, dict]:
    import tomllib

    text = raw.decode()
    try:
        meta = _named(tomllib.loads(text), ("name", "title", "description"))
    except tomllib.TOMLDecodeError:
        meta = {}
    return f"```toml\n{_clean(text)}\n```", meta.get("title") or meta.get("name"), meta


def _yaml(raw: bytes) -> tuple[str, str | None, dict]:
    text = raw.decode()
    try:
        meta = _named(load_yaml(text), ("name", "title"))
    except ValueError:
        meta = {}
    return f"```yaml\n{_clean(text)}\n```", meta.get("title") or meta.get("name"), meta


#: Formats that need a parser: bytes -> (text, title) or (text, title, metadata);
#: more can be registered.
PARSERS: dict[str, Callable[[bytes], tuple]] = {"csv": _csv, "docx": _docx, "pdf": _pdf, "toml": _toml, "yaml": _yaml, "yml": _yaml}
SUPPORTED = {"md", "markdown", "txt", "rst", "html", "htm", "json", *CODE, *PARSERS}


def register(extension: str, parser: Callable[[bytes], tuple]) -> None:
    extension = extension.lower().lstrip(".")
    PARSERS[extension] = parser
    SUPPORTED.add(extension)


def _parsed(kinds: dict) -> Callable:
    @F.pandas_udf("text string, title string, metadata map<string,string>, error string")
    def parse(extension: pd.Series, content: pd.Series) -> pd.DataFrame:
        def one(kind, raw):
            try:
                text, title, *meta = kinds[kind](raw)
                return text, title, meta[0] if meta else {}, None
            except ImportError as e:
                return None, None, None, f"no library for {kind}: {e}"
            except Exception as e:  # noqa: BLE001  a bad file is a failed row
                return None, None, None, f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(k, r) for k, r in zip(extension, content, strict=True)], columns=["text", "title", "metadata", "error"])

    return parse


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, extension, text, title, metadata, status, error) of all files under
    ``path`` but hidden ones; unsupported and unreadable files have status
    ``failed``.  Spark's reader leaves files of no bytes out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.col("path").rlike(r"/\.[^/]*"))
    return extract(files)


def extract(files: DataFrame) -> DataFrame:
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = files.select("path", "content", kind.alias("extension"))
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    ext = F.col("extension")
    of_native = ext.isin(*(SUPPORTED - {*PARSERS, "md", "markdown"}))
    by_column = (
        F.when(ext.isin("txt", "rst"), plain(F.col("t")))
        .when(ext.isin("html", "htm"), page(F.col("t")))
        .when(ext == "json", json_file(F.col("t")))
        .otherwise(code(F.col("t"), F.col("path")))
    )
    ok = F.col("t").isNotNull()

    def shown(rows: DataFrame) -> DataFrame:
        return rows.select(
            "path",
            "extension",
            F.when(ok, F.col("x.text")).alias("text"),
            F.when(ok, F.col("x.title")).alias("title"),
            F.when(ok, F.col("x.metadata")).alias("metadata"),
            F.when(ok, "extracted").otherwise("failed").alias("status"),
            F.when(~ok, "not UTF-8").alias("error"),
        )

    native = shown(files.where(of_native).withColumn("t", utf8).withColumn("x", by_column))
    headed = files.where(ext.isin("md", "markdown")).withColumn("t", utf8).withColumn("h", front_matter(F.col("t")))
    headed = shown(headed.withColumn("x", markdown(F.col("t"), F.col("h"))))
    other = files.where(ext.isin(*PARSERS)).withColumn("x", _parsed(dict(PARSERS))("extension", "content")).select(
        "path",
        "extension",
        "x.text",
        "x.title",
        "x.metadata",
        F.when(F.col("x.error").isNull(), "extracted").otherwise("failed").alias("status"),
        "x.error",
    )
    missing = files.where(~ext.isin(*SUPPORTED)).select(
        "path",
        "extension",
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
        F.lit("failed").alias("status"),
        F.concat(F.lit("unsupported format: "), ext).alias("error"),
    )
    return native.unionByName(headed).unionByName(other).unionByName(missing)


def to_json(metadata: dict) -> str:
    return json.dumps(metadata, sort_keys=True, ensure_ascii=False)
