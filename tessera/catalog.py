"""Further registered queries, of readers, notes, links, feedback and the control
plane, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql as Q
from .durable import materialise
from .functions import scoring as S
from .functions import text as T
from .operators import control, feedback, fingerprint, graph, index, store, tenancy
from .sources import files, html, notes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _md5(c) -> F.Column:
    return F.md5(F.coalesce(c, F.lit("")).cast("binary"))


# -- readers ---------------------------------------------------------------------


def extract_formats(spark, sf_dir):
    """Rows of tables as small files of six formats."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    bodies = {
        "json": F.to_json(F.struct(F.col("c_name").alias("name"), F.lit("a customer").alias("description"), F.col("c_nationkey").alias("nation"))),
        "md": F.concat(
            F.lit("---\ntitle: "),
            "c_name",
            F.lit("\ntags: ["),
            "c_mktsegment",
            F.lit(", other]\n---\n\n# "),
            "c_name",
            F.lit("\n\n\n\nin "),
            "c_mktsegment",
            F.lit("  \n"),
        ),
        "txt": F.concat(F.lit("# Customer "), "c_name", F.lit("\r\n\r\nsegment "), "c_mktsegment"),
        "py": F.concat(F.lit('"""About '), "c_name", F.lit('."""\n\nx = '), k.cast("string"), F.lit("\n")),
        "csv": F.concat(F.lit('key,name\n'), k.cast("string"), F.lit(',"'), "c_name", F.lit(', Inc"\n7\n')),
        "xyz": F.lit("unknown"),
    }
    kinds = list(bodies)
    chosen = F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % len(kinds) + 1).cast("int"))
    content = F.coalesce(*[F.when(chosen == x, b) for x, b in bodies.items()])
    rows = c.select(F.concat(F.lit("/in/"), k.cast("string"), F.lit("."), chosen).alias("path"), content.cast("binary").alias("content"))
    made = files.extract(materialise(rows, "files"))
    return made.select(
        "path",
        "extension",
        "title",
        _md5("text").alias("text_md5"),
        F.coalesce(
            F.try_element_at("metadata", F.lit("summary")),
            F.try_element_at("metadata", F.lit("description")),
            F.try_element_at("metadata", F.lit("tags")),
            F.try_element_at("metadata", F.lit("row_count")),
        ).alias("about"),
        "status",
        "error",
    )


SQL_FORMATS = """WITH c AS (SELECT *, ['json', 'md', 'txt', 'py', 'csv', 'xyz'][(c_custkey % 6 + 1)::INT] AS extension FROM customer),
t AS (SELECT *, chr(10) AS n, CASE extension
  WHEN 'json' THEN '```json' || chr(10) || '{"name":"' || c_name || '","description":"a customer","nation":' || c_nationkey || '}' || chr(10) || '```'
  WHEN 'md' THEN '# ' || c_name || chr(10) || chr(10) || 'in ' || c_mktsegment
  WHEN 'txt' THEN '# Customer ' || c_name || chr(10) || chr(10) || 'segment ' || c_mktsegment
  WHEN 'py' THEN '```python' || chr(10) || '\"\"\"About ' || c_name || '.\"\"\"' || chr(10) || chr(10) || 'x = ' || c_custkey || chr(10) || chr(10) || '```'
  WHEN 'csv' THEN '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_custkey || ' | ' || c_name || ', Inc |' || chr(10) || '| 7 |  |' ELSE '' END AS text FROM c)
SELECT '/in/' || c_custkey || '.' || extension AS path, extension, CASE WHEN extension IN ('json', 'md') THEN c_name WHEN extension = 'txt' THEN 'Customer ' || c_name END AS title, md5(text) AS text_md5,
  CASE extension WHEN 'json' THEN 'a customer' WHEN 'md' THEN '["' || c_mktsegment || '", "other"]' WHEN 'py' THEN 'About ' || c_name || '.' WHEN 'csv' THEN '2' END AS about,
  CASE WHEN extension = 'xyz' THEN 'failed' ELSE 'extracted' END AS status, CASE WHEN extension = 'xyz' THEN 'unsupported format: xyz' END AS error FROM t"""


def page_metadata(spark, sf_dir):
    """Pages with a head of our own before them."""
    head = F.concat(
        F.lit('<head><META content="About page '),
        F.col("page_id").cast("string"),
        F.lit('" property="og:description"><link href="/x" rel="canonical"><link rel=\'canonical\' href=\'https://e.org/'),
        F.col("page_id").cast("string"),
        F.lit("'><time datetime=\"2024-01-0"),
        (F.col("page_id") % 9 + 1).cast("string"),
        F.lit('">'),
    )
    named = F.when(
        F.col("page_id") % 3 == 0,
        F.concat(F.lit('<meta name="description" content="First '), F.col("page_id").cast("string"), F.lit('">')),
    ).otherwise("")
    m = html.page_metadata(F.concat(head, named, "html"))
    return table(spark, sf_dir, "pages").select("page_id", m.alias("m")).select(
        "page_id",
        "m.title",
        "m.description",
        "m.canonical_url",
        "m.publish_date",
    )


SQL_PAGE_METADATA = r"""SELECT page_id, nullif(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g'), '') AS title,
  CASE WHEN page_id % 3 = 0 THEN 'First ' || page_id ELSE coalesce(nullif(regexp_extract(html, '(?is)<meta\s[^>]*(?:name|property)=["'']description["''][^>]*content=["'']([^"'']*)', 1), ''), 'About page ' || page_id) END AS description,
  'https://e.org/' || page_id AS canonical_url,
  coalesce(nullif(regexp_extract(html, '(?is)<meta\s[^>]*(?:name|property)=["''](?:article:published_time|date|pubdate)["''][^>]*content=["'']([^"'']*)', 1), ''), '2024-01-0' || (page_id % 9 + 1)) AS publish_date FROM pages"""


def source_languages(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("a.py", "b/c.JS", "d.e.ts", "Makefile", "f.yml", "g.h", "h.zig", ".rs", "i.MD", "j.sh")])
    path = F.concat(F.lit("src/"), F.element_at(names, (F.col("p_partkey") % 10 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), T.language_of(path).alias("language"))


SQL_LANGUAGES = """SELECT p_partkey, 'src/' || ['a.py', 'b/c.JS', 'd.e.ts', 'Makefile', 'f.yml', 'g.h', 'h.zig', '.rs', 'i.MD', 'j.sh'][(p_partkey % 10 + 1)::INT] AS path,
  ['python', 'javascript', 'typescript', 'text', 'yaml', 'c', 'text', 'rust', 'markdown', 'bash'][(p_partkey % 10 + 1)::INT] AS language FROM part"""


def model_keywords(spark, sf_dir):
    """What a language model might answer, read as keywords."""
    k = F.col("s_suppkey")
    listed = F.concat(F.lit('["B '), k.cast("string"), F.lit('", " a ", "a", "Name '), "s_name", F.lit('", "c", "d", "e", "f", "g", "h", "i", "j"]'))
    answer = F.when(
        k % 4 == 0,
        F.concat(F.lit("```json\n"), listed, F.lit("\n```")),
    ).when(k % 4 == 1, listed).when(k % 4 == 2, '["a", "b", "A"]').otherwise("no list")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(T.parse_keywords(answer), ",").alias("keywords"))


SQL_MODEL_KEYWORDS = "SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 2 THEN 'b ' || s_suppkey || ',a,name ' || lower(s_name) || ',c,d,e,f,g,h,i' END AS keywords FROM supplier"


def embedding_texts(spark, sf_dir):
    """What a model is given of each document: its first 512 words."""
    return table(spark, sf_dir, "documents").select("doc_id", _md5(T.first_words(F.coalesce("text", F.lit("")), 512)).alias("text_md5"))


SQL_EMBEDDING_TEXTS = f"SELECT doc_id, md5(array_to_string({Q.words('''coalesce(text, '')''')}[1:512], ' ')) AS text_md5 FROM documents"


# -- notes -----------------------------------------------------------------------


def note_render(spark, sf_dir):
    """Documents as notes: a header in fixed order, quoted where needed."""
    c = table(spark, sf_dir, "customer")
    docs = c.select(
        F.col("c_custkey").alias("slug"),
        F.when(
            F.col("c_custkey") % 3 == 0,
            F.concat(F.lit('He said: "'), "c_name", F.lit('"')),
        ).when(F.col("c_custkey") % 3 == 1, F.col("c_custkey").cast("string")).otherwise(F.col("c_mktsegment")).alias("title"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("no")).alias("summary"),
        F.when(F.col("c_custkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("c_mktsegment", F.lit("x: y"))).alias("categories"),
        F.lit("text\n").alias("body"),
    )
    return notes.render(docs)


SQL_NOTES = """SELECT c_custkey AS slug, '---' || chr(10) || 'title: ' || CASE c_custkey % 3 WHEN 0 THEN '"He said: \\"' || c_name || '\\""' WHEN 1 THEN '"' || c_custkey || '"' ELSE c_mktsegment END || chr(10) ||
  CASE WHEN c_custkey % 2 = 0 THEN 'summary: "no"' || chr(10) ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'categories: [' || c_mktsegment || ', "x: y"]' || chr(10) END || '---' || chr(10) || chr(10) || 'text' || chr(10) AS note FROM customer"""


def index_lines(spark, sf_dir):
    """The index as lines, written and read again."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("slug"),
        F.concat("p_brand", F.lit(" | "), "p_type").alias("title"),
        F.array("p_brand", "p_type").alias("categories"),
        F.concat("p_name", F.lit("\nline")).alias("synopsis"),
        F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("fingerprint"),
    )
    back = notes.read_index(notes.index_rows(p))
    return back.select("slug", "title", F.array_join("categories", ";").alias("categories"), "synopsis", F.size("fingerprint").alias("n_fingerprint"))


SQL_INDEX_LINES = "SELECT p_partkey::VARCHAR AS slug, p_brand || ' | ' || p_type AS title, p_brand || ';' || p_type AS categories, p_name || ' line' AS synopsis, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS n_fingerprint FROM part"


def metadata_merge(spark, sf_dir):
    """Headers of parts, two fields changed for some; the update wins."""
    p = table(spark, sf_dir, "part")
    old = p.select(
        F.col("p_partkey").alias("slug"),
        F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("extra"),
    )
    new = p.where("p_partkey % 3 = 0").select(
        F.col("p_partkey").alias("slug"),
        F.create_map(F.lit("size"), F.lit("new"), F.lit("type"), F.col("p_type")).alias("extra"),
    )
    out = store.merge_metadata(old, new)
    return out.select(
        "slug",
        F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("extra"),
    )


SQL_METADATA_MERGE = "SELECT p_partkey AS slug, 'brand=' || p_brand || ';size=' || CASE WHEN p_partkey % 3 = 0 THEN 'new;type=' || p_type ELSE p_size::VARCHAR END AS extra FROM part"


# -- links -----------------------------------------------------------------------


def linked_notes(spark, sf_dir) -> DataFrame:
    """Orders as notes: links with and without labels, repeated, and in code."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    link = lambda x, label="": F.concat(F.lit("[["), x.cast("string"), F.lit(f"{label}]]"))
    body = F.concat(
        F.lit("see "),
        link(k + 1),
        F.lit(" and "),
        link(k * 2, "|twice"),
        F.lit(" ```"),
        link(k + 5),
        F.lit("``` "),
        link(k + 1, "|again"),
        F.lit(" [[ ]] "),
        link(k % 7),
    )
    return o.select(k.cast("string").alias("slug"), "o_custkey", body.alias("body"))


def link_extraction(spark, sf_dir):
    return index.links(linked_notes(spark, sf_dir)).select("src", "dst", F.col("pos").cast("long").alias("pos"))


SQL_LINK_ROWS = """n AS (SELECT o_orderkey AS k, o_custkey, [(o_orderkey + 1)::VARCHAR, (o_orderkey * 2)::VARCHAR, (o_orderkey % 7)::VARCHAR] AS raw FROM orders),
d AS (SELECT k, o_custkey, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS l FROM n),
ln AS (SELECT k::VARCHAR AS src, o_custkey, unnest(l) AS dst, unnest(range(len(l))) AS pos FROM d)"""


def link_maintenance(spark, sf_dir):
    """The graph after every fifth customer's notes are rewritten and every
    seventh's removed; links of each note that is left."""
    docs = linked_notes(spark, sf_dir)
    changed = docs.where("o_custkey % 5 = 0").withColumn("body", F.lit("now [[home]]"))
    gone = docs.where("o_custkey % 7 = 0").select("slug")
    links = graph.remove(index.replace_links(index.links(docs), changed), gone)
    return graph.forward_links(links, docs.select("slug")).groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("first"))


SQL_LINK_MAINTENANCE = f"WITH {SQL_LINK_ROWS} SELECT src AS slug, count(*) AS n, min(dst) AS first FROM (SELECT src, o_custkey, dst FROM ln WHERE o_custkey % 5 <> 0 UNION SELECT src, o_custkey, 'home' FROM ln WHERE o_custkey % 5 = 0) WHERE o_custkey % 7 <> 0 GROUP BY 1"


# -- scores ----------------------------------------------------------------------


def entry_scores(spark, sf_dir):
    """The richer score of each document's entry for one question."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.tokenize_query("text")).alias("kw"))
    n = asked.agg(F.count(F.lit(1)).alias("n"))
    rows = docs.crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n")).join(asked, "item_id")  # n is one row
    places = {"f": (1, 10), "ti": (3, 6), "sy": (11, 20), "al": (1, 30), "fi": (5, 5)}
    rows = rows.select("doc_id", "kw", F.array("lang", "source").alias("cats"), F.slice(T.tokenize_query("text"), 1, 30).alias("t"))
    rows = rows.select("*", *[F.array_distinct(F.slice("t", *p)).alias(c) for c, p in places.items()])
    score = S.entry_score(F.col("kw"), F.col("f"), F.col("cats"), F.col("ti"), F.col("sy"))
    total = S.combined(score, S.jaccard(F.col("kw"), F.col("al")), S.partial_match(F.col("kw"), F.col("fi")))
    return rows.select("doc_id", F.round(score, 9).alias("entry_score"), F.round(total, 9).alias("combined"))


def _sql_jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct({a} || {b})) ELSE 0 END)"


def _sql_partial(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_filter({a}, lambda k: len(list_filter({b}, lambda t: contains(t, k) OR contains(k, t))) > 0))::DOUBLE / len({a}) ELSE 0 END)"


def _sql_best(b: str) -> str:
    return f"greatest({_sql_jaccard('kw', b)}, 0.7::DOUBLE * {_sql_partial('kw', b)})"


SQL_ENTRY_SCORES = f"""WITH q AS (SELECT item_id, list_distinct({Q.query_tokens('text')}) AS kw FROM benchmark),
d AS (SELECT doc_id, [lang, source] AS cats, {Q.query_tokens("coalesce(text, '')")} AS t FROM documents),
r AS (SELECT doc_id, kw, cats, list_distinct(t[1:10]) AS f, list_distinct(t[3:8]) AS ti, list_distinct(t[11:30]) AS sy, list_distinct(t[1:30]) AS al, list_distinct(t[5:9]) AS fi FROM d JOIN q ON item_id = doc_id % (SELECT count(*) FROM benchmark)),
s AS (SELECT *, 3.0::DOUBLE * {_sql_best('f')} + 3.0::DOUBLE * {_sql_best('ti')} + 2.0::DOUBLE * {_sql_best('cats')} + 1.5::DOUBLE * {_sql_jaccard('kw', 'sy')} AS score FROM r)
SELECT doc_id, round(score, 9) AS entry_score, round(score + {_sql_jaccard('kw', 'al')} * 0.8::DOUBLE + {_sql_partial('kw', 'fi')} * 0.6::DOUBLE, 9) AS combined FROM s"""


def merged_categories(spark, sf_dir):
    """Categories that documents have already, then those found in them."""
    from .queries import corpus

    tokens = F.transform(fingerprint.keyword_array(F.col("title"), F.col("text")), lambda r: r["token"])
    found = F.transform(fingerprint.category_array(tokens), lambda r: r["category"])
    known = F.when(F.col("doc_id") % 2 == 0, F.array("lang", F.lit("text"), "source")).when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>"))
    return corpus(spark, sf_dir).select("slug", F.array_join(fingerprint.merged_categories(known, found), ",").alias("categories"))


SQL_MERGED = "WITH " + ",\n".join((Q.CORPUS, Q.TF, Q.KEYWORDS, Q.CATEGORIES)) + """,
g AS (SELECT slug, list(category ORDER BY rank) AS found FROM ct GROUP BY 1),
a AS (SELECT c.slug, CASE WHEN doc_id % 2 = 0 THEN [lang, 'text', source] ELSE [] END || coalesce(found, []) AS l FROM corpus c LEFT JOIN g USING (slug))
SELECT slug, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:5], ',') AS categories FROM a"""


def section_synopses(spark, sf_dir):
    """Synopses of 150 characters, as a document's map of sections has them."""
    from .queries import corpus

    return corpus(spark, sf_dir).select("slug", fingerprint.synopsis(F.col("text"), F.col("title"), 150).alias("synopsis"))


SQL_SECTION_SYNOPSES = "WITH " + Q.CORPUS + ", " + Q.synopsis(150) + " SELECT slug, synopsis FROM syn"


def snippets(spark, sf_dir):
    """The words of each document around those of one question."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    asked = table(spark, sf_dir, "benchmark").select("item_id", T.tokenize_query("text").alias("terms"))
    n = asked.agg(F.count(F.lit(1)).alias("n"))
    rows = docs.crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n")).join(asked, "item_id")  # n is one row
    return rows.select("doc_id", _md5(T.snippet(F.col("text"), F.col("terms"), 12)).alias("snippet_md5"))


SQL_SNIPPETS = rf"""WITH q AS (SELECT item_id, {Q.query_tokens('text')} AS terms FROM benchmark),
d AS (SELECT doc_id, {Q.words("coalesce(text, '')")} AS ws, terms FROM documents JOIN q ON item_id = doc_id % (SELECT count(*) FROM benchmark)),
h AS (SELECT doc_id, ws, list_transform(ws, lambda w: list_contains(terms, regexp_replace(strip_accents(lower(w)), '[^\p{{L}}\p{{N}}]', '', 'g'))) AS hit FROM d),
e AS (SELECT doc_id, unnest(hit) AS hit, unnest(range(len(ws))) AS i FROM h),
c AS (SELECT doc_id, i, count(*) FILTER (hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS n, max(i) OVER (PARTITION BY doc_id) AS last FROM e),
b AS (SELECT doc_id, i AS spot FROM c WHERE i <= greatest(last + 1 - 12, 0) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1)
SELECT doc_id, md5(CASE WHEN coalesce(spot, 0) > 0 THEN '...' ELSE '' END || array_to_string(list_transform(list_zip(ws, hit)[coalesce(spot, 0) + 1:coalesce(spot, 0) + 12], lambda x: CASE WHEN x[2] THEN '<b>' || x[1] || '</b>' ELSE x[1] END), ' ') || CASE WHEN coalesce(spot, 0) + 12 < len(ws) THEN '...' ELSE '' END) AS snippet_md5 FROM h LEFT JOIN b USING (doc_id)"""


# -- feedback --------------------------------------------------------------------


def _signals(spark, sf_dir):
    from .queries import query_log

    log = query_log(spark, sf_dir)
    return log, feedback.signals(log, scale=3600)


def signals_applied(spark, sf_dir):
    """The log, its scores overwritten by the latest signal on each query."""
    log, found = _signals(spark, sf_dir)
    return feedback.apply_signals(log, found).select("query_id", "feedback_score", "signal_type")


def tuning_gate(spark, sf_dir):
    from .queries import query_log

    return feedback.tuning_gate(query_log(spark, sf_dir))


# -- control plane ---------------------------------------------------------------


def key_verification(spark, sf_dir):
    """Orders as calls with their customer's secret."""
    c = table(spark, sf_dir, "customer")
    keys = c.select(
        F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("tenant_id"),
        F.sha2(F.concat(F.lit("secret-"), F.col("c_custkey").cast("string")), 256).alias("key_hash"),
        F.col("c_custkey").cast("string").alias("key_id"),
        (F.col("c_custkey") % 2 == 0).alias("read_only"),
        (F.col("c_custkey") % 5 == 0).alias("revoked"),
    )
    o = table(spark, sf_dir, "orders")
    method = F.element_at(F.array(F.lit("get"), F.lit("POST"), F.lit("Head"), F.lit("DELETE")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    calls = o.select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(
            F.lit("secret-"),
            F.when(F.col("o_orderkey") % 10 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).cast("string"),
        ).alias("secret"),
        method.alias("method"),
    )
    return control.verify(calls, keys)


SQL_KEYS = """SELECT o_orderkey AS request_id, CASE WHEN c_custkey IS NOT NULL THEN 't' || c_nationkey END AS tenant_id,
  c_custkey IS NOT NULL AND (c_custkey % 2 = 1 OR o_orderkey % 4 IN (0, 2)) AS allowed FROM orders LEFT JOIN customer ON c_custkey = CASE WHEN o_orderkey % 10 = 0 THEN -o_custkey ELSE o_custkey END AND c_custkey % 5 <> 0"""


def webhook_fanout(spark, sf_dir):
    """Orders as events, to the hooks of their customers' nations."""
    n = table(spark, sf_dir, "nation")
    events = F.array(*[F.lit(e) for e in control.EVENTS])
    hooks = n.select(
        F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("tenant_id"),
        F.col("n_name").alias("id"),
        F.lit("http://x").alias("url"),
        F.slice(events, 1, F.col("n_nationkey").cast("int") % 4 + 1).alias("events"),
        F.lit("s").alias("secret"),
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    fired = o.select(
        F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("tenant_id"),
        F.element_at(events, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("event"),
        F.col("o_orderkey").cast("string").alias("payload"),
    )
    wrong = F.array_join(control.invalid_events(F.array(F.col("event"), F.concat("event", F.lit("x")))), ",")
    return control.deliveries(fired, hooks, sign=False).select("tenant_id", "event", "payload", "id", wrong.alias("invalid"))


SQL_FANOUT = """WITH v AS (SELECT ['document.created', 'document.updated', 'document.deleted', 'reindex.started', 'reindex.completed'] AS ev)
SELECT 't' || n_nationkey AS tenant_id, ev[(o_orderkey % 5 + 1)::INT] AS event, o_orderkey::VARCHAR AS payload, n_name AS id, ev[(o_orderkey % 5 + 1)::INT] || 'x' AS invalid
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey, v WHERE o_orderkey % 5 <= n_nationkey % 4"""


def webhook_retries(spark, sf_dir):
    """Line items as failed attempts; when each is tried again."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_linenumber").cast("int").alias("attempt"),
        F.col("l_shipdate").cast("timestamp").alias("failed_at"),
    )
    return control.due(li).select("l_orderkey", "l_linenumber", F.col("next_at").cast("string").alias("next_at"))


SQL_RETRIES = "SELECT l_orderkey, l_linenumber, strftime(l_shipdate::TIMESTAMP + INTERVAL 1 SECOND * CASE l_linenumber WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 5 END, '%Y-%m-%d %H:%M:%S') AS next_at FROM lineitem WHERE l_linenumber < 3"


def custom_fields(spark, sf_dir):
    """Fields of nations' tenants, some replaced, one tenant's dropped."""
    n = table(spark, sf_dir, "nation")
    of = lambda rows, kind, required: rows.select(
        F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("tenant_id"),
        F.col("n_name").alias("field_name"),
        F.lit(kind).alias("field_type"),
        F.lit(required).alias("required"),
    )
    fields = control.put_field(of(n, "string", False), of(n.where("n_nationkey % 3 = 0"), "int", True))
    one = control.drop_field(fields, "t1", "BRAZIL")
    return tenancy.scoped(one, "t1").unionByName(tenancy.scoped(one, "t2"))


SQL_FIELDS = "SELECT 't' || n_regionkey AS tenant_id, n_name AS field_name, CASE WHEN n_nationkey % 3 = 0 THEN 'int' ELSE 'string' END AS field_type, n_nationkey % 3 = 0 AS required FROM nation WHERE n_regionkey IN (1, 2) AND NOT (n_regionkey = 1 AND n_name = 'BRAZIL')"


QUERIES = {
    "extract_formats": extract_formats,
    "page_metadata": page_metadata,
    "source_languages": source_languages,
    "model_keywords": model_keywords,
    "embedding_texts": embedding_texts,
    "note_render": note_render,
    "index_lines": index_lines,
    "metadata_merge": metadata_merge,
    "link_extraction": link_extraction,
    "link_maintenance": link_maintenance,
    "entry_scores": entry_scores,
    "merged_categories": merged_categories,
    "section_synopses": section_synopses,
    "snippets": snippets,
    "signals_applied": signals_applied,
    "tuning_gate": tuning_gate,
    "key_verification": key_verification,
    "webhook_fanout": webhook_fanout,
    "webhook_retries": webhook_retries,
    "custom_fields": custom_fields,
}

ORACLE_SQL = {
    "extract_formats": SQL_FORMATS,
    "page_metadata": SQL_PAGE_METADATA,
    "source_languages": SQL_LANGUAGES,
    "model_keywords": SQL_MODEL_KEYWORDS,
    "embedding_texts": SQL_EMBEDDING_TEXTS,
    "note_render": SQL_NOTES,
    "index_lines": SQL_INDEX_LINES,
    "metadata_merge": SQL_METADATA_MERGE,
    "link_extraction": f"WITH {SQL_LINK_ROWS} SELECT src, dst, pos FROM ln",
    "link_maintenance": SQL_LINK_MAINTENANCE,
    "entry_scores": SQL_ENTRY_SCORES,
    "merged_categories": SQL_MERGED,
    "section_synopses": SQL_SECTION_SYNOPSES,
    "snippets": SQL_SNIPPETS,
    "key_verification": SQL_KEYS,
    "webhook_fanout": SQL_FANOUT,
    "webhook_retries": SQL_RETRIES,
    "custom_fields": SQL_FIELDS,
}
