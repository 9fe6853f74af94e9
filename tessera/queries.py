"""The registered queries of the engine's own operators, and the same in SQL.

Documents of the driver's tables have no titles: the title is the first
sentence, cut at 60 characters; the slug is ``doc-<id>``.  Retrieval reads an
index that is built once for each session and folder, as an engine keeps it:
``index_build`` builds it anew, all other queries join its tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from . import sql as Q
from .durable import fresh_folder, materialise
from .functions import scoring as S
from .functions import text as T
from .operators import control, feedback, fingerprint, graph, index, rank, split, store, tenancy
from .plans import indexes, ingest, retrieve
from .sources import files, html, notes, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- frames ----------------------------------------------------------------------


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    # its first 80 characters, runs of white space counted as one, tell where the first 60 of a sentence end
    head = F.regexp_extract("text", r"(?U)^\s*((?:\s++|\S){0,80})", 1)
    first = F.coalesce(F.substring(F.get(T.sentences(head), 0), 1, 60), F.lit(""))
    return docs.select(F.concat(F.lit("doc-"), "doc_id").alias("slug"), "doc_id", first.alias("title"), "text", "lang", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.col("text").alias("question"),
    )


class Store:
    """What an engine keeps: documents, their index, and a plain full-text index
    of titles and texts.  Each table is made when it is first asked for, so that a
    query that reads only the plain one doesn't wait for the others."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def _tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Documents, postings and keyword weights, made in one pass over the texts."""
        indexes.write_blocks(corpus(self.spark, self.sf_dir), folder := fresh_folder(self.spark, "index"))
        return indexes.read_blocks(self.spark, folder)

    @cached_property
    def documents(self) -> DataFrame:
        """The corpus as engine documents; every document with over 300 words lists
        the next one as its section."""
        nxt = F.concat(F.lit("doc-"), F.col("doc_id") + 1)
        section = F.array(F.struct(nxt.alias("slug"), F.col("title").alias("title"), F.col("summary").alias("synopsis")))
        none = F.array().cast("array<struct<slug:string,title:string,synopsis:string>>")
        return self._tables[0].withColumn("section_map", F.when(F.col("is_long"), section).otherwise(none)).drop("is_long")

    @property
    def postings(self) -> DataFrame:
        self.documents  # noqa: B018
        return self._tables[1]

    @property
    def weights(self) -> DataFrame:
        return self._tables[2]

    @property
    def lengths(self) -> DataFrame:
        return index.block_lengths(self.postings, "slug")

    @property
    def index(self) -> indexes.Index:
        return indexes.Index(self.postings, self.weights, self.lengths)

    @cached_property
    def plain(self) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths of titles and texts, for which nothing else of a
        document is made."""
        docs = corpus(self.spark, self.sf_dir).select("slug", "title", "text")
        postings = indexes.build_one("postings", {"postings": indexes.packed(docs, F.col("title"), F.col("text"))}, fresh_folder(self.spark, "index"))
        return postings, index.block_lengths(postings, "slug")


_stores: dict[tuple[str, str], Store] = {}


def kept(spark: SparkSession, sf_dir: str) -> Store:
    """The session's store of a folder's documents."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        _stores[key] = Store(spark, sf_dir)
    return _stores[key]


# -- ranking ---------------------------------------------------------------------


def index_build(spark, sf_dir):
    """Builds the store anew; what the index holds of each document."""
    key = (spark.sparkContext.applicationId, sf_dir)
    _stores[key] = made = Store(spark, sf_dir)
    made.plain  # noqa: B018
    terms = index.unpacked(made.postings, "slug").groupBy("slug").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"))
    weights = index.unpacked_weights(made.weights, "slug").groupBy("slug").agg(F.count(F.lit(1)).alias("n_keywords"), F.sum("weight").alias("weight"))
    none = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind)).alias(c)
    return made.index.lengths.join(terms, "slug", "left").join(weights, "slug", "left").select(
        "slug",
        "dl",
        none("n_terms", "long"),
        none("n_tokens", "long"),
        none("n_keywords", "long"),
        none("weight", "double"),
    )


SQL_POOLED = "title || ' ' || summary || ' ' || text || ' ' || array_to_string(categories, ' ') || ' ' || array_to_string(concepts, ' ') || ' ' || array_to_string(fingerprint, ' ')"
SQL_KEPT = f"{Q.CORPUS},\n{Q.FINGERPRINTS}"
SQL_PLAIN = Q.bm25("corpus", "title || ' ' || text", "plain")
SQL_PORTER = Q.bm25("described", SQL_POOLED, "bm25", stemmed=True)


def bm25_topk(spark, sf_dir):
    postings, lengths = kept(spark, sf_dir).plain
    return rank.bm25(questions(spark, sf_dir), postings, indexes.stats(lengths), "slug")


def bm25_porter_topk(spark, sf_dir):
    """Stems of all seven fields, as an engine searches."""
    store = kept(spark, sf_dir)
    return rank.bm25(questions(spark, sf_dir), store.postings, indexes.stats(store.lengths), "slug", stemmed=True)


def tier0_keyword_topk(spark, sf_dir):
    return rank.tier0(questions(spark, sf_dir), kept(spark, sf_dir).weights)


SQL_WEIGHTS = rf"""kw AS (
  SELECT DISTINCT slug, lower(unnest(fingerprint)) AS token, 3.0 AS w, 'f' AS k FROM described
  UNION SELECT DISTINCT slug, lower(unnest(categories)), 2.0, 'c' FROM described
  UNION SELECT DISTINCT slug, unnest({Q.words('lower(summary)')}), 1.5, 's' FROM described
  UNION SELECT DISTINCT slug, unnest({Q.words('lower(title)')}), 3.0, 't' FROM described),
kwt AS (SELECT token, slug, sum(w)::DOUBLE AS weight FROM kw GROUP BY ALL)"""
SQL_TIER0 = f"""{SQL_WEIGHTS},
qk AS (SELECT item_id AS query_id, unnest({Q.query_tokens('text')}) AS token FROM benchmark),
t0 AS (SELECT query_id, slug, sum(weight) AS score FROM qk JOIN kwt USING (token) GROUP BY ALL),
tier0 AS (SELECT query_id, slug, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) AS rank FROM t0 QUALIFY rank <= 10)"""


def vector_queries(spark, sf_dir):
    """Every vector whose id is divisible by 100 asks, against all."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def cosine_topk(spark, sf_dir):
    return rank.cosine(vector_queries(spark, sf_dir), table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL_COSINES = """round(coalesce(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) /
  nullif(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 0), 0), 6)"""
SQL_COSINE = f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {SQL_COSINES} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10"""

#: Best full-text score below which the registered questions ask for vectors too.
GATE = 80.0


def question_vectors(spark, sf_dir):
    """(query_id, slug, score): the vector of a question's number against all;
    vector i is document i's."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = questions(spark, sf_dir).join(vectors, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("query"))
    return rank.cosine(asked, vectors).select("query_id", F.concat(F.lit("doc-"), "vec_id").alias("slug"), "score")


def ranked(spark, sf_dir):
    return retrieve.ranked_sources(questions(spark, sf_dir), kept(spark, sf_dir).index, vectors=question_vectors(spark, sf_dir), gate=GATE)


def rrf_hybrid(spark, sf_dir):
    return rank.fuse(ranked(spark, sf_dir))


SQL_RRF = f"""gated AS (SELECT item_id AS query_id FROM benchmark LEFT JOIN bm25 ON query_id = item_id GROUP BY 1 HAVING coalesce(max(score), 0) < {GATE} OR count(score) < 3),
vs AS (SELECT b.item_id AS query_id, 'doc-' || e.vec_id AS slug, {SQL_COSINES} AS score, e.vec_id FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e),
v10 AS (SELECT query_id, slug, score FROM vs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10),
near AS (SELECT query_id, slug, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) AS rank FROM v10 SEMI JOIN gated USING (query_id)),
lists AS (SELECT query_id, 'master_index' AS source, 0 AS p, 1.0 AS w, slug, rank FROM tier0 UNION ALL SELECT query_id, 'fts5', 1, 1.0, slug, rank FROM bm25 UNION ALL SELECT query_id, 'embeddings', 2, 0.8, slug, rank FROM near),
fu AS (SELECT query_id, slug, round(sum(w::DOUBLE / (60 + rank)), 9) AS score, arg_min(source, p) AS source FROM lists GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) AS rank FROM fu QUALIFY rank <= 10)"""


def embedding_gate(spark, sf_dir):
    return rank.embedding_gate(questions(spark, sf_dir), bm25_topk(spark, sf_dir), least=100.0)


def link_table(spark, sf_dir):
    """Document i links to 7 i + 1 and 13 i + 5, modulo the number of documents."""
    docs = table(spark, sf_dir, "documents")
    n = docs.agg((F.max("doc_id") + 1).alias("n"))
    to = lambda a, b: F.concat(F.lit("doc-"), (F.col("doc_id") * a + b) % F.col("n"))
    return docs.crossJoin(F.broadcast(n)).select(
        F.concat(F.lit("doc-"), "doc_id").alias("src"),
        F.explode(F.array(to(7, 1), to(13, 5))).alias("dst"),
    )  # n is one row


SQL_LINKS = """links AS (SELECT 'doc-' || doc_id AS src, 'doc-' || unnest([(doc_id * 7 + 1) % n, (doc_id * 13 + 5) % n]) AS dst FROM documents, (SELECT max(doc_id) + 1 AS n FROM documents))"""


def answers(spark, sf_dir):
    return retrieve.retrieve(questions(spark, sf_dir), kept(spark, sf_dir).documents, link_table(spark, sf_dir), ranked(spark, sf_dir))


def tiered_retrieve(spark, sf_dir):
    return answers(spark, sf_dir).select(
        "query_id",
        "rank",
        "slug",
        "title",
        "score",
        "tier",
        "source",
        F.array_join("categories", ",").alias("categories"),
        F.md5(F.coalesce("snippet", F.lit("")).cast("binary")).alias("snippet_md5"),
    )


def retrieval_reads(spark, sf_dir):
    """What the tiers read for each question, and the deepest tier."""
    return retrieve.bytes_read(answers(spark, sf_dir))


STRUCTURED = "|".join(T.STRUCTURED)

SQL_TIERED = rf"""docs2 AS (SELECT *, len({Q.words('text')}) > 300 AS has_sec, list_transform(concepts, lambda x: lower(x)) AS lc,
  {Q.query_tokens("title || ' ' || summary")} AS st, strlen(concat_ws(' ', title, summary, array_to_string(categories, ' '), array_to_string(concepts, ' '))) AS header FROM described),
asked AS (SELECT item_id AS query_id, list_distinct({Q.query_tokens('text')}) AS kw, regexp_matches(lower(text), '{STRUCTURED}') AS structured FROM benchmark),
f5 AS (SELECT f.query_id, f.slug, f.score AS fused, f.source, a.structured, d.title, d.text, d.summary, d.categories, d.header, 'doc-' || (d.doc_id + 1) AS nxt,
  f.score + 2 * (CASE WHEN len(a.kw) > 0 AND len(d.lc) > 0 THEN len(list_intersect(a.kw, d.lc))::DOUBLE / len(list_distinct(a.kw || d.lc)) ELSE 0 END) AS t1,
  CASE WHEN d.has_sec AND len(a.kw) > 0 AND len(d.st) > 0 THEN len(list_intersect(a.kw, d.st))::DOUBLE / len(list_distinct(a.kw || d.st)) ELSE 0 END AS sec
  FROM fused f JOIN asked a USING (query_id) JOIN docs2 d USING (slug) WHERE f.rank <= 5 AND len(a.kw) > 0),
ans AS (SELECT f.query_id, coalesce(c.slug, f.slug) AS slug, f.title, CASE WHEN f.structured THEN f.summary ELSE trim(left(coalesce(c.text, f.text), 300), chr(32) || chr(9) || chr(10) || chr(13)) END AS snippet,
  CASE WHEN c.slug IS NOT NULL THEN t1 + sec ELSE t1 END AS score, CASE WHEN f.structured THEN 1 WHEN c.slug IS NOT NULL THEN 2 ELSE 3 END AS tier, f.source, f.categories,
  CASE WHEN c.slug IS NOT NULL THEN NULL ELSE fused END AS near, f.header + CASE WHEN f.structured THEN 0 ELSE strlen(coalesce(c.text, f.text)) END AS n_bytes
  FROM f5 f LEFT JOIN corpus c ON c.slug = f.nxt AND f.sec > 0 AND NOT f.structured),
found AS (SELECT * FROM ans
  UNION ALL SELECT f.query_id, f.slug, d.title, d.summary, 0.5 * f.score, 0, f.source, d.categories, f.score, 0 FROM fused f JOIN docs2 d USING (slug) JOIN asked a USING (query_id) ANTI JOIN ans x ON x.query_id = f.query_id AND x.slug = f.slug WHERE f.rank > 5 AND len(a.kw) > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) AS r FROM found QUALIFY r <= 3),
src AS (SELECT b.query_id, l.src, b.slug AS dst, coalesce(b.near, 0.1::DOUBLE) AS near, b.r, row_number() OVER (PARTITION BY b.query_id, b.slug ORDER BY l.src) AS n FROM best b JOIN (SELECT DISTINCT * FROM links) l ON l.dst = b.slug QUALIFY n <= 2),
more AS (SELECT query_id, src AS slug, arg_min(near, r) AS near FROM src s WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.query_id = s.query_id AND f.slug = s.src) GROUP BY 1, 2),
res AS (SELECT query_id, slug, title, snippet, round(score, 6) AS score, tier, source, categories, n_bytes FROM found
  UNION ALL SELECT m.query_id, m.slug, d.title, d.summary, round(0.5 * m.near, 6), 1, 'backlinks', d.categories, d.header FROM more m JOIN docs2 d USING (slug)),
answers AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug, tier) AS rank FROM res QUALIFY rank <= 10)"""


# -- text ------------------------------------------------------------------------


def text_scalars(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        T.word_count(t).alias("n_words"),
        F.size(T.tokenize_query(t)).alias("n_query_tokens"),
        F.size(T.tokenize(t)).alias("n_tokens"),
        F.size(T.sentences(t)).alias("n_sentences"),
        F.md5(T.strip_markdown(t).cast("binary")).alias("plain_md5"),
        F.md5(T.clean(t).cast("binary")).alias("clean_md5"),
        T.truncate(t, 200).alias("truncated"),
        T.content_hash(t).alias("content_hash"),
        T.slug(F.substring(t, 1, 90)).alias("slug"),
        T.heading_slug(F.substring(t, 1, 50)).alias("heading_slug"),
        T.human_size(F.octet_length(t)).alias("size"),
    )


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SQL_SCALARS = rf"""WITH a AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(left(text, 90)), '^\s+|\s+$', '', 'g'), '[\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-{{2,}}', '-', 'g') AS s0,
  regexp_replace(regexp_replace(lower(regexp_replace(left(text, 50), '^#+\s*', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS h, left(text, 200) AS head FROM documents),
b AS (SELECT *, regexp_replace(s0, '^-+|-+$', '', 'g') AS s, 200 - strpos(reverse(head), ' ') AS last FROM a)
SELECT doc_id, len({Q.words('text')})::INT AS n_words, len({Q.query_tokens('text')})::INT AS n_query_tokens, len({Q.tokens('text')})::INT AS n_tokens,
  len(list_filter(string_split(regexp_replace({_STRIP.format("regexp_replace(text, '\\s+', ' ', 'g')")}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> ''))::INT AS n_sentences,
  md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^#{{1,6}}\s+', '', 'g'), '\*{{1,3}}|_{{1,3}}', '', 'g'), '`{{1,3}}', '', 'g'), '(?m)^\s*[-*+]\s', '', 'g'), '(?m)^\s*\d+\.\s', '', 'g')) AS plain_md5,
  md5({_STRIP.format("regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \\t]+$', '', 'g')")}) AS clean_md5,
  CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(CASE WHEN strpos(reverse(head), ' ') > 0 AND last > 100 THEN left(head, last) ELSE head END, '[ .,;:!?]+$', '') || '...' END AS truncated,
  sha256(lower({_STRIP.format('text')})) AS content_hash,
  CASE WHEN s = '' THEN 'untitled' WHEN length(s) <= 60 THEN s WHEN strpos(reverse(left(s, 60)), '-') > 0 AND 60 - strpos(reverse(left(s, 60)), '-') > 0 THEN left(s, 60 - strpos(reverse(left(s, 60)), '-')) ELSE left(s, 60) END AS slug,
  CASE WHEN length(h) <= 30 THEN h WHEN strpos(reverse(left(h, 30)), '-') > 0 AND 30 - strpos(reverse(left(h, 30)), '-') > 0 THEN left(h, 30 - strpos(reverse(left(h, 30)), '-')) ELSE left(h, 30) END AS heading_slug,
  CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' B' WHEN strlen(text) < 1048576 THEN printf('%.1f KB', strlen(text) / 1024.0::DOUBLE) ELSE printf('%.1f MB', strlen(text) / 1048576.0::DOUBLE) END AS size
FROM b"""


def query_classify(spark, sf_dir):
    q = F.concat(
        F.element_at(
            F.array(*[F.lit(x) for x in ("Which file has ", "How many ", "Explain ", "What are the ", "Discount ")]),
            (F.col("query_id") % 5 + 1).cast("int"),
        ),
        "question",
    )
    return user_turns(spark, sf_dir).select("query_id", T.classify(q).alias("kind"), T.query_hash(q).alias("query_hash"))


SQL_CLASSIFY = rf"""WITH q AS (SELECT conv_id * 1000 + turn AS query_id, ['Which file has ', 'How many ', 'Explain ', 'What are the ', 'Discount '][((conv_id * 1000 + turn) % 5 + 1)::INT] || text AS q FROM conversations WHERE role = 'user')
SELECT query_id, CASE WHEN regexp_matches(lower(q), '{STRUCTURED}') THEN 'structured' ELSE 'semantic' END AS kind, sha256(q) AS query_hash FROM q"""


def jaccard_turns(spark, sf_dir):
    """Keyword overlap of each question with the benchmark item of its number."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id"), T.tokenize_query(F.col("text")).alias("b"))
    n = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("n"))
    turns = user_turns(spark, sf_dir).crossJoin(F.broadcast(n))  # one row
    rows = turns.withColumn("item_id", F.col("query_id") % F.col("n")).join(b, "item_id").withColumn("a", T.tokenize_query(F.col("question")))
    return rows.select(
        "query_id",
        "item_id",
        F.round(S.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"),
        F.round(S.partial_match(F.array_distinct("a"), F.array_distinct("b")), 6).alias("partial"),
    )


SQL_JACCARD = f"""WITH b AS (SELECT item_id, list_distinct({Q.query_tokens('text')}) AS b FROM benchmark),
q AS (SELECT conv_id * 1000 + turn AS query_id, list_distinct({Q.query_tokens('text')}) AS a FROM conversations WHERE role = 'user')
SELECT query_id, item_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) ELSE 0 END, 6) AS jaccard,
round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_filter(a, lambda k: len(list_filter(b, lambda t: contains(t, k) OR contains(k, t))) > 0))::DOUBLE / len(a) ELSE 0 END, 6) AS partial
FROM q JOIN b ON item_id = query_id % (SELECT count(*) FROM benchmark)"""


# -- fingerprints ----------------------------------------------------------------


def tf_augmented(spark, sf_dir):
    return fingerprint.term_frequencies(corpus(spark, sf_dir)).select("slug", "token", "n", F.round("tf", 6).alias("tf"))


def keyword_fingerprint(spark, sf_dir):
    return fingerprint.keywords(corpus(spark, sf_dir))


def category_detect(spark, sf_dir):
    return fingerprint.categories(corpus(spark, sf_dir))


def synopsis_sentence(spark, sf_dir):
    return corpus(spark, sf_dir).select("slug", fingerprint.synopsis(F.col("text"), F.col("title")).alias("synopsis"))


def bigram_concepts(spark, sf_dir):
    return fingerprint.bigrams(corpus(spark, sf_dir)).where("n >= 2")


def document_concepts(spark, sf_dir):
    return fingerprint.concepts(corpus(spark, sf_dir))


# -- ingest and store --------------------------------------------------------------


def exact_duplicates(spark, sf_dir):
    return store.mark_duplicates(table(spark, sf_dir, "documents"), "doc_id")


SQL_DUPLICATES = r"""WITH h AS (SELECT doc_id, sha256(lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'))) AS content_hash FROM documents)
SELECT doc_id, content_hash, CASE WHEN doc_id = min(doc_id) OVER w THEN 'created' ELSE 'duplicate' END AS status, min(doc_id) OVER w AS original FROM h WINDOW w AS (PARTITION BY content_hash)"""


def slug_numbering(spark, sf_dir):
    return store.number_slugs(table(spark, sf_dir, "part").select(F.col("p_brand").alias("title"), F.col("p_partkey").alias("ord")))


SQL_SLUGS = """WITH b AS (SELECT p_brand AS title, p_partkey AS ord, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_brand), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part)
SELECT title, ord, s || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '-' || row_number() OVER w END AS slug FROM b WINDOW w AS (PARTITION BY s ORDER BY ord)""".replace("\\\\", "\\")


def upsert_merge(spark, sf_dir):
    """Orders of one in three customers updated, and a copy of each added."""
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slug"), "o_orderstatus", "o_totalprice")
    third = table(spark, sf_dir, "orders").where("o_custkey % 3 = 0").select(
        F.col("o_orderkey").alias("slug"),
        F.lit("U").alias("o_orderstatus"),
        "o_totalprice",
    )
    return store.upsert(old, third.unionByName(third.withColumn("slug", -F.col("slug"))))


SQL_UPSERT = """SELECT o_orderkey AS slug, CASE WHEN o_custkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders
UNION ALL SELECT -o_orderkey, 'U', o_totalprice FROM orders WHERE o_custkey % 3 = 0"""


def delete_cascade(spark, sf_dir):
    """Each order that is divisible by 5 lists the next two as its children."""
    docs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("slug"),
        F.when(
            F.col("o_orderkey") % 5 == 0,
            F.array(F.col("o_orderkey") + 1, F.col("o_orderkey") + 2),
        ).otherwise(F.array().cast("array<bigint>")).alias("children"),
        "o_custkey",
    )
    return store.delete(docs, docs.where("o_custkey % 7 = 0").select("slug")).select("slug", "o_custkey")


SQL_CASCADE = """WITH g AS (SELECT o_orderkey AS slug FROM orders WHERE o_custkey % 7 = 0), k AS (SELECT slug FROM g UNION SELECT unnest([slug + 1, slug + 2]) FROM g WHERE slug % 5 = 0)
SELECT o_orderkey AS slug, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT slug FROM k)"""


def incremental_reindex(spark, sf_dir):
    now = table(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0").select(
        F.col("o_orderkey").alias("slug"),
        F.when(F.col("o_custkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("v"),
    )
    before = table(spark, sf_dir, "orders").where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("slug"), F.col("o_orderstatus").alias("v"))
    return index.changed(index.index_state(now, "slug", "v"), index.index_state(before, "slug", "v"))


SQL_REINDEX = """WITH n AS (SELECT o_orderkey AS slug, CASE WHEN o_custkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS slug, o_orderstatus AS v FROM orders WHERE o_orderkey % 13 <> 0)
SELECT coalesce(n.slug, b.slug) AS slug, CASE WHEN b.slug IS NULL THEN 'created' WHEN n.slug IS NULL THEN 'deleted' ELSE 'updated' END AS status FROM n FULL JOIN b ON n.slug = b.slug WHERE b.slug IS NULL OR n.slug IS NULL OR n.v <> b.v"""


def structured_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("slug"),
        F.array("lang", "source").alias("categories"),
        (F.col("doc_id") % 2 == 0).alias("has_children"),
        T.word_count(F.col("text")).alias("word_count"),
        F.timestamp_seconds(F.col("doc_id") * 7919 % 100003).alias("updated"),
    )
    return store.search(docs, {"category": "fr", "has_children": True, "min_word_count": 100, "unknown": 1}, 20).select("slug", "word_count")


SQL_SEARCH = f"""SELECT doc_id AS slug, len({Q.words('text')})::INT AS word_count FROM documents WHERE (lang = 'fr' OR source = 'fr') AND doc_id % 2 = 0 AND len({Q.words('text')}) >= 100 ORDER BY doc_id * 7919 % 100003 DESC, doc_id LIMIT 20"""


def paginate(spark, sf_dir):
    return store.page(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slug"), "s_name"), 3, 20)


def store_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.array("lang", "source"))))).cast("long").alias("categories"),
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.octet_length("text")).alias("bytes"),
    )


# -- pages and sections ----------------------------------------------------------


def html_to_markdown(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        html.title(h).alias("title"),
        F.md5(html.to_markdown(h).cast("binary")).alias("body_md5"),
        F.size(html.links(h)).alias("n_links"),
    )


def _sql_html() -> str:
    c = r"regexp_replace(html, '(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)\s*>', '', 'g')"
    for n in range(1, 7):
        c = rf"regexp_replace({c}, '(?is)<h{n}\b[^>]*>\s*(.*?)\s*</h{n}\s*>', chr(10) || chr(10) || '{'#' * n} \1' || chr(10) || chr(10), 'g')"
    c = rf"regexp_replace({c}, '(?i)<br\s*/?>', chr(10), 'g')"
    c = rf"regexp_replace({c}, '(?is)<p\b[^>]*>(.*?)</p\s*>', chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g')"
    c = rf"regexp_replace({c}, '(?is)<li\b[^>]*>\s*(.*?)\s*</li\s*>', chr(10) || '- \1', 'g')"
    c = rf"regexp_replace({c}, '(?s)<!--.*?-->|<[^>]+>', '', 'g')"
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{mark}')"
    return c


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '^\s+|\s+$', '', 'g')"
SQL_HTML = rf"""SELECT page_id, nullif(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g'), '') AS title, md5({_CLEAN.format(_sql_html())}) AS body_md5,
len(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']([^"''#]+)', 1)))::INT AS n_links FROM pages"""


def sectioned(spark, sf_dir):
    """Pages as markdown: every third as it is, the others with a heading of the
    second or third level before each paragraph."""
    text = html.to_markdown(F.col("html"))
    headed = lambda mark: F.replace(text, F.lit("\n\n"), F.lit(f"\n\n{mark} Part One\n\n"))
    kind = F.col("page_id") % 3
    return table(spark, sf_dir, "pages").select(
        "page_id",
        html.title(F.col("html")).alias("title"),
        F.when(kind == 1, headed("##")).when(kind == 2, headed("###")).otherwise(text).alias("text"),
    )


_PARTED = "replace(md, chr(10) || chr(10), chr(10) || chr(10) || '{} Part One' || chr(10) || chr(10))"
SQL_SECTIONED = rf"""pm AS (SELECT page_id, nullif(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g'), '') AS title, {Q.clean(_sql_html())} AS md FROM pages),
pt AS (SELECT page_id, title, CASE page_id % 3 WHEN 1 THEN {_PARTED.format('##')} WHEN 2 THEN {_PARTED.format('###')} ELSE md END AS text FROM pm)"""


def page_sections(spark, sf_dir):
    docs = materialise(sectioned(spark, sf_dir).select(F.concat(F.lit("page-"), "page_id").alias("slug"), "text"), "pages")
    _, children = split.split(docs, threshold=60, least=20)
    return children.select(
        "slug",
        "parent",
        F.col("section_index").cast("long").alias("section_index"),
        "title",
        T.word_count(F.col("body")).alias("n_words"),
        F.md5(F.col("body").cast("binary")).alias("body_md5"),
    )


SQL_SECTIONS = f"WITH {SQL_SECTIONED}, ps AS (SELECT 'page-' || page_id AS slug, text FROM pt),\n{Q.sections('ps', 60, 20)}\nSELECT slug, parent, section_index, title, len({Q.words('body')})::INT AS n_words, md5(body) AS body_md5 FROM kids"


# -- graph -----------------------------------------------------------------------


def backlinks_reverse(spark, sf_dir):
    links = link_table(spark, sf_dir)
    return graph.backlinks(links, links.select(F.col("src").alias("slug")).distinct()).groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first"))


SQL_BACKLINKS = f"WITH {SQL_LINKS} SELECT dst AS slug, count(DISTINCT src) AS n, min(src) AS first FROM links WHERE dst IN (SELECT src FROM links) GROUP BY 1"


def related_bfs(spark, sf_dir):
    """From every document whose id is divisible by 100."""
    start = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.concat(F.lit("doc-"), "doc_id").alias("slug"))
    return graph.related(link_table(spark, sf_dir), start, 3)


SQL_BFS = f"""WITH RECURSIVE {SQL_LINKS}, b AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links),
w AS (SELECT 'doc-' || doc_id AS start, 'doc-' || doc_id AS slug, 0 AS hops FROM documents WHERE doc_id % 100 = 0 UNION SELECT start, dst, hops + 1 FROM w JOIN b ON src = slug WHERE hops < 3)
SELECT start, slug, min(hops)::INT AS hops FROM w GROUP BY 1, 2 HAVING min(hops) > 0"""


# -- feedback --------------------------------------------------------------------


def query_log(spark, sf_dir) -> DataFrame:
    """Events as a query log: the type and an hour make the question."""
    e = table(spark, sf_dir, "events")
    sources = F.array(*[F.lit(s) for s in rank.WEIGHTS])
    return e.select(
        F.col("event_id").alias("query_id"),
        F.col("user_id").alias("session"),
        F.concat_ws(
            " ",
            F.lit("please report"),
            "event_type",
            F.concat(F.lit("batch"), (F.col("event_id") % 3).cast("string")),
            F.concat(F.lit("day"), F.dayofmonth("ts").cast("string")),
        ).alias("question"),
        "ts",
        (F.col("event_id") % 4).cast("int").alias("tier_max"),
        F.array(F.get(sources, (F.col("event_id") % 4).cast("int")), F.lit("fts5")).alias("result_sources"),
        F.when(F.col("event_id") % 3 != 0, F.round(F.col("event_id") % 11 / 10.0, 1)).alias("feedback_score"),
        F.lit(None).cast("string").alias("signal_type"),
    )


SQL_LOG = """log AS (SELECT event_id AS query_id, user_id AS session, 'please report ' || event_type || ' batch' || (event_id % 3) || ' day' || day(ts) AS question, ts, event_id % 4 AS tier_max,
  ['master_index', 'fts5', 'embeddings', 'backlinks'][(event_id % 4 + 1)::INT] AS src, CASE WHEN event_id % 3 <> 0 THEN round((event_id % 11) / 10.0::DOUBLE, 1) END AS feedback_score FROM events)"""


def query_log_stats(spark, sf_dir):
    return feedback.statistics(query_log(spark, sf_dir))


def source_win_rates(spark, sf_dir):
    return feedback.win_rates(query_log(spark, sf_dir))


def tier_distribution(spark, sf_dir):
    return feedback.tier_distribution(query_log(spark, sf_dir))


def implicit_signals(spark, sf_dir):
    return feedback.signals(query_log(spark, sf_dir), scale=3600).drop("feedback_at")


SQL_SIGNALS = f"""WITH {SQL_LOG}, r AS (SELECT *, list_distinct({Q.query_tokens('question')}) AS kw, row_number() OVER (PARTITION BY session ORDER BY ts, query_id) AS n FROM log),
p AS (SELECT c.query_id AS by_query_id, p.query_id, p.n, c.question = p.question AS same, epoch(c.ts) - epoch(p.ts) AS gap, len(list_intersect(c.kw, p.kw))::DOUBLE / len(list_distinct(c.kw || p.kw)) AS o
  FROM r c JOIN r p ON c.session = p.session AND c.n - p.n BETWEEN 1 AND 20),
k AS (SELECT *, CASE WHEN same AND gap <= 216000 THEN 'repeat_query' WHEN gap <= 1080000 AND o > 0.6 THEN 'refinement' WHEN gap <= 108000 AND o < 0.2 THEN 'topic_switch' END AS signal_type FROM p)
SELECT query_id, by_query_id, CASE signal_type WHEN 'repeat_query' THEN 0.3 WHEN 'refinement' THEN 0.5 ELSE 0.8 END::DOUBLE AS score, signal_type FROM k WHERE signal_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY by_query_id ORDER BY n DESC) = 1"""


SQL_APPLIED = f"""WITH {SQL_LOG}, found AS ({SQL_SIGNALS.replace(f"WITH {SQL_LOG}, r AS", "WITH r AS")}),
last AS (SELECT f.query_id, f.score, f.signal_type FROM found f JOIN log l ON l.query_id = f.by_query_id QUALIFY row_number() OVER (PARTITION BY f.query_id ORDER BY l.ts DESC, f.by_query_id DESC) = 1)
SELECT query_id, coalesce(score, feedback_score) AS feedback_score, last.signal_type FROM log LEFT JOIN last USING (query_id)"""


def tier_penalty_flagged(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("slug"), (F.col("event_id") % 4).alias("tier"))
    return feedback.flagged(e, rate=0.2, totals=e.groupBy("slug").agg(F.count(F.lit(1)).alias("total")))


SQL_FLAGGED = "SELECT user_id::VARCHAR AS slug, count(*) FILTER (event_id % 4 = 3) AS tier3, count(*) AS total, round(count(*) FILTER (event_id % 4 = 3)::DOUBLE / count(*), 6) AS rate FROM events GROUP BY 1 HAVING rate > 0.2 AND total >= 5 AND tier3 > 0"


def tune_weights(spark, sf_dir):
    return feedback.tune(source_win_rates(spark, sf_dir))


SQL_RATES = "wr AS (SELECT src AS source, count(*) AS wins, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS rate FROM log WHERE feedback_score >= 0.7 GROUP BY 1)"


def rate_limit_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "ts")
    return feedback.rate_limit(e, most=3, seconds=86400).select("event_id", "recent", "allowed")


SQL_RATE_LIMIT = "SELECT event_id, count(*) OVER w AS recent, count(*) OVER w <= 3 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW)"


def url_safety(spark, sf_dir):
    hosts = F.array(*[F.lit(h) for h in (
        "10.1.2.3",
        "8.8.8.8",
        "172.31.255.255",
        "172.32.0.0",
        "192.168.0.1",
        "example.org",
        "localhost",
        "127.0.0.1",
    )])
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.concat(
            F.element_at(F.array(F.lit("http://"), F.lit("ftp://"), F.lit("https://")), (F.col("s_suppkey") % 3 + 1).cast("int")),
            F.element_at(hosts, (F.col("s_suppkey") % 8 + 1).cast("int")),
            F.lit("/a?b=c"),
        ).alias("url"),
    )
    return urls.safe(rows).select("s_suppkey", "host", "ip", "safe")


SQL_URLS = """WITH u AS (SELECT s_suppkey, ['http://', 'ftp://', 'https://'][(s_suppkey % 3 + 1)::INT] AS scheme, ['10.1.2.3', '8.8.8.8', '172.31.255.255', '172.32.0.0', '192.168.0.1', 'example.org', 'localhost', '127.0.0.1'][(s_suppkey % 8 + 1)::INT] AS host FROM supplier),
i AS (SELECT *, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN string_split(host, '.')[1]::BIGINT * 16777216 + string_split(host, '.')[2]::BIGINT * 65536 + string_split(host, '.')[3]::BIGINT * 256 + string_split(host, '.')[4]::BIGINT END AS ip FROM u)
SELECT s_suppkey, host, ip, scheme <> 'ftp://' AND host <> 'localhost' AND NOT coalesce(ip BETWEEN 167772160 AND 184549375 OR ip BETWEEN 2886729728 AND 2887778303 OR ip BETWEEN 3232235520 AND 3232301055 OR ip BETWEEN 2130706432 AND 2147483647, false) AS safe FROM i"""


def schema_validation(spark, sf_dir):
    fields = spark.sql("SELECT * FROM VALUES ('name', 'string', true), ('size', 'int', true), ('price', 'float', false), ('tags', 'list', true) AS t(field_name, field_type, required)")
    p = table(spark, sf_dir, "part")
    extra = F.map_filter(
        F.create_map(
            F.lit("name"),
            F.concat(F.lit('"'), "p_name", F.lit('"')),
            F.lit("size"),
            F.when(F.col("p_size") % 7 == 0, F.lit('"big"')).otherwise(F.col("p_size").cast("string")),
            F.lit("price"),
            F.when(F.col("p_size") % 5 == 0, F.lit("[1]")).otherwise(F.lit("1.5")),
            F.lit("tags"),
            F.when(F.col("p_size") % 3 != 0, F.lit("[]")),
        ),
        lambda _, v: v.isNotNull(),
    )
    return tenancy.validate(p.select(F.col("p_partkey").alias("slug"), extra.alias("extra")), fields)


SQL_VALIDATION = """SELECT p_partkey AS slug, array_to_string(list_sort(list_filter([CASE WHEN p_size % 3 = 0 THEN 'missing required field: tags' END, CASE WHEN p_size % 5 = 0 THEN 'price is no float' END, CASE WHEN p_size % 7 = 0 THEN 'size is no int' END], lambda x: x IS NOT NULL)), '; ') AS errors FROM part"""


def tenant_isolation(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_nationkey") < 20, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("tenant_id"),
    )
    return tenancy.scoped(rows, "n7").unionByName(tenancy.scoped(rows, None)).groupBy(F.coalesce("tenant_id", F.lit("global")).alias("tenant")).agg(F.count(F.lit(1)).alias("n"))


def full_ingest(spark, sf_dir):
    """Pages, some of them twice, through the whole ingest program."""
    pages = sectioned(spark, sf_dir).select(F.col("page_id").alias("ord"), "title", "text")
    again = pages.where("ord % 5 = 0").withColumn("ord", F.col("ord") + 1_000_000)
    pages = materialise(pages.unionByName(again), "pages")
    documents, _ = ingest.ingest(pages, threshold=150)
    listed = lambda c: F.array_join(c, ",").alias(c)
    return documents.select(
        "slug",
        "title",
        "parent",
        "word_count",
        listed("categories"),
        listed("concepts"),
        listed("fingerprint"),
        "summary",
        listed("children"),
        F.md5(F.col("body").cast("binary")).alias("body_md5"),
    )


SQL_INGEST = f"""WITH {SQL_SECTIONED},
pg AS (SELECT page_id AS ord, coalesce(title, 'untitled') AS title, text FROM pt UNION ALL SELECT page_id + 1000000, coalesce(title, 'untitled'), text FROM pt WHERE page_id % 5 = 0),
pf AS (SELECT *, {Q.slug_base('title')} AS b0 FROM pg QUALIFY row_number() OVER (PARTITION BY sha256(lower({Q.strip('text')})) ORDER BY ord) = 1),
pb AS (SELECT ord, title, text, CASE WHEN b0 = '' THEN 'untitled' ELSE {Q.cut_at_hyphen('b0', 60)} END AS b FROM pf),
pn AS (SELECT ord, title, text, b || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '-' || row_number() OVER w END AS slug FROM pb WINDOW w AS (PARTITION BY b ORDER BY ord)),
{Q.sections('pn', 150, 50)},
pl AS (SELECT parent, list(slug ORDER BY section_index) AS children, string_agg('- [[' || slug || ']]', chr(10) ORDER BY section_index) AS links FROM kids GROUP BY 1),
pr AS (SELECT secs.slug, children, {Q.strip(Q.joined('preamble', "'## Sections' || chr(10)", 'links'))} AS body FROM secs JOIN pl ON pl.parent = secs.slug),
corpus AS (SELECT pn.slug, title, coalesce(body, text) AS text, NULL::VARCHAR AS parent, coalesce(children, []) AS children FROM pn LEFT JOIN pr USING (slug) UNION ALL SELECT slug, title, body, parent, [] FROM kids),
{Q.FINGERPRINTS}
SELECT slug, title, parent, len({Q.words('text')})::INT AS word_count, array_to_string(categories, ',') AS categories, array_to_string(concepts, ',') AS concepts, array_to_string(fingerprint, ',') AS fingerprint, summary, array_to_string(children, ',') AS children, md5(text) AS body_md5 FROM described"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


_SEARCH = (SQL_KEPT, SQL_PORTER, SQL_TIER0, SQL_RRF)

QUERIES = {
    "tiered_retrieve": tiered_retrieve,
    "retrieval_reads": retrieval_reads,
    "index_build": index_build,
    "bm25_topk": bm25_topk,
    "bm25_porter_topk": bm25_porter_topk,
    "tier0_keyword_topk": tier0_keyword_topk,
    "cosine_topk": cosine_topk,
    "rrf_hybrid": rrf_hybrid,
    "embedding_gate": embedding_gate,
    "text_scalars": text_scalars,
    "query_classify": query_classify,
    "jaccard_turns": jaccard_turns,
    "tf_augmented": tf_augmented,
    "keyword_fingerprint": keyword_fingerprint,
    "category_detect": category_detect,
    "synopsis_sentence": synopsis_sentence,
    "bigram_concepts": bigram_concepts,
    "document_concepts": document_concepts,
    "exact_duplicates": exact_duplicates,
    "slug_numbering": slug_numbering,
    "upsert_merge": upsert_merge,
    "delete_cascade": delete_cascade,
    "incremental_reindex": incremental_reindex,
    "structured_search": structured_search,
    "paginate": paginate,
    "store_stats": store_stats,
    "html_to_markdown": html_to_markdown,
    "page_sections": page_sections,
    "full_ingest": full_ingest,
    "backlinks_reverse": backlinks_reverse,
    "related_bfs": related_bfs,
    "query_log_stats": query_log_stats,
    "source_win_rates": source_win_rates,
    "tier_distribution": tier_distribution,
    "implicit_signals": implicit_signals,
    "tier_penalty_flagged": tier_penalty_flagged,
    "tune_weights": tune_weights,
    "rate_limit_window": rate_limit_window,
    "url_safety": url_safety,
    "schema_validation": schema_validation,
    "tenant_isolation": tenant_isolation,
    **catalog.QUERIES,
}

ORACLE_SQL = {
    "tiered_retrieve": _with(*_SEARCH, SQL_LINKS, SQL_TIERED) + " SELECT query_id, rank, slug, title, score, tier, source, array_to_string(categories, ',') AS categories, md5(snippet) AS snippet_md5 FROM answers",
    "retrieval_reads": _with(*_SEARCH, SQL_LINKS, SQL_TIERED) + " SELECT query_id, sum(n_bytes)::BIGINT AS n_bytes, max(tier) AS tier_max FROM answers GROUP BY 1",
    "index_build": _with(SQL_KEPT, SQL_PORTER, SQL_WEIGHTS) + " SELECT slug, len(t) AS dl, coalesce(n_terms, 0) AS n_terms, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(n_keywords, 0) AS n_keywords, coalesce(weight, 0)::DOUBLE AS weight FROM bm25t LEFT JOIN (SELECT slug, count(*) AS n_terms, sum(tf) AS n_tokens FROM bm25p GROUP BY 1) USING (slug) LEFT JOIN (SELECT slug, count(*) AS n_keywords, sum(weight) AS weight FROM kwt GROUP BY 1) USING (slug)",
    "bm25_topk": _with(Q.CORPUS, SQL_PLAIN) + " SELECT * FROM plain",
    "bm25_porter_topk": _with(SQL_KEPT, SQL_PORTER) + " SELECT * FROM bm25",
    "tier0_keyword_topk": _with(SQL_KEPT, SQL_TIER0) + " SELECT * FROM tier0",
    "cosine_topk": SQL_COSINE,
    "rrf_hybrid": _with(*_SEARCH) + " SELECT * FROM fused",
    "embedding_gate": _with(Q.CORPUS, SQL_PLAIN) + " SELECT item_id AS query_id, coalesce(max(score), 0) AS best, count(score) AS n_hits, coalesce(max(score), 0) < 100 OR count(score) < 3 AS use_embeddings FROM benchmark LEFT JOIN plain ON query_id = item_id GROUP BY 1",
    "text_scalars": SQL_SCALARS,
    "query_classify": SQL_CLASSIFY,
    "jaccard_turns": SQL_JACCARD,
    "tf_augmented": _with(Q.CORPUS, Q.TF) + " SELECT slug, token, n, round(tf, 6) AS tf FROM tfa",
    "keyword_fingerprint": _with(Q.CORPUS, Q.TF, Q.KEYWORDS) + " SELECT * FROM kf",
    "category_detect": _with(Q.CORPUS, Q.TF, Q.KEYWORDS, Q.CATEGORIES) + " SELECT * FROM ct",
    "synopsis_sentence": _with(Q.CORPUS, Q.synopsis()) + " SELECT * FROM syn",
    "bigram_concepts": _with(Q.CORPUS, Q.BIGRAMS) + " SELECT * FROM bg",
    "document_concepts": _with(Q.CORPUS, Q.BIGRAMS, Q.CONCEPTS) + " SELECT * FROM cc",
    "exact_duplicates": SQL_DUPLICATES,
    "slug_numbering": SQL_SLUGS,
    "upsert_merge": SQL_UPSERT,
    "delete_cascade": SQL_CASCADE,
    "incremental_reindex": SQL_REINDEX,
    "structured_search": SQL_SEARCH,
    "paginate": "SELECT s_suppkey AS slug, s_name FROM supplier ORDER BY 1 LIMIT 20 OFFSET 40",
    "store_stats": "SELECT (SELECT count(DISTINCT c) FROM (SELECT lang AS c FROM documents UNION ALL SELECT source FROM documents)) AS categories, count(*) AS documents, sum(strlen(text))::BIGINT AS bytes FROM documents",
    "html_to_markdown": SQL_HTML,
    "page_sections": SQL_SECTIONS,
    "full_ingest": SQL_INGEST,
    "backlinks_reverse": SQL_BACKLINKS,
    "related_bfs": SQL_BFS,
    "query_log_stats": _with(SQL_LOG) + " SELECT count(*) AS total, count(feedback_score) AS with_feedback, round(avg(feedback_score), 6) AS avg_score FROM log",
    "source_win_rates": _with(SQL_LOG, SQL_RATES) + " SELECT * FROM wr",
    "tier_distribution": _with(SQL_LOG) + " SELECT tier_max::INT AS tier_max, count(*) AS n FROM log GROUP BY 1",
    "implicit_signals": SQL_SIGNALS,
    "tier_penalty_flagged": SQL_FLAGGED,
    "tune_weights": _with(SQL_LOG, SQL_RATES) + ", b AS (SELECT * FROM (VALUES ('master_index', 1.0::DOUBLE), ('fts5', 1.0::DOUBLE), ('embeddings', 0.8::DOUBLE), ('backlinks', 0.3::DOUBLE)) t(source, base)) SELECT source, round(least(3.0, greatest(0.1, 0.7 * least(3.0, greatest(0.1, base * (1 + 0.5 * (coalesce(rate, m) - m)))) + 0.3 * base))::DOUBLE, 6) AS weight FROM b LEFT JOIN wr USING (source), (SELECT avg(rate) AS m FROM wr)",
    "rate_limit_window": SQL_RATE_LIMIT,
    "url_safety": SQL_URLS,
    "schema_validation": SQL_VALIDATION,
    "tenant_isolation": "SELECT CASE WHEN c_nationkey = 7 THEN 'n7' ELSE 'global' END AS tenant, count(*) AS n FROM customer WHERE c_nationkey = 7 OR c_nationkey >= 20 GROUP BY 1",
    "signals_applied": SQL_APPLIED,
    "tuning_gate": _with(SQL_LOG) + " SELECT count(*) FILTER (feedback_score >= 0.7) AS data_points, count(*) FILTER (feedback_score >= 0.7) >= 50 AS enough FROM log",
    **catalog.ORACLE_SQL,
}
