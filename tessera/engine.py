"""The façade: a store of documents in a folder, with ingest, query, feedback.

All of it lives in the folder (``tables``): another process that opens it
answers from the same documents and the same index.  Ingest and deletion change
the index for the documents they touch; a batch of questions reads the index and
the few documents it answers with, never the corpus.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import materialise
from .functions import text as T
from .operators import control, feedback, fingerprint, graph, index, rank, store, tenancy
from .plans import bundle, indexes, ingest, retrieve
from .sources import files, html, urls
from .tables import Tables

#: Hooks: url -> (content type, bytes); texts -> vectors; text, title -> summary.
Fetcher = Callable[[str], tuple[str, bytes]]
Embedder = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Config:
    """Settings; those in the store's ``config.json`` stand where the caller gives
    none.  tier0_cache_size and obsidian_compat are accepted and mean nothing
    here: the index is a table, and notes are always plain markdown."""

    split_threshold: int = 2000
    synopsis_mode: str = "extractive"
    llm_provider: str | None = None
    llm_api_key: str | None = None
    embeddings: bool = False
    fts5: bool = True
    tier0_cache_size: int = 50_000
    max_results: int = 10
    obsidian_compat: bool = True
    ranking_weights: dict[str, float] = field(default_factory=lambda: dict(rank.WEIGHTS))
    self_tuning: bool = False
    feedback: bool = True
    feedback_anonymize: bool = False
    tune_interval: int = 100

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Config:
        path = f"{folder.rstrip('/')}/config.json"
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return cls()
        try:
            found = json.loads(spark.read.text(path, wholetext=True).first()[0])
        except ValueError:
            return cls()  # a damaged file counts as none
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in found.items() if k in known})


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        config: Config | None = None,
        fetch: Fetcher | None = None,
        embed: Embedder | None = None,
        summarise: Callable | None = None,
        taxonomy: dict | None = None,
    ):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.config = config or Config.read(spark, self.folder)
        self.fetch, self.embed, self.taxonomy = fetch, embed, taxonomy
        if self.config.synopsis_mode == "llm" and summarise is None:
            raise ValueError("synopsis_mode llm needs a summarise function")
        self.summarise = summarise or fingerprint.synopsis
        self.tables = Tables(spark, self.folder)

    @property
    def weights(self) -> dict[str, float]:
        tuned = self.tables.now.values.get("weights") or {}
        return {source: tuned.get(source, weight) for source, weight in self.config.ranking_weights.items()}

    def table(self, name: str) -> DataFrame | None:
        return self.tables.read(name)

    # -- documents

    def ingest(self, path: str) -> DataFrame:
        """All files under ``path``: ord (the path), slug, status, error."""
        found = materialise(files.read(self.spark, path), "files")
        return self._extracted(found)

    def _extracted(self, found: DataFrame) -> DataFrame:
        rows = found.where("status = 'extracted'").select(F.col("path").alias("ord"), "title", "text", "metadata")
        done = self.ingest_rows(rows)
        return found.select(
            F.col("path").alias("ord"),
            F.when(F.col("status") == "failed", "failed").alias("_f"),
            "error",
        ).join(done, "ord", "left").select("ord", "slug", F.coalesce("_f", "status").alias("status"), "error")

    def ingest_text(self, text: str, title: str | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
        row = (uuid.uuid4().hex, title, text, metadata or {})
        return self.ingest_rows(self.spark.createDataFrame([row], "ord string, title string, text string, metadata map<string,string>"))

    def ingest_url(self, url: str) -> DataFrame:
        """A page, by the caller's ``fetch``; hosts inside are refused."""
        asked = self.spark.createDataFrame([(url,)], "url string")
        if not urls.safe(asked).first()["safe"]:
            return self.spark.createDataFrame([(url, None, "failed", "blocked address")], "ord string, slug string, status string, error string")
        if self.fetch is None:
            raise RuntimeError("no fetch function was given: nothing here reaches the network")
        try:
            kind, body = self.fetch(url)
        except Exception as e:  # noqa: BLE001  a page that can't be fetched is a failed row
            return self.spark.createDataFrame(
                [(url, None, "failed", f"{type(e).__name__}: {e}")],
                "ord string, slug string, status string, error string",
            )
        kinds = {"application/pdf": "pdf", "text/html": "html", "application/xhtml+xml": "html"}
        extension = kinds.get(kind.partition(";")[0].strip().lower(), "txt" if kind.startswith("text/") else None)
        if extension is None:
            return self.spark.createDataFrame(
                [(url, None, "failed", f"unsupported content type: {kind}")],
                "ord string, slug string, status string, error string",
            )
        page = self.spark.createDataFrame([(f"{url}#.{extension}", bytearray(body))], "path string, content binary")
        found = files.extract(page).withColumn("path", F.lit(url))
        if extension == "html":
            more = html.page_metadata(F.col("_raw"))
            raw = self.spark.createDataFrame([(bytes(body).decode("utf-8", "replace"),)], "_raw string")
            found = found.crossJoin(F.broadcast(raw)).withColumn("_m", more)  # one row each
            described = F.map_filter(
                F.create_map(
                    F.lit("source"),
                    F.lit(url),
                    F.lit("description"),
                    F.col("_m.description"),
                    F.lit("canonical_url"),
                    F.col("_m.canonical_url"),
                    F.lit("created"),
                    F.col("_m.publish_date"),
                ),
                lambda _, v: v.isNotNull(),
            )
            found = found.withColumn("metadata", described).drop("_raw", "_m")
        return self._extracted(materialise(found, "page"))

    def ingest_rows(self, rows: DataFrame) -> DataFrame:
        """Rows (ord, title, text, perhaps metadata): ord, slug, status of each.
        Texts that are in the store already, or twice in the rows, are duplicates."""
        old, hashes = self.table("documents"), self.table("hashes")
        if "metadata" not in rows.columns:
            rows = rows.withColumn("metadata", F.create_map().cast("map<string,string>"))
        rows = materialise(rows.select("ord", "title", F.coalesce("text", F.lit("")).alias("text"), "metadata"), "rows")
        seen = None
        if hashes is not None:
            known = store.mark_duplicates(rows, "ord", known=hashes)
            seen = materialise(known.join(hashes, "content_hash").select("ord", "slug", "status"), "seen")
            rows = rows.join(seen.select("ord"), "ord", "left_anti")
        documents, results = ingest.ingest(rows, self.config.split_threshold, old, self.taxonomy, self.summarise)
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        results = materialise(results, "results")
        given = results.where("slug IS NOT NULL").select("ord", "slug").join(rows.select("ord", "metadata"), "ord").select("slug", "metadata")
        documents = documents.join(given, "slug", "left").withColumn(
            "created",
            F.coalesce(F.try_element_at("metadata", F.lit("created")), now),
        ).withColumn("updated", now)
        documents = materialise(documents, "documents")
        first = results.where("status <> 'duplicate'").select("ord", "slug")
        hashed = rows.select("ord", T.content_hash(F.col("text")).alias("content_hash")).join(first, "ord").select("content_hash", "slug")
        self.tables.commit(append={"documents": documents, "hashes": hashed, **self._derived(documents)})
        return results if seen is None else results.unionByName(seen)

    def _derived(self, documents: DataFrame) -> dict[str, DataFrame]:
        made = ingest.derive_indexes(documents)
        for name, term in (("postings", "term"), ("weights", "token")):
            made[name] = rank.with_bucket(made[name], term)
        if self.embed is not None and self.config.embeddings:
            made["vectors"] = self._embedded(documents)
        return made

    def _embedded(self, documents: DataFrame) -> DataFrame:
        """(slug, embedding) of each document's first 512 words; empty texts have none."""
        texts = documents.select("slug", T.first_words(F.col("body"), 512).alias("text")).where("text <> ''")
        return self.embed(texts, "slug").select("slug", "embedding")

    def put_vectors(self, vectors: DataFrame) -> None:
        """(slug, embedding) of documents, made elsewhere; older ones are replaced."""
        old = self.table("vectors")
        new = vectors.select("slug", "embedding")
        self.tables.commit(replace={"vectors": new if old is None else old.join(new.select("slug"), "slug", "left_anti").unionByName(new)})

    def get(self, slug: str) -> DataFrame:
        return self.table("documents").where(F.col("slug") == slug)

    def update(self, changed: DataFrame) -> None:
        """New bodies (slug, body) of documents; what is derived follows."""
        old = self.table("documents").join(changed.select("slug", F.col("body").alias("_body")), "slug")
        fresh = old.withColumn("text", F.coalesce("_body", F.lit(""))).withColumn("existing_categories", F.col("categories"))
        fresh = ingest.describe(fresh.drop("body", "_body", "fingerprint", "concepts", "summary", "categories"), self.taxonomy, self.summarise)
        fresh = fresh.withColumn("word_count", T.word_count(F.col("text"))).withColumnRenamed("text", "body").withColumn(
            "updated",
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        )
        fresh = materialise(fresh, "updated")
        hashed = fresh.select(T.content_hash(F.col("body")).alias("content_hash"), "slug")
        vectors = self.table("vectors")
        kept = {} if vectors is None or (self.embed is not None and self.config.embeddings) else {"vectors": vectors.join(fresh.select("slug"), "slug", "left_semi")}
        self.tables.commit(append={"documents": fresh, "hashes": hashed, **self._derived(fresh), **kept}, gone=fresh.select("slug"))

    def delete(self, slug: str) -> bool:
        """A document and the sections it lists; whether there was one."""
        docs = self.table("documents")
        own = docs.where(F.col("slug") == slug)
        if own.isEmpty():
            return False
        gone = own.select("slug").unionByName(own.select(F.explode("children").alias("slug")))
        self.tables.commit(gone=materialise(gone, "gone"))
        return True

    def documents(self, page: int = 1, size: int = 20) -> DataFrame:
        return store.page(self.table("documents").select("slug", "title", "summary"), page, size)

    def reindex(self, incremental: bool = True) -> DataFrame:
        """(slug, status) of documents whose index is not that of their content;
        their index rows are made anew (all of them if not ``incremental``)."""
        docs = self.table("documents")
        state = materialise(index.index_state(docs, "slug", "title", "body"), "state")
        before = self.table("index_state")
        diff = state.select("slug", F.lit("created").alias("status")) if before is None or not incremental else index.changed(state, before)
        diff = materialise(diff, "changes")
        if not diff.isEmpty():
            touched = materialise(docs.join(diff.select("slug"), "slug", "left_semi"), "reindexed")
            hashes, vectors = self.table("hashes"), self.table("vectors")
            same = {
                name: materialise(t.join(diff.select("slug"), "slug", "left_semi"), name) for name,
                t in (("hashes", hashes), ("vectors", vectors)) if t is not None
            }
            self.tables.commit(append={**same, "documents": touched, **{k: v for k, v in self._derived(touched).items()}}, gone=diff.select("slug"))
        return diff

    # -- questions

    def index(self) -> indexes.Index:
        return indexes.Index(*(self.table(n) for n in ("postings", "weights", "lengths")))

    def query(self, questions: DataFrame | str, k: int | None = None, session: str = "", vectors: DataFrame | None = None) -> DataFrame:
        """Answers to a batch of questions (query_id, question), or to one.
        ``vectors`` (query_id, query) are the questions' own, where the engine
        embeds none itself; questions are logged if the settings say so."""
        if isinstance(questions, str):
            questions = self.spark.createDataFrame([(uuid.uuid4().int >> 65, questions)], "query_id long, question string")
        if not self.tables.has("documents"):
            return retrieve.nothing(self.spark)
        k = store.bounded_k(k, self.config.max_results)
        found = materialise(
            retrieve.retrieve(questions, self.table("documents"), self.table("links"), self._ranked(questions, k, vectors), k, self.weights),
            "answers",
        )
        if self.config.feedback:
            self._logged(questions, found, session)
        return found

    def _ranked(self, questions: DataFrame, k: int, vectors: DataFrame | None) -> DataFrame:
        near, known = None, self.table("vectors") if self.config.embeddings else None
        if known is not None and vectors is None and self.embed is not None:
            vectors = self.embed(
                questions.select("query_id", F.col("question").alias("text")),
                "query_id",
            ).select("query_id", F.col("embedding").alias("query"))
        if known is not None and vectors is not None:
            numbers = materialise(known.withColumn("vec_id", F.monotonically_increasing_id()), "vectors")
            near = rank.cosine(vectors, numbers.select("vec_id", "embedding"), k).join(numbers.select("vec_id", "slug"), "vec_id").where("score > 0").select("query_id", "slug", "score")
        out = retrieve.ranked_sources(questions, self.index(), k, vectors=near)
        return out if self.config.fts5 else out.where("source <> 'fts5'")

    def search(self, text: str = "", filters: dict | None = None, k: int | None = None) -> DataFrame:
        """(slug, title, summary, score): by full text, or by filters alone."""
        k = store.bounded_k(k, self.config.max_results)
        docs = self.table("documents")
        if filters:
            docs = docs.withColumn("has_children", F.size("children") > 0)
            return store.search(docs, filters, k).select("slug", "title", "summary", F.lit(0.0).alias("score"))
        questions = self.spark.createDataFrame([(0, text)], "query_id long, question string")
        tables = self.index()
        found = materialise(rank.bm25(questions, tables.postings, tables.stats(), "slug", k, stemmed=True), "hits")
        return docs.select("slug", "title", "summary").join(F.broadcast(found.select("slug", "score", "rank")), "slug").orderBy("rank").drop("rank")  # k rows

    def snippets(self, text: str, k: int | None = None) -> DataFrame:
        """Search with the words around the hits."""
        hits = materialise(self.search(text, k=k).select("slug", "score"), "hits")
        terms = F.array(*[F.lit(t) for t in self._terms(text)]) if self._terms(text) else F.array().cast("array<string>")
        return self.table("documents").join(F.broadcast(hits), "slug").select(
            "slug",
            "score",
            T.snippet(F.col("body"), terms).alias("snippet"),
        )  # k rows

    def _terms(self, text: str) -> list[str]:
        row = self.spark.createDataFrame([(text,)], "q string")
        return row.select(T.full_text_tokens(F.array_join(T.sanitize(F.col("q")), " "))).first()[0]

    def _one(self, slug: str) -> DataFrame:
        return self.spark.createDataFrame([(slug,)], "slug string")

    def related(self, slug: str, depth: int = 2) -> DataFrame:
        found = graph.related(self.table("links"), self._one(slug), depth)
        return found.join(self.table("documents").select("slug"), "slug", "left_semi")

    def backlinks(self, slug: str) -> DataFrame:
        return graph.backlinks(self.table("links"), self._one(slug))

    def forward_links(self, slug: str) -> DataFrame:
        return graph.forward_links(self.table("links"), self._one(slug))

    # -- feedback

    def _logged(self, questions: DataFrame, found: DataFrame, session: str) -> None:
        reads = retrieve.bytes_read(found)
        sources = found.groupBy("query_id").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "source", "slug"))),
            lambda x: x["source"],
        ).alias("result_sources"))  # k rows each
        text = T.query_hash(F.col("question")) if self.config.feedback_anonymize else F.col("question")
        none = F.array().cast("array<string>")
        log = questions.join(reads, "query_id", "left").join(sources, "query_id", "left").select(
            F.col("query_id").cast("long").alias("query_id"), F.lit(session).alias("session"), text.alias("question"), T.query_hash(F.col("question")).alias("query_hash"), F.current_timestamp().alias("ts"),
            F.coalesce("tier_max", F.lit(0)).cast("int").alias("tier_max"), F.coalesce("result_sources", none).alias("result_sources"), F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"),
        )
        log = materialise(log, "log")
        tiers = found.where("tier = 3").select("slug", "tier", F.col("query_id").cast("long").alias("query_id"))
        count = self.tables.now.values.get("queries", 0) + log.count()
        values = {"queries": count}
        each = self.config.tune_interval
        self.tables.commit(append={"query_log": log, "tier_events": tiers}, values=values)
        if not self.config.feedback_anonymize:
            self._signalled(session)
        if self.config.self_tuning and each and count // each > (count - log.count()) // each:
            self.tune_now()

    def _signalled(self, session: str) -> None:
        """What the session's last questions say about those before them."""
        log = self.log().where(F.col("session") == session).orderBy(F.desc("ts"), F.desc("query_id")).limit(2 * feedback.MEMORY)
        found = feedback.signals(log).select("query_id", "score", "signal_type", F.col("feedback_at").alias("at"), "by_query_id")
        known = self.table("feedback")
        if known is not None:
            found = found.join(known.select("query_id", "by_query_id"), ["query_id", "by_query_id"], "left_anti")
        found = materialise(found, "signals")
        if not found.isEmpty():
            self.tables.commit(append={"feedback": found})

    def record_feedback(self, query_id: int, score: float) -> None:
        """A reader's own score of a query; the latest word on it stands."""
        row = self.spark.range(1).select(
            F.lit(query_id).cast("long").alias("query_id"),
            F.lit(float(score)).alias("score"),
            F.lit("explicit").alias("signal_type"),
            F.current_timestamp().alias("at"),
            F.lit(query_id).cast("long").alias("by_query_id"),
        )
        self.tables.commit(append={"feedback": row})

    def log(self) -> DataFrame | None:
        """The queries with what is known of how good their answers were."""
        log, found = self.table("query_log"), self.table("feedback")
        if log is None:
            return None
        log = log.withColumn("feedback_score", F.lit(None).cast("double")).withColumn("signal_type", F.lit(None).cast("string"))
        return log if found is None else feedback.apply_signals(log, found.withColumnRenamed("at", "feedback_at"))

    def retrieval_stats(self) -> dict[str, DataFrame]:
        log = self.log()
        return {"totals": feedback.statistics(log), "sources": feedback.win_rates(log), "tiers": feedback.tier_distribution(log)}

    def flagged(self, rate: float = 0.5, least: int = 5) -> DataFrame | None:
        """Documents whose answers mostly took their full text."""
        events = self.table("tier_events")
        return None if events is None else feedback.flagged(events, least, rate)

    def tune_now(self) -> dict[str, float] | None:
        log = self.log()
        if log is None or not feedback.tuning_gate(log).first()["enough"]:
            return None
        rows = feedback.tune(feedback.win_rates(log), self.weights, self.config.ranking_weights).collect()  # a row for each source
        made = {r["source"]: r["weight"] for r in rows}
        if made:
            self.tables.commit(values={"weights": made})
            self.fire(tenancy.GLOBAL, "weights_updated", json.dumps({"weights": made}, sort_keys=True))
        return made or None

    def stats(self) -> DataFrame:
        docs = self.table("documents")
        return docs.agg(
            F.count(F.lit(1)).alias("documents"),
            F.size(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories"),
            F.sum(F.octet_length("body")).alias("bytes"),
        )

    # -- control plane

    def _changed(self, name: str, change: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
        now = self.table(name)
        made = materialise(change(self.spark.createDataFrame([], schema) if now is None else now), name)
        self.tables.commit(replace={name: made})
        return made

    def create_key(self, tenant_id: str = tenancy.GLOBAL, read_only: bool = False) -> str:
        secret, row = control.create_key(self.spark, tenant_id, read_only)
        self._changed("keys", lambda keys: keys.unionByName(row), control.KEYS)
        return secret

    def keys(self, tenant_id: str | None = None) -> DataFrame:
        rows = self._listed("keys", control.KEYS).select("tenant_id", "key_id", "read_only", "revoked")
        return rows if tenant_id is None else rows.where(F.col("tenant_id") == tenant_id)

    def revoke_key(self, key_id: str) -> None:
        self._changed("keys", lambda keys: control.revoke_key(keys, key_id), control.KEYS)

    def verify(self, requests: DataFrame) -> DataFrame:
        return control.verify(requests, self._listed("keys", control.KEYS))

    def _listed(self, name: str, schema: str) -> DataFrame:
        found = self.table(name)
        return self.spark.createDataFrame([], schema) if found is None else found

    def put_webhook(self, url: str, events: list[str], secret: str = "", tenant_id: str = tenancy.GLOBAL) -> str:
        wrong = sorted(set(events) - set(control.EVENTS))
        if wrong:
            raise ValueError(f"unknown events: {', '.join(wrong)}")
        own = uuid.uuid4().hex
        row = self.spark.createDataFrame([(tenant_id, own, url, events, secret)], control.WEBHOOKS)
        self._changed("webhooks", lambda hooks: hooks.unionByName(row), control.WEBHOOKS)
        return own

    def webhooks(self, tenant_id: str = tenancy.GLOBAL) -> DataFrame:
        return self._listed("webhooks", control.WEBHOOKS).where(F.col("tenant_id") == tenant_id).drop("secret")

    def drop_webhook(self, id_: str) -> None:
        self._changed("webhooks", lambda hooks: hooks.where(F.col("id") != id_), control.WEBHOOKS)

    def fire(self, tenant_id: str, event: str, payload: str) -> DataFrame | None:
        """Deliveries due for an event: queued, signed; a sender reads the queue."""
        if not self.tables.has("webhooks"):
            return None
        events = self.spark.createDataFrame([(tenant_id, event, payload)], "tenant_id string, event string, payload string")
        due = materialise(control.deliveries(events, self.table("webhooks")), "deliveries")
        self.tables.commit(append={"deliveries": due})
        return due

    def put_field(self, field_name: str, field_type: str, required: bool = False, tenant_id: str = tenancy.GLOBAL) -> None:
        row = self.spark.createDataFrame([(tenant_id, field_name, field_type, required)], control.FIELDS)
        self._changed("fields", lambda known: control.put_field(known, row), control.FIELDS)

    def drop_field(self, field_name: str, tenant_id: str = tenancy.GLOBAL) -> None:
        self._changed("fields", lambda known: control.drop_field(known, tenant_id, field_name), control.FIELDS)

    def fields(self, tenant_id: str = tenancy.GLOBAL) -> DataFrame:
        return self._listed("fields", control.FIELDS).where(F.col("tenant_id") == tenant_id)

    # -- bundles

    def export(self, folder: str, vectors: bool = True) -> DataFrame:
        return bundle.export(self.table("documents"), folder, self.table("vectors") if vectors else None)

    def load(self, folder: str) -> int:
        """The documents of a bundle, in place of the store's; hashes and index
        are made anew."""
        found = bundle.load(self.spark, folder)
        documents = found["documents"]
        hashed = documents.where("parent IS NULL AND size(children) = 0").select(T.content_hash(F.col("body")).alias("content_hash"), "slug")
        made = {"documents": documents, "hashes": hashed, **self._derived(documents)}
        if "embeddings" in found:
            made["vectors"] = found["embeddings"]
        old = self.table("documents")
        self.tables.commit(replace=made, gone=None if old is None else old.select("slug"))
        return self.table("documents").count()


def settings(config: Config) -> dict:
    return asdict(config)


def tenant(spark: SparkSession, folder: str, name: str | None, config: Config | None = None) -> Engine:
    """A tenant's own store, beside the others."""
    own = hashlib.sha256((name or tenancy.GLOBAL).encode()).hexdigest()[:16]
    return Engine(spark, f"{folder.rstrip('/')}/tenants/{own}", config)


def sign(payload: bytes, secret: str) -> str:
    """HMAC of a webhook's payload."""
    return hmac.new(secret.encode(), payload, hashlib.sha256).hexdigest()
