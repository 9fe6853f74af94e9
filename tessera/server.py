"""The engine over HTTP: a WSGI application of the standard library.

Routes answer JSON.  Calls need a key in ``X-API-Key`` once the store has keys;
a key names its tenant, whose own store answers, and may be for reading alone.
Calls beyond the limit of a trailing minute are refused and don't count.  The
application plans and starts jobs; the work is the cluster's.
"""

from __future__ import annotations

import email
import email.policy
import json
import os
import re
import time
from collections import OrderedDict, defaultdict, deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from urllib.parse import parse_qs, unquote

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .durable import clear
from .engine import Engine, tenant
from .operators import tenancy
from .sources import files


@dataclass(frozen=True)
class Settings:
    port: int = 8000
    host: str = "0.0.0.0"
    folder: str = "./knowledge"
    origins: str = "*"
    rate_limit: int = 100
    seconds: int = 60
    tenants: int = 100
    log_level: str = "INFO"
    embeddings: bool = False

    @classmethod
    def from_environment(cls, environment=os.environ) -> Settings:
        """``TESSERA_PORT`` and so on; what isn't set has its default."""
        found = {}
        for name, kind in cls.__annotations__.items():
            value = environment.get(f"TESSERA_{name.upper()}")
            if value is not None:
                found[name] = value.lower() == "true" if kind == "bool" else int(value) if kind == "int" else value
        return cls(**found)


class Refused(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


STATUS = {
    200: "OK",
    201: "Created",
    204: "No Content",
    400: "Bad Request",
    401: "Unauthorized",
    403: "Forbidden",
    404: "Not Found",
    422: "Unprocessable Entity",
    429: "Too Many Requests",
    500: "Internal Server Error",
}


class Limiter:
    """At most ``most`` accepted calls of a key in any trailing ``seconds``."""

    def __init__(self, most: int, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock = most, seconds, clock
        self.recent: dict[str, deque[float]] = defaultdict(deque)

    def allows(self, key: str) -> bool:
        now, held = self.clock(), self.recent[key]
        while held and held[0] <= now - self.seconds:
            held.popleft()
        if len(held) >= self.most:
            return False
        held.append(now)
        return True


def _k(body: dict) -> int | None:
    k = body.get("top_k")
    if k is not None and (not isinstance(k, int) or not 1 <= k <= 100):
        raise Refused(422, "top_k must be from 1 to 100")
    return k


def _need(body: dict, *names: str) -> list:
    missing = [n for n in names if n not in body]
    if missing:
        raise Refused(422, f"missing: {', '.join(missing)}")
    return [body[n] for n in names]


def _rows(df, most: int = 100) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]  # an answer's rows


class App:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, engine: Engine | None = None):
        self.spark, self.settings = spark, settings or Settings.from_environment()
        self.root = engine or Engine(spark, self.settings.folder)
        self.limiter = Limiter(self.settings.rate_limit, self.settings.seconds)
        self.engines: OrderedDict[str, Engine] = OrderedDict()
        none = r"([^/]+)"
        self.routes = [
            ("GET", r"/health", lambda e, b, q: (200, {"status": "ok"})),
            ("POST", r"/ingest", self.ingest),
            ("POST", r"/query", self.query),
            ("POST", r"/search", self.search),
            ("GET", r"/documents", self.documents),
            ("GET", rf"/documents/{none}", self.document),
            ("DELETE", rf"/documents/{none}", self.remove),
            ("POST", r"/reindex", lambda e, b, q: (200, {"message": f"Reindexed {e.reindex(q.get('full') != 'true').count()} documents."})),
            ("GET", r"/stats", self.stats),
            ("POST", r"/feedback", self.feedback),
            ("GET", r"/stats/retrieval", self.retrieval),
            ("GET", r"/stats/flagged", self.flagged),
            ("POST", r"/tune", self.tune),
            ("POST", r"/webhooks", self.add_webhook),
            ("GET", r"/webhooks", lambda e, b, q: (200, _rows(e.webhooks().select("id", "url", "events"), 1000))),
            ("DELETE", rf"/webhooks/{none}", self.drop_webhook),
            ("POST", r"/schema", self.add_field),
            ("GET", r"/schema", lambda e, b, q: (200, _rows(e.fields().drop("tenant_id"), 1000))),
            ("DELETE", rf"/schema/{none}", self.drop_field),
        ]

    # -- who asks

    def engine_of(self, tenant_id: str | None) -> Engine:
        """The tenant's store; those used last are kept open."""
        if not tenant_id or tenant_id == tenancy.GLOBAL:
            return self.root
        if tenant_id not in self.engines:
            self.engines[tenant_id] = tenant(self.spark, self.root.folder, tenant_id, self.root.config)
        self.engines.move_to_end(tenant_id)
        while len(self.engines) > self.settings.tenants:
            self.engines.popitem(last=False)
        return self.engines[tenant_id]

    def admitted(self, key: str | None, method: str) -> Engine:
        if not self.root.tables.has("keys"):
            return self.root  # no keys: open
        if not key:
            raise Refused(401, "Missing API key. Provide X-API-Key header.")
        asked = self.spark.createDataFrame([(1, key, "GET"), (2, key, method)], "request_id int, secret string, method string")
        found = {r["request_id"]: r for r in self.root.verify(asked).collect()}
        if not found[1]["allowed"]:
            raise Refused(403, "Invalid API key.")
        if not self.limiter.allows(key):
            raise Refused(429, "Rate limit exceeded. Try again later.")
        if not found[2]["allowed"]:
            raise Refused(403, "This key is for reading alone.")
        return self.engine_of(found[1]["tenant_id"])

    # -- routes

    def ingest(self, e: Engine, body: dict, _):
        if "_file" in body:
            name, content = body["_file"]
            row = self.spark.createDataFrame([(name, bytearray(content))], "path string, content binary")
            found = files.extract(row)
            if body.get("title"):
                found = found.withColumn("title", F.lit(body["title"]))
            made = e._extracted(found).first()
        else:
            text, title = _need(body, "text", "title")
            made = e.ingest_text(text, title, {str(k): str(v) for k, v in (body.get("metadata") or {}).items()}).first()
        out = made.asDict()
        if out.get("status") != "failed":
            held = e.get(out["slug"]).first()
            out |= {"title": held["title"], "children": list(held["children"]) or None}
        return (400 if out["status"] == "failed" else 201), {k: out.get(k) for k in ("slug", "title", "status", "children", "error")}

    def query(self, e: Engine, body: dict, _):
        (question,) = _need(body, "question")
        began = time.perf_counter()
        found = e.query(question, _k(body)).orderBy("rank")
        rows = _rows(found)
        names = {
            "slug": "slug",
            "title": "title",
            "snippet": "snippet",
            "score": "score",
            "tier": "tier_resolved",
            "categories": "categories",
            "source": "source",
        }
        results = [{new: r[old] for old, new in names.items()} | {"source_file": f"documents/{r['slug']}.md"} for r in rows]
        return 200, {
            "results": results,
            "query": question,
            "total_ms": (time.perf_counter() - began) * 1000,
            "total_bytes_read": sum(r["n_bytes"] or 0 for r in rows),
        }

    def search(self, e: Engine, body: dict, _):
        (text,) = _need(body, "query")
        return 200, [r | {"categories": []} for r in _rows(e.search(text, body.get("filters"), _k(body)))]

    def documents(self, e: Engine, _, q: dict):
        number = lambda name, default: int(q[name]) if re.fullmatch(r"-?\d+", q.get(name, "")) else default
        page, size = max(1, number("page", 1)), max(1, min(100, number("per_page", 20)))
        if not e.tables.has("documents"):
            return 200, {"documents": [], "page": page, "per_page": size, "total": 0}
        return 200, {"documents": _rows(e.documents(page, size)), "page": page, "per_page": size, "total": e.table("documents").count()}

    def _held(self, e: Engine, slug: str):
        row = e.get(slug).first() if e.tables.has("documents") else None
        if row is None:
            raise Refused(404, f"Document '{slug}' not found.")
        return row.asDict(recursive=True)

    def document(self, e: Engine, _, __, slug: str):
        row = self._held(e, slug)
        kept = ("slug", "title", "body", "word_count")
        return 200, {k: row[k] for k in kept} | {
            "has_children": bool(row["children"]),
            "frontmatter": {k: v for k, v in row.items() if k not in kept and v not in (None, "", [], {})},
        }

    def remove(self, e: Engine, _, __, slug: str):
        self._held(e, slug)
        e.delete(slug)
        e.fire(tenancy.GLOBAL, "document.deleted", json.dumps({"slug": slug}))
        return 200, {"message": f"Document '{slug}' deleted."}

    def stats(self, e: Engine, _, __):
        if not e.tables.has("documents"):
            return 200, {"document_count": 0, "index_size_bytes": 0, "categories": []}
        row = e.stats().first()
        categories = e.table("documents").select(F.explode("categories").alias("c")).distinct().orderBy("c")
        return 200, {
            "document_count": row["documents"],
            "index_size_bytes": row["bytes"] or 0,
            "categories": [r["c"] for r in _rows(categories, 1000)],
        }

    def feedback(self, e: Engine, body: dict, _):
        query_id, score = _need(body, "query_id", "score")
        if not isinstance(score, (int, float)) or not 0 <= score <= 1:
            raise Refused(422, "score must be from 0 to 1")
        e.record_feedback(query_id, score)
        return 200, {"message": "Feedback recorded."}

    def retrieval(self, e: Engine, _, __):
        if not e.tables.has("query_log"):
            return 200, {"total_queries": 0, "feedback_rate": 0.0, "avg_score": None, "source_win_rates": {}, "tier_distribution": {}}
        found = e.retrieval_stats()
        row = found["totals"].first()
        return 200, {
            "total_queries": row["total"],
            "feedback_rate": row["with_feedback"] / row["total"] if row["total"] else 0.0,
            "avg_score": row["avg_score"],
            "source_win_rates": {r["source"]: r["rate"] for r in _rows(found["sources"])},
            "tier_distribution": {str(r["tier_max"]): r["n"] for r in _rows(found["tiers"])},
        }

    def flagged(self, e: Engine, _, __):
        found = e.flagged()
        return 200, {"flagged_documents": [] if found is None else [r["slug"] for r in _rows(found.orderBy("slug"), 1000)]}

    def tune(self, e: Engine, _, __):
        made = e.tune_now()
        return 200, {"weights": made, "status": "ok" if made else "insufficient_data"}

    def add_webhook(self, e: Engine, body: dict, _):
        url, events, secret = _need(body, "url", "events", "secret")
        try:
            own = e.put_webhook(url, events, secret)
        except ValueError as x:
            raise Refused(400, str(x)) from x
        return 201, {"id": own, "url": url, "events": events}

    def drop_webhook(self, e: Engine, _, __, own: str):
        if e.webhooks().where(F.col("id") == own).isEmpty():
            raise Refused(404, f"Webhook '{own}' not found.")
        e.drop_webhook(own)
        return 200, {"message": f"Webhook '{own}' removed."}

    def add_field(self, e: Engine, body: dict, _):
        name, kind = _need(body, "field_name", "field_type")
        if kind not in ("string", "int", "float", "bool", "list"):
            raise Refused(400, f"unknown field type: {kind}")
        e.put_field(name, kind, bool(body.get("required")))
        return 201, {"field_name": name, "field_type": kind, "required": bool(body.get("required"))}

    def drop_field(self, e: Engine, _, __, name: str):
        if e.fields().where(F.col("field_name") == name).isEmpty():
            raise Refused(404, f"Field '{name}' not found.")
        e.drop_field(name)
        return 200, {"message": f"Field '{name}' removed."}

    # -- WSGI

    def _body(self, env: dict) -> dict:
        raw = env["wsgi.input"].read(int(env.get("CONTENT_LENGTH") or 0))
        kind = env.get("CONTENT_TYPE", "")
        if kind.startswith("multipart/form-data"):
            parsed = email.message_from_bytes(b"Content-Type: " + kind.encode() + b"\r\n\r\n" + raw, policy=email.policy.HTTP)
            out: dict = {}
            for part in parsed.iter_parts():
                name, content = part.get_param("name", header="content-disposition"), part.get_payload(decode=True)
                out |= {"_file": (part.get_filename() or "upload.txt", content)} if name == "file" else {name: content.decode()}
            return out
        if not raw:
            return {}
        try:
            found = json.loads(raw)
        except ValueError as x:
            raise Refused(400, "the body is no JSON") from x
        if not isinstance(found, dict):
            raise Refused(400, "the body is no JSON object")
        return found

    def answer(self, env: dict) -> tuple[int, object]:
        method, path = env["REQUEST_METHOD"], env.get("PATH_INFO", "/").rstrip("/") or "/"
        if method == "OPTIONS":
            return 204, None
        for verb, pattern, handle in self.routes:
            found = re.fullmatch(pattern, path) if verb == method else None
            if found:
                e = self.root if path == "/health" else self.admitted(env.get("HTTP_X_API_KEY"), method)
                query = {k: v[-1] for k, v in parse_qs(env.get("QUERY_STRING", "")).items()}
                return handle(e, self._body(env), query, *map(unquote, found.groups()))
        raise Refused(404, "no such route")

    def __call__(self, env: dict, start: Callable) -> Iterable[bytes]:
        try:
            status, out = self.answer(env)
        except Refused as x:
            status, out = x.status, {"detail": x.detail}
        except Exception as x:  # noqa: BLE001  a failed call is an answer
            status, out = 500, {"detail": f"{type(x).__name__}: {x}"}
        clear()  # the answer has been read: what was written for it can go
        body = b"" if out is None else json.dumps(out, default=str, ensure_ascii=False).encode()
        headers = [("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(body)))]
        headers += [
            ("Access-Control-Allow-Origin", self.settings.origins),
            ("Access-Control-Allow-Methods", "*"),
            ("Access-Control-Allow-Headers", "*"),
        ]
        start(f"{status} {STATUS[status]}", headers)
        return [body]


def serve(spark: SparkSession, settings: Settings | None = None) -> None:
    from wsgiref.simple_server import make_server

    app = App(spark, settings)
    spark.sparkContext.setLogLevel(app.settings.log_level)
    make_server(app.settings.host, app.settings.port, app).serve_forever()
