"""Command line: ``python -m tessera.cli COMMAND ... --store FOLDER``.

A store is opened, not built: what was ingested before is there.  Pages are
fetched by the standard library, from hosts that aren't inside.
"""

from __future__ import annotations

import argparse
import json
import urllib.request
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import server
from .durable import clear
from .engine import Engine
from .sources import urls

STORE = "./knowledge"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, under=sub, **options) -> argparse.ArgumentParser:
        c = under.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        c.add_argument("--store", default=STORE)
        for option, settings in options.items():
            c.add_argument(f"--{option.replace('_', '-')}", **settings)
        return c

    command("ingest", "path")
    command("ingest-url", "url")
    command("query", "question", top_k={"type": int, "default": 5})
    command("search", "query", top_k={"type": int, "default": 10}, filters={"type": json.loads, "default": None})
    command("stats", feedback={"action": "store_true"})
    command("tune")
    command("flagged")
    command("reindex", full={"action": "store_true"})
    command("export", "output_path", no_embeddings={"action": "store_true"})
    command("import", "bundle_path")
    command("serve", host={"default": "127.0.0.1"}, port={"type": int, "default": 8000})
    keys = sub.add_parser("api-key").add_subparsers(dest="action", required=True)
    command("create", "name", under=keys, read_only={"action": "store_true"})
    command("list", under=keys)
    command("revoke", "name", under=keys)
    return p


class _Watched(urllib.request.HTTPRedirectHandler):
    """Redirects, five at most, to hosts that aren't inside."""

    max_redirections = 5

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if not urls.outside(newurl):
            raise ValueError("redirected to a blocked address")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def fetch(url: str) -> tuple[str, bytes]:
    """(content type, bytes) of a page; names are resolved and looked at first."""
    if not urls.outside(url):
        raise ValueError("blocked address")
    with urllib.request.build_opener(_Watched).open(url, timeout=10) as page:
        return page.headers.get("Content-Type", "text/plain"), page.read()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    if a.command == "serve":
        server.serve(spark, replace(server.Settings.from_environment(), folder=a.store, host=a.host, port=a.port))
        return 0
    e = Engine(spark, a.store, fetch=fetch)
    show = lambda df, n=20: df.show(n, truncate=80)
    if a.command == "ingest":
        show(e.ingest(a.path), 100)
    elif a.command == "ingest-url":
        show(e.ingest_url(a.url))
    elif a.command == "import":
        print(e.load(a.bundle_path), "documents")
    elif a.command == "api-key" and a.action == "create":
        print(e.create_key(a.name, a.read_only))
    elif a.command == "api-key" and a.action == "list":
        show(e.keys())
    elif a.command == "api-key":
        for r in e.keys(a.name).collect():  # one tenant's keys
            e.revoke_key(r["key_id"])
    elif not e.tables.has("documents"):
        print("the store is empty")
        return 1
    elif a.command == "query":
        show(e.query(a.question, a.top_k).orderBy("rank").select("rank", "slug", "title", F.col("score"), "tier", "snippet"), a.top_k)
    elif a.command == "search":
        show(e.search(a.query, a.filters, a.top_k), a.top_k)
    elif a.command == "stats":
        show(e.stats())
        if a.feedback and e.tables.has("query_log"):
            for df in e.retrieval_stats().values():
                show(df)
    elif a.command == "tune":
        print(json.dumps(e.tune_now()))
    elif a.command == "flagged":
        found = e.flagged()
        print("nothing logged") if found is None else show(found)
    elif a.command == "reindex":
        print(e.reindex(not a.full).count(), "documents")
    elif a.command == "export":
        show(e.export(a.output_path, not a.no_embeddings))
    clear()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
