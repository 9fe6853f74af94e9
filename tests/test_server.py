import io
import json

from tessera.server import App, Limiter, Settings


def test_routes(spark, tmp_path):
    app = App(spark, Settings(folder=str(tmp_path / "store")))

    def call(method, path, body=None, key=None, kind="application/json", query=""):
        raw = body if isinstance(body, bytes) else json.dumps(body).encode() if body is not None else b""
        env = {"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "CONTENT_LENGTH": str(len(raw)), "CONTENT_TYPE": kind, "wsgi.input": io.BytesIO(raw)}
        if key:
            env["HTTP_X_API_KEY"] = key
        said = []
        out = b"".join(app(env, lambda status, headers: said.append((int(status[:3]), dict(headers)))))
        return said[0][0], json.loads(out) if out else None

    assert call("GET", "/health") == (200, {"status": "ok"}) and call("OPTIONS", "/query")[0] == 204
    assert call("GET", "/documents")[1]["total"] == 0 and call("GET", "/stats")[1]["document_count"] == 0
    made = call("POST", "/ingest", {"text": "Cats purr at night and sleep all day.", "title": "Cats"})
    assert made == (201, {"slug": "cats", "title": "Cats", "status": "created", "children": None, "error": None})
    part = b'--B\r\nContent-Disposition: form-data; name="file"; filename="d.md"\r\n\r\n# Dogs\n\nDogs bark at night.\r\n--B\r\nContent-Disposition: form-data; name="title"\r\n\r\nDogs\r\n--B--\r\n'
    assert call("POST", "/ingest", part, kind="multipart/form-data; boundary=B")[1]["slug"] == "dogs"
    assert call("POST", "/ingest", {"text": "x"})[0] == 422 and call("POST", "/ingest", b"{")[0] == 400
    assert call("POST", "/query", {"question": "purring cats"})[1]["results"][0]["slug"] == "cats"
    assert call("POST", "/query", {"question": "x", "top_k": 101})[0] == 422
    assert call("POST", "/search", {"query": "barking", "top_k": 1})[1][0]["slug"] == "dogs"
    assert call("GET", "/documents", query="per_page=1&page=2")[1]["documents"][0]["slug"] == "dogs"
    assert call("GET", "/documents/cats")[1]["word_count"] == 8 and call("GET", "/documents/none")[0] == 404
    assert call("POST", "/reindex") == (200, {"message": "Reindexed 0 documents."})
    assert call("POST", "/feedback", {"query_id": 1, "score": 2})[0] == 422 and call("POST", "/feedback", {"query_id": 1, "score": 1})[0] == 200
    assert call("GET", "/stats/retrieval")[1]["total_queries"] == 1 and call("GET", "/stats/flagged")[1] == {"flagged_documents": []}
    assert call("POST", "/tune")[1] == {"weights": None, "status": "insufficient_data"}
    assert call("POST", "/webhooks", {"url": "http://h", "events": ["nope"], "secret": "s"})[0] == 400
    hook = call("POST", "/webhooks", {"url": "http://h", "events": ["document.deleted"], "secret": "s"})[1]["id"]
    assert [h["id"] for h in call("GET", "/webhooks")[1]] == [hook]
    assert call("DELETE", "/documents/dogs")[0] == 200 and app.root.table("deliveries").count() == 1
    assert call("DELETE", f"/webhooks/{hook}")[0] == 200 and call("DELETE", f"/webhooks/{hook}")[0] == 404
    assert call("POST", "/schema", {"field_name": "size", "field_type": "int"})[0] == 201 and call("GET", "/schema")[1][0]["field_name"] == "size"
    assert call("DELETE", "/schema/size")[0] == 200 and call("GET", "/nowhere")[0] == 404
    reader, writer = app.root.create_key("t", read_only=True), app.root.create_key("t")
    assert call("GET", "/stats")[0] == 401 and call("GET", "/stats", key="wrong")[0] == 403
    assert call("GET", "/stats", key=reader)[1]["document_count"] == 0  # the tenant's own store
    assert call("POST", "/ingest", {"text": "a b", "title": "A"}, key=reader)[0] == 403
    assert call("POST", "/ingest", {"text": "a b", "title": "A"}, key=writer)[0] == 201 and app.root.table("documents").count() == 1
    app.limiter = Limiter(1, 60)
    assert call("GET", "/stats", key=reader)[0] == 200 and call("GET", "/stats", key=reader)[0] == 429


def test_settings_and_limiter():
    found = Settings.from_environment({"TESSERA_PORT": "9", "TESSERA_EMBEDDINGS": "True", "OTHER": "x"})
    assert (found.port, found.embeddings, found.host) == (9, True, "0.0.0.0")
    now = [0.0]
    limit = Limiter(2, 45, lambda: now[0])
    said = []
    for t in range(0, 100, 10):
        now[0] = float(t)
        said.append(limit.allows("k"))
    assert said == [True, True, False, False, False, True, True, False, False, False]
