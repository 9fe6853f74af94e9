from pyspark.sql import functions as F

from tessera.engine import sign
from tessera.functions import text as T
from tessera.operators import control as C
from tessera.sources import files, notes, urls


def test_keys(spark):
    secret, keys = C.create_key(spark, "t1", read_only=True)
    other, more = C.create_key(spark, "t2")
    keys = keys.unionByName(more)
    asks = spark.createDataFrame([(1, secret, "get"), (2, secret, "POST"), (3, other, "POST"), (4, "wrong", "GET")], "request_id int, secret string, method string")
    assert {r.request_id: (r.tenant_id, r.allowed) for r in C.verify(asks, keys).collect()} == {1: ("t1", True), 2: ("t1", False), 3: ("t2", True), 4: (None, False)}
    gone = C.revoke_key(keys, more.first().key_id)
    assert not C.verify(asks.where("request_id = 3"), gone).first().allowed


def test_webhooks_and_fields(spark):
    hooks = spark.createDataFrame([("a", "h1", "u", ["document.created", "reindex.started"], "s"), ("b", "h2", "u", ["document.created"], "s")], "tenant_id string, id string, url string, events array<string>, secret string")
    events = spark.createDataFrame([("a", "document.created", "{}"), ("a", "document.deleted", "{}")], "tenant_id string, event string, payload string")
    out = C.deliveries(events, hooks).collect()
    assert [(r.id, r.signature) for r in out] == [("h1", sign(b"{}", "s"))]
    assert hooks.select(C.invalid_events(F.array(F.lit("x"), F.lit("reindex.started"))).alias("x")).first().x == ["x"]
    tries = spark.createDataFrame([("h1", 1, "2024-01-01"), ("h1", 3, "2024-01-01")], "id string, attempt int, failed_at string").withColumn("failed_at", F.to_timestamp("failed_at"))
    assert [r.next_at.second for r in C.due(tries).collect()] == [1]
    fields = spark.createDataFrame([("a", "x", "int"), ("a", "y", "int")], "tenant_id string, field_name string, field_type string")
    new = spark.createDataFrame([("a", "x", "string")], fields.schema)
    merged = C.put_field(fields, new)
    assert {(r.field_name, r.field_type) for r in merged.collect()} == {("x", "string"), ("y", "int")}
    assert C.drop_field(merged, "a", "x").count() == 1


def test_notes_round_trip(spark):
    rows = [("a", "A: title", "sum | mary", ["x", "y z"], "body\n", ["k"]), ("b", "true", None, [], "", [])]
    docs = spark.createDataFrame(rows, "slug string, title string, summary string, categories array<string>, body string, fingerprint array<string>")
    made = {r.slug: r.note for r in notes.render(docs).collect()}
    assert made["a"] == '---\ntitle: "A: title"\nsummary: "sum | mary"\ncategories: [x, y z]\n---\n\nbody\n' and 'title: "true"' in made["b"]
    back = notes.render(docs).select("slug", files.markdown(F.col("note")).alias("x")).collect()
    assert {r.slug: r.x.title for r in back} == {"a": "A: title", "b": "true"}
    lines = notes.index_rows(docs.withColumnRenamed("summary", "synopsis"))
    got = {r.slug: r for r in notes.read_index(lines.unionByName(spark.createDataFrame([("", "# Index")], "slug string, line string"))).collect()}
    assert got["a"].synopsis == "sum | mary" and got["a"].categories == ["x", "y z"] and got["b"].fingerprint == []


def test_snippet_and_keywords(spark):
    df = spark.createDataFrame([("w " * 60 + "Cats, and dogs " + "v " * 60, ["cats", "dogs"])], "body string, terms array<string>")
    out = df.select(T.snippet(F.col("body"), F.col("terms"), 5).alias("s")).first().s
    assert out == "...w w <b>Cats,</b> and <b>dogs</b>..."
    k = spark.createDataFrame([('```json\n["B ", "a", "b", "c", "d", "e"]\n```',), ('["a"]',), ("no",)], "t string").select(T.parse_keywords(F.col("t")).alias("k")).collect()
    assert [r.k for r in k] == [["b", "a", "c", "d", "e"], None, None]


def test_command_line(spark, tmp_path, capsys):
    from tessera.cli import main

    store, src = str(tmp_path / "store"), tmp_path / "src"
    src.mkdir()
    (src / "a.md").write_text("---\ntitle: Cats\ntags: [x, y]\n---\nCats purr at night and sleep all day.")
    run = lambda *words: (main([*words, "--store", store], spark), capsys.readouterr().out)
    assert run("query", "cats")[0] == 1
    assert "created" in run("ingest", str(src))[1]
    assert "cats" in run("query", "purring cats")[1] and "cats" in run("search", "sleeping")[1]
    assert "cats" in run("search", "", "--filters", '{"min_word_count": 3}')[1]
    assert run("reindex")[1] == "0 documents\n" and run("reindex", "--full")[1] == "1 documents\n"
    assert "1" in run("stats", "--feedback")[1] and run("tune")[1] == "null\n" and run("flagged")[0] == 0
    assert run("export", str(tmp_path / "bundle"))[0] == 0
    assert len(run("api-key", "create", "t")[1]) > 20 and "t" in run("api-key", "list")[1]
    assert run("api-key", "revoke", "t")[0] == 0 and "true" in run("api-key", "list")[1]
    assert "blocked address" in run("ingest-url", "http://127.0.0.1:9/")[1]
    assert not urls.outside("http://localhost/") and not urls.outside("file:///etc") and not urls.outside("http://[::1]/")
    assert main(["import", str(tmp_path / "bundle"), "--store", str(tmp_path / "other")], spark) == 0
    assert "1 documents" in capsys.readouterr().out
