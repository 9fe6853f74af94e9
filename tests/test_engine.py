import io
import sqlite3
import zipfile

from pyspark.sql import functions as F

from tessera import tables
from tessera.engine import Config, Engine, sign, tenant
from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.functions.porter import stem
from tessera.operators import fingerprint, graph, index, rank, split, store
from tessera.sources import files, urls


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column).first()[0]


def test_porter_agrees_with_a_database():
    words = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valency hesitancy digitizer conformably radically differently vilely analogously vietnamization predication operator feudalism decisiveness hopefulness callousness formality sensitivity sensibility triplicate formative formalize electricity electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angularity homologous effective bowdlerize probate rate cease controll roll generalizations oscillators".split()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, row)")
    for w in words:
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (w,))
        assert con.execute("SELECT term FROM v").fetchone()[0] == stem(w), w


def test_bm25_agrees_with_a_database(spark):
    from tessera.operators import rank

    texts = ["the cat sat on the mat", "a dog and a cat", "dogs running, running dogs", "birds fly over the running water", "nothing here"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(texts, 1)))
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "slug long, text string")
    for q in ("running cat", "dogs dogs the", "water bird"):
        match = " OR ".join(f'"{w}"' for w in q.split())
        want = {r: round(-s, 6) for r, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
        asked = spark.createDataFrame([(1, q)], "query_id long, question string")
        got = rank.bm25(asked, index.postings(docs, "slug", F.col("text"), stemmed=True), rank.corpus_stats(docs, "slug", F.col("text")), "slug", stemmed=True)
        assert {r.slug: r.score for r in got.collect()} == want


def test_scalars(spark):
    t = F.col("t")
    assert one(spark, T.clean(t), t="\0a \r\n\r\n\r\n\r\nb\t\r c  ") == "a\n\nb\n c"
    assert one(spark, T.strip_markdown(t), t="# H\n- **b** [x](y) `c`\n1. z") == "H\nb x c\nz"
    assert one(spark, T.sentences(t), t="One. Two!  Three? four.") == ["One.", "Two!", "Three? four."]
    assert one(spark, T.slug(t), t="  Hello_World: Again!  ") == "hello-world-again"
    assert one(spark, T.slug(t), t="!!!") == "untitled"
    assert one(spark, T.wikilinks(t), t="[[a]] [[b|x]] [[a]] ```[[c]]``` [[ d ]]") == ["a", "b", "d"]
    assert one(spark, T.truncate(t, 10), t="abcdefg hi, jklm") == "abcdefg..."
    assert one(spark, T.tokenize_query(t), t="What is the REST api, api v2?") == ["rest", "api", "api", "v2"]
    assert one(spark, T.word_count(t), t=" a\xa0b  c ") == 3 and one(spark, T.word_count(t), t="") == 0
    assert one(spark, T.classify(t), t="How many docs?") == "structured" and one(spark, T.classify(t), t="discounts") == "semantic"
    assert one(spark, T.human_size(F.lit(1280))) == "1.2 KB"
    assert one(spark, T.language_of(t), t="a/b.PY") == "python"
    assert [one(spark, T.static_idf(t), t=w) for w in ("the", "people", "cat", "cats")] == [0.0, 1.0, 2.45, 3.5]
    assert one(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, S.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5


def test_splitting(spark):
    long = " ".join(["word"] * 60)
    rows = [
        ("h2", f"intro\n\n## One\n\n{long}\n\n## Two\n\nshort\n\n## Three\n\n{long}\n\n## One\n\n{long}\n\n## End\n\nlast bit"),
        ("h3", f"### A\n{long}\n### B\n{long}"),
        ("para", f"{long}\n\n{long}\n\n{long}"),
        ("single", long * 3),
        ("small", "## a\n\nb\n\n## c\n\nd"),
    ]
    parents, children = split.split(spark.createDataFrame(rows, "slug string, text string"), threshold=100)
    kids = {}
    for r in children.orderBy("parent", "section_index").collect():
        kids.setdefault(r.parent, []).append(r)
    assert [k.slug for k in kids["h2"]] == ["h2-one", "h2-three", "h2-one-2"]
    assert kids["h2"][1].body.startswith("## Three\n\n## Two\n\nshort") and kids["h2"][2].body.endswith("## End\n\nlast bit")
    assert [k.title for k in kids["h3"]] == ["A", "B"] and len(kids["para"]) == 3 and kids["para"][0].slug == "para-section-0"
    body = {r.slug: r for r in parents.collect()}
    assert set(body) == {"h2", "h3", "para"} and body["h2"].body.startswith("intro\n\n## Sections") and body["h2"].children[1] == "h2-three"


def test_fingerprint_parts(spark):
    docs = spark.createDataFrame([("a", "Kubernetes Guide", "Kubernetes cluster guide. The **API gateway** routes. New York City is big. API token, API token."), ("b", "x", "")], "slug string, title string, text string")
    words = fingerprint.keywords(docs)
    assert words.where("slug = 'a' AND rank = 1").first().token in ("kubernetes", "guide")
    assert {r.category for r in fingerprint.categories(docs).where("slug = 'a'").collect()} >= {"deployment"}
    found = {r.concept: r.score for r in fingerprint.concepts(docs).where("slug = 'a'").collect()}
    assert found["Kubernetes Guide"] == 5.0 and found["New York City"] == 1.0 and found["API gateway"] == 2.0 and found["api token"] == 3.0


def test_store_and_graph(spark):
    docs = spark.createDataFrame([("a", ["b"]), ("b", []), ("c", [])], "slug string, children array<string>")
    assert [r.slug for r in store.delete(docs, docs.where("slug = 'a'")).collect()] == ["c"]
    titles = spark.createDataFrame([(1, "T"), (2, "t!"), (3, "U")], "ord int, title string")
    have = spark.createDataFrame([("t",), ("t-3",)], "slug string")
    assert [r.slug for r in store.number_slugs(titles, have).orderBy("ord").collect()] == ["t-4", "t-5", "u"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "gone"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "slug string")
    assert {(r.slug, r.hops) for r in graph.related(edges, start, 2).collect()} == {("b", 1), ("c", 1), ("gone", 2)}


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: The Title\ntags: x\nlist:\n  - one\n  - 'two'\nflow: [a, b]\nnested: {k: 1}\n---\n# H\n\nbody\n")
    (tmp_path / "k.md").write_text("---\ntitle: [broken\n---\nbody")
    (tmp_path / "l.csv").write_text('name,note\n"x,1","say ""hi"""\n"two\nlines",z\n')
    (tmp_path / "m.csv").write_text("a,b\n" + "".join(f"{k},{k * k}\n" for k in range(101)))
    (tmp_path / "n.yaml").write_text("title: Why\nlist:\n- 1\n")
    (tmp_path / "o.pdf").write_bytes(b"%PDF-1.4")

    (tmp_path / "b.txt").write_text("# Head line\n\ntext.")
    (tmp_path / "c.py").write_text('"""Doc string."""\nx = 1\n')
    (tmp_path / "d.json").write_text('{"name": "N", "v": [1]}')
    (tmp_path / "e.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    (tmp_path / "f.html").write_text("<title>P</title><h2>Q</h2><p>r &amp; s</p><script>no</script><li>t</li>")
    (tmp_path / "g.toml").write_text('title = "Tom"\n')
    (tmp_path / "h.xlsx").write_bytes(b"xx")
    (tmp_path / "i.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / ".hidden.txt").write_text("no")
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>h1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>h2</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "j.docx").write_bytes(word.getvalue())
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read(spark, str(tmp_path)).collect()}
    assert (got["a.md"].title, got["a.md"].text, got["a.md"].metadata["tags"]) == ("The Title", "# H\n\nbody", "x")
    assert got["b.txt"].title == "Head line" and got["c.py"].metadata["summary"] == "Doc string." and got["c.py"].text.startswith("```python\n")
    assert got["d.json"].title == "N" and got["e.csv"].text == "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |\n| 4 | 5 |"
    assert (got["f.html"].title, got["f.html"].text) == ("P", "P\n\n## Q\n\nr & s\n\n- t")
    assert got["g.toml"].title == "Tom" and got["j.docx"].text == "# Top\n\npara\n\n| h1 | h2 |\n| --- | --- |\n| c |  |"
    assert {k: got["a.md"].metadata[k] for k in ("list", "flow", "nested")} == {"list": '["one", "two"]', "flow": '["a", "b"]', "nested": '{"k": 1}'}
    assert got["k.md"].text.startswith("---\ntitle: [broken") and got["k.md"].status == "extracted" and got["k.md"].title is None
    assert got["l.csv"].text == '| name | note |\n| --- | --- |\n| x,1 | say "hi" |\n| two\nlines | z |'
    assert got["m.csv"].text.startswith("**CSV Summary**: 101 rows, 2 columns\n**Columns**: a, b\n") and got["m.csv"].metadata["row_count"] == "101"
    assert got["n.yaml"].title == "Why"
    assert files.extract(spark.createDataFrame([("p.csv", bytearray(b""))], "path string, content binary")).first().text == "*Empty CSV file*"
    assert got["o.pdf"].status == "failed" and got["o.pdf"].error
    assert got["h.xlsx"].status == got["i.txt"].status == "failed" and ".hidden.txt" not in got


def test_urls(spark):
    rows = [("http://127.0.0.1/x", False), ("https://10.0.0.1", False), ("http://169.254.1.1", False), ("http://8.8.8.8/a", True), ("ftp://8.8.8.8", False), ("nonsense", False), ("https://example.org", True)]
    rows += [(f"http://{h}/", False) for h in ("2130706433", "0x7f.1", "017700000001", "127.1", "[::1]", "[fd00::1]", "[fe80::1%25eth0]", "[::ffff:10.0.0.1]", "[::ffff:a00:1]", "[::127.0.0.1]", "[64:ff9b::a00:1]", "0", "10.1.65535", "999.1.1.1", "a.local", "x:y@127.0.0.1:80")]
    rows += [("http://134744072/", True), ("http://[2606:4700::1111]/", True), ("HTTPS://user@Example.ORG:8443/p", True), ("http://", False), (None, False)]
    got = urls.safe(spark.createDataFrame(rows, "url string, want boolean")).collect()
    assert all(r.safe == r.want for r in got), got


def sources(folder):
    folder.mkdir()
    for k, body in enumerate(["# Cats\n\nCats purr and sleep. See [[dogs]].", "# Dogs\n\nDogs bark at cats and run.", "# Birds\n\nBirds fly over water."]):
        (folder / f"{k}.md").write_text(body.replace("# ", "---\ntitle: " + body[2:6] + "\n---\n# ", 1))
    return str(folder)


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    assert e.query("anything").count() == 0
    assert sorted(r.status for r in e.ingest(sources(tmp_path / "src")).collect()) == ["created"] * 3
    again = e.ingest_text("# Cats\n\nCats purr and sleep. See [[dogs]].", "Other").collect()
    assert [(r.slug, r.status) for r in again] == [("cats", "duplicate")]
    assert e.ingest_text("A new text about fish and water.", "Cats").first().slug == "cats-2"
    assert e.documents(1, 50).count() == 4
    top = e.query("purring cats sleep").collect()
    assert top[0].slug == "cats" and e.query("the of and").count() == 0
    assert {r.slug for r in e.search("dogs").collect()} == {"cats", "dogs"} and e.search("barked").first().slug == "dogs"
    assert "<b>" in e.snippets("dogs").where("slug = 'dogs'").first().snippet
    assert e.reindex().count() == 0
    assert e.delete("cats") and not e.delete("cats")
    assert e.get("cats").count() == 0 and e.documents(1, 50).count() == 3
    assert e.search("purr").count() == 0 and [r.src for r in e.backlinks("dogs").collect()] == []
    assert e.ingest_text("# Cats\n\nCats purr and sleep. See [[dogs]].", "Cats").first().status == "created"
    assert [r.slug for r in e.related("dogs").collect()] == [r.src for r in e.backlinks("dogs").collect()] != []
    assert e.stats().first().documents == 4
    manifest = e.export(str(tmp_path / "bundle")).first()
    other = Engine(spark, str(tmp_path / "other"))
    assert manifest.document_count == 4 and other.load(str(tmp_path / "bundle")) == 4
    assert other.search("purr").first().title == "Cats" and other.ingest_text("Birds fly over water.", "x").first().status == "created"
    assert len(sign(b"x", "k")) == 64


def test_a_store_outlives_its_engine(spark, tmp_path):
    folder = str(tmp_path / "store")
    first = Engine(spark, folder)
    first.ingest(sources(tmp_path / "src"))
    asked = {(r.slug, r.score) for r in first.query("cats and dogs").collect()}
    second = Engine(spark, folder)
    assert {(r.slug, r.score) for r in second.query("cats and dogs").collect()} == asked
    assert second.ingest_text("Birds fly over water.", "b").first().status == "created"
    assert second.ingest_text("# Birds\n\nBirds fly over water.", "b").first().status == "duplicate"
    # incremental rows equal those of an index made at once
    second.delete("dogs")
    second.update(spark.createDataFrame([("bird", "Birds swim under [[cats]].")], "slug string, body string"))
    assert second.search("swim").first().slug == "bird" and {r.slug for r in second.search("fly").collect()} == {"b"}
    assert [r.src for r in second.backlinks("cats").collect()] == ["bird"]
    docs = second.table("documents")
    from tessera.plans import indexes

    whole = indexes.tables_of(docs)
    kept = second.index()
    for name, table in (("postings", kept.postings), ("weights", kept.weights), ("lengths", kept.lengths)):
        columns = whole[name].columns
        assert sorted(table.select(*columns).collect()) == sorted(whole[name].collect()), name
    before = {r.slug: r.body for r in docs.collect()}
    second.tables.compact()
    third = Engine(spark, folder)
    assert {r.slug: r.body for r in third.table("documents").collect()} == before and not third.tables.has("tombstones")
    assert third.search("swim").first().slug == "bird"
    # of two writers the later one fails, and a damaged manifest doesn't stand
    second.delete("b")
    try:
        third.delete("bird")
    except tables.Conflict:
        third.tables.refresh()
    else:
        raise AssertionError
    assert third.get("b").count() == 0 and third.get("bird").count() == 1
    (tmp_path / "store" / "manifests" / "99999.json").write_text("{")
    assert Engine(spark, folder).get("bird").count() == 1


def test_null_texts_and_repeats_have_a_status(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("1", "a", None), ("2", "b", ""), ("3", "c", "text one"), ("4", "d", " TEXT ONE ")], "ord string, title string, text string")
    assert sorted((r.ord, r.slug, r.status) for r in e.ingest_rows(rows).collect()) == [("1", "a", "created"), ("2", "a", "duplicate"), ("3", "c", "created"), ("4", "c", "duplicate")]


def test_feedback_loop(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), Config(self_tuning=True, tune_interval=60))
    e.ingest(sources(tmp_path / "src"))
    asked = spark.createDataFrame([(k, "cats purr" if k % 2 else "dogs bark") for k in range(60)], "query_id long, question string")
    assert e.query(asked).count() > 0
    assert e.log().count() == 60 and e.log().where("tier_max = 3").count() == 60
    assert {r.slug for r in e.flagged().collect()} >= {"cats", "dogs"}
    assert e.tune_now() is None  # too little is known
    e.record_feedback(3, 0.1)
    e.record_feedback(3, 0.9)
    assert e.log().where("query_id = 3").first().feedback_score == 0.9
    assert e.retrieval_stats()["totals"].first().total == 60
    scores = spark.range(55).selectExpr("id AS query_id", "1.0D AS score", "'explicit' AS signal_type", "current_timestamp() AS at", "id AS by_query_id")
    e.tables.commit(append={"feedback": scores})
    e.query(asked.withColumn("query_id", F.col("query_id") + 100))  # the interval is full
    again = Engine(spark, str(tmp_path / "store"))
    assert set(again.tables.now.values["weights"]) == set(rank.WEIGHTS) and list(again.weights) == list(rank.WEIGHTS)


def test_vectors_answer_weak_questions(spark, tmp_path):
    def embed(texts, key):
        one = lambda w: F.size(F.filter(F.split(F.lower("text"), r"\W+"), lambda x: x.startswith(w))).cast("double")
        return texts.select(key, F.array(one("cat"), one("dog"), one("fl"), one("zeppelin")).alias("embedding"))

    e = Engine(spark, str(tmp_path / "store"), Config(embeddings=True), embed=embed)
    e.ingest(sources(tmp_path / "src"))
    assert e.table("vectors").count() == 3
    found = e.query("flibber flop").collect()
    assert [(r.slug, r.source) for r in found] == [("bird", "embeddings")]
    e.delete("bird")
    assert e.query("flibber flop").count() == 0 and e.table("vectors").count() == 2


def test_urls_and_control_plane(spark, tmp_path):
    page = b"<html><head><title>Frogs</title><meta name='description' content='Green'><link rel='canonical' href='http://x/y'></head><body><h1>Frogs</h1><p>Frogs jump.</p></body></html>"
    e = Engine(spark, str(tmp_path / "store"), fetch=lambda url: ("text/html; charset=utf-8", page) if "ok" in url else ("image/png", b""))
    assert e.ingest_url("http://2130706433/").first().status == "failed"
    assert e.ingest_url("https://example.org/ok").first().slug == "frogs"
    assert e.ingest_url("https://example.org/no").first().error.startswith("unsupported content type")
    assert e.get("frogs").first().metadata == {"source": "https://example.org/ok", "description": "Green", "canonical_url": "http://x/y"}
    secret = e.create_key("t", read_only=True)
    asks = spark.createDataFrame([(1, secret, "GET"), (2, secret, "POST")], "request_id int, secret string, method string")
    again = Engine(spark, str(tmp_path / "store"))
    assert {r.request_id: r.allowed for r in again.verify(asks).collect()} == {1: True, 2: False} and again.keys("t").count() == 1
    again.revoke_key(again.keys().first().key_id)
    assert not any(r.allowed for r in again.verify(asks).collect())
    hook = again.put_webhook("http://h", ["document.created"], "s", "t")
    assert again.fire("t", "document.created", "{}").first().signature == sign(b"{}", "s") and again.webhooks("t").count() == 1
    try:
        again.put_webhook("http://h", ["nope"])
    except ValueError:
        pass
    else:
        raise AssertionError
    again.drop_webhook(hook)
    assert again.webhooks("t").count() == 0
    again.put_field("size", "int", True, "t")
    again.put_field("size", "float", False, "t")
    assert [(r.field_name, r.field_type) for r in again.fields("t").collect()] == [("size", "float")]
    again.drop_field("size", "t")
    assert again.fields("t").count() == 0
    (tmp_path / "store" / "config.json").write_text('{"max_results": 3, "unknown": 1}')
    assert Engine(spark, str(tmp_path / "store")).config.max_results == 3
    assert tenant(spark, str(tmp_path), "a").folder != tenant(spark, str(tmp_path), "b").folder


def test_sections_have_synopses(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), Config(split_threshold=40, feedback=False))
    parts = [f"## {name}\n\n" + " ".join([f"{name} {word} explained in one long sentence of its own."] * 8) for name, word in (("Apples", "orchards"), ("Pears", "gardens"), ("Plums", "brandy"))]
    assert e.ingest_text("Intro.\n\n" + "\n\n".join(parts), "Fruit").first().status == "split"
    parent = e.get("fruit").first()
    assert [s.slug for s in parent.section_map] == parent.children and all("explained" in s.synopsis and len(s.synopsis) <= 153 for s in parent.section_map)
    found = e.query("explained brandy of fruit").collect()
    assert any(r.tier == 2 and r.slug == "fruit-plums" and r.title == "Plums" for r in found), found


def test_parts_are_merged(spark, tmp_path):
    t = tables.Tables(spark, str(tmp_path / "store"))
    row = lambda k: spark.createDataFrame([(f"s{k}", f"body {k}")], "slug string, body string")
    for k in range(40):
        t.commit(append={"documents": row(k), "query_log": row(k)}, gone=row(k - 3).select("slug") if k % 4 == 3 else None)
    assert len(t.now.parts["documents"]) <= tables.MOST_PARTS and max(p[2] for p in t.now.parts["documents"]) >= 1
    gone = {f"s{k}" for k in range(0, 40, 4)}
    again = tables.Tables(spark, str(tmp_path / "store"))
    assert {r.slug for r in again.read("documents").collect()} == {f"s{k}" for k in range(40)} - gone and again.read("query_log").count() == 40
    kept = {p.name for p in (tmp_path / "store" / "parts").iterdir()}
    assert len(kept) < 120 and len(list((tmp_path / "store" / "manifests").glob("*.json"))) <= tables.KEPT + 1 + tables.MOST_PARTS
    again.compact()
    assert not again.has("tombstones") and again.read("documents").count() == 30


def test_a_parser_follows_what_patterns_cannot(spark):
    from tessera.sources import html

    page = "<h2 class='a>b'>One</h2><p>x &lt; y<br>z</p><ul><li>k<li>l</ul><script>no</script>"
    assert one(spark, html.parsed_markdown(F.col("t")), t=page) == "## One\n\nx < y\nz\n\n- k\n- l"


def test_questions_read_the_buckets_of_their_terms(spark):
    from tessera import queries

    tables = queries.kept(spark, "/root/testdata/sf0.001").index
    asked = spark.createDataFrame([(0, "market")], "query_id long, question string")
    plan = rank.tier0(asked, tables.weights)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
