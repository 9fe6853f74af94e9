"""The index is made in the row and the ranking by blocks: what grows with the
corpus isn't shuffled as rows of terms, nor joined to one row a question and term."""

import math
import os
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tessera import queries
from tessera import sql as Q
from tessera.operators import index, rank
from tessera.plans import indexes, ingest

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_and_weights_are_made_without_a_shuffle(spark):
    docs = spark.createDataFrame([("a", "Dogs", "Dogs running, ÉTÉ été ete", ["Pet"], ["dogs"]), ("b", None, None, [], [])], "slug string, title string, body string, categories array<string>, fingerprint array<string>")
    docs = docs.withColumn("summary", F.lit("Dogs run"))
    made = indexes.tables_of(docs)
    assert not any("Exchange" in plan(made[t]) for t in ("postings", "weights", "lengths"))
    got = {(r.term, r.slug): (r.tf, r.dl) for r in made["postings"].collect()}
    assert got == {("dog", "a"): (4, 10), ("run", "a"): (2, 10), ("et", "a"): (3, 10), ("pet", "a"): (1, 10)} | {(t, "b"): (1, 2) for t in ("dog", "run")}
    assert {r.slug: r.dl for r in made["lengths"].collect()} == {"a": 10, "b": 2}
    assert {(r.token, r.slug): r.weight for r in made["weights"].collect()}["dogs", "a"] == 7.5


def test_texts_without_tokens_have_a_length_and_no_postings(spark):
    docs = spark.createDataFrame([(1, "!?"), (2, ""), (3, " x\x1cy "), (4, "o'neill")], "slug long, text string")
    assert sorted((r.slug, r.term, r.tf, r.dl) for r in index.postings(docs, "slug", F.col("text")).collect()) == [(3, "x", 1, 2), (3, "y", 1, 2), (4, "neill", 1, 2), (4, "o", 1, 2)]
    assert [r.dl for r in index.lengths(docs, "slug", F.col("text")).orderBy("slug").collect()] == [0, 0, 2, 2]


def test_plain_search_makes_no_fingerprints(spark, tmp_path):
    os.symlink(SF, there := tmp_path / "plain")
    assert queries.bm25_topk(spark, str(there)).count() > 0
    store = queries.kept(spark, str(there))
    assert not {"documents", "postings", "weights"} & {*vars(store)}
    assert queries.bm25_porter_topk(spark, str(there)).count() > 0
    assert "documents" in vars(store) and "weights" not in vars(store)


def test_ranking_by_blocks_keeps_the_first_of_ties_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(rank, "DOCUMENTS", 3)
    monkeypatch.setattr(rank, "ASKED", 2)
    texts = {f"d{i:02}": "cat dog" if i % 3 else f"cat bird{i % 4} cat" for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "slug string, text string")
    asked = {1: "cat cat", 2: "bird1 dog", 3: "nothing", 4: "bird2"}
    stats = rank.corpus_stats(docs, "slug", F.col("text"))
    found = rank.bm25(spark.createDataFrame(list(asked.items()), "query_id long, question string"), index.postings(docs, "slug", F.col("text")), stats, "slug", 7)
    assert "MapInArrow" in plan(found)
    tokens = {s: Counter(t.split()) for s, t in texts.items()}
    average = sum(sum(c.values()) for c in tokens.values()) / len(tokens)
    want = set()
    for q, text in asked.items():
        scores = {}
        for term, n in Counter(text.split()).items():
            df = sum(term in c for c in tokens.values())
            idf = math.log((len(tokens) - df + 0.5) / (df + 0.5))
            for s, c in tokens.items():
                if term in c:
                    scores[s] = scores.get(s, 0) + n * (idf if idf > 0 else 1e-6) * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average))
        best = sorted((-round(x, 6), s) for s, x in scores.items())[:7]
        want |= {(q, s, -x, i + 1) for i, (x, s) in enumerate(best)}
    assert {(r.query_id, r.slug, r.score, r["rank"]) for r in found.collect()} == want


def test_descriptions_of_odd_texts_are_those_of_sql(spark):
    texts = [
        "", "x", "A  b\n\n\nc", "# Head One Two Three\n\nBody *Bold Name* and __under__ text. Next One! See [x](y) `c`\n1. z\n- w",
        "École Paris École ParisÉ Rome2 Rome Rome. " * 12, "Rome Athens " * 40, "database databases sqlite index-query rest resting token. " * 9,
        "***All*** **b** _c d e f_ \n## 12 3\n### A-b c! d e\ntrailing #", "ſ K Istanbul STRASSE ß. New York City New York. " * 8, ("Short one. " * 3 + "word " * 70 + ". Tail ends, here") * 2,
    ]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(f"WITH {Q.CORPUS},\n{Q.FINGERPRINTS} SELECT slug, title, fingerprint, categories, concepts, summary FROM described").fetchall()
    rows = docs.write.mode("overwrite")
    folder = queries.fresh_folder(spark, "odd")
    rows.parquet(f"{folder}/documents.parquet")
    got = ingest.describe(queries.corpus(spark, folder)).select("slug", "title", "fingerprint", "categories", "concepts", "summary").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_postings_in_blocks_are_those_of_rows_and_rank_the_same(spark, monkeypatch, tmp_path):
    texts = {f"d{i:02}": ["cat dog dogs", "Été cat cat bird", "", "!?", f"running runs x{i}"][i % 5] for i in range(33)} | {"none": None}
    docs = spark.createDataFrame([*texts.items()][::-1], "slug string, text string").coalesce(2)
    monkeypatch.setattr(index, "BLOCK", 7)
    blocks = indexes.build_one("postings", {"postings": indexes.packed(docs, F.col("text"), stemmed=True)}, str(tmp_path))
    rows, columns = index.postings(docs, "slug", F.col("text"), stemmed=True), ("term", "slug", "tf", "dl")
    assert sorted(map(tuple, index.unpacked(blocks, "slug").select(*columns).collect())) == sorted(map(tuple, rows.select(*columns).collect()))
    lengths = index.block_lengths(blocks, "slug")
    assert sorted(map(tuple, lengths.collect())) == sorted(map(tuple, index.lengths(docs, "slug", F.col("text")).collect()))
    asked = spark.createDataFrame([(1, "cats running"), (2, "x4 bird"), (3, "nothing"), (4, "")] + [(q, "dog cat été") for q in range(10, 25)], "query_id long, question string")
    ranked = lambda p: sorted(map(tuple, rank.bm25(asked, p, indexes.stats(lengths), "slug", 5, stemmed=True).collect()))
    assert (want := ranked(rows)) and ranked(blocks) == want
    monkeypatch.setattr(rank, "USUAL", 1 << 30)
    assert ranked(blocks) == want
    monkeypatch.setattr(rank, "BROADCAST_BYTES", -1)  # too many terms to meet blocks
    assert ranked(blocks) == want


def test_registered_retrieval_makes_no_row_of_a_posting(spark, tmp_path):
    os.symlink(SF, there := tmp_path / "blocks")
    store = queries.kept(spark, str(there))
    rows = indexes.tables_of(store.documents)["postings"].count()
    assert store.postings.count() < rows / 50
    found = plan(queries.bm25_porter_topk(spark, str(there)))
    assert "Exchange hashpartitioning(block" in found and "Exchange hashpartitioning(slug" not in found


def test_suffixes_and_keywords_of_unusual_words(spark):
    from tessera.functions.porter import stem
    from tessera.operators import fingerprint

    words = "relational conditional rationalize triplicate formality saying syzygy hopping falling agreed feed skies generalizations controll rate cease oscillators".split()
    assert [stem(w) for w in words] == "relat condit ration triplic formal sai syzygi hop fall agre feed ski gener control rate ceas oscil".split()
    stop, common = frozenset(["the"]), frozenset(["new"])
    text = "new new new abc abc delta delta alpha beta\n\n# Gamma delta\nnew gamma omega omega omega"
    best = [w for w, _ in fingerprint.best_tokens("Beta title", text, 4, stop, common)]
    scores = fingerprint.best_tokens("Beta title", text, 100, stop, common)
    assert best == [w for w, _ in scores[:4]] and len(scores) == 7


def test_answers_and_what_they_read_come_from_blocks(spark, tmp_path):
    os.symlink(SF, there := tmp_path / "answers")
    answers = queries.tiered_retrieve(spark, str(there)).select("query_id").distinct().count()
    store = queries.kept(spark, str(there))
    assert {"bucket", "slugs", "terms"} <= {*store.postings.columns} and "lengths" not in vars(store)
    assert queries.retrieval_reads(spark, str(there)).count() == answers > 0
