import hashlib
import re
from collections import defaultdict

from tessera.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, k))
    out = []
    for t, members in groups.items():
        keep = rows[min(members)[3]][0]
        for n, m in enumerate(sorted(members)):
            out.append((rows[m[3]][0], keep, len(members), n == 0, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    long = "lorem ipsum " * 40
    rows = [(1, "a b c"), (2, "abc"), (3, "a  b c"), (4, None), (5, ""), (6, " \n"), (7, long), (8, long.replace(" ", "")), (9, long + "x"), (10, "x" + long), (2, "abc"), (None, "abc"), (None, "abcd"), (11, "é" * 50), (12, "é" * 49 + "e"), (13, "\xa0a")]
    rows += [(100 + k, "one large group") for k in range(60)]
    docs = spark.createDataFrame([(*r, "en", 0) for r in rows], "doc_id long, text string, level string, name int")
    for block in (3, 7, 4096):
        got = X.exact_groups(docs, block=block).drop("tag").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows), block


def test_drop_copies_keeps_columns(spark):
    rows = [(1, "a b", "p"), (2, "ab", "q"), (2, "ab", "q"), (3, "c", "r"), (3, "c", "r"), (None, "d", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    got = X.drop_copies(docs, block=1)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a b", "p"), (3, "c", "r"), (None, "d", "s")]
    assert X.drop_copies(docs.limit(0)).collect() == []


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = X.exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_text_ids_and_clashing_columns(spark):
    rows = [("b", "a b"), ("a", "a b"), (None, "ab"), ("c", None), ("d", " ")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id string, text string, _own int, tag int, _mark int, _copies int, _kept int")
    got = {r.doc_id: (r.keep_id, r.kept) for r in X.exact_groups(docs).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), None: ("a", False), "c": ("d", False), "d": ("d", True)}
    kept = X.drop_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {"a", "d"}


def test_marks_are_drawn_again_where_blocks_share_one(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", "ab", "c" * 9000, "c" * 9000, "c" * 9001, None])], "doc_id long, text string")
    want = sorted(X.exact_groups(docs).collect())
    real, seeds = X._block_names, []

    def shared_once(normal, size, seed):
        seeds.append(seed)
        return None if seed == 0 else real(normal, size, seed)

    monkeypatch.setattr(X, "_block_names", shared_once)
    assert sorted(X.exact_groups(docs).collect()) == want and seeds == [0, 1]
    # the check itself: two blocks, one mark
    rows = docs.selectExpr("text AS _t").where("_t IS NOT NULL")
    monkeypatch.setattr(X.F, "xxhash64", lambda *_: X.F.lit(7).cast("long"))
    assert real(rows, 4096, 0) is None
