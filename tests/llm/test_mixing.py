import hashlib
import random
from collections import defaultdict

import pytest

from tessera.llm import mixing as M


def test_period_meets_deadlines_and_stays_within_a_block():
    rng = random.Random(1)
    for n in (1, 2, 7, 30):
        share = M.shares({f"s{k}": rng.random() + 0.01 for k in range(n)}, 256)
        plan = M.period(share)
        slots = sum(share.values())
        assert slots == len(plan) == 256 and [p[5] for p in plan] == list(range(slots))
        done = defaultdict(int)
        for s, q, k, release, deadline, t in plan:
            assert k == done[s] and q == share[s] and release <= t < deadline
            done[s] += 1
            for x in share:
                assert abs(done[x] - (t + 1) * share[x] / slots) < 1
        assert done == share


def test_shares_follow_weights():
    assert M.shares({"a": 3, "b": 1}, 16) == {"a": 12, "b": 4}
    assert M.shares({"a": 1e9, "b": 1}, 16) == {"a": 15, "b": 1}
    assert sum(M.shares({str(k): 1 for k in range(100)}, 16).values()) == 400
    with pytest.raises(ValueError):
        M.shares({"a": 0}, 16)


def brute(rows, share, block):
    plan = {(s, k): (r, d, t) for s, _, k, r, d, t in M.period(share)}
    slots = sum(share.values())
    by = defaultdict(list)
    for doc_id, text, source in rows:
        by["" if source is None else "=" + source].append((hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest(), doc_id, len(text or "")))
    out = []
    for s, own in by.items():
        at = 0
        for _, doc_id, n in sorted(own, key=lambda x: (x[0], x[2])):
            j = at // block
            turn = j // share[s] * slots
            r, d, t = plan[s, j % share[s]]
            out.append((doc_id, j, turn + r, turn + d, turn + t, at))
            at += n
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_ROWS", 20)
    rng = random.Random(2)
    rows = [(k, "x" * rng.randint(0, 50), "hot" if k % 3 else rng.choice(["a", "b'\\", None])) for k in range(900)]
    rows += [(None, "zz", "a"), (5000, None, "b'\\"), (7000, "same", "a"), (7000, "same", "a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, mix_slot int")
    got = M.mix(docs, {"hot": 5, "a": 1.5, None: 2}, slots=32, block_chars=100)
    assert got.columns == ["doc_id", "text", "source", *M.COLUMNS]
    share = M.shares({"=hot": 5, "=a": 1.5, "": 2, "=b'\\": 1.0}, 32)
    assert sorted(((r.doc_id, *r[3:]) for r in got.collect()), key=str) == brute(rows, share, 100)


def test_interleaved_order_and_empty(spark):
    rows = [(k, "t" * 10, "ab"[k % 10 == 0]) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = M.interleaved(docs, {"a": 1, "b": 1}, slots=8, block_chars=10)
    assert out.columns == docs.columns
    ordered = [r.source for r in out.collect()]
    assert len(ordered) == 400 and abs(ordered[:60].count("b") - 30) <= 1
    assert M.mix(docs.limit(0)).collect() == []


def test_clashing_columns_are_kept(spark):
    names = ["_s", "_n", "_h", "_t", "_p", "_q", "_parts", "_k", "c0"]
    docs = spark.createDataFrame([(k, "x" * k, f"s{k % 3}", *range(9)) for k in range(50)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    made = M.mix(docs)
    assert made.columns == [*docs.columns, *M.COLUMNS]
    assert sorted(made.select(*docs.columns).collect()) == sorted(docs.collect())
    assert M.interleaved(docs).columns == docs.columns


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_SOURCES", 5)
    docs = spark.range(6).selectExpr("id AS doc_id", "'t' AS text", "id AS source")
    try:
        M.mix(docs)
    except ValueError:
        return
    raise AssertionError
