import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import substring_dedup as D


def brute(rows, window):
    """(words, removed, kept text) by document, from the definition."""
    order = sorted({(d is None, d or 0, h, t) for d, t, h in rows})
    seen, out = {}, {}
    for n, (_, _, _, t) in enumerate(order):
        words = t.encode().split()
        for k in range(len(words) - window + 1):
            seen.setdefault(tuple(words[k : k + window]), (n, k))
    for n, doc in enumerate(order):
        words = doc[3].encode().split()
        gone = set()
        for k in range(len(words) - window + 1):
            if seen[tuple(words[k : k + window])] != (n, k):
                gone.update(range(k, k + window))
        out[doc] = (len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode())
    return [out[d is None, d or 0, h, t] for d, t, h in rows]


@pytest.mark.parametrize("hot", [D.HOT, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(D, "HOT", hot)
    monkeypatch.setattr(D, "HOT_SHARE", D.HOT_SHARE if hot == D.HOT else 10**9)
    rng = random.Random(1)
    vocab = ["a", "b", "é", "of", "the", "x\xa0y", "日本"]
    passage = " ".join(f"w{k}" for k in range(50))
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [" ".join(rng.choice("ab") for _ in range(300)), "a " * 400, passage, "zz\t" + passage + "\n zz", passage + " " + passage, None, "", passage + " tail"]
    texts += [passage + f" {k} " + texts[k] for k in range(20)]
    rows = [(k * 7 % 101, t) for k, t in enumerate(texts)] + [(None, passage), (4, "q " * 30), (4, "q " * 30), (4, "r " * 30 + "q " * 25)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_words int").repartition(3)
    tagged = docs.selectExpr("doc_id", "coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()
    for window, m in ((20, 4), (5, 2), (3, 3)):
        want = brute([tuple(r) for r in tagged], window)
        got = D.drop_repeats(docs, window=window, m=m).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == sorted((str(r.doc_id), *w) for r, w in zip(tagged, want, strict=True))
    hashed = D.drop_repeats(docs, columns=["doc_id"], digest=True).collect()
    want = brute([tuple(r) for r in tagged], 20)
    assert sorted((str(r.doc_id), r.kept_sha256) for r in hashed) == sorted((str(r.doc_id), hashlib.sha256(w[2].encode()).hexdigest()) for r, w in zip(tagged, want, strict=True))
    assert D.drop_repeats(docs.limit(0)).collect() == []


def test_hash_collisions_are_told_apart(monkeypatch):
    """With a useless hash, grouping still goes by the words."""
    monkeypatch.setattr(D, "mix", lambda x: np.ones_like(x))
    skm = {"key": [1, 2, 3], "tag": [0, 0, 0], "start": [0, 0, 0], "windows": [1, 1, 1], "text": [b"a b c", b"a b d", b"a b c"]}
    key, _, start, windows = D.bucket_repeats([D._pack(skm, [])], window=3)
    assert (key.tolist(), start.tolist(), windows.tolist()) == ([3], [0], [1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nabé", max_size=60), max_size=6), st.integers(2, 6), st.booleans())
def test_super_kmers_cover_each_window_once(texts, window, all_hot):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    made = D.super_kmers(data, offsets, window, 2)
    if made and all_hot:
        plain = len(made[0])
        made = D.super_kmers(data, offsets, window, 2, np.unique(made[3]))
        assert (made[4] > 0).all() and len(made[0]) >= plain
    got = []
    if made:
        for t, s, n, _, _, a, z, string in zip(*made[:7], [made[7]] * len(made[0])):
            words = string[a:z].split(b" ")
            assert len(words) == n + window - 1
            got += [(t, s + k, tuple(words[k : k + window])) for k in range(n)]
    want = [(t, k, tuple(w[k : k + window])) for t, w in enumerate(map(bytes.split, raw)) for k in range(len(w) - window + 1)]
    assert sorted(got) == want


def test_text_ids_and_clashing_columns(spark):
    passage = " ".join(f"w{k}" for k in range(25))
    rows = [("b", passage), ("a", passage), (None, passage + " more"), ("c", None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id string, text string, _key int, _tag int, _place int, _text int")
    got = {r.doc_id: r for r in D.drop_repeats(docs).collect()}
    assert {k: r.n_removed for k, r in got.items()} == {"a": 0, "b": 25, None: 25, "c": 0}
    assert (got[None]._key, got[None]._tag, got[None]._place, got[None]._text, got[None].kept_text) == (1, 2, 3, 4, "more")
