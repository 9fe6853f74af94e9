import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import kneser_ney as K


def brute(train, scored):
    three, uni = Counter(), Counter()
    split = lambda t: [*(t or "").encode().lower().split(), "</s>"]
    for t in train:
        w = split(t)
        uni.update(w)
        three.update(zip(["<s>", "<s>", *w[:-2]], ["<s>", *w[:-1]], w))
    contexts, follow, left = defaultdict(Counter), defaultdict(Counter), Counter()
    for (u, v, w), c in three.items():
        contexts[u, v][w] = c
        follow[v][w] += c if v == "<s>" else 1
    for v in follow:
        left.update(follow[v].keys())
    two = [x for v in follow.values() for x in v.values()]
    d1, d2, d3 = (K.discounts(*(Counter(x)[k] for k in (1, 2, 3, 4))) for x in (left.values(), two, three.values()))
    cut = lambda c, d: 0 if c == 0 else d[min(c, 3) - 1]
    pairs, n, size = len(two), sum(uni.values()), len(uni)
    rest = sum(cut(x, d1) for x in left.values()) / pairs

    def over(counts, x, d, low):
        total = sum(counts.values())
        return max(counts[x] - cut(counts[x], d), 0) / total + sum(cut(k, d) for k in counts.values()) / total * low if total else low

    out = []
    for t in scored:
        w = split(t)
        total = base = 0.0
        for u, v, x in zip(["<s>", "<s>", *w[:-2]], ["<s>", *w[:-1]], w):
            p = max(left[x] - cut(left[x], d1), 0) / pairs + rest / (size + 1)
            p = over(contexts[u, v], x, d3, over(follow[v], x, d2, p))
            total += math.log10(p)
            base += math.log10((uni[x] + 1) / (n + size + 1))
        out.append((len(w), sum(uni[x] > 0 for x in w), n, base, total))
    return out


@pytest.mark.parametrize("words, part", [(6, 1 << 22), (400, 1 << 22), (6, 16), (400, 16), (400, 1)])
def test_against_brute_force(spark, words, part):
    rng = random.Random(words)
    vocab = [f"W{k}" if k % 3 else f"é{k}" for k in range(words)]
    texts = [" ".join(rng.choice(vocab[: 1 + k]) for _ in range(rng.randint(0, 80))) for k in (rng.randrange(words) for _ in range(80))]
    texts += [None, "", " \t", "never seen words here", "a" * 3000, texts[0], texts[0]]
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)], "doc_id long, text string, score double").repartition(3)
    model = K.train(docs, F.col("doc_id") % 4 != 1, part=part)
    got = sorted(K.score(docs, model, F.col("doc_id") % 4 == 1).collect())
    want = brute([t for k, t in enumerate(texts) if k % 4 != 1], texts)
    assert [r.held_out for r in got] == [k % 4 == 1 for k in range(len(texts))]
    for r, w in zip(got, want, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3], abs=1e-9) and r.score == pytest.approx(w[4], abs=1e-9)


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "b a b", "c c a d", "a"] * 3 + ["d a", "e"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    model = K.train(docs, F.lit(True))
    words = [b"a", b"b", b"c", b"d", b"e"]
    tokens = np.array([K.tokens_of(np.frombuffer(w, np.uint8), np.array([0, 1]))[0][0] for w in words] + [K.END, 12345], np.uint64)
    texts = [[], *([x] for x in tokens), *([x, y] for x in tokens for y in tokens)]  # contexts
    for context in texts:
        rows = np.array([[*context, x] for x in tokens], np.uint64)
        begin = np.arange(len(rows) + 1) * rows.shape[1]
        _, logs = model.log10(rows.ravel(), begin)
        last = logs[begin[1:] - 1]
        assert (10**last).sum() == pytest.approx(1)  # the last stands for all unseen words


def test_tables_find_what_was_written(tmp_path):
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 5000, 100_000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        counts = [rng.geometric(0.5, len(keys)) ** 7, rng.integers(0, 40, len(keys))]
        for whole in (False, True):
            name = f"{n}-{whole}"
            K.write_table(f"file://{tmp_path}", name, keys, counts, (6, 6), whole=whole)
            table = K._table(f"file://{tmp_path}", name)
            at = table.find(keys)
            assert (at == np.arange(len(keys))).all() and (table.rows(at) == np.stack(counts, axis=1)).all()
            other = np.setdiff1d(rng.integers(0, 1 << 64, 3000, dtype=np.uint64), keys)
            assert (table.find(other) == -1).all() and not table.rows(table.find(other)).any()
    close = np.array([5, 6, 7 << 40], np.uint64)  # alike in the bits kept: written whole
    K.write_table(f"file://{tmp_path}", "close", close, [np.arange(3) << 40], (20,))
    assert K._table(f"file://{tmp_path}", "close").rows(np.arange(3))[:, 0].tolist() == [0, 1 << 40, 2 << 40]
    assert K._table(f"file://{tmp_path}", "close").find(close).tolist() == [0, 1, 2]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    nothing = K.train(docs, F.lit(False))
    row = K.score(docs, nothing, F.lit(True)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert K.score(docs.limit(0), nothing, F.lit(True)).collect() == []


def test_files_of_a_store_that_is_no_path(tmp_path, monkeypatch):
    import pyarrow.fs

    keys = np.arange(1, 2000, dtype=np.uint64) << np.uint64(40)
    for k in range(5):
        K.write_table(f"file://{tmp_path}", f"t-{k}", keys, [np.full(len(keys), k)], (20,))
    local = pyarrow.fs.SubTreeFileSystem("/", pyarrow.fs.LocalFileSystem())
    size = sum(f.stat().st_size for f in tmp_path.iterdir()) // 5

    class Remote:
        FileSystem = type("FileSystem", (), {"from_uri": staticmethod(lambda uri: (local, uri.removeprefix("other://")))})
        LocalFileSystem, FileType = pyarrow.fs.LocalFileSystem, pyarrow.fs.FileType

    monkeypatch.setattr(K.pyarrow, "fs", Remote)
    monkeypatch.setattr(K, "CACHE_BYTES", 2 * size)
    K._tables.clear()
    for k in (0, 1, 2, 3, 4, 0):
        table = K._table(f"other://{tmp_path}", f"t-{k}")
        assert (table.rows(table.find(keys))[:, 0] == k).all()
        assert len(K._tables) <= 2
    assert K._table(f"other://{tmp_path}", "none").n == 0
    K._tables.clear()
