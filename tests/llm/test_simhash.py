import random

import numpy as np
import xxhash

from tessera.llm import simhash as S
from tessera.llm.graph import components, forest


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_golay_is_perfect():
    code = S.golay()
    assert len(np.unique(code.error)) == 2048
    words = np.random.default_rng(1).integers(0, 1 << 23, 4000).astype(np.int32)
    assert set((code.near(words, 23) >= 0).sum(axis=1)) == {1, 6}


def planted(rng, n):
    made = set()
    while len(made) < n:
        x = rng.getrandbits(64)
        made.add(x)
        for _ in range(rng.choice([0, 0, 1, 5])):
            for k in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << k
            made.add(x)
    return sorted(made)[:]


def test_edges_connect_what_brute_force_connects(spark):
    rng = random.Random(3)
    fps = planted(rng, 900)
    centre = rng.getrandbits(64)  # one large group of near copies
    fps = sorted({*fps, *(centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40))})
    x = np.array(fps, dtype=np.uint64)
    want = brute_components([(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= 3) + i + 1], range(len(x)))
    nodes = spark.createDataFrame([(k, int(v.view(np.int64))) for k, v in enumerate(x)], "node long, fp long").repartition(5)
    got = {r.node: r.component for r in components(S.edges(nodes)).collect()}
    assert {k: got.get(k, k) for k in range(len(x))} == want


def test_large_keys_are_dealt_to_cells(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL", 8)
    test_edges_connect_what_brute_force_connects(spark)


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(4)
    ids = rng.sample(range(10**6), 400)
    pairs = list(zip(ids[:150], ids[1:150])) + [(ids[200], x) for x in ids[201:400]] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute_components(pairs, {*ids, 5})
    assert {n: got.get(n, n) for n in want} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    a, b = forest(np.array([1, 2, 9]), np.array([2, 3, 8]))
    assert dict(zip(a, b)) == {2: 1, 3: 1, 9: 8}


def slow_fingerprint(text, n):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in [*range(9, 14)]}).split(" ")
    words = [w for w in words if w]
    parts = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_near_groups_on_odd_tables(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 30
    rows = [(7, base), (3, base + "LAMBDA"), (9, base.upper()), (1, None), (4, ""), (5, "one"), (6, "One"), (8, "a\xa0b c d"), (None, "nobody else says this"), (2, "x y z w"), (2, "x y z w")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = sorted(S.near_groups(docs).collect(), key=str)
    assert sorted((r.doc_id, r.fingerprint) for r in got if r.doc_id is not None) == sorted((d, f"{slow_fingerprint(t, 3):016x}") for d, t in rows if d is not None)
    group = {r.doc_id: r.component_id for r in got}
    assert group[7] == group[3] == group[9] == 3
    assert group[1] == group[4] == 1 and group[5] == group[6] == 5 and group[None] is None and group[8] == 8
    assert len(got) == len(rows)
    # Spark's own xxhash64 is the same function
    assert spark.sql("select xxhash64('one')").first()[0] == np.uint64(xxhash.xxh64("one", seed=42).intdigest()).view(np.int64)
    assert S.near_groups(docs.limit(0)).collect() == []


def test_similar_groups_find_edited_copies(spark):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(3000)]
    base = [[rng.choice(vocab) for _ in range(n)] for n in (30, 120, 400, 900, 2500)]
    rows, want = [], {}
    for b, words in enumerate(base):
        first = len(rows)
        for copy in range(6):
            edited = list(words)
            for _ in range(copy * (len(words) // 400) if len(words) >= 400 else copy % 2 * (len(words) > 100)):
                edited[rng.randrange(len(edited))] = f"edit{rng.random()}"
            rows.append((len(rows) + 10, " ".join(edited)))
        want |= {10 + first + k: 10 + first for k in range(6)}
    rows += [(500 + k, " ".join(rng.choice(vocab) for _ in range(200)) + " one common line for them all here") for k in range(60)]
    rows += [(900, None), (901, ""), (None, "alone " * 40)]
    texts = {k: (t or "").split() for k, t in rows}

    def jaccard(a, b):
        a, b = ({" ".join(x[k : k + 5]) for k in range(max(1, len(x) - 4))} for x in (texts[a], texts[b]))
        return len(a & b) / len(a | b)

    assert all(jaccard(k, v) >= 0.8 for k, v in want.items())
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids == ((set(texts) - set(want)) | set(want.values())) - {901}  # two empty texts are copies
    assert S.drop_near_copies(docs.limit(0)).collect() == []


def jaccard_sets(text):
    w = text.split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def whole_groups(rows):
    sets = {k: jaccard_sets(t) for k, t in rows}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    return brute_components([(a, b) for a in sets for b in sets if a < b and near(a, b)], sets)


def test_pairs_among_many_variants_of_one_text_are_found(spark):
    # different texts share band keys; only the two of a pair are similar
    rng = random.Random(12)
    template, rows = [f"w{k}" for k in range(300)], []
    for pair in range(120):
        words = list(template)
        for k in rng.sample(range(300), 8):
            words[k] = f"p{pair}e{k}"
        edited = list(words)
        for k in rng.sample(range(300), 5):
            edited[k] = f"q{pair}e{k}"
        rows += [(pair, " ".join(words)), (1000 - pair, " ".join(edited))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = whole_groups(rows)
    assert 100 < len(set(want.values())) < 150
    assert {r.doc_id for r in S.drop_near_copies(docs).collect()} == set(want.values())


def test_long_texts_are_decided_on_all_their_shingles(spark):
    rng = random.Random(13)
    rows = []
    for pair in range(60):
        words = [f"p{pair}w{rng.randrange(10**6)}" for _ in range(2500)]
        edited = list(words)
        for k in rng.sample(range(5, 2495), 56 + pair % 3 * 2):  # similarities close to 0.8
            edited[k] = f"edit{rng.random()}"
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(edited))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = whole_groups(rows)
    assert 60 < len(set(want.values())) < 120
    assert {r.doc_id for r in S.drop_near_copies(docs).collect()} == set(want.values())


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(14)
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    for n in (1, 2, 5, 15, 40, 333):
        for _ in range(40):
            base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            other = np.unique(np.concatenate([base[rng.random(n) < 0.95], rng.integers(0, 1 << 63, int(rng.integers(0, n // 10 + 1))).astype(np.uint64)]))
            common = len(np.intersect1d(base, other))
            if common and common / len(np.union1d(base, other)) >= 0.8:
                told = np.sort(base[: n // 2]), rng.integers(1, 9, n // 2)
                for f in (none, told):
                    assert len(np.intersect1d(S.prefix(base, 0.8, f), S.prefix(other, 0.8, f)))
                assert S.differing([S.parity(base)], [S.parity(other)])[0] <= len(base) + len(other) - 2 * common


def test_folded_signatures_count_no_more_than_the_difference():
    rng = np.random.default_rng(15)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 200, 300, 700, 2000, 40_000)]
    sets += [np.unique(np.concatenate([sets[3][:-5], sets[1]]))]
    pairs = [(x, y) for x in sets for y in sets]
    got = S.differing([S.parity(x) for x, _ in pairs], [S.parity(y) for _, y in pairs])
    for (x, y), n in zip(pairs, got.tolist(), strict=True):
        true = len(np.setxor1d(x, y))
        assert n <= true and (n == 0) == (true == 0 or n == 0)
    assert S.differing([], []).tolist() == []


def test_a_shingle_of_many_texts_is_dealt_to_cells(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL", 16)
    rng = random.Random(16)
    rows = []
    for pair in range(60):  # short texts: the common passage is among the prefixes
        words = "this passage is in every one of the texts of this table".split() + [f"p{pair}w{k}" for k in range(40)]
        rows += [(pair, " ".join(words)), (1000 + pair, " ".join(words[:-1] + [f"edit{rng.random()}"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = whole_groups(rows)
    assert len(set(want.values())) == 60
    assert {r.doc_id for r in S.drop_near_copies(docs).collect()} == set(want.values())


def test_text_ids_and_clashing_columns(spark):
    rows = [("b", "one two three four five six seven"), ("a", "one two three four five six seven"), (None, "other words"), ("c", None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id string, text string, _gone int, _id int, _number int, _text int")
    got = {r.doc_id: r.component_id for r in S.near_groups(docs).collect()}
    assert got == {"a": "a", "b": "a", None: None, "c": "c"}
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {"a", None, "c"}
