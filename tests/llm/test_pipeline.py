"""Each stage of the pipeline against brute force on the smallest tables."""

import hashlib
import re

import public_tokenizers as P
import pyarrow.parquet as pq
import tiktoken

import corpus_pipeline as C
from tessera.llm import bpe, mixing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, columns = docs.collect(), docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stages = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]

    good = stages["quality classifier"](spark, docs, SF)
    assert good.columns == columns
    kept = {r.doc_id for r in good.collect()}
    known = [r.doc_id for r in start if r.doc_id in labels]
    assert sum((d in kept) == bool(labels[d]) for d in known) / len(known) > 0.9

    unique = stages["exact dedup"](spark, good.cache(), SF)
    groups = {}
    for r in start:
        if r.doc_id in kept:
            groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r.text), []).append((-len(r.text), r.doc_id))
    ids = {r.doc_id for r in unique.collect()}
    assert unique.columns == columns and ids == {min(g)[1] for g in groups.values()}

    apart = stages["SimHash near-dedup"](spark, unique.cache(), SF)
    text = {r.doc_id: r.text for r in start if r.doc_id in ids}
    shingles = {}
    for d, t in text.items():
        w = t.encode().lower().split()
        shingles[d] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    parent = {d: d for d in text}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in text:
        for b in text:
            if a < b and len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert apart.columns == columns
    left = {r.doc_id for r in apart.collect()}
    assert left == {root(d) for d in text}

    mixed = stages["mixing sources to target weights"](spark, apart.cache(), SF)
    assert mixed.columns == columns and sorted(r.doc_id for r in mixed.collect()) == sorted(left)

    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(C.RANKS)), special_tokens={})
    for r in stages["byte-level BPE encoding and decoding"](spark, mixed, SF).collect():
        ids_ = theirs.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids_), hashlib.sha256(",".join(map(str, ids_)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stage(spark):
    assert C.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_the_schedule_survives_a_write_and_read(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    C.mix_sources(spark, docs, SF).write.parquet(f"{tmp_path}/mixed")
    # whatever order the files' parts are packed in
    again = spark.read.parquet(f"{tmp_path}/mixed").repartition(7, "doc_id")
    C.byte_level_bpe(spark, again, SF).write.parquet(f"{tmp_path}/tokens")
    got = [d for p in sorted((tmp_path / "tokens").glob("part-*")) for d in pq.read_table(p).column("doc_id").to_pylist()]
    want = [r.doc_id for r in mixing.mix(docs).orderBy("mix_slot", "mix_start").collect()]
    assert len(want) > 100 and got == want
