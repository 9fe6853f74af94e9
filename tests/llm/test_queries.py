"""The registered queries on the smallest tables against plain programs."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tessera.llm import bpe, queries, webp
from tokenizers import Tokenizer

from .test_kneser_ney import brute
from .test_simhash import brute_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def rows(spark, name):
    found = queries.QUERIES[name](spark, SF).collect()
    assert len(found) == len({r.doc_id for r in found})
    return {r.doc_id: r for r in found}


def test_op1(spark, docs):
    got = rows(spark, "op1_webp_lossless")
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r, media = got[k], webp.to_media(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        parts = np.frombuffer(payload, np.uint8).reshape(64, -1).astype(int).sum(axis=1)
        bits = "".join("1" if p * 64 > parts.sum() else "0" for p in parts.tolist())
        assert r.feature == f"{len(payload) // 576}x576:{int(bits, 2):016x}:{int(parts.sum()) * 1000 // len(payload)}"


def test_op3(spark, docs):
    got = rows(spark, "op3_simhash_golay")
    prints = {k: slow_fingerprint(t, 3) for k, t in docs.items()}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == prints
    near = [(a, b) for a in docs for b in docs if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {k: r.component_id for k, r in got.items()} == brute_components(near, docs)


def test_op5(spark, docs):
    got = rows(spark, "op5_byte_bpe")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(queries.RANKS)), special_tokens={})
    for k, text in docs.items():
        ids = library.encode_ordinary(text or "")
        r = got[k]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_op7(spark, docs):
    got = rows(spark, "op7_quality_nbsvm")
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in got.items())
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    held = [k for k in labels if got[k].held_out]
    assert sum(got[k].predicted == labels[k] for k in held) > 0.8 * len(held)
    assert {k: r.score for k, r in rows(spark, "op7_quality_nbsvm").items()} == {k: r.score for k, r in got.items()}


def test_op8(spark, docs):
    got = rows(spark, "op8_kneser_ney")
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in docs}
    want = brute([t for k, t in docs.items() if not held[k]], docs.values())
    for (k, h), w in zip(held.items(), want, strict=True):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, *w[:3])
        assert r.base_score == pytest.approx(w[3], rel=1e-9) and r.score == pytest.approx(w[4], rel=1e-9)


def test_op10(spark, docs):
    got = rows(spark, "op10_token_counts")
    library = Tokenizer.from_file(P.path(queries.COUNTED))
    for k, text in docs.items():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((text or "").encode()), n, n > 1024)
