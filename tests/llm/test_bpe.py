import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessera.llm import bpe

PIECES = [" ", "  ", "\n", "\t", "a", "the", " <|endoftext|>", "é", "\x1c", "\x85", "\xa0", "　", "日本", "\U0001f600", "1", "²", "!", "'s", "'ll", "abc", "​", "ZZ", "́", "<|endoftext|>", "\x00"]


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(5)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    made += ["".join(chr(rng.choice([rng.randint(0, 300), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    return [*made, "", "a" * 5000, "ab" * 3000, "aaab" * 777, " " * 4000, "\n" * 999 + "x"]


def test_encoding_is_the_librarys(samples):
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.Codec(ranks, P.PATTERN)
    for text in samples:
        assert ours.encode(text) == theirs.encode_ordinary(text), text
        assert ours.decode(ours.encode(text)) == text.encode()


def test_counts_are_the_librarys(samples):
    theirs = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ours = bpe.counter(P.path("byte_bpe_50k.json"))
    for text in samples:
        assert ours.count(text) == len(theirs.encode(text, add_special_tokens=False).ids), text


def test_memo_limit_changes_nothing():
    own = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    text = "the cat sat on the mat, and the dog; " * 3
    want = own.encode(text)
    for memo in (own.pieces, own.first, own.later, own.fits, own.halves, own.prefix):
        memo.clear()
        memo.limit = 2
    assert own.encode(text) == want


def test_operators_on_odd_tables(spark):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (None, "a", None), (3, None, "y"), (4, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = sorted(bpe.round_trip(docs, path, P.PATTERN).collect(), key=str)
    assert len(got) == 5
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id in (3, 4)} == {(0, empty, empty)}
    back = bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted(bytes(r.decoded).decode() for r in back) == sorted(x[1] or "" for x in rows)
    counts = bpe.count_tokens(docs, P.path("byte_bpe_50k.json"), limit=1).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in counts) == [(0, 0, False), (0, 0, False), (1, 1, False), (7, 2, True), (7, 2, True)]
    assert bpe.round_trip(docs.limit(0), path, P.PATTERN).collect() == []


def test_memos_are_bounded_in_bytes():
    made = []
    memo = bpe.Memo(lambda k: made.append(k) or (k,) * 10, limit=20_000)
    for k in range(3000):
        assert memo[f"key{k}"] == (f"key{k}",) * 10
        assert memo["often"] == ("often",) * 10
        assert memo["long" * 50] == ("long" * 50,) * 10
    assert memo.size <= 10_000 and len(memo) + len(memo.old) < 100
    assert made.count("often") == 1 and made.count("long" * 50) == 3000


def test_unfit_vocabulary_files_are_refused():
    fit = {"model": {"type": "BPE"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}
    bpe.refuse(fit)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}, {"model": {"type": "WordPiece"}}, {"model": {"type": "BPE", "byte_fallback": True}}, {"added_tokens": [{"content": "x", "lstrip": True}]}):
        try:
            bpe.refuse(fit | change)
        except ValueError:
            continue
        raise AssertionError(change)
