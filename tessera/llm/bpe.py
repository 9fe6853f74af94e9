"""Byte-level BPE: linear-time encoding and decoding (operator 5) and token
counting (operator 10).

Encoding maps bytes to Latin-1 characters so that an Aho-Corasick automaton
over the vocabulary yields, in one pass, the longest token that starts at each
byte.  The encoder walks from longest match to longest match and backtracks to
the next shorter prefix where two neighbouring tokens could not stand next to
each other in a greedy-merge result.  That test depends on the two tokens
alone, so it is memoised.  Every byte position is abandoned at most once, which
keeps a piece linear in its length.

Counting needs no ids: adjacent pairs wait in a heap by merge rank, symbols sit
in a doubly linked list, and the count is the number of initial symbols minus
the merges done.

Both work on pre-tokenised pieces and memoise space-delimited chunks.  A memo
holds ``MEMO_BYTES`` at most, and nothing of more than ``LONGEST`` characters,
so memory is bounded, and results do not depend on it.

Defined results: null text counts as empty (no tokens); very long pieces cost
linear time (encoding) or n log n (counting); columns beyond those named are
left out of the results or passed through untouched, as each function says.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain
from sys import getsizeof

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import bounded_batches, keeps, release

#: Bytes of one memo, keys, values and slots counted.
MEMO_BYTES = 160 << 20
#: Longest piece or chunk, in characters, that is memoised.
LONGEST = 64
#: Bytes of a dictionary's slot, about, with room to grow.
SLOT = 90
#: A space inside a run of white space, where splitting before it would cut a
#: piece in two; such texts are split by the pattern alone.
WHITE = r"\t-\r\x20\x85\xa0  -     　"
INNER_SPACE = regex.compile(rf"[{WHITE}] (?:[{WHITE}]|\Z)")


class Memo(dict):
    """A memo of a function of one argument, bounded in bytes, in two
    generations: when the young one is full it replaces the old one, and what is
    used again returns from there, so frequent entries stay."""

    def __init__(self, make, limit: int = MEMO_BYTES):
        super().__init__()
        self.make, self.limit, self.size, self.old = make, limit, 0, {}

    def __missing__(self, key):
        if type(key) is str and len(key) > LONGEST:
            return self.make(key)
        value = self.old.pop(key, None)
        if value is None:  # no memo holds None
            value = self.make(key)
        # a tuple of one id is shared by all that have it
        self.size += getsizeof(key) + SLOT + (getsizeof(value) if type(value) is tuple and len(value) > 1 else 0)
        if self.size > self.limit // 2:
            self.old, self.size = dict(self), 0
            self.clear()
        self[key] = value
        return value


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_bytes: int = MEMO_BYTES):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.size_of = {i: len(t) for t, i in ranks.items()}
        self.single = {i: (i,) for i in self.bytes_of}
        self.digits = {i: str(i) for i in self.bytes_of}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.halves = Memo(self._halves, memo_bytes)
        self.prefix = Memo(self._prefix, memo_bytes)
        self.fits = Memo(self._fits, memo_bytes)
        self.pieces = Memo(self.encode_piece, memo_bytes)
        self.first = Memo(self._chunk, memo_bytes // 4)
        self.later = Memo(lambda part: self._chunk(" " + part), memo_bytes)

    # -- pairs ---------------------------------------------------------------

    def _halves(self, i: int) -> tuple[int, int]:
        """The last merge that makes token i; a byte is its own two halves."""
        token, ranks = self.bytes_of[i], self.ranks
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best, at = min(((ranks.get(a + b, i), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(i, 0))
            if best >= i:
                return i, i  # no merge leads here
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (i, i)

    def _prefix(self, i: int) -> int:
        token, ranks = self.bytes_of[i], self.ranks
        return next((r for k in range(len(token) - 1, 0, -1) if (r := ranks.get(token[:k])) is not None), -1)

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether merging by rank would keep the boundary between two tokens:
        undo their last merges, newest first, and see if at any time the two
        symbols at the boundary would have merged earlier."""
        left, right = pair
        bytes_of, ranks, halves = self.bytes_of, self.ranks, self.halves
        limit = 1 << 62
        while True:
            joined = ranks.get(bytes_of[left] + bytes_of[right])
            if joined is not None and joined < limit:
                return False
            # undo the merge that came later; at equal times the left one came first
            can_left, can_right = halves[left][1] != left, halves[right][0] != right
            if not can_left and not can_right:
                return True
            if can_left and (left > right or not can_right):
                limit, left = left, halves[left][1]
            else:
                limit, right = right + 1, halves[right][0]

    # -- pieces --------------------------------------------------------------

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        if whole is not None:
            return self.single[whole]
        size_of, prefix, fits, n = self.size_of, self.prefix, self.fits, len(data)
        longest = [0] * n
        for end, i in self.automaton.iter(data.decode("latin-1")):
            longest[end - size_of[i] + 1] = i  # longer ones end later
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + size_of[token]
            if open_at[end] and (not out or fits[out[-1], token]):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
                continue
            shorter = prefix[token]
            if shorter >= 0:
                token = shorter
                continue
            open_at[at] = 0
            token = out.pop()
            at -= size_of[token]
            # the token itself led to a dead end; its successor is now closed
        return tuple(out)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        pieces = self.find(chunk)
        return self.pieces[pieces[0]] if len(pieces) == 1 else tuple(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if INNER_SPACE.search(text):
            return list(self._chunk(text))
        head, *tail = text.split(" ")
        return [*self.first[head], *chain.from_iterable(map(self.later.__getitem__, tail))]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str, int], Codec] = {}


def codec(path: str, pattern: str, memo_bytes: int = MEMO_BYTES) -> Codec:
    """One codec for each worker process and vocabulary."""
    if (path, pattern, memo_bytes) not in _codecs:
        keeps("codec", _codecs.clear)
        _codecs[path, pattern, memo_bytes] = Codec(read_ranks(path), pattern, memo_bytes)
    return _codecs[path, pattern, memo_bytes]


def _strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` plus ``ids`` array<int>; a column of that name
    is replaced."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            lists = [own.encode(x) for x in _strings(b, text)]
            flat = np.fromiter(chain.from_iterable(lists), np.int32)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*b.schema.names, ids])

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(ids, ArrayType(IntegerType())))


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns plus ``decoded`` binary; null ids decode to no bytes."""
    bounded_batches(tokens.sparkSession)
    tokens = tokens.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            made = pa.array([own.decode(x or ()) for x in b.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, out])

    from pyspark.sql.types import BinaryType, StructType

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields]).add(out, BinaryType()))


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Encode each text and decode its ids in one pass: key, n_tokens,
    ids_sha256 (of the decimal ids joined by commas), decoded_sha256.  One row
    for each row, repeated and null keys included.  ``memo_bytes`` bounds each memo:
    less takes less of a worker's memory and more of its time."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("codec")
        own, sha = codec(path, pattern, memo_bytes), hashlib.sha256
        digits = own.digits.__getitem__
        for b in batches:
            counts, coded, decoded = [], [], []
            for x in _strings(b, text):
                found = own.encode(x)
                counts.append(len(found))
                coded.append(sha(",".join(map(digits, found)).encode()).hexdigest())
                decoded.append(sha(own.decode(found)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(key), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


# -- counting ------------------------------------------------------------------


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible
    Latin-1 characters stand for themselves, the rest follow from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def refuse(spec: dict) -> None:
    """Raise ``ValueError`` for a file of the tokenizers library that asks for
    what the counter doesn't do."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    unfit = [
        (model.get("type", "BPE") != "BPE", "a model that isn't BPE"),
        (model.get("dropout"), "dropout"),
        (model.get("ignore_merges"), "ignored merges"),
        (model.get("byte_fallback"), "byte fallback"),
        (model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"), "affixes of subwords"),
        (spec.get("normalizer"), "a normaliser"),
        (
            before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True),
            "another pre-tokeniser than plain byte level",
        ),
        (any(t.get(f) for t in spec.get("added_tokens", ()) for f in ("lstrip", "rstrip", "single_word")), "added tokens with flags"),
    ]
    for wrong, what in unfit:
        if wrong:
            raise ValueError(f"the vocabulary file asks for {what}")


class Counter:
    """Token counts for a byte-level BPE file of the tokenizers library."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        self.start = [vocab[letters[b]] for b in range(256)]
        #: pair of symbols -> rank << 32 | merged symbol
        self.merge = {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])
        special = [t["content"] for t in spec.get("added_tokens", ()) if t["content"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_strings = special
        self.find = regex.compile(self.PATTERN).findall
        self.pieces = Memo(self.count_piece)
        self.first = Memo(self._chunk, MEMO_BYTES // 4)
        self.later = Memo(lambda part: self._chunk(" " + part))

    def count_piece(self, piece: str) -> int:
        start, merge = self.start, self.merge
        symbols = [start[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = left = len(symbols)
        if n < 2:
            return n
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(m >> 32, k, symbols[k] << 32 | symbols[k + 1]) for k in range(n - 1) if (m := merge.get(symbols[k] << 32 | symbols[k + 1])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, k, pair = pop(heap)
            right = after[k]
            if symbols[k] < 0 or right >= n or symbols[k] << 32 | symbols[right] != pair:
                continue  # one of the two has been merged since
            made = merge[pair] & 0xFFFFFFFF
            symbols[k], symbols[right] = made, -1
            left -= 1
            follow = after[k] = after[right]
            if follow < n:
                before[follow] = k
                if (m := merge.get(made << 32 | symbols[follow])) is not None:
                    push(heap, (m >> 32, k, made << 32 | symbols[follow]))
            lead = before[k]
            if lead >= 0 and (m := merge.get(symbols[lead] << 32 | made)) is not None:
                push(heap, (m >> 32, lead, symbols[lead] << 32 | made))
        return left

    def _chunk(self, chunk: str) -> int:
        return sum(map(self.pieces.__getitem__, self.find(chunk)))

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if INNER_SPACE.search(text):
            return self._chunk(text)
        head, *tail = text.split(" ")
        return self.first[head] + sum(map(self.later.__getitem__, tail))

    def count(self, text: str) -> int:
        """Special strings inside the text are one token each, as the library
        has it by default."""
        if self.special and any(s in text for s in self.special_strings):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        keeps("counter", _counters.clear)
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit): one row
    for each row; null text has 0 bytes and 0 tokens."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("counter")
        own = counter(path)
        for b in batches:
            rows = _strings(b, text)
            counts = pa.array([own.count(x) for x in rows], pa.int64())
            sizes = pa.array([len(x) if x.isascii() else len(x.encode()) for x in rows], pa.int64())
            over = pa.array([x > limit for x in counts.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(key), sizes, counts, over], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
