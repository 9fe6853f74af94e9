"""Interpolated modified Kneser-Ney language model (operator 8), order 3.

Counting runs in Spark, in two passes.  The first counts words: each bucket of
the vocabulary is a sorted array of 64-bit word hashes in the shared folder, and
a word's number comes from its rank in its bucket, frequent words first.  In the
second each batch of texts sends its distinct trigrams, as numbers, to the bucket
of their middle word, so that a bucket knows all of what its middle words need:
trigram counts, the followers of each context (u v), and the distinct words
before each (v w).  Words that are a hot group, by their count in the vocabulary,
are spread over as many buckets as it takes to leave ``PART`` of their occurrences
in each, and what these know of one pair is added up in a further step.  All of
it grows with the corpus; only fourteen sums of the whole reach the driver.

n-grams are stored as sorted hash arrays: in a bucket a directory by the leading
bits of the 64-bit hash, then 32 further bits of each, and one byte that stands
for its counts (an index into a table of the bucket's commonest combinations, or
255: counts of 64 bits in a list of their own).  Scoring maps the files into
memory, or reads them into a cache of ``CACHE_BYTES`` where the shared folder is
no path, so a worker's own memory holds a slice of text at a time.

    p(w | u v) = max(c(u v w) - D3(c(u v w)), 0) / c(u v) + g3(u v) p(w | v)
    p(w | v)   = max(l(v w) - D2(l(v w)), 0) / l(v) + g2(v) p(w)
    p(w)       = max(l(w) - D1(l(w)), 0) / L + g1 / (V + 1)

with l(v w) and l(w) the number of distinct words before, l(v) and L their sums,
and discounts for each order from its counts of counts; after the start of a text
l(v w) is the count.  An unseen context leaves the lower order alone.  Words are
told apart by 64-bit hashes, the n-grams of a bucket by 32 bits more than tell
its size to a factor of 64 (by 64 bits where that would confuse two), so that an
n-gram that was never seen is taken for a seen one at most once in 2 ** 26 times.

Defined results: null text has no words and scores as its end token alone;
ASCII letters are lower-cased; every text is scored, whether it taught or not;
with no training text p is 1; repeated rows count and score each; a missing
doc_id counts as an empty text in the split; other columns are ignored.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import binary_rows, bounded_batches, bucket_count, by_bucket, fresh_path, keeps, materialise, release, remove, text_slices
from .simhash import free_shuffles
from .substring_dedup import mix, word_hashes, words_of

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Occurrences of one middle word that a bucket takes.
PART = 1 << 22
#: Input bytes for each bucket of the vocabulary.
WORDS_OF = 64 << 20
SLICE = 4 << 20
#: Bytes of model files that a worker holds, and files that it keeps mapped.
CACHE_BYTES, MOST_MAPS = 256 << 20, 4096
_ODD, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x632BE59BD9B4E019)
UNKNOWN = np.uint64(2**64 - 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bits of each count in the table of commonest combinations.
RAW, LEFT, CONTEXT, WORD = (20,), (20,), (6, 6, 4, 4), (4, 5, 5, 3, 3)
SUMS = ["files", "tokens", "words", "pairs", "c1", "c2", "c3", "c4", "b1", "b2", "b3", "b4", "l1", "l2", "l3", "l4"]
BLOBS = "kind int, bucket int, blob binary, " + ", ".join(f"{s} long" for s in SUMS)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, and each text's first token (n+1)."""
    data = _LOWER[data]
    first, end, of_text = words_of(data, offsets)
    n = len(offsets) - 1
    begin = of_text + np.arange(n + 1)
    tokens = np.empty(len(first) + n, np.uint64)
    ends = begin[1:] - 1
    inner = np.ones(len(tokens), dtype=bool)
    inner[ends] = False
    tokens[ends] = END
    tokens[inner] = word_hashes(data, first, end)
    return tokens, begin


def before(tokens: np.ndarray, begin: np.ndarray, start: np.uint64) -> np.ndarray:
    """The token before each token; ``start`` before each text's first."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[begin[:-1]] = start
    return out


def gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _ODD + b + _ADD)


def trigram(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return gram(gram(u, v), w)


def word_bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(word + _ODD) % np.uint64(buckets)).astype(np.int64)


def parts_of(raw: np.ndarray, part: int) -> np.ndarray:
    """Buckets, a power of two, that a word's trigrams are spread over."""
    return np.uint64(1) << np.ceil(np.log2(np.maximum(raw / part, 1))).astype(np.uint64)


def middle_bucket(v: np.ndarray, part: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(gram(v, part) + _ADD) % np.uint64(buckets)).astype(np.int64)


def part_of(u: np.ndarray, w: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return gram(w, u) & (parts - np.uint64(1))


def pair_bucket(pair: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(pair + _ODD) % np.uint64(buckets)).astype(np.int64)


# -- what travels ----------------------------------------------------------------


def _zip(*arrays: np.ndarray) -> bytes:
    """Whole numbers as their low bytes, plane by plane, compressed."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a, np.uint64)
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        parts += [np.array([len(a), width], np.int64).tobytes(), a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unzip(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 8
    for _ in range(int(np.frombuffer(raw, np.int64, 1)[0])):
        n, width = np.frombuffer(raw, np.int64, 2, at).tolist()
        made = np.zeros((n, 8), np.uint8)
        made[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n).T
        out.append(made.view(np.uint64).ravel())
        at += 16 + n * width
    return out


def _all(blobs: list[bytes], n: int) -> list[np.ndarray]:
    parts = [_unzip(b) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.uint64) for k in range(n)]


def _sum(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted; the first row of each; the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[cut], order[cut], *(np.add.reduceat(v[order].astype(np.int64), cut) if len(cut) else np.empty(0, np.int64) for v in values)


def _by(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its rows) of all buckets."""
    if len(bucket):
        order = np.argsort(bucket, kind="stable")
        ranked = bucket[order]
        for some in np.split(order, np.flatnonzero(ranked[1:] != ranked[:-1]) + 1):
            yield int(bucket[some[0]]), some


# -- files -----------------------------------------------------------------------


def _write(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """A file of the model, complete or absent; a repeated task writes the same."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    with fs.open_output_stream(part) as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).data)
    fs.move(part, f"{path}/{name}")


def write_table(
    folder: str,
    name: str,
    keys: np.ndarray | None,
    columns: list[np.ndarray],
    bits: tuple[int, ...],
    extra: np.ndarray | None = None,
    whole: bool = False,
) -> None:
    """Sorted distinct ``keys`` (none: rows are found by number) and counts."""
    n = len(columns[0])
    code, fits, shift = np.zeros(n, np.int64), np.ones(n, dtype=bool), 0
    for c, b in zip(columns, bits, strict=True):
        fits &= c < 1 << b
        code |= np.where(c < 1 << b, c, 0) << shift
        shift += b
    often = np.bincount(code[fits], minlength=1 << shift)
    top = np.argsort(-often, kind="stable")[:255]
    top = top[often[top] > 0]
    place = np.full(1 << shift, 255, np.uint8)
    place[top] = np.arange(len(top))
    codes = np.where(fits, place[code], 255).astype(np.uint8)
    over = np.flatnonzero(codes == 255)
    lead, low = 0, np.empty(0, np.uint32)
    if keys is not None and n and not whole:
        lead = max(0, (n // 64).bit_length())
        low = ((keys << np.uint64(lead)) >> np.uint64(32)).astype(np.uint32)
        whole = bool((((keys >> np.uint64(32 - lead))[1:]) == (keys >> np.uint64(32 - lead))[:-1]).any())
    head = np.array([n, -1 if keys is None else 64 if whole else lead, len(top), len(columns), len(over), extra is not None], np.int64)
    table = np.stack([(top >> s) & ((1 << b) - 1) for s, b in zip(np.cumsum([0, *bits])[:-1].tolist(), bits, strict=True)], axis=1).astype(np.int64)
    arrays = [head, table, np.stack([c[over] for c in columns], axis=1).astype(np.int64)]
    if keys is not None and whole:
        arrays.append(keys)
    elif keys is not None:
        arrays += [
            np.searchsorted(
                keys,
                np.arange(1 << lead, dtype=np.uint64) << np.uint64(64 - lead),
            ).astype(np.uint32) if lead else np.zeros(1, np.uint32),
            low,
        ]
    arrays += [over.astype(np.uint32)] + ([extra.astype(np.uint32)] if extra is not None else []) + [codes]
    _write(folder, name, arrays)


class Table:
    """A file of the model in memory."""

    def __init__(self, raw: np.ndarray):
        self.at = 0

        def take(kind, size):
            made = raw[self.at : self.at + size * np.dtype(kind).itemsize].view(kind)
            self.at += size * np.dtype(kind).itemsize
            return made

        self.n, self.lead, top, width, over, extra = take(np.int64, 6).tolist() if len(raw) else (0, 64, 0, 1, 0, 0)
        self.palette = np.zeros((256, width), np.int64)
        self.palette[:top] = take(np.int64, top * width).reshape(top, width)
        self.over = take(np.int64, over * width).reshape(over, width)
        if self.lead == 64:
            self.keys = take(np.uint64, self.n)
        elif self.lead >= 0:
            self.first = take(np.uint32, 1 << self.lead)
            self.keys = take(np.uint32, self.n)
        self.places = take(np.uint32, over)
        self.extra = take(np.uint32, self.n if extra else 0)
        self.codes = take(np.uint8, self.n)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it isn't in the table."""
        if not self.n:
            return np.full(len(wanted), -1)
        if self.lead == 64:
            at = np.minimum(np.searchsorted(self.keys, wanted), self.n - 1)
            return np.where(self.keys[at] == wanted, at, -1)
        slot = (wanted >> np.uint64(64 - self.lead)).astype(np.int64) if self.lead else np.zeros(len(wanted), np.int64)
        ends = np.append(self.first[1:], np.uint32(self.n)).astype(np.int64)
        lo, hi = self.first[slot].astype(np.int64), ends[slot]
        low = ((wanted << np.uint64(self.lead)) >> np.uint64(32)).astype(np.uint32)
        end = hi.copy()
        for _ in range(int((ends - self.first).max()).bit_length()):  # one binary search in all ranges
            middle = (lo + hi) >> 1
            less = (lo < hi) & (self.keys[np.minimum(middle, self.n - 1)] < low)
            lo, hi = np.where(less, middle + 1, lo), np.where(less, hi, middle)
        return np.where((lo < end) & (self.keys[np.minimum(lo, self.n - 1)] == low), lo, -1)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Counts of rows; zeros for -1."""
        known = at >= 0
        out = np.zeros((len(at), self.palette.shape[1]), np.int64)
        code = self.codes[at[known]] if self.n else np.empty(0, np.uint8)
        made = self.palette[code]
        large = np.flatnonzero(code == 255)
        if len(large):
            made[large] = self.over[np.searchsorted(self.places, at[known][large])]
        out[known] = made
        return out


_tables: OrderedDict[str, tuple[Table, int]] = OrderedDict()


def _table(folder: str, name: str) -> Table:
    """A bucket's file; a bucket that got no rows has none (``train`` has
    counted them).  What has been used last stays in memory."""
    whole = f"{folder}/{name}"
    if whole in _tables:
        _tables.move_to_end(whole)
        return _tables[whole][0]
    fs, path = pyarrow.fs.FileSystem.from_uri(whole)
    size = 0
    if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        raw = np.empty(0, np.uint8)
    elif isinstance(fs, pyarrow.fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with fs.open_input_file(path) as f:
            raw = np.frombuffer(f.readall(), np.uint8)
        size = len(raw)
    keeps("kneser-ney", _tables.clear)
    _tables[whole] = Table(raw), size
    while len(_tables) > 1 and (len(_tables) > MOST_MAPS or sum(s for _, s in _tables.values()) > CACHE_BYTES):
        _tables.popitem(last=False)
    return _tables[whole][0]


# -- the model -------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    folder: str
    word_buckets: int
    buckets: int
    part: int
    tokens: int = 0  # N, of the training texts
    words: int = 0  # V, distinct tokens
    pairs: int = 0  # L, distinct bigrams
    discounts: tuple[tuple[float, float, float], ...] = ()  # of orders 1, 2, 3
    low_rest: float = 1.0  # g1

    def find(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words (``UNKNOWN``: none) and their training counts."""
        words, at = np.unique(word, return_inverse=True)
        number, raw = np.full(len(words), UNKNOWN), np.zeros(len(words), np.int64)
        for b, some in _by(word_bucket(words, self.word_buckets)):
            table = _table(self.folder, f"words-{b}")
            place = table.find(words[some])
            ok = place >= 0
            number[some[ok]] = table.extra[place[ok]].astype(np.uint64) * np.uint64(self.word_buckets) + np.uint64(b)
            raw[some] = table.rows(place)[:, 0]
        return number[at], raw[at]

    def stats(self, number: np.ndarray) -> np.ndarray:
        """left; total, one, two, more of the followers: a row for each word."""
        numbers, at = np.unique(number, return_inverse=True)
        out = np.zeros((len(numbers), 5), np.int64)
        known = np.flatnonzero(numbers != UNKNOWN)
        for b, some in _by((numbers[known] % np.uint64(self.word_buckets)).astype(np.int64)):
            some = known[some]
            table = _table(self.folder, f"stats-{b}")
            place = (numbers[some] // np.uint64(self.word_buckets)).astype(np.int64)
            out[some] = table.rows(np.where(place < table.n, place, -1))
        return out[at]

    def _counts(self, kind: str, key: np.ndarray, bucket: np.ndarray, some: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(key), width), np.int64)
        some = np.flatnonzero(some)
        for b, part in _by(bucket[some]):
            part = some[part]
            table = _table(self.folder, f"{kind}-{b}")
            out[part] = table.rows(table.find(key[part]))
        return out

    def _pairs(self, kind: str, pair: np.ndarray, middle: np.ndarray, hot: np.ndarray, known: np.ndarray, width: int) -> np.ndarray:
        plain = self._counts(kind, pair, middle_bucket(middle, np.zeros_like(middle), self.buckets), known & ~hot, width)
        return plain + self._counts(f"hot-{kind}", pair, pair_bucket(pair, self.buckets), known & hot, width)

    def log10(self, tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's training count and log10 probability."""
        w, raw = self.find(tokens)
        start, of_start = self.find(np.array([START]))
        v, of_v = before(w, begin, start[0]), before(raw, begin, of_start[0])
        u = before(v, begin, start[0])
        parts = parts_of(of_v, self.part)
        hot, known = parts > 1, (u != UNKNOWN) & (v != UNKNOWN)
        c = self._counts("trigrams", trigram(u, v, w), middle_bucket(v, part_of(u, w, parts), self.buckets), known & (w != UNKNOWN), 1)[:, 0]
        context = self._pairs("contexts", gram(u, v), v, hot, known, 4)
        left = self._pairs("lefts", gram(v, w), v, hot, (v != UNKNOWN) & (w != UNKNOWN), 1)[:, 0]
        of_word, of_context = self.stats(w)[:, 0], self.stats(v)[:, 1:]
        d1, d2, d3 = self.discounts
        p = (np.maximum(of_word - _discount(of_word, d1), 0) / self.pairs if self.pairs else np.zeros(len(w))) + self.low_rest / (self.words + 1)
        p = _over(left, of_context, d2, p)
        return raw, np.log10(_over(c, context, d3, p))


def _over(c: np.ndarray, context: np.ndarray, d: tuple[float, float, float], low: np.ndarray) -> np.ndarray:
    """A higher order's probability, given its counts and the lower order's."""
    total = context[:, 0]
    seen = np.maximum(total, 1)
    rest = context[:, 1:] @ np.array(d)
    return np.where(total > 0, np.maximum(c - _discount(c, d), 0) / seen + rest / seen * low, low)


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c >= 3, d[2], np.where(c == 2, d[1], np.where(c == 1, d[0], 0.0)))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; where a count of counts is zero the usual
    fixed ones stand in."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(x if 0 < x <= k else f for x, k, f in zip(d, (1, 2, 3), (0.5, 1.0, 1.5), strict=True))


# -- counting ---------------------------------------------------------------------


def _four(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _classes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return c == 1, c == 2, c >= 3


def _rows(found: list[tuple[int, int, bytes]], **sums: int) -> pa.Table:
    """Blobs, and one row of sums."""
    n = len(found)
    made = {
        "kind": pa.array([x[0] for x in found] + [2], pa.int32()),
        "bucket": pa.array([x[1] for x in found] + [0], pa.int32()),
        "blob": pa.array([x[2] for x in found] + [b""], pa.binary()),
    }
    return pa.table(made | {s: pa.array([0] * n + [int(sums.get(s, 0))], pa.int64()) for s in SUMS})


def _word_blobs(w: np.ndarray, left: np.ndarray, v: np.ndarray, classes: list[np.ndarray], word_buckets: int) -> list[tuple[int, int, bytes]]:
    """What is known of words' lefts, and of their followers, for their buckets."""
    of_w = dict(_by((w % np.uint64(word_buckets)).astype(np.int64)))
    of_v = dict(_by((v % np.uint64(word_buckets)).astype(np.int64)))
    none = np.empty(0, np.int64)
    out = []
    for b in sorted({*of_w, *of_v}):
        i, j = of_w.get(b, none), of_v.get(b, none)
        out.append((1, b, _zip(w[i] // np.uint64(word_buckets), left[i], v[j] // np.uint64(word_buckets), *(c[j] for c in classes))))
    return out


def _bigrams(v: np.ndarray, w: np.ndarray, left: np.ndarray, word_buckets: int) -> tuple[list[tuple[int, int, bytes]], int]:
    """Blobs for the words of complete bigrams with their lefts, and how many."""
    word, first, n = _sum(w, np.ones_like(w))
    of, _, total, one, two, more = _sum(v, left, *_classes(left))
    return _word_blobs(word, n, of, [total, one, two, more], word_buckets), len(left)


def train(docs: DataFrame, learn: Column, text: str = "text", part: int = PART) -> Model:
    """Count the rows of ``docs`` for which ``learn`` holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = fresh_path(spark, "kneser-ney")
    buckets, word_buckets = bucket_count(docs), bucket_count(docs, WORDS_OF)
    empty = Model(folder, word_buckets, buckets, part)

    def slices(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = np.nan_to_num(pa.compute.binary_length(b.column(0)).to_numpy(zero_copy_only=False))
        for lo, hi in text_slices(sizes, SLICE):
            yield tokens_of(*binary_rows(b.column(0).slice(lo, hi - lo)))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("kneser-ney")
        for b in batches:
            parts = [np.unique(tokens, return_counts=True) for tokens, _ in slices(b)]
            if b.num_rows:
                parts.append((np.array([START]), np.array([b.num_rows])))
                word, _, n = _sum(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                found = [(g, _zip(word[some], n[some])) for g, some in _by(word_bucket(word, word_buckets))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g for g, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())],
                    names=["bucket", "blob"],
                )

    def merge_words(group: pa.Table) -> pa.Table:
        word, _, raw = _sum(*_all(group.column("blob").to_pylist(), 2))
        rank = np.empty(len(word), np.int64)
        rank[np.argsort(-raw, kind="stable")] = np.arange(len(word))
        write_table(folder, f"words-{group.column('bucket')[0].as_py()}", word, [raw], RAW, rank, whole=True)
        token = word != START
        return _rows([], files=1, tokens=raw[token].sum(), words=token.sum())

    texts_ = docs.where(learn).select(F.coalesce(text, F.lit("")).alias("t"))
    sums = [F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in SUMS]
    of_words = texts_.mapInArrow(count_words, "bucket int, blob binary").groupBy("bucket").applyInArrow(merge_words, BLOBS).agg(*sums).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, of_start = empty.find(np.array([START]))
        for b in batches:
            parts = []
            for tokens, begin in slices(b):
                w, raw = empty.find(tokens)
                v = before(w, begin, start[0])
                parts.append((before(v, begin, start[0]), v, w, before(raw, begin, of_start[0])))
            if not parts:
                continue
            u, v, w, raw = map(np.concatenate, zip(*parts, strict=True))
            del parts
            _, first, n = _sum(trigram(u, v, w), np.ones(len(w), np.int64))
            u, v, w, raw = u[first], v[first], w[first], raw[first]
            spread = parts_of(raw, part)
            bucket = middle_bucket(v, part_of(u, w, spread), buckets)
            order = np.argsort((bucket.astype(np.uint64) << np.uint64(40)) + (v & np.uint64((1 << 40) - 1)))
            groups, blobs = [], []
            for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                of = v[some]
                cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                groups.append(int(bucket[some[0]]))
                blobs.append(_zip(of[cut], np.diff(np.append(cut, len(of))), spread[some[cut]] > 1, u[some], w[some], n[some]))
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def merge(group: pa.Table) -> pa.Table:
        b = group.column("bucket")[0].as_py()
        parts = [_unzip(x) for x in group.column("blob").to_pylist()]
        v, hot = (np.concatenate([np.repeat(p[k], p[1].astype(np.int64)) for p in parts]) for k in (0, 2))
        u, w, n = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5))
        del parts
        start = empty.find(np.array([START]))[0][0]
        key, first, c = _sum(trigram(u, v, w), n)
        u, v, w, hot = u[first], v[first], w[first], hot[first] > 0
        write_table(folder, f"trigrams-{b}", key, [c], RAW)
        found: list[tuple[int, int, bytes]] = []
        pair, first, *classes = _sum(gram(u, v), c, *_classes(c))
        some = ~hot[first]
        write_table(folder, f"contexts-{b}", pair[some], [x[some] for x in classes], CONTEXT)
        follow, at, left = _sum(gram(v, w), np.where(v == start, c, 1))
        plain = ~hot[at]
        write_table(folder, f"lefts-{b}", follow[plain], [left[plain]], LEFT)
        blobs, bigrams = _bigrams(v[at][plain], w[at][plain], left[plain], word_buckets)
        found += blobs
        # parts of hot words' pairs: added up by pair
        pair, classes = pair[~some], [x[~some] for x in classes]
        follow, of, to, some_left = follow[~plain], v[at][~plain], w[at][~plain], left[~plain]
        lefts, contexts = dict(_by(pair_bucket(follow, buckets))), dict(_by(pair_bucket(pair, buckets)))
        none = np.empty(0, np.int64)
        for g in sorted({*lefts, *contexts}):
            i, j = contexts.get(g, none), lefts.get(g, none)
            found.append((0, g, _zip(pair[i], *(x[i] for x in classes), of[j], to[j], some_left[j])))
        return _rows(
            found,
            files=3,
            pairs=bigrams,
            **dict(zip(SUMS[4:8], _four(c), strict=True)),
            **dict(zip(SUMS[8:12], _four(left[plain]), strict=True)),
        )

    def merge_pairs(group: pa.Table) -> pa.Table:
        b = group.column("bucket")[0].as_py()
        pair, total, one, two, more, v, w, left = _all(group.column("blob").to_pylist(), 8)
        pair, _, *classes = _sum(pair, total, one, two, more)
        write_table(folder, f"hot-contexts-{b}", pair, classes, CONTEXT)
        follow, first, left = _sum(gram(v, w), left)
        write_table(folder, f"hot-lefts-{b}", follow, [left], LEFT)
        found, bigrams = _bigrams(v[first], w[first], left, word_buckets)
        return _rows(found, files=2, pairs=bigrams, **dict(zip(SUMS[8:12], _four(left), strict=True)))

    def merge_stats(group: pa.Table) -> pa.Table:
        b = group.column("bucket")[0].as_py()
        w, n, v, total, one, two, more = _all(group.column("blob").to_pylist(), 7)
        zero_w, zero_v = np.zeros(len(w), np.int64), np.zeros(len(v), np.int64)
        rank, _, left, *classes = _sum(
            np.concatenate([w, v]),
            np.concatenate([n.astype(np.int64), zero_v]),
            *(np.concatenate([zero_w, x.astype(np.int64)]) for x in (total, one, two, more)),
        )
        size = int(rank[-1]) + 1
        columns = []
        for x in (left, *classes):
            columns.append(np.zeros(size, np.int64))
            columns[-1][rank.astype(np.int64)] = x
        write_table(folder, f"stats-{b}", None, columns, WORD)
        return _rows([], files=1, **dict(zip(SUMS[12:16], _four(left), strict=True)))

    counted = by_bucket(texts_.mapInArrow(count, "bucket int, blob binary"), buckets)
    grams = materialise(counted.groupBy("bucket").applyInArrow(merge, BLOBS), "trigram-sums")
    free_shuffles(spark)
    hot = materialise(grams.where("kind = 0").select("bucket", "blob").groupBy("bucket").applyInArrow(merge_pairs, BLOBS), "pair-sums")
    both = grams.unionByName(hot)
    done = both.where("kind = 1").select("bucket", "blob").groupBy("bucket").applyInArrow(merge_stats, BLOBS)
    of_stats = done.agg(*sums).first()
    of_grams = both.where("kind = 2").agg(*sums).first()
    remove(grams, hot)
    free_shuffles(spark)
    files = of_words.files + of_grams.files + of_stats.files
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    written = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True)) if not f.base_name.startswith(".")]
    if len(written) != files:
        raise RuntimeError(f"{len(written)} of {files} model files in {folder}")
    words = of_words.words
    l1, l2, l3, l4 = (of_stats[s] for s in SUMS[12:16])
    d = tuple(discounts(*four) for four in ((l1, l2, l3, l4), tuple(of_grams[s] for s in SUMS[8:12]), tuple(of_grams[s] for s in SUMS[4:8])))
    rest = (d[0][0] * l1 + d[0][1] * l2 + d[0][2] * (words - l1 - l2)) / of_grams.pairs if of_grams.pairs else 1.0
    return Model(folder, word_buckets, buckets, part, of_words.tokens, words, of_grams.pairs, d, rest)


def score(docs: DataFrame, model: Model, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams), score (the model's log10 probability): one row for each row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("kneser-ney")
        for b in batches:
            sizes = np.nan_to_num(pa.compute.binary_length(b.column("t")).to_numpy(zero_copy_only=False))
            for lo, hi in text_slices(sizes, SLICE):
                tokens, begin = tokens_of(*binary_rows(b.column("t").slice(lo, hi - lo)))
                raw, logs = model.log10(tokens, begin)
                base = np.log10((raw + 1) / (model.tokens + model.words + 1))
                each = [np.add.reduceat(x, begin[:-1]) for x in ((raw > 0).astype(np.int64), base, logs)]
                rows = [
                    b.column("k").slice(lo, hi - lo),
                    b.column("h").slice(lo, hi - lo),
                    pa.array(np.diff(begin).astype(np.int64)),
                    pa.array(each[0]),
                    pa.array(np.full(hi - lo, model.tokens, np.int64)),
                    pa.array(each[1]),
                    pa.array(each[2]),
                ]
                yield pa.RecordBatch.from_arrays(rows, names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), held_out.alias("h"), F.coalesce(text, F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
