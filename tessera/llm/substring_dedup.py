"""Substring deduplication by super-k-mer partitioning (operator 2).

A window is ``WINDOW`` consecutive words of one document.  Each window has a
minimiser, the least hash among its runs of ``MINIMISER`` words; consecutive
windows that share it travel as one packed string, a super-k-mer, to the bucket
of the minimiser.  Equal windows have equal minimisers, so they meet in one
bucket, where sorting brings them together and counts them exactly: the sort is
by a 64-bit hash, and the words of all windows of a run are compared with the
first's (runs with a collision are grouped by their words).  All windows but
the earliest of each run are repeats; their runs return to their documents,
which drop the words they cover.

Equal super-k-mers within an Arrow batch are merged before they travel: all but
the earliest are repeats whatever the other batches hold, and need no bucket but
go to any.  Strings of one batch and bucket are one compressed row.

Minimisers that many documents of a sample have are hot: their super-k-mers are
cut further, by the windows' second minimiser (another hash), and dealt to
buckets by both, and they are merged over all of a task's batches, not only
within one.  So a passage that is in a third of all documents sends one string
for each task, not for each copy, and what follows or precedes a common phrase is
spread.  The sample steers the work only: equal windows have both minimisers in
common, so they meet in one bucket either way.

Defined results: null text has no words; words are kept byte for byte and
joined by one space; texts shorter than a window lose nothing; windows are
judged on the input.  Documents are ordered by doc_id, a null doc_id after all
others, rows of one doc_id by a 64-bit hash of their text; ids that aren't
integers are ordered by their own type; identical rows count as one document and
each get its result.  Columns of other names are kept by ``drop_repeats``.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import binary_rows, bounded_batches, bucket_count, by_bucket, free_name, materialise, numbered, release, remove, text_slices

WINDOW = 20
MINIMISER = 4
SLICE = 1 << 20
#: Documents, about, of the sample that tells hot minimisers; a minimiser is hot
#: if it has so many super-k-mers of the sample, and a quarter (``HOT_SHARE``) of
#: what a bucket has of it on average; how many are told at most; and strings of
#: hot ones that a task remembers.  They only steer the work, not its results.
SAMPLE_ROWS, HOT, HOT_SHARE, MOST_HOT, REMEMBERED = 8192, 16, 4, 1 << 15, 1 << 16

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MUL
    return x ^ (x >> np.uint64(29))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and each text's first word (n+1)."""
    dark = ~_WHITE[data]
    before, after = np.empty_like(dark), np.empty_like(dark)
    if len(data):
        before[0], after[-1] = True, True
        before[1:], after[:-1] = ~dark[:-1], ~dark[1:]
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        before[inner], after[inner - 1] = True, True
    first = np.flatnonzero(dark & before)
    return first, np.flatnonzero(dark & after) + 1, np.searchsorted(first, offsets)


#: Masks of a word's first 0 to 8 bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    size = end - first
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix(size.astype(np.uint64) * _ODD ^ (eight[first] & _FIRST[np.minimum(size, 8)]))
    some, k = np.flatnonzero(size > 8), 8
    while len(some):
        out[some] = mix(out[some] * _ODD ^ (eight[first[some] + k] & _FIRST[np.minimum(size[some] - k, 8)]))
        k += 8
        some = some[size[some] > k]
    return mix(out * _ODD)


def joined(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words, each followed by one space, and where each begins."""
    size = end - first
    at = np.cumsum(size + 1) - (size + 1)
    out = np.full(int(size.sum()) + len(size), 0x20, dtype=np.uint8)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[step + np.repeat(at, size)] = data[step + np.repeat(first, size)]
    return out.tobytes(), at


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    low = x
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    return np.minimum(low[: len(x) - width + 1], low[width - span :][: len(x) - width + 1])


def super_kmers(data: np.ndarray, offsets: np.ndarray, window: int, m: int, hot: np.ndarray | None = None):
    """(text number, first word within it, windows, minimiser, second minimiser
    or 0, string start, string end) of each super-k-mer, and the joined words of
    all texts.  ``hot`` are the sorted minimisers that are cut by a second."""
    first, end, of_text = words_of(data, offsets)
    n = len(first)
    if n < window:
        return None
    hashes = word_hashes(data, first, end)
    grams = np.zeros(n - m + 1, dtype=np.uint64)
    for k in range(m):
        grams = mix(grams * _ODD + hashes[k : n - m + 1 + k])
    low = sliding_min(grams, window - m + 1)
    second = np.zeros(len(low), np.uint64)
    if hot is not None and len(hot):
        of_hot = hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low
        if of_hot.any():
            second[of_hot] = sliding_min(mix(grams ^ _MUL), window - m + 1)[of_hot]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(of_text))
    ok = text[: n - window + 1] == text[window - 1 :]
    starts = np.flatnonzero(ok)
    if not len(starts):
        return None
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (low[starts[1:]] != low[starts[:-1]]) | (second[starts[1:]] != second[starts[:-1]])
    begin = starts[new]
    windows = np.diff(np.append(np.flatnonzero(new), len(starts)))
    string, at = joined(data, first, end)
    last = begin + windows + window - 2  # the last word
    return text[begin], begin - of_text[text[begin]], windows, low[begin], second[begin], at[begin], at[last] + (end - first)[last], string


#: key, tag, start, windows
_KINDS = (np.int64, np.int64, np.int32, np.int32)


def _pack(skm: dict[str, list], known: list[tuple[int, int, int, int]]) -> bytes:
    """One batch's super-k-mers of one bucket, and runs already known to be
    repeats, as one compressed string."""
    arrays = [np.array(skm["key"], np.int64), np.array(skm["tag"], np.int64), np.array(skm["start"], np.int32), np.array(skm["windows"], np.int32)]
    runs = [np.array([r[k] for r in known], t) for k, t in enumerate(_KINDS)]
    head = np.array([len(skm["key"]), len(known)], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([
        head.tobytes(),
        *(a.tobytes() for a in arrays),
        *(a.tobytes() for a in runs),
        b" ".join(skm["text"]),
    ]))


def _unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, r = np.frombuffer(raw, np.int64, 2)
    at, out = 16, []
    for size in (n, r):
        for kind in _KINDS:
            out.append(np.frombuffer(raw, kind, size, at))
            at += int(size) * np.dtype(kind).itemsize
    return out[:4], out[4:], raw[at:]


def _runs(marked: np.ndarray, piece: np.ndarray, key: np.ndarray, tag: np.ndarray, start: np.ndarray):
    """Marked windows joined to runs: key, tag, first window, windows."""
    at = np.flatnonzero(marked)
    if not len(at):
        return [x[:0] for x in (key, tag, start, start)]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (piece[at[1:]] != piece[at[:-1]])
    lead = at[new]
    return key[lead], tag[lead], start[lead], np.diff(np.append(np.flatnonzero(new), len(at))).astype(np.int32)


def bucket_repeats(blobs: list[bytes], window: int = WINDOW):
    """(key, tag, start, windows) of all runs of windows in one bucket that
    occur earlier too."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    metas, known, ids = [], [], []
    for blob in blobs:
        meta, runs, string = _unpack(blob)
        known.append(runs)
        if len(meta[0]):
            metas.append(meta)
            ids.append(np.fromiter(map(numbers.__getitem__, string.split(b" ")), np.int64))
    out = [[np.concatenate([k[i] for k in known]) for i in range(4)]]
    if metas:
        key, tag, start, windows = (np.concatenate([m[i] for m in metas]) for i in range(4))
        word = np.concatenate(ids)
        widths = windows.astype(np.int64) + window - 1
        origin = np.cumsum(widths) - widths
        piece = np.repeat(np.arange(len(key)), windows)
        inner = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = origin[piece] + inner
        key, tag, start = key[piece], tag[piece], (start[piece] + inner).astype(np.int32)
        mixed = mix(word.astype(np.uint64) + _ODD)
        hashed = np.zeros(len(word) - window + 1, np.uint64)
        for k in range(window):
            hashed = hashed * _ODD + mixed[k : len(word) - window + 1 + k]
        hashed = hashed[at]
        order = np.argsort(hashed)
        same = hashed[order[1:]] == hashed[order[:-1]]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        some = order[several]
        marked = np.zeros(len(at), dtype=bool)
        if len(some):
            some = some[np.lexsort((start[some], tag[some], key[some], hashed[some]))]
            new = np.concatenate([[True], hashed[some[1:]] != hashed[some[:-1]]])
            lead = some[np.flatnonzero(new)[np.cumsum(new) - 1]]
            differs = np.zeros(len(some), dtype=bool)
            for k in range(window):
                differs |= word[at[some] + k] != word[at[lead] + k]
            if differs.any():  # two sequences share a hash: group by the words
                groups = np.isin(hashed[some], hashed[some[differs]])
                leaders: dict[tuple, int] = {}
                lead = lead.copy()
                for i in np.flatnonzero(groups):
                    lead[i] = leaders.setdefault(tuple(word[at[some[i]] : at[some[i]] + window]), some[i])
            marked[some] = (key[some] != key[lead]) | (tag[some] != tag[lead]) | (start[some] != start[lead])
        out.append(_runs(marked, piece, key, tag, start))
    return [np.concatenate([o[i] for o in out]) for i in range(4)]


def hot_minimisers(rows: DataFrame, window: int, m: int, buckets: int) -> np.ndarray:
    """Minimisers (sorted) of many super-k-mers of a sample of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.nan_to_num(pa.compute.binary_length(b.column("_text")).to_numpy(zero_copy_only=False))
            for lo, hi in text_slices(sizes, SLICE):
                made = super_kmers(*binary_rows(b.column("_text").slice(lo, hi - lo)), window, m)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(made[3].view(np.int64))], names=["low"])

    every = max(1, rows.count() // SAMPLE_ROWS)
    some = rows.where(F.pmod(F.xxhash64("_tag"), F.lit(every)) == 0).select("_text").mapInArrow(run, "low long")
    counts = materialise(some.groupBy("low").agg(F.count(F.lit(1)).alias("n")), "minimisers")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(HOT, total // (HOT_SHARE * buckets))
    found = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "low").limit(MOST_HOT).collect()
    remove(counts)
    return np.sort(np.array([r.low for r in found], np.int64).view(np.uint64))


def repeats(rows: DataFrame, window: int = WINDOW, m: int = MINIMISER, buckets: int | None = None) -> DataFrame:
    """(_key, _tag, start, windows): runs of windows that occur earlier, by
    document.  ``rows`` has the document's place in the order, _key, the hash of
    its text, _tag, and its _text."""
    bounded_batches(rows.sparkSession)
    buckets = buckets or bucket_count(rows)
    hot = hot_minimisers(rows, window, m, buckets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("substrings")
        sent: dict[bytes, tuple[int, int, int]] = {}  # the earliest of each string that this task has sent
        turn = 0
        for b in batches:
            keys, tags = b.column("_key").to_numpy(), b.column("_tag").to_numpy()
            order = np.lexsort((tags, keys))
            repeated = np.zeros(len(order), dtype=bool)  # identical rows are one document
            repeated[1:] = (keys[order[1:]] == keys[order[:-1]]) & (tags[order[1:]] == tags[order[:-1]])
            order = order[~repeated]
            keys, tags = keys[order], tags[order]
            texts = b.column("_text").take(pa.array(order))
            sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
            seen: set[bytes] = set()
            out: dict[int, dict[str, list]] = defaultdict(lambda: {"key": [], "tag": [], "start": [], "windows": [], "text": []})
            known: list[tuple[int, int, int, int]] = []
            for lo, hi in text_slices(np.nan_to_num(sizes), SLICE):
                data, offsets = binary_rows(texts.slice(lo, hi - lo))
                made = super_kmers(data, offsets, window, m, hot)
                if made is None:
                    continue
                of, start, windows, low, second, a, z, string = made
                bucket = (np.where(second > 0, mix(low + second * _ODD), low) % np.uint64(buckets)).tolist()
                for k, t, s, n, g, h, i, j in zip(
                    keys[lo + of].tolist(),
                    tags[lo + of].tolist(),
                    start.tolist(),
                    windows.tolist(),
                    bucket,
                    second.tolist(),
                    a.tolist(),
                    z.tolist(),
                    strict=True,
                ):
                    piece = string[i:j]
                    if piece in seen:
                        known.append((k, t, s, n))
                        continue
                    seen.add(piece)
                    if h:
                        if sent.get(piece, (k, t, s)) < (k, t, s):
                            known.append((k, t, s, n))
                            continue
                        if len(sent) >= REMEMBERED:
                            sent.clear()
                        sent[piece] = (k, t, s)
                    o = out[g]
                    o["key"].append(k)
                    o["tag"].append(t)
                    o["start"].append(s)
                    o["windows"].append(n)
                    o["text"].append(piece)
            # runs known to be repeats need no bucket of their own
            groups = sorted(out)
            blobs = [_pack(out[g], []) for g in groups]
            for lo in range(0, len(known), 1 << 12):
                turn += 1
                groups.append((int(keys[0]) + turn) % buckets)
                blobs.append(_pack({"key": [], "tag": [], "start": [], "windows": [], "text": []}, known[lo : lo + (1 << 12)]))
            if groups:
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def count_windows(group: pa.Table) -> pa.Table:
        found = bucket_repeats(group.column("blob").to_pylist(), window)
        return pa.table([pa.array(x) for x in found], names=["_key", "_tag", "start", "windows"])

    packed = rows.select("_key", "_tag", "_text").mapInArrow(cut, "bucket int, blob binary")
    return by_bucket(packed, buckets).groupBy("bucket").applyInArrow(count_windows, "_key long, _tag long, start int, windows int")


def keep_words(text: bytes, runs: list[tuple[int, int]], window: int) -> tuple[int, int, bytes]:
    """(words, removed words, kept text) of one document."""
    words = text.split()
    if not runs:
        return len(words), 0, b" ".join(words)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for start, n in runs:
        cover[start] += 1
        cover[start + n + window - 1] -= 1
    kept = np.cumsum(cover[:-1]) == 0
    return len(words), int(len(words) - kept.sum()), b" ".join([words[k] for k in np.flatnonzero(kept)])


def drop_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    m: int = MINIMISER,
    columns: list[str] | None = None,
    digest: bool = False,
) -> DataFrame:
    """``columns`` of ``docs`` (default: all but the results' names) and
    n_words, n_removed, and kept_text or, if ``digest``, kept_sha256."""
    names = [c for c in (docs.columns if columns is None else columns) if c not in ("n_words", "n_removed", "kept_text", "kept_sha256")]
    place = free_name("_place", docs)
    ordered, _ = numbered(docs, key, place)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = ordered.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
        whole.alias("_text"),
        F.col(place).alias("_key"),
        F.xxhash64(whole).alias("_tag"),
    )
    found = repeats(rows, window, m, bucket_count(docs)).groupBy("_key", "_tag").agg(F.collect_list(F.struct("start", "windows")).alias("_runs"))
    both = rows.join(found.hint("shuffle_hash"), ["_key", "_tag"], "left").drop("_key", "_tag")
    last = "kept_sha256" if digest else "kept_text"

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [
                keep_words(t.encode(), [(r["start"], r["windows"]) for r in runs or ()], window) for t,
                runs in zip(b.column("_text").to_pylist(), b.column("_runs").to_pylist(), strict=True)
            ]
            made = [hashlib.sha256(x[2]).hexdigest() if digest else x[2].decode() for x in done]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[: len(names)],
                    pa.array([x[0] for x in done], pa.int64()),
                    pa.array([x[1] for x in done], pa.int64()),
                    pa.array(made, pa.string()),
                ],
                names=[*b.schema.names[: len(names)], "n_words", "n_removed", last],
            )

    schema = StructType(both.schema.fields[: len(names)]).add("n_words", "long").add("n_removed", "long").add(last, "string")
    return both.mapInArrow(drop, schema).withColumnsRenamed({f"c{i}": c for i, c in enumerate(names)})


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
