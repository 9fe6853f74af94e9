"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 3).

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to
a word of the perfect binary Golay code [23, 12, 7].  Every 23-bit word lies
within 3 bits of exactly one codeword; decoding a segment and each of its
one-bit neighbours gives the indices of the codewords near it, one or six of
them.  Two fingerprints at 3 or fewer differing bits have, by pigeonhole, at
least two segments with at most one error each.  So for one of the three pairs
of segments (p, q) of two such fingerprints x and y, x's own codeword at p is
near y's segment, and y's own codeword at q is near x's.  Each fingerprint
therefore sends, for each pair, (own p, near q) to one side of an equi-join and
(near p, own q) to the other: 12 keys of 24 bits at most for a pair, and no
link is lost.  Candidates with one key are verified by counting bits.

Copies are no candidates: rows are grouped by fingerprint first.  Within one
key, links are reduced to a forest as they are found, so a group of near copies
costs as many output rows as it has members.  A key with more than ``CELL`` rows
on a side is dealt to cells, each with the pairs of one part of either side, so
that no task takes all of it.

Defined results: null text counts as empty; a text without words has
fingerprint zero and links like any other; fewer words than a shingle are one
shingle; rows of one doc_id are one vertex of the graph, and a null doc_id
sorts after all others; ids that aren't integers are ordered by their own type, and
component_id is of that type; repeated rows each get their row; other columns
are ignored.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LAST, bounded_batches, free_name, materialise, numbered, release, remove, small, texts
from .graph import components, forest

SEED = 42
MAX_BITS = 3
#: (shift, bits) of the three segments of a fingerprint.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR = 0b101011100011
#: Rows of one key or shingle that are compared in one task, about.
CELL = 1024
#: Key groups up to this many candidate pairs are taken together.
PAIRS_AT_ONCE = 1 << 20


class Golay:
    """Nearest-codeword decoding of 23-bit words, vectorised."""

    def __init__(self):
        unit = np.array([self._remainder(1 << k) for k in range(23)], dtype=np.int32)
        self.unit = unit
        #: syndrome -> the only error pattern of weight <= 3 that has it
        self.error = np.zeros(2048, dtype=np.int32)
        for weight in (1, 2, 3):
            for bits in combinations(range(23), weight):
                syndrome = 0
                for k in bits:
                    syndrome ^= int(unit[k])
                self.error[syndrome] = sum(1 << k for k in bits)

    @staticmethod
    def _remainder(word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= GENERATOR << (k - 11)
        return word

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.int32)
        for k in range(23):
            out ^= np.where(words >> k & 1, self.unit[k], 0).astype(np.int32)
        return out

    def own(self, words: np.ndarray) -> np.ndarray:
        """Index (12 bits) of the nearest codeword."""
        return (words ^ self.error[self.syndrome(words)]) >> 11

    def near(self, words: np.ndarray, bits: int) -> np.ndarray:
        """Indices of the codewords nearest to the word or to it with one of
        its ``bits`` low bits changed: a row each, sorted; repeats are -1."""
        flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.int32)
        units = np.concatenate([[0], self.unit[:bits]]).astype(np.int32)
        syndromes = self.syndrome(words)[:, None] ^ units[None, :]
        found = np.sort((words[:, None] ^ flips[None, :] ^ self.error[syndromes]) >> 11, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, key, side) of all keys."""
    code = golay()
    words = [((fingerprints >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int32) for s, n in SEGMENTS]
    own = [code.own(w) for w in words]
    near = [code.near(w, n) for w, (_, n) in zip(words, SEGMENTS, strict=True)]
    rows, out, sides = [], [], []
    for number, (p, q) in enumerate(combinations(range(3), 2)):
        for side, (at_p, at_q) in enumerate(((own[p][:, None], near[q]), (near[p], own[q][:, None]))):
            row, _ = np.nonzero((at_p >= 0) & (at_q >= 0))
            made = (number << 24 | at_p << 12 | at_q)[(at_p >= 0) & (at_q >= 0)]
            rows.append(row)
            out.append(made)
            sides.append(np.full(len(made), bool(side)))
    return np.concatenate(rows), np.concatenate(out).astype(np.int32), np.concatenate(sides)


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority of the bits of the shingles' XXH64, as an unsigned integer."""
    words = text.lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    if len(words) > shingle:
        parts = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    else:
        parts = [b" ".join(words)]
    digest = xxhash.xxh64_digest
    bits = np.unpackbits(np.frombuffer(b"".join([digest(x, SEED) for x in parts]), np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(parts)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """key and fp, the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(x, shingle) for x in texts(b, text)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(made)], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


def _links_within(left: np.ndarray, right: np.ndarray, near: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one key's sides that differ in ``near`` bits at most."""
    step = max(1, PAIRS_AT_ONCE // len(right))
    for k in range(0, len(left), step):
        i, j = np.nonzero(np.bitwise_count(left[k : k + step, None] ^ right[None, :]) <= near)
        yield i + k, j


def links(keyed: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], near: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges between nodes, as forests, of whole key groups in key order."""
    key, side, fps, nodes = keyed
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    sizes = np.diff(cut)
    rights = np.add.reduceat(side.astype(np.int64), cut[:-1]) if len(key) else np.empty(0, np.int64)
    lefts = sizes - rights
    pairs = lefts * rights
    small = (pairs > 0) & (pairs <= 4096)
    # small groups: all their candidate pairs at once, some groups at a time
    order = np.lexsort((side, key))  # within a key: left side first
    fps, nodes = fps[order], nodes[order]
    chosen = np.flatnonzero(small)
    ends, k = np.cumsum(pairs[chosen]), 0
    while k < len(chosen):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS_AT_ONCE, side="right")))
        some, k = chosen[k:stop], stop
        n = pairs[some]
        group = np.repeat(np.arange(len(some)), n)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        width = rights[some][group]
        i = cut[:-1][some][group] + inner // width
        j = cut[:-1][some][group] + lefts[some][group] + inner % width
        ok = (np.bitwise_count(fps[i] ^ fps[j]) <= near) & (nodes[i] != nodes[j])
        if ok.any():
            yield forest(nodes[i[ok]], nodes[j[ok]])
    for g in np.flatnonzero((pairs > 0) & ~small):
        lo, mid, hi = cut[g], cut[g] + lefts[g], cut[g + 1]
        for i, j in _links_within(fps[lo:mid], fps[mid:hi], near):
            a, b = nodes[lo:mid][i], nodes[mid:hi][j]
            ok = a != b
            held.append((a[ok], b[ok]))
            size += len(held[-1][0])
            if size > PAIRS_AT_ONCE:
                held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
        if held:
            yield forest(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0


def edges(nodes: DataFrame) -> DataFrame:
    """(a, b) node pairs that connect all fingerprints at ``MAX_BITS`` or fewer
    differing bits.  ``nodes`` has long columns node and fp, fp distinct."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, own = b.column("fp").to_numpy().view(np.uint64), b.column("node").to_numpy()
            for lo in range(0, len(fps), 1 << 14):
                row, key, side = keys(fps[lo : lo + (1 << 14)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(side), pa.array(fps[lo:][row].view(np.int64)), pa.array(own[lo:][row])],
                    names=["key", "side", "fp", "node"],
                )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def done(groups: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            key, side, fps, own = map(np.concatenate, zip(*groups, strict=True))
            found = list(links((key, side, fps.view(np.uint64), own)))
            if found:
                a, b = forest(*map(np.concatenate, zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "side", "fp", "node")]
            last = int(np.searchsorted(now[0], now[0][-1]))  # its last key may go on in the next batch
            if last:
                held.append([x[:last] for x in now])
                yield from done(held)
                held = [[x[last:] for x in now]]
            elif held and held[-1][0][-1] != now[0][0]:
                yield from done(held)
                held = [now]
            else:
                held.append(now)
        if held:
            yield from done(held)

    keyed = nodes.select("fp", "node").mapInArrow(emit, "key int, side boolean, fp long, node long")
    # a key of very many rows is dealt to cells, each with a part of either side
    sides = keyed.groupBy("key").agg(F.count_if(F.col("side")).alias("r"), F.count_if(~F.col("side")).alias("l"))
    parts = [F.ceil(F.col(c) / F.lit(CELL)).cast("int").alias(f"{c}_parts") for c in ("l", "r")]
    large = materialise(sides.where((F.col("l") > CELL) | (F.col("r") > CELL)).where("l > 0 AND r > 0").select("key", *parts), "large-keys")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("side"), F.col("r_parts")).otherwise(F.col("l_parts"))).cast("int")
    cells = F.expr("transform(sequence(0, if(side, l_parts, r_parts) - 1), o -> xxhash64(key, if(side, o, _own), if(side, _own, o)))")
    dealt = keyed.join(small(large), "key", "left").withColumn("_own", own)
    dealt = dealt.select(
        F.explode(F.when(F.col("l_parts").isNull(), F.array(F.col("key").cast("long"))).otherwise(cells)).alias("key"),
        "side",
        "fp",
        "node",
    )
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(match, "a long, b long")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hex digits) and
    component_id, the smallest key reachable over links (null only where no
    row of the component has a key)."""
    rows, keys = numbered(docs.select(key, F.col(text).alias("_text")), key, "_id")
    prints = materialise(fingerprints(rows, "_id", "_text", shingle), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("_id").alias("node")), "fingerprint-nodes")
    found = components(edges(nodes))
    labels = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("_c"))
    made = prints.join(labels, "fp").select(
        F.when(F.col("_id") != LAST, F.col("_id")).alias("_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("_c") != LAST, F.col("_c")).alias("_c"),
    )
    if keys is None:
        kind = docs.schema[key].dataType
        return made.select(F.col("_id").cast(kind).alias(key), "fingerprint", F.col("_c").alias("component_id"))
    own = keys.select(F.col("_number").alias("_id"), F.col("_own").alias(key))
    least = keys.select(F.col("_number").alias("_c"), F.col("_own").alias("component_id"))
    return made.join(own, "_id", "left").join(least, "_c", "left").select(key, "fingerprint", "component_id")


# -- near copies at a stated similarity ----------------------------------------

BANDS, ROWS = 9, 3
#: Bits of a text's parity signature: a power of two, twice its shingles or
#: more, between these.
LEAST_PARITY, MOST_PARITY = 1 << 9, 1 << 16
#: Bytes of signatures compared at once.
SIGNATURE_BYTES = 4 << 20
#: Documents, about, and occurrences in them that tell frequent shingles, and how
#: many of these are told at most.  They only steer the work, not its results.
SAMPLE_ROWS, FREQUENT, MOST_FREQUENT = 8192, 8, 1 << 17
_MULTIPLIERS = (np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: bytes, shingle: int) -> list[bytes]:
    words = text.lower().split()
    if not words:
        return []
    return list(map(b" ".join, zip(*(words[k:] for k in range(shingle))))) if len(words) > shingle else [b" ".join(words)]


def _hashes(parts: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(x, SEED) for x in parts]), np.uint8).reshape(-1, 8)


def sketch(text: bytes, shingle: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(fingerprint, band keys, distinct shingle hashes) of a text."""
    parts = shingles(text, shingle)
    if not parts:
        return 0, np.empty(0, np.int64), np.empty(0, np.uint64)
    raw = _hashes(parts)
    bits = np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    distinct = np.unique(raw.view(">u8").ravel().astype(np.uint64))
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for lo in range(0, len(distinct), 4096):
        some = distinct[lo : lo + 4096, None] * _MULTIPLIERS[None, :]
        least = np.minimum(least, (some ^ (some >> np.uint64(31))).min(axis=0))
    bands = least.reshape(BANDS, ROWS)
    keys_ = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys_ = (keys_ ^ bands[:, k]) * np.uint64(0xD6E8FEB86659FD93)
    return int.from_bytes(np.packbits(bits * 2 > len(parts)).tobytes(), "big"), keys_.view(np.int64), distinct


def exact_similarity(a: bytes, b: bytes, shingle: int) -> float:
    """Jaccard similarity of two texts' whole shingle sets."""
    x, y = set(shingles(a, shingle)), set(shingles(b, shingle))
    common = len(x & y)
    return common / (len(x) + len(y) - common) if x or y else 1.0


def prefix(distinct: np.ndarray, least: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles in one order of all (frequent ones last): two sets of
    similarity ``least`` or more share one of these."""
    n = len(distinct)
    if not n:
        return distinct
    level = np.zeros(n, np.int64)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], distinct), len(frequent[0]) - 1)
        level = np.where(frequent[0][at] == distinct, frequent[1][at], 0)
    return distinct[np.argsort(level, kind="stable")[: n - math.ceil(least * n - 1e-9) + 1]]


def parity(distinct: np.ndarray) -> bytes:
    """Parities of the shingles in each of a number of classes: two signatures,
    the longer one folded, differ in no more bits than the sets in elements."""
    size = min(MOST_PARITY, max(LEAST_PARITY, 1 << (2 * len(distinct)).bit_length()))
    return np.packbits(np.bincount((distinct >> np.uint64(16) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def differing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Bits in which the signatures of each pair differ."""
    sizes = np.array([[len(a), len(b)] for a, b in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(x), np.int64)
    for pair in np.unique(sizes, axis=0):
        some = np.flatnonzero((sizes == pair).all(axis=1))
        step, width = max(1, SIGNATURE_BYTES // int(pair.max())), int(pair.min()) // 8
        for lo in range(0, len(some), step):
            part = some[lo : lo + step].tolist()
            both = [np.bitwise_xor.reduce(
                np.frombuffer(b"".join([of[k] for k in part]), np.uint64).reshape(len(part), -1, width),
                axis=1,
            ) for of in (x, y)]
            out[part] = np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype=np.int64)
    return out


def _need(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Shingles that sets of these sizes share at a similarity of ``least``."""
    return np.ceil(least / (1 + least) * (n + m) - 1e-9)


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut between its values only."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        first = b.column(0).to_numpy()
        cut = int(np.searchsorted(first, first[-1]))
        if cut or (held and held[-1].column(0)[-1].as_py() != first[0]):
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _meetings(
    group: np.ndarray,
    component: np.ndarray,
    chunk: np.ndarray,
    inner: np.ndarray,
    n: np.ndarray,
    place: np.ndarray,
    least: float,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one cell and two components whose sizes, and the places of
    the shingle in their order if it is the first that they share, allow a
    similarity of ``least``.  Pairs of one chunk belong to its ``inner`` cell."""
    at, k = np.arange(len(group)), 0
    while len(at):
        k += 1
        at = at[at + k < len(group)]
        at = at[group[at] == group[at + k]]
        for lo in range(0, len(at), 1 << 15):
            i = at[lo : lo + (1 << 15)]
            j = i + k
            need = _need(n[i], n[j], least)
            ok = (component[i] != component[j]) & (inner[i] | (chunk[i] != chunk[j])) & (n[i] - place[i] >= need) & (n[j] - place[j] >= need)
            if ok.any():
                yield i[ok], j[ok]


def _apart(least: float):
    """Pairs (a, b) that the parity signatures don't show to be less similar
    than ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_keys(batches):
            group, own, component, chunk, inner, place, n = (t.column(c).to_numpy() for c in ("cell", "_id", "component", "chunk", "inner", "place", "n"))
            bits = t.column("parity").to_pylist()
            found: list[np.ndarray] = []
            size = 0
            for i, j in _meetings(group, component, chunk, inner, n, place, least):
                ok = differing([bits[k] for k in i.tolist()], [bits[k] for k in j.tolist()]) <= n[i] + n[j] - 2 * _need(n[i], n[j], least)
                a, b = own[i[ok]], own[j[ok]]
                if len(a):
                    found.append(np.stack([np.maximum(a, b), np.minimum(a, b)]))
                    size += len(a)
                if size > PAIRS_AT_ONCE:
                    a, b = np.unique(np.concatenate(found, axis=1), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    found, size = [], 0
            if found:
                a, b = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def free_shuffles(spark) -> None:
    """Let Spark delete the shuffle files of finished jobs now: it does so when
    the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _frequent(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that many texts of a sample have, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in texts(b, "_text"):
                if parts := shingles(x, shingle):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.unique(_hashes(parts).view(">u8").ravel().astype(np.uint64)).view(np.int64))],
                        names=["token"],
                    )

    every = max(1, rows.count() // SAMPLE_ROWS)
    some = rows.where(F.pmod(F.xxhash64("_id"), F.lit(every)) == 0).mapInArrow(run, "token long")
    found = some.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).collect()
    tokens, counts = np.array([r.token for r in found], np.int64).view(np.uint64), np.array([r.n for r in found], np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _close(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs``, a written table, that sizes and signatures don't
    show to be less similar than ``least``."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column("x").to_numpy(), b.column("y").to_numpy()
            ok = (_need(n, m, least) <= np.minimum(n, m)) & (differing(b.column("p").to_pylist(), b.column("q").to_pylist()) <= n + m - 2 * _need(n, m, least))
            yield b.select(["a", "b"]).filter(pa.array(ok))

    left = sketches.select(F.col("_id").alias("a"), F.col("n").alias("x"), F.col("parity").alias("p"))
    right = sketches.select(F.col("_id").alias("b"), F.col("n").alias("y"), F.col("parity").alias("q"))
    return materialise(
        left.join(small(pairs), "a").join(right, "b").select("a", "b", "x", "y", "p", "q").mapInArrow(settle, "a long, b long"),
        "close-pairs",
    )


def _similar(pairs: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """The (a, b) of ``pairs``, a written table, whose whole texts are of
    similarity ``least`` or more.  Only texts that pairs name are shuffled,
    where the pairs are few enough to be sent to the texts."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [exact_similarity(x, y, shingle) >= least for x, y in zip(texts(b, "x"), texts(b, "y"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    named = materialise(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "named-texts")
    needed = rows.join(small(named), "_id", "left_semi")
    one, other = needed.select(F.col("_id").alias("a"), F.col("_text").alias("x")), needed.select(F.col("_id").alias("b"), F.col("_text").alias("y"))
    found = materialise(
        one.join(small(pairs), "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long").distinct(),
        "similar-pairs",
    )
    remove(named, pairs)
    free_shuffles(rows.sparkSession)
    return found


def similar_groups(rows: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(_id, component): texts that lie in one group with a smaller ``_id``, by
    links of similarity ``least`` or more.  ``rows`` has a long _id and _text;
    rows of one _id are one member, similar to what any of them is similar to.

    First most groups are found, by some of the links: candidates are the Golay
    keys' forests, equal fingerprints, and ``BANDS`` keys of ``ROWS`` least
    hashes, each linking its texts to three of them; of a text's candidates that
    may be similar, the least and the greatest are compared.  Then all other
    links: any two similar texts share a shingle of their prefixes, so each pair
    of texts that share one and aren't in one group yet is compared, unless
    sizes, places or parity signatures prove it less similar.  A shingle that
    very many texts share is dealt out to cells, each with the pairs of two
    chunks of them.  Links count only once the whole texts are compared."""
    spark = rows.sparkSession
    bounded_batches(spark)
    frequent = _frequent(rows, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("simhash")
        for b in batches:
            made = []
            for x in texts(b, "_text"):
                fp, bands, distinct = sketch(x, shingle)
                made.append((bands, len(distinct), parity(distinct), prefix(distinct, least, frequent).view(np.int64), fp))
            columns = [b.column("_id"), pa.array(np.array([m[4] for m in made], np.uint64).view(np.int64))]
            columns += [
                pa.array([m[k] for m in made], kind) for k,
                kind in enumerate((pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.int64())))
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "fp", "bands", "n", "parity", "prefix"])

    sketches = materialise(rows.mapInArrow(run, "_id long, fp long, bands array<long>, n long, parity binary, prefix array<long>"), "sketches")
    nodes = sketches.groupBy("fp").agg(F.min("_id").alias("node"))
    same = sketches.select("_id", "fp").join(nodes, "fp").where("_id <> node").select(F.col("_id").alias("a"), F.col("node").alias("b"))
    # texts without words have no shingle to meet by: they are one group
    empty = sketches.where("n = 0").select(F.col("_id").alias("a")).crossJoin(F.broadcast(sketches.where("n = 0").agg(F.min("_id").alias("b"))))  # one row
    banded = sketches.select("_id", F.explode("bands").alias("band"))
    order = F.xxhash64("_id")
    stars = banded.groupBy("band").agg(
        F.min("_id").alias("r0"),
        F.min_by("_id", order).alias("r1"),
        F.max_by("_id", order).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    ).where("n > 1")
    starred = banded.join(stars, "band").select(F.col("_id").alias("a"), F.explode(F.array_distinct(F.array("r0", "r1", "r2"))).alias("b"))
    pairs = edges(nodes).unionByName(same).unionByName(starred).where("a <> b").select(
        F.greatest("a", "b").alias("a"),
        F.least("a", "b").alias("b"),
    ).distinct()
    pairs = materialise(pairs, "candidate-pairs")
    close = _close(pairs, sketches, least)
    some = materialise(
        close.groupBy("a").agg(F.array_distinct(F.array(F.min("b"), F.max("b"))).alias("b")).select("a", F.explode("b").alias("b")),
        "first-pairs",
    )
    linked = _similar(some, rows, shingle, least)
    first = components(linked.unionByName(empty.where("a <> b"))).withColumnRenamed("node", "_id")
    remove(pairs, close)

    named = sketches.select("_id", "n", "prefix").join(small(first), "_id", "left").select(
        "_id",
        "n",
        F.coalesce("component", "_id").alias("component"),
        F.posexplode("prefix").alias("place", "token"),
    )
    shared = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    shared = materialise(shared.select("token", F.ceil(F.col("n") / F.lit(CELL)).cast("int").alias("chunks")), "shared-shingles")
    free_shuffles(spark)
    met = materialise(
        named.select("token", "_id", "component", F.col("place").cast("long").alias("place")).join(small(shared), "token"),
        "meeting-texts",
    )
    free_shuffles(spark)
    dealt = sketches.select("_id", "n", "parity").join(small(met), "_id").withColumn("chunk", F.pmod(F.xxhash64("_id"), F.col("chunks")).cast("int"))
    cells = F.expr("transform(sequence(0, chunks - 1), c -> named_struct('cell', xxhash64(token, least(c, chunk), greatest(c, chunk)), 'inner', c = chunk))")
    dealt = dealt.withColumn("_cell", F.explode(cells)).select(
        F.col("_cell.cell").alias("cell"),
        "_id",
        "component",
        "chunk",
        F.col("_cell.inner").alias("inner"),
        "place",
        "n",
        "parity",
    )
    rest = materialise(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_apart(least), "a long, b long").distinct(), "rest-pairs")
    linked = _similar(rest, rows, shingle, least)
    done = components(first.select(F.col("_id").alias("a"), F.col("component").alias("b")).unionByName(linked)).withColumnRenamed("node", "_id")
    remove(sketches, shared, met, linked)
    free_shuffles(spark)
    return done


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, one key of each group (the smallest),
    columns unchanged; rows of one key stay or go together."""
    number, gone = free_name("_number", docs), free_name("_gone", docs)
    rows, _ = numbered(docs, key, number)
    dropped = similar_groups(rows.select(F.col(number).alias("_id"), F.col(text).alias("_text")), shingle, least)
    return rows.join(
        small(dropped.select(F.col("_id").alias(gone))),
        F.col(number) == F.col(gone),
        "left_anti",
    ).select(*[F.col(f"`{c}`") for c in docs.columns])
