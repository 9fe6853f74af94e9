"""Lossless WebP columns (operator 1): a decoder for the whole format, an
encoder, and DataFrame operators on top.

``decode`` reads RIFF/VP8L: simple and normal prefix codes, meta prefix codes,
back-references, the colour cache, and the four transforms (predictor,
cross-colour, subtract-green, colour indexing with pixel bundling), and gives
an RGBA pixel array.

Where only the green channel carries bits and there is no colour cache (samples
of one channel), the symbol and length at *every* bit position are looked up at
once with numpy; literal runs are then followed four symbols a step, and only
back-references are handled one by one.  All other streams take the general
loop; both give the same pixels.

What it holds at once is bounded: bit positions are taken ``CHUNK`` bytes at a
time.

The encoder finds real back-references: places chosen by their content (a hash
of the next bytes) are compared with earlier places of the same hash, matches
are grown to both sides and checked, and runs of one pixel copy their neighbour.
Of the transforms it takes those that pay for the image at hand: the palette
where 16 colours or fewer occur, the predictor (each tile with the mode, of those
that the row above alone decides, that leaves least) where it shortens the
samples by estimate.

``store_payloads`` keeps a text's bytes, padded with 255 to a positive multiple
of 576, as 8-bit samples in the green channel of one file, 576 wide.  Up to
16,384 rows are a simple file; more, which no VP8L image can hold, are frames of
the same container, one below the other on one canvas.  ``read_payloads`` decodes
the stored bytes again and describes what it has read.

Defined results: null text counts as empty (one row of 255); media that is
null, cut short or not lossless WebP raises ``ValueError`` in ``decode`` and
gives null pixels and an error text in ``decode_media``; columns of other names
are ignored or kept as each function says; repeated rows each get their row.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ._common import bounded_batches, release, texts

ROW = 576
MAX_SIDE = 1 << 14
MAX_COPY = 4096
#: Bytes whose bit positions are looked up at once.
CHUNK = 1 << 16
#: Bytes of a match at least, and how far back it may lie.
LEAST_MATCH, FARTHEST = 24, (1 << 20) - 120
#: Rows of a frame.
FRAME_ROWS = MAX_SIDE
#: Side of a predictor's tile, as a power of two, and the modes that the encoder
#: chooses from: nothing, above, above left, and the mean of these.
TILE, MODES = 5, (0, 2, 4, 8)
#: Longest code that the encoder makes; decoding tables hold up to 15 bits.
ENCODED_BITS = 12

# Fixed values of the format (RFC 9649): the order in which code lengths of the
# code length code are stored, and the neighbours (dx, dy) of distance codes 1-120.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1),
    (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4),
    (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6),
    (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5),
    (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD


# -- bits ----------------------------------------------------------------------


class Reader:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)

    def __call__(self, n: int) -> int:
        at = self.at
        if at + n > self.end:
            raise ValueError("lossless WebP data is cut short")
        self.at = at + n
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        at = self.at
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << n) - 1)


class Writer:
    def __init__(self):
        self.value, self.size = 0, 0

    def __call__(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def bits(self) -> np.ndarray:
        raw = self.value.to_bytes((self.size + 7) // 8, "little")
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: self.size]


# -- prefix codes --------------------------------------------------------------


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of the given lengths, first bit lowest."""
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return np.zeros(len(lengths), np.int64)
    order = used[np.lexsort((used, lengths[used]))]
    sizes = lengths[order].astype(np.int64)
    longest = int(sizes.max())
    shares = np.int64(1) << (longest - sizes)
    if shares.sum() != 1 << longest:
        raise ValueError("a prefix code is not complete")
    codes = (np.cumsum(shares) - shares) >> (longest - sizes)
    flipped = np.zeros(len(order), np.int64)
    for k in range(longest):
        flipped |= np.where(k < sizes, (codes >> np.maximum(sizes - 1 - k, 0) & 1) << k, 0)
    out = np.zeros(len(lengths), np.int64)
    out[order] = flipped
    return out


class Code:
    """A decoding table: symbol and length by the next ``bits`` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            raise ValueError("a prefix code without symbols")
        if len(used) == 1:
            self.bits, self.symbols, self.sizes = 0, used.astype(np.int32), np.zeros(1, np.int32)
        else:
            self.bits = int(lengths.max())
            self.symbols = np.empty(1 << self.bits, np.int32)
            self.sizes = np.empty(1 << self.bits, np.int32)
            codes = canonical(lengths)
            for s in used.tolist():
                step = 1 << int(lengths[s])
                self.symbols[codes[s] :: step] = s
                self.sizes[codes[s] :: step] = lengths[s]
        self.single = int(used[0]) if len(used) == 1 else None

    def read(self, r: Reader) -> int:
        if self.single is not None:
            return self.single
        k = r.peek(self.bits)
        r.at += int(self.sizes[k])
        if r.at > r.end:
            raise ValueError("lossless WebP data is cut short")
        return int(self.symbols[k])


_length_codes: dict[tuple[int, ...], Code] = {}


def read_code(r: Reader, alphabet: int) -> Code:
    if r(1):  # simple: one or two symbols
        lengths = np.zeros(max(alphabet, 256), np.int32)
        two = r(1)
        lengths[r(8 if r(1) else 1)] = 1
        if two:
            lengths[r(8)] = 1
        return Code(lengths)
    stored = [0] * 19
    for k in range(4 + r(4)):
        stored[LENGTH_ORDER[k]] = r(3)
    own = tuple(stored)
    if own not in _length_codes:
        if len(_length_codes) > 256:
            _length_codes.clear()
        _length_codes[own] = Code(np.array(stored, np.int32))
    code = _length_codes[own]
    left = 2 + r(2 + 2 * r(3)) if r(1) else alphabet
    lengths = np.zeros(alphabet, np.int32)
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        k = code.read(r)
        if k < 16:
            lengths[at] = k
            last = k or last
            at += 1
            continue
        value, n = (last, 3 + r(2)) if k == 16 else (0, 3 + r(3)) if k == 17 else (0, 11 + r(7))
        if at + n > alphabet:
            raise ValueError("too many code lengths")
        lengths[at : at + n] = value
        at += n
    return Code(lengths)


def code_lengths(counts: np.ndarray, limit: int = ENCODED_BITS) -> np.ndarray:
    """Huffman code lengths of at most ``limit`` bits; symbols that don't occur
    get none, a sole symbol gets length 1."""
    counts = counts.astype(np.int64)
    used = np.flatnonzero(counts).tolist()
    lengths = np.zeros(len(counts), np.int32)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    while True:
        heap = [(c, s) for c, s in zip(counts[used].tolist(), range(len(used)), strict=True)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(used) - 1)
        for node in range(len(used), 2 * len(used) - 1):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = node
            heapq.heappush(heap, (a[0] + b[0], node))
        depth = [0] * len(parent)
        for node in range(len(parent) - 2, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[: len(used)]) <= limit:
            lengths[used] = depth[: len(used)]
            return lengths
        counts[used] = (counts[used] + 1) >> 1


#: The encoder's code for code lengths: 13 of 4 bits and 6 of 5, complete.
_PLAIN = np.array([4] * 13 + [5] * 6, np.int32)
_PLAIN_CODES = canonical(_PLAIN).tolist()


def write_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and (not used or used[-1] < 256):
        w(1, 1)
        w(max(0, len(used) - 1), 1)
        w(1, 1)
        w(used[0] if used else 0, 8)
        if len(used) == 2:
            w(used[1], 8)
        return
    w(0, 1)
    w(15, 4)
    for s in LENGTH_ORDER:
        w(int(_PLAIN[s]), 3)
    w(0, 1)  # all lengths follow

    def token(k: int, extra: int = 0, n: int = 0) -> None:
        w(_PLAIN_CODES[k], int(_PLAIN[k]))
        if n:
            w(extra, n)

    at = 0
    for s in [*used, len(lengths)]:
        gap = s - at
        while gap >= 11:
            n = min(gap, 138)
            token(18, n - 11, 7)
            gap -= n
        if gap >= 3:
            token(17, gap - 3, 3)
            gap = 0
        for _ in range(gap):
            token(0)
        if s < len(lengths):
            token(int(lengths[s]))
        at = s + 1


def prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their number) of a length or distance of 1 or more."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    return 2 * top + (v >> (top - 1) & 1), v & ((1 << (top - 1)) - 1), top - 1


def unprefix(symbol: int, r: Reader) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + r(n) + 1


# -- entropy-coded images ------------------------------------------------------


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = NEIGHBOURS[code - 1]
    return max(1, dx + dy * width)


def _copy(out: np.ndarray, at: int, distance: int, n: int) -> None:
    if distance > at:
        raise ValueError("a back-reference before the first pixel")
    if at + n > len(out):
        raise ValueError("a back-reference past the last pixel")
    if distance >= n:
        out[at : at + n] = out[at - distance : at - distance + n]
    else:
        out[at : at + n] = np.resize(out[at - distance : at], n)


def _green_only(r: Reader, width: int, size: int, codes: list[Code]) -> np.ndarray:
    """Pixels where only the green code (and lengths and distances) has bits."""
    green = codes[0]
    base = codes[3].single << 24 | codes[1].single << 16 | codes[2].single
    if green.single is not None and green.single < 256:
        return np.full(size, base | green.single << 8, np.uint32)
    out = np.empty(size, np.uint32)
    done = 0
    while done < size:
        first = r.at >> 3
        data = np.frombuffer(r.data, np.uint8, min(CHUNK, len(r.data) - first), first)
        last = first + len(data) == len(r.data)
        data = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
        n = len(data) - 4
        if not n:
            raise ValueError("lossless WebP data is cut short")
        windows = data[:n] | data[1 : n + 1] << 8 | data[2 : n + 2] << 16
        windows = (windows[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32((1 << green.bits) - 1)).ravel()
        symbols = green.symbols[windows]
        sizes = green.sizes[windows]
        # a chunk's last bits are read with the next one
        stop = len(symbols) - 1 if last else len(symbols) - 32
        here = np.arange(len(symbols), dtype=np.int32)
        one = np.where((symbols < 256) & (here < stop), here + sizes, here)  # others stay where they are
        np.minimum(one, len(symbols) - 1, out=one)
        two = one[one]
        four = two[two]
        step, kind = memoryview(four), memoryview(symbols)
        at, start = r.at - 8 * first, 8 * first
        while done < size and (at < stop or last):
            if kind[at] < 256:
                run, limit = [], (size - done + 3) // 4
                while len(run) < limit:
                    run.append(at)
                    onward = step[at]
                    if onward == at:
                        break
                    at = onward
                spots = np.array(run, np.int32)
                spots = np.stack([spots, one[spots], two[spots], one[two[spots]]], axis=1).ravel()
                spots = spots[(symbols[spots] < 256) & ((spots < stop) | last)][: size - done]
                # places after a stop repeat: each literal is one place
                spots = spots[np.concatenate([[True], spots[1:] != spots[:-1]])] if len(spots) else spots
                if not len(spots):
                    raise ValueError("lossless WebP data is cut short")
                out[done : done + len(spots)] = base | symbols[spots].astype(np.uint32) << 8
                done += len(spots)
                at = int(spots[-1]) + int(sizes[spots[-1]])
                if at >= len(symbols):
                    break
                if done < size and at < stop and kind[at] < 256:
                    raise ValueError("lossless WebP data is cut short")
                continue
            symbol = kind[at]
            r.at = start + at + int(sizes[at])
            if symbol >= 280:
                raise ValueError("a colour cache symbol without a colour cache")
            length = unprefix(symbol - 256, r)
            _copy(out, done, _distance(unprefix(codes[4].read(r), r), width), length)
            done += length
            at = r.at - start
        r.at = start + at
        if r.at > r.end or (done < size and r.at == r.end):
            raise ValueError("lossless WebP data is cut short")
    return out


def read_image(r: Reader, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as height x width ARGB words; only the ``top``
    one may have meta prefix codes."""
    cache_bits = r(4) if r(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, meta, meta_bits, across = 1, None, 0, 0
    if top and r(1):
        meta_bits = r(3) + 2
        across = (width + (1 << meta_bits) - 1) >> meta_bits
        down = (height + (1 << meta_bits) - 1) >> meta_bits
        meta = (read_image(r, across, down, False) >> 8 & 0xFFFF).ravel().tolist()
        groups = max(meta) + 1
    alphabets = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(r, n) for n in alphabets] for _ in range(groups)]
    size = width * height
    if groups == 1 and not cache_bits and all(c.single is not None for c in codes[0][1:4]):
        return _green_only(r, width, size, codes[0]).reshape(height, width)
    out = np.empty(size, np.uint32)
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift = 32 - cache_bits
    done = cached = 0
    while done < size:
        own = codes[meta[(done // width >> meta_bits) * across + (done % width >> meta_bits)]] if meta else codes[0]
        symbol = own[0].read(r)
        if symbol < 256:
            red = own[1].read(r)
            blue = own[2].read(r)
            out[done] = own[3].read(r) << 24 | red << 16 | symbol << 8 | blue
            done += 1
        elif symbol < 280:
            length = unprefix(symbol - 256, r)
            _copy(out, done, _distance(unprefix(own[4].read(r), r), width), length)
            done += length
        else:
            for x in out[cached:done].tolist():
                cache[(CACHE_FACTOR * x & 0xFFFFFFFF) >> shift] = x
            cached = done
            out[done] = cache[symbol - 280]
            done += 1
    return out.reshape(height, width)


# -- transforms ----------------------------------------------------------------


def _bytes(image: np.ndarray) -> np.ndarray:
    """height x width x (blue, green, red, alpha)."""
    return np.ascontiguousarray(image, "<u4").view(np.uint8).reshape(*image.shape, 4)


def _predicted(mode: int, left, up, up_right, up_left):
    """A pixel's prediction from neighbours (lists of 4 channels)."""
    avg = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    if mode == 1:
        return left
    if mode == 2:
        return up
    if mode == 3:
        return up_right
    if mode == 4:
        return up_left
    if mode == 5:
        return avg(avg(left, up_right), up)
    if mode == 6:
        return avg(left, up_left)
    if mode == 7:
        return avg(left, up)
    if mode == 8:
        return avg(up_left, up)
    if mode == 9:
        return avg(up, up_right)
    if mode == 10:
        return avg(avg(left, up_left), avg(up, up_right))
    if mode == 11:
        to_left = sum(abs(u - c) for u, c in zip(up, up_left))
        to_up = sum(abs(x - c) for x, c in zip(left, up_left))
        return left if to_left < to_up else up
    if mode == 12:
        return [min(255, max(0, x + u - c)) for x, u, c in zip(left, up, up_left)]
    if mode == 13:
        return [min(255, max(0, a + int((a - c) / 2))) for a, c in zip(avg(left, up), up_left)]
    return [0, 0, 0, 255]


def _from_above(modes: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Predictions of a row's pixels but the first, where the row above alone
    decides them (modes 0, 2, 4, 8)."""
    up, corner = above[1:], above[:-1]
    black = np.array([0, 0, 0, 255], np.uint8)
    mean = ((up.astype(np.uint16) + corner) >> 1).astype(np.uint8)
    kind = modes[1:, None]
    return np.where(kind == 2, up, np.where(kind == 4, corner, np.where(kind == 8, mean, black)))


def predict(image: np.ndarray, modes: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Subtract (``forward``) or add each pixel's prediction.  Predictions use
    original pixels, so the inverse goes pixel by pixel; the first row, and rows
    that the row above decides, are taken at once."""
    height, width = image.shape
    given = _bytes(image)
    real = given if forward else np.zeros_like(given)
    out = np.zeros_like(given)
    sign = -1 if forward else 1

    def put(y, x, guess):
        made = (given[y, x].astype(np.int64) + sign * np.asarray(guess)) & 255
        out[y, x] = made
        if not forward:
            real[y, x] = made

    for y in range(height):
        row = (modes[y >> bits] >> 8 & 0xF).tolist()
        if y == 0:
            guess = np.zeros_like(given[0])
            guess[0, 3] = 255
            if forward:
                guess[1:] = real[0, :-1]
                out[0] = given[0] - guess
            else:
                real[0] = out[0] = np.cumsum(np.concatenate([given[0, :1] + guess[:1], given[0, 1:]]), axis=0, dtype=np.uint8)
            continue
        if set(row) <= {*MODES}:
            guess = np.concatenate([real[y - 1, :1], _from_above(np.repeat(row, 1 << bits)[:width], real[y - 1])])
            out[y] = given[y] - guess if forward else given[y] + guess
            if not forward:
                real[y] = out[y]
            continue
        above = real[y - 1].tolist()
        for x in range(width):
            if x == 0:
                put(y, x, above[0])
            else:
                right = above[x + 1] if x + 1 < width else real[y, 0].tolist()
                put(y, x, _predicted(row[x >> bits], real[y, x - 1].tolist(), above[x], right, above[x - 1]))
    return out.view("<u4").reshape(height, width)


def cross_colour(image: np.ndarray, elements: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    height, width = image.shape
    px = _bytes(image).astype(np.int32)
    el = _bytes(elements).view(np.int8).astype(np.int32)
    el = el.repeat(1 << bits, axis=0)[:height].repeat(1 << bits, axis=1)[:, :width]
    green_to_red, green_to_blue, red_to_blue = el[..., 0], el[..., 1], el[..., 2]
    signed = lambda c: c.astype(np.uint8).view(np.int8).astype(np.int32)
    green, red, blue = signed(px[..., 1]), px[..., 2], px[..., 0]
    shift = green_to_red * green >> 5
    whole = red if forward else (red + shift) & 255  # red as it is without the transform
    to_blue = (green_to_blue * green >> 5) + (red_to_blue * signed(whole) >> 5)
    sign = -1 if forward else 1
    px[..., 2] = (red + sign * shift) & 255
    px[..., 0] = (blue + sign * to_blue) & 255
    return px.astype(np.uint8).view("<u4").reshape(height, width)


def add_green(image: np.ndarray, forward: bool) -> np.ndarray:
    px = _bytes(image).copy()
    for c in (0, 2):
        px[..., c] = px[..., c] - px[..., 1] if forward else px[..., c] + px[..., 1]
    return px.view("<u4").reshape(image.shape)


def palette_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def from_palette(image: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    bits = palette_bits(len(table))
    index = image >> 8 & 0xFF
    if bits:
        per, each = 1 << bits, 8 >> bits
        index = (index[:, :, None] >> (np.arange(per, dtype=np.uint32) * each) & ((1 << each) - 1)).reshape(len(image), -1)[:, :width]
    full = np.zeros(256, np.uint32)  # an index past the table is transparent black
    full[: len(table)] = table
    return full[index]


def to_palette(image: np.ndarray, table: np.ndarray) -> np.ndarray:
    index = np.searchsorted(table, image).astype(np.uint32)
    bits = palette_bits(len(table))
    if bits:
        per, each = 1 << bits, 8 >> bits
        index = np.pad(index, ((0, 0), (0, -index.shape[1] % per)))
        index = (index.reshape(len(index), -1, per) << (np.arange(per, dtype=np.uint32) * each)).sum(axis=2, dtype=np.uint32)
    return index << 8


def _running(table: np.ndarray) -> np.ndarray:
    return np.cumsum(_bytes(table[None])[0].astype(np.int64), axis=0).astype(np.uint8).view("<u4").ravel()


# -- whole files ---------------------------------------------------------------


def _frames(data: bytes) -> tuple[list[tuple[int, int, int, int]], int, int]:
    """(x, y, first byte, size) of each VP8L chunk, and the canvas (0, 0 where
    the only image is all of it)."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    end = 8 + int.from_bytes(data[4:8], "little")
    if len(data) > end + (end & 1):
        raise ValueError("bytes after the end of the file")
    number = lambda at: int.from_bytes(data[at : at + 3], "little")
    found, width, height = [], 0, 0

    def walk(at: int, stop: int, x: int, y: int) -> None:
        nonlocal width, height
        while at + 8 <= min(stop, len(data)):
            kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if kind == b"VP8L":
                if at + 8 + size > len(data):
                    raise ValueError("lossless WebP data is cut short")
                found.append((x, y, at + 8, size))
            elif kind == b"VP8X":
                width, height = number(at + 12) + 1, number(at + 15) + 1
            elif kind == b"ANMF":
                walk(at + 24, at + 8 + size, 2 * number(at + 8), 2 * number(at + 11))
            at += 8 + size + (size & 1)

    walk(12, end, 0, 0)
    if not found:
        raise ValueError("no lossless image in the file")
    return found, width, height


def decode_argb(data: bytes) -> np.ndarray:
    """The pixels of a file as ARGB words.  Frames of one file are laid on its
    canvas in order, each over what is there; the rest is transparent."""
    frames, width, height = _frames(data)
    if len(frames) == 1:
        _, _, first, size = frames[0]
        return _decode_frame(data[first : first + size])
    canvas = np.zeros((height, width), np.uint32)
    for x, y, first, size in frames:
        part = _decode_frame(data[first : first + size])
        if y + part.shape[0] > height or x + part.shape[1] > width:
            raise ValueError("a frame outside the canvas")
        canvas[y : y + part.shape[0], x : x + part.shape[1]] = part
    return canvas


def _decode_frame(body: bytes) -> np.ndarray:
    r, size = Reader(body), len(body)
    if size < 5 or r(8) != 0x2F:
        raise ValueError("no lossless image in the file")
    width, height = r(14) + 1, r(14) + 1
    r(1)
    if r(3):
        raise ValueError("unknown version")
    undo, seen, now = [], set(), width
    while r(1):
        kind = r(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (0, 1):
            bits = r(3) + 2
            side = lambda n: (n + (1 << bits) - 1) >> bits  # noqa: B023, E731
            part = read_image(r, side(now), side(height), False)
            undo.append((predict if kind == 0 else cross_colour, part, bits))
        elif kind == 2:
            undo.append((add_green,))
        else:
            table = _running(read_image(r, r(8) + 1, 1, False)[0])
            undo.append((from_palette, table, now))
            now = (now + (1 << palette_bits(len(table))) - 1) >> palette_bits(len(table))
    image = read_image(r, now, height, True)
    for step, *with_ in reversed(undo):
        image = step(image, *with_) if step is from_palette else step(image, *with_, False)
    return image


def decode(data: bytes) -> np.ndarray:
    """height x width x RGBA."""
    return _bytes(decode_argb(data))[..., [2, 1, 0, 3]]


def find_copies(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sample, length and distance of copies, in order and apart: of runs,
    from the sample before; of matches, from anywhere up to ``FARTHEST`` back."""
    n = len(samples)
    same = np.concatenate([[False], samples[1:] == samples[:-1]])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    starts, lengths = edges[::2], np.diff(edges)[::2]
    found = [(s, k, 1) for s, k in zip(starts[lengths >= 8].tolist(), lengths[lengths >= 8].tolist(), strict=True)]
    if n > 2 * LEAST_MATCH:
        eight = np.ndarray(n - LEAST_MATCH + 1, "<u8", samples, strides=(1,))
        # one place in eight, chosen by the bytes there
        places = np.flatnonzero((eight * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(61) == 0)
        later = np.ndarray(n - 7, "<u8", samples, strides=(1,))
        key = (eight[places] * np.uint64(0x9E3779B97F4A7C15) ^ later[places + 8]) * np.uint64(0xD6E8FEB86659FD93) ^ later[places + 16]
        order = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        if len(again):
            pairs = sorted(zip(places[order[again + 1]].tolist(), places[order[again]].tolist(), strict=True))
            data, reach = samples.tobytes(), 0
            matches = []
            for at, source in pairs:
                distance = at - source
                if at < reach or distance > FARTHEST or data[at : at + LEAST_MATCH] != data[source : source + LEAST_MATCH]:
                    continue
                while at > reach and source > 0 and data[at - 1] == data[source - 1]:
                    at, source = at - 1, source - 1
                length = LEAST_MATCH
                while at + length < n:
                    step = min(512, n - at - length)
                    a, b = samples[at + length : at + length + step], samples[source + length : source + length + step]
                    differ = np.flatnonzero(a != b)
                    length += int(differ[0]) if len(differ) else step
                    if len(differ):
                        break
                matches.append((at, length, distance))
                reach = at + length
            found = _apart(found, matches)
    made = np.array(sorted(found), np.int64).reshape(-1, 3)
    return made[:, 0], made[:, 1], made[:, 2]


def _apart(runs: list[tuple[int, int, int]], matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Matches, and of runs what lies between them."""
    out, k = list(matches), 0
    for start, length, distance in runs:
        while k < len(matches) and matches[k][0] + matches[k][1] <= start:
            k += 1
        at, end, j = start, start + length, k
        while at < end:
            if j < len(matches) and matches[j][0] <= at:
                at, j = max(at, matches[j][0] + matches[j][1]), j + 1
                continue
            stop = min(end, matches[j][0]) if j < len(matches) else end
            if stop - at >= 8:
                out.append((at, stop - at, distance))
            at = stop
    return out


def write_image(w: Writer, image: np.ndarray, top: bool, cache_bits: int = 0) -> np.ndarray:
    """Code an image; what ``w`` holds and the rest of the bits come back as one
    array, and ``w`` is spent."""
    pixels = np.ascontiguousarray(image, np.uint32).ravel()
    if not ((pixels ^ pixels[0]) & np.uint32(0xFFFF00FF)).any():
        starts, lengths, distances = find_copies((pixels >> 8).astype(np.uint8))
    else:
        starts, lengths, distances = _pixel_runs(pixels)
    keep = np.ones(len(pixels), dtype=bool)
    for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        keep[s : s + n] = False
    green = (pixels >> 8 & 0xFF).astype(np.int64)
    cached = np.zeros(len(pixels), dtype=bool)
    if cache_bits:
        cache, shift = [None] * (1 << cache_bits), 32 - cache_bits
        for k, x in enumerate(pixels.tolist()):
            slot = (CACHE_FACTOR * x & 0xFFFFFFFF) >> shift
            if keep[k] and cache[slot] == x:
                green[k], cached[k] = 280 + slot, True
            cache[slot] = x
    copies = []  # (pixel, symbol, extra, extra bits; the same three of the distance)
    for at, n, d in zip(starts.tolist(), lengths.tolist(), distances.tolist(), strict=True):
        far = prefix(2 if d == 1 else d + 120)  # code 2: the pixel to the left
        while n:
            part = min(n, MAX_COPY)
            copies.append((at, *prefix(part), *far))
            at, n = at + part, n - part
    alphabet = 280 + (1 << cache_bits if cache_bits else 0)
    counts = [np.bincount(green[keep], minlength=alphabet)]
    for c in copies:
        counts[0][256 + c[1]] += 1
    plain = keep & ~cached
    channels = [(pixels[plain] >> s & 0xFF).astype(np.int64) for s in (16, 0, 24)]
    counts += [np.bincount(c, minlength=256) for c in channels]
    near = np.bincount([c[4] for c in copies], minlength=40) if copies else np.zeros(40, np.int64)
    lengths_of = [code_lengths(c) for c in [*counts, near]]
    w(1, 1) if cache_bits else w(0, 1)
    if cache_bits:
        w(cache_bits, 4)
    if top:
        w(0, 1)
    for own in lengths_of:
        write_code(w, own)
    sizes = [own if (own > 0).sum() > 1 else np.zeros_like(own) for own in lengths_of]
    codes = [canonical(own) for own in lengths_of]
    # every symbol with its place in the stream: pixel, then channel
    values, widths, places = [codes[0][green[keep]]], [sizes[0][green[keep]]], [np.flatnonzero(keep) * 8]
    for k, c in enumerate(channels):
        if sizes[k + 1].any():
            values.append(codes[k + 1][c])
            widths.append(sizes[k + 1][c])
            places.append(np.flatnonzero(plain) * 8 + 1 + k)
    if copies:
        at, symbol, extra, n, far, rest, m = (np.array(x, np.int64) for x in zip(*copies, strict=True))
        values += [codes[0][256 + symbol], extra, codes[4][far], rest]
        widths += [sizes[0][256 + symbol], n, sizes[4][far], m]
        places += [at * 8, at * 8 + 1, at * 8 + 2, at * 8 + 3]
    if len(values) > 1:
        order = np.argsort(np.concatenate(places), kind="stable")
        values, widths = np.concatenate(values)[order], np.concatenate(widths)[order]
    else:
        values, widths = values[0], widths[0]
    return np.concatenate([w.bits(), _bits(values, widths)])


def _bits(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The bits of all values, each of its width (24 at most)."""
    ends = np.cumsum(widths)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.uint8)
    begin = ends - widths
    placed = values.astype(np.int64) << (begin & 7)
    first, size = begin >> 3, (int(ends[-1]) >> 3) + 5
    # bits of different values don't overlap, so the bytes' sums are their unions
    out = sum(np.bincount(first + k, placed >> 8 * k & 255, size) for k in range(4))
    return np.unpackbits(out.astype(np.uint8), bitorder="little")[: int(ends[-1])]


def _pixel_runs(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one pixel, where more than one channel has bits."""
    same = np.concatenate([[False], pixels[1:] == pixels[:-1]])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    starts, lengths = edges[::2], np.diff(edges)[::2]
    long = lengths >= 8
    return starts[long], lengths[long], np.ones(long.sum(), np.int64)


def _continued(bits: np.ndarray) -> Writer:
    w = Writer()
    w.value = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    w.size = len(bits)
    return w


def _file(chunks: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WEBP" + chunks


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def encode_argb(image: np.ndarray, transforms: tuple = (), cache_bits: int = 0) -> bytes:
    """A lossless WebP file of an image of ARGB words."""
    return _file(_encoded(image, transforms, cache_bits))


def _encoded(image: np.ndarray, transforms: tuple, cache_bits: int = 0) -> bytes:
    """The VP8L chunk of a file.  ``transforms`` apply in order, each once:
    ("predictor", modes, bits), ("cross", elements, bits), ("green",),
    ("palette",); modes and elements are sub-images of ARGB words."""
    height, width = image.shape
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError(f"an image has 1 to {MAX_SIDE} rows and columns")
    w = Writer()
    w(0x2F, 8)
    w(width - 1, 14)
    w(height - 1, 14)
    w(1, 1)
    w(0, 3)
    for name, *own in transforms:
        w(1, 1)
        w(("predictor", "cross", "green", "palette").index(name), 2)
        if name in ("predictor", "cross"):
            part, bits = own
            w(bits - 2, 3)
            w = _continued(write_image(w, part, False))
            image = (predict if name == "predictor" else cross_colour)(image, part, bits, True)
        elif name == "green":
            image = add_green(image, True)
        else:
            table = np.unique(image)
            if len(table) > 256:
                raise ValueError("more than 256 colours")
            w(len(table) - 1, 8)
            steps = _bytes(table[None])[0]
            steps = np.concatenate([steps[:1], steps[1:] - steps[:-1]]).copy().view("<u4").ravel()
            w = _continued(write_image(w, steps[None], False))
            image = to_palette(image, table)
    w(0, 1)
    body = np.packbits(write_image(w, image, True, cache_bits), bitorder="little").tobytes()
    return _chunk(b"VP8L", body)


def encode(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0) -> bytes:
    """A file of height x width x RGBA pixels."""
    return encode_argb(np.ascontiguousarray(pixels[..., [2, 1, 0, 3]], np.uint8).view("<u4")[..., 0], transforms, cache_bits)


# -- payloads ------------------------------------------------------------------


def _entropy(samples: np.ndarray) -> float:
    """Bits of the samples by their frequencies."""
    counts = np.bincount(samples.ravel(), minlength=256)
    counts = counts[counts > 0]
    return float(counts.sum() * np.log2(counts.sum()) - (counts * np.log2(counts)).sum())


def choose(samples: np.ndarray) -> tuple:
    """The transforms that pay for rows of samples, by estimate."""
    if np.count_nonzero(np.bincount(samples.ravel(), minlength=256)) <= 16:
        return (("palette",),)
    if len(samples) < 1 << TILE:
        return ()  # the tiles' table and the first row cost more than they save
    side, (height, width) = 1 << TILE, samples.shape
    up, corner = samples[:-1], np.concatenate([samples[:-1, :1], samples[:-1, :-1]], axis=1)
    left = {0: samples[1:], 2: samples[1:] - up, 4: samples[1:] - corner, 8: samples[1:] - ((up.astype(np.uint16) + corner) >> 1).astype(np.uint8)}
    if min(_entropy(left[m]) for m in MODES[1:]) > 0.9 * _entropy(samples):
        return ()
    rows, columns = np.arange(0, height, side), np.arange(0, width, side)
    small = np.stack([np.add.reduceat(
        np.add.reduceat(np.minimum(x, -x).astype(np.int64), rows[:1].tolist() + (rows[1:] - 1).tolist(), axis=0),
        columns,
        axis=1,
    ) for x in left.values()])
    modes = np.array(MODES, np.uint32)[np.argmin(small, axis=0)]
    return (("predictor", modes << np.uint32(8), TILE),)


def to_media(data: bytes) -> bytes:
    """Bytes, padded with 255 to a positive multiple of 576, as one file."""
    samples = np.frombuffer(data + b"\xff" * (-len(data) % ROW if data else ROW), np.uint8).reshape(-1, ROW)
    parts = [samples[lo : lo + FRAME_ROWS] for lo in range(0, len(samples), FRAME_ROWS)]
    coded = [_encoded(x.astype(np.uint32) << np.uint32(8), choose(x)) for x in parts]
    if len(coded) == 1:
        return _file(coded[0])
    number = lambda x: struct.pack("<I", x)[:3]
    chunks = [_chunk(b"VP8X", b"\x02\0\0\0" + number(ROW - 1) + number(len(samples) - 1)), _chunk(b"ANIM", bytes(6))]
    for k, (x, body) in enumerate(zip(parts, coded, strict=True)):
        # no blending (2): a frame replaces what is below it
        chunks.append(_chunk(b"ANMF", number(0) + number(k * FRAME_ROWS // 2) + number(ROW - 1) + number(len(x) - 1) + number(0) + b"\x02" + body))
    return _file(b"".join(chunks))


def from_media(media: bytes) -> np.ndarray:
    """All samples of a file, in order."""
    return (decode_argb(media) >> 8 & 0xFF).astype(np.uint8).ravel()


def describe(samples: np.ndarray) -> str:
    """Rows, an 8 x 8 average hash over equal stretches, and the mean."""
    parts = samples.reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = np.packbits(parts * 64 > parts.sum()).tobytes().hex()
    return f"{len(samples) // ROW}x{ROW}:{bits}:{int(parts.sum()) * 1000 // len(samples)}"


# -- DataFrames ----------------------------------------------------------------


def store_payloads(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (of the text) and media, its stored form."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = texts(b, text)
            yield pa.RecordBatch.from_arrays(
                [b.column(key), pa.array([len(x) for x in rows], pa.int64()), pa.array([to_media(x) for x in rows], pa.binary())],
                names=[key, "n_bytes", "media"],
            )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def read_payloads(stored: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key, n_bytes, and what the decoded media holds: payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    bounded_batches(stored.sparkSession)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(media).to_pylist():
                samples = from_media(x)
                raw = samples.tobytes()
                out.append((
                    len(raw),
                    hashlib.sha256(raw).hexdigest(),
                    zlib.crc32(raw[-32:]),
                    len(x),
                    hashlib.sha256(x).hexdigest(),
                    describe(samples),
                ))
            columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(key), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=[key, "n_bytes", *names],
            )

    kind = stored.schema[key].dataType.simpleString()
    return stored.select(key, "n_bytes", media).mapInArrow(
        run,
        f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def decode_media(table: DataFrame, media: str = "media") -> DataFrame:
    """All columns plus media_height, media_width, media_pixels (RGBA bytes) and
    media_error; columns of these names are replaced.  Frames of one file are one
    picture; bytes after a file's end are an error."""
    bounded_batches(table.sparkSession)
    added = ["media_height", "media_width", "media_pixels", "media_error"]
    table = table.drop(*added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(media).to_pylist():
                try:
                    if x is None:
                        raise ValueError("no media")
                    px = decode(x)
                    out.append((px.shape[0], px.shape[1], px.tobytes(), None))
                except ValueError as e:
                    out.append((None, None, None, str(e)))
            columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 4
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=[*b.schema.names, *added],
            )

    schema = StructType([*table.schema.fields]).add("media_height", "integer").add("media_width", "integer").add("media_pixels", "binary").add("media_error", "string")
    return table.mapInArrow(run, schema)
