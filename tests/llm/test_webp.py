import base64
import hashlib
import zlib

import numpy as np
import pytest

from tessera.llm import webp as W

RNG = np.random.default_rng(1)


def image(height, width, colours=None):
    if colours:
        table = RNG.integers(0, 1 << 32, colours, dtype=np.uint32)
        return table[RNG.integers(0, colours, (height, width))]
    base = np.add.outer(np.arange(height), np.arange(width)).astype(np.uint32)
    noise = RNG.integers(0, 3, (height, width), dtype=np.uint32)
    return 0xFF000000 | (base * 3 + noise & 255) << 16 | (base * 2 & 255) << 8 | (base + noise & 255)


def part(height, width, bits, make):
    shape = (height + (1 << bits) - 1) >> bits, (width + (1 << bits) - 1) >> bits
    return make(shape)


def test_a_known_file():
    """The one-pixel lossless file that browsers are probed with."""
    px = W.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert px.shape == (1, 1, 4) and px[0, 0, 3] == 0


@pytest.mark.parametrize("height,width", [(1, 1), (7, 13), (33, 20)])
def test_every_transform_round_trips(height, width):
    modes = part(height, width, 2, lambda s: (RNG.integers(0, 14, s).astype(np.uint32) << 8))
    cross = part(height, width, 3, lambda s: RNG.integers(0, 1 << 24, s).astype(np.uint32))
    plain = image(height, width)
    for transforms in ((), (("green",),), (("predictor", modes, 2),), (("cross", cross, 3),), (("predictor", modes, 2), ("cross", cross, 3), ("green",))):
        for cache_bits in (0, 1, 6, 11):
            data = W.encode_argb(plain, transforms, cache_bits)
            assert (W.decode_argb(data) == plain).all()
    for colours in (1, 2, 3, 4, 11, 16, 17, 200):
        few = image(height, width, colours)
        assert (W.decode_argb(W.encode_argb(few, (("palette",),))) == few).all()


def test_all_modes_alone():
    plain = image(9, 11)
    for mode in range(14):
        modes = np.full((3, 3), mode << 8, np.uint32)
        assert (W.decode_argb(W.encode_argb(plain, (("predictor", modes, 2),))) == plain).all()


def test_predictors_follow_the_format():
    left, up, right, corner = [10, 20, 30, 40], [50, 60, 70, 80], [5, 6, 7, 8], [9, 99, 30, 255]
    want = {0: [0, 0, 0, 255], 5: [28, 36, 44, 52], 6: [9, 59, 30, 147], 11: up, 12: [51, 0, 70, 0], 13: [40, 11, 60, 0]}
    for mode, guess in want.items():
        assert W._predicted(mode, left, up, right, corner) == guess


def hand_made(width, height, symbols, lengths, body, meta=None):
    """A file whose green code is given: other channels are constant."""
    w = W.Writer()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        w(v, n)
    own = np.zeros(280, np.int32)
    own[symbols] = lengths
    W.write_code(w, own)
    for s in (7, 8, 9):
        one = np.zeros(256, np.int32)
        one[s] = 1
        W.write_code(w, one)
    near = np.zeros(40, np.int32)
    near[[0, 1, 13]] = [1, 2, 2]
    W.write_code(w, near)
    codes, near_codes = W.canonical(own), W.canonical(near)
    for kind, value, n in body:
        if kind == "green":
            w(int(codes[value]), int(own[value]))
        elif kind == "near":
            w(int(near_codes[value]), int(near[value]))
        else:
            w(value, n)
    raw = np.packbits(w.bits(), bitorder="little").tobytes()
    raw += b"\0" * (len(raw) & 1)
    return b"RIFF" + (12 + len(raw)).to_bytes(4, "little") + b"WEBPVP8L" + len(raw).to_bytes(4, "little") + raw


def test_back_references_and_neighbour_distances():
    # a b c d | copy 3 from the row above | e | copy of 5 at distance 130 - 120 = 10
    body = [("green", s, 0) for s in (1, 2, 3, 4)] + [("green", 256 + 2, 0), ("near", 0, 0), ("green", 5, 0)]
    body += [("green", 256 + 4, 0), ("bits", 0, 1), ("near", 13, 0), ("bits", 130 - 1 - 96, 5)]
    symbols, lengths = [1, 2, 3, 4, 5, 258, 260], [3, 3, 3, 3, 3, 3, 2]
    got = W.decode_argb(hand_made(4, 2, symbols, lengths, body[:7])).ravel()
    assert (got >> 8 & 255).tolist() == [1, 2, 3, 4, 1, 2, 3, 5]
    assert set((got & 0xFF0000FF | got >> 16 & 0xFF).tolist()) and (got >> 24 == 9).all() and (got >> 16 & 255 == 7).all()
    with pytest.raises(ValueError):  # distance 10 before the first pixel
        W.decode_argb(hand_made(4, 4, symbols, lengths, body))


def test_cut_and_foreign_files_are_refused():
    data = W.encode_argb(image(20, 20))
    for bad in (b"", b"RIFF", data[:30], data[:-40], b"GIF89a" + data):
        with pytest.raises(ValueError):
            W.decode_argb(bad)
    gray = W.to_media(bytes(RNG.integers(0, 99, 5000, dtype=np.uint8)))
    cut = gray[:4] + (len(gray) - 508).to_bytes(4, "little") + gray[8:16] + (len(gray) - 520).to_bytes(4, "little") + gray[20:-500]
    with pytest.raises(ValueError):
        W.decode_argb(cut)


def test_general_loop_equals_the_fast_path(monkeypatch):
    data = W.to_media(b"the quick brown fox; " * 90 + b"\0" * 700 + bytes(range(256)))
    fast = W.decode_argb(data)
    slow = []
    monkeypatch.setattr(W, "_green_only", lambda r, width, size, codes: slow.append(1) or _plain(r, width, size, codes))
    assert (W.decode_argb(data) == fast).all() and slow


def _plain(r, width, size, codes):
    out = np.empty(size, np.uint32)
    done = 0
    while done < size:
        s = codes[0].read(r)
        if s < 256:
            out[done] = codes[3].read(r) << 24 | codes[1].read(r) << 16 | s << 8 | codes[2].read(r)
            done += 1
        else:
            n = W.unprefix(s - 256, r)
            W._copy(out, done, W._distance(W.unprefix(codes[4].read(r), r), width), n)
            done += n
    return out


@pytest.mark.parametrize("data", [b"", b"a", b"\xff" * 576, bytes(576), b"ab" * 288, bytes(range(256)) * 9, "é日本 ".encode() * 500, b"x" * 99_999, bytes(RNG.integers(0, 256, 20_000, dtype=np.uint8))])
def test_payloads_round_trip(data):
    media = W.to_media(data)
    got = W.from_media(media).tobytes()
    assert len(got) % 576 == 0 and len(got) >= 576 and got == data + b"\xff" * (len(got) - len(data)) and len(got) - len(data) <= 576
    assert W.to_media(data) == media


@pytest.mark.parametrize("chunk", [48, 200, 1 << 16])
def test_chunks_of_bit_positions_change_nothing(monkeypatch, chunk):
    monkeypatch.setattr(W, "CHUNK", chunk)
    text = b"".join(b"%d some words of %d, " % (k * 7919, k) for k in range(900)) + b"\0" * 999 + b"the end, " * 40
    for data in (text, text[:577], b"ab" * 4000 + text[:5000] + text[1000:4000], bytes(RNG.integers(0, 256, 9000, dtype=np.uint8))):
        media = W.to_media(data)
        assert W.from_media(media).tobytes().startswith(data)
        with pytest.raises(ValueError):
            W.decode_argb(media[:4] + (len(media) - 28).to_bytes(4, "little") + media[8:16] + (len(media) - 40).to_bytes(4, "little") + media[20:-20])


def test_back_references_are_found():
    line = bytes(RNG.integers(32, 127, 700, dtype=np.uint8))
    data = line + bytes(RNG.integers(32, 127, 3000, dtype=np.uint8)) + line[5:690] + b"." * 300 + line + line[:100]
    starts, lengths, distances = W.find_copies(np.frombuffer(data, np.uint8))
    covered = np.zeros(len(data), dtype=bool)
    for s, n, d in zip(starts.tolist(), lengths.tolist(), distances.tolist()):
        assert not covered[s : s + n].any() and 0 < d <= s
        covered[s : s + n] = True
        made = bytearray(data[:s])
        for _ in range(n):
            made.append(made[-d])
        assert made[s:] == data[s : s + n]
    assert covered[3700:].sum() > 1700 and len(W.to_media(data)) < 0.9 * 3700 + 600
    for n in (0, 1, 23, 48, 49, 60):
        W.find_copies(np.frombuffer(data[:n], np.uint8))


def test_predictors_are_chosen_where_they_pay():
    base = RNG.integers(0, 200, W.ROW).astype(np.int64)
    drift = np.cumsum(RNG.integers(0, 2, (80, W.ROW)), axis=0)
    data = (base + drift & 255).astype(np.uint8).tobytes()
    assert W.choose(np.frombuffer(data, np.uint8).reshape(-1, W.ROW))[0][0] == "predictor"
    media = W.to_media(data)
    assert W.from_media(media).tobytes() == data and len(media) < len(data) / 3
    assert W.choose(RNG.integers(0, 200, (80, W.ROW)).astype(np.uint8)) == ()


def test_rows_at_once_equal_pixels_one_by_one(monkeypatch):
    plain = RNG.integers(0, 1 << 32, (9, 21), dtype=np.uint32)
    for mode in W.MODES:
        modes = np.full((3, 6), mode << 8, np.uint32)
        fast = W.predict(plain, modes, 2, True)
        assert (W.predict(fast, modes, 2, False) == plain).all()
        with monkeypatch.context() as m:
            m.setattr(W, "MODES", ())
            assert (W.predict(plain, modes, 2, True) == fast).all() and (W.predict(fast, modes, 2, False) == plain).all()


def test_long_payloads_are_frames_of_one_file(monkeypatch):
    monkeypatch.setattr(W, "FRAME_ROWS", 8)
    data = b"0123456789 abcdefghijklmnop" * 500
    media = W.to_media(data)
    frames, width, height = W._frames(media)
    assert len(frames) == 3 and (width, height) == (W.ROW, 24) and [f[:2] for f in frames] == [(0, 0), (0, 8), (0, 16)]
    assert media.count(b"RIFF") == 1 and W.from_media(media).tobytes().startswith(data)
    assert W.decode(media).shape == (24, W.ROW, 4)


def test_operators(spark):
    rows = [(1, "some text", 5), (1, "some text", 5), (2, None, 5), (3, "", 5), (None, "é" * 9999, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media int")
    got = W.read_payloads(W.store_payloads(docs)).collect()
    assert len(got) == 5
    for r in got:
        text = {x[0]: x[1] for x in rows}[r.doc_id] or ""
        payload = text.encode() + b"\xff" * (-len(text.encode()) % 576 or (0 if text else 576))
        assert (r.n_bytes, r.payload_bytes) == (len(text.encode()), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len({(r.feature, r.media_sha256) for r in got if r.doc_id in (2, 3)}) == 1
    media = W.store_payloads(docs).select("doc_id", "media")
    out = W.decode_media(media.unionByName(spark.createDataFrame([(9, None), (8, bytearray(b"no"))], "doc_id long, media binary"))).collect()
    assert {r.doc_id for r in out if r.media_error} == {8, 9} and all(len(r.media_pixels) == r.media_height * r.media_width * 4 for r in out if not r.media_error)
    assert W.read_payloads(W.store_payloads(docs.limit(0))).collect() == []


def test_decode_media_reads_a_value_whole(spark):
    data = bytes(k * 7 % 251 for k in range(W.ROW)) * 1030
    wide = W.encode_argb(np.zeros((2, 5), np.uint32))
    rows = [(0, W.to_media(data)), (1, wide + b"rest"), (2, wide + wide), (3, wide)]
    got = {r.doc_id: r for r in W.decode_media(spark.createDataFrame([(k, bytearray(x)) for k, x in rows], "doc_id long, media binary")).collect()}
    assert (got[0].media_height, got[0].media_width, got[0].media_error) == (1030, W.ROW, None)
    assert np.frombuffer(got[0].media_pixels, np.uint8)[1::4].tobytes() == data
    assert got[3].media_height == 2 and got[3].media_error is None
    assert all(got[k].media_pixels is None and got[k].media_error for k in (1, 2))


def test_long_texts_through_spark(spark):
    docs = spark.range(1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 150000), k -> concat('word', k * 7919 % 5003))) AS text")
    text = docs.first().text
    (r,) = W.read_payloads(W.store_payloads(docs)).collect()
    payload = text.encode() + b"\xff" * (-len(text) % 576)
    assert len(text) > 1_000_000 and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_bytes < r.n_bytes
