import hashlib
import zlib

import numpy as np
import pytest

from tests.llm.helpers import awkward, empty
from vedette.llm import jpeg, media


class Writer:
    """Huffman-coded scans by the book, one bit after the other: an encoder apart from the operator's."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s):
        self.put(s, 8)  # the table below gives symbol s (0..254) the code s

    def signed(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def data(self):
        raw = np.packbits(self.bits + [1] * (-len(self.bits) % 8)).tobytes()
        return raw.replace(b"\xff", b"\xff\x00")


def tables():
    body = bytes([0, 0, 0, 0, 0, 0, 0, 255, 0, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(255))
    return jpeg._segment(0xC4, b"\x00" + body) + jpeg._segment(0xC4, b"\x10" + body)


def shifted(v, low):
    return int(np.sign(v)) * (abs(int(v)) >> low)


def dc_first(blocks, low, restart=0):
    out, w, before = [], Writer(), {}
    for n, (c, b) in enumerate(blocks):
        if restart and n and n % restart == 0:
            out.append(w.data())
            w, before = Writer(), {}
        v = int(b[0]) >> low
        d = v - before.get(c, 0)
        before[c] = v
        w.symbol(abs(d).bit_length())
        if d:
            w.signed(d)
    out.append(w.data())
    return b"".join(x + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(out) else b"") for i, x in enumerate(out))


def dc_refine(blocks, low):
    w = Writer()
    for _, b in blocks:
        w.put(int(b[0]) >> low & 1, 1)
    return w.data()


def ac_first(blocks, start, end, low):
    w, ended = Writer(), 0

    def flush():
        nonlocal ended
        if ended:
            n = ended.bit_length() - 1
            w.symbol(n << 4)
            w.put(ended - (1 << n), n)
            ended = 0

    for b in blocks:
        run = 0
        for k in range(start, end + 1):
            v = shifted(b[k], low)
            if not v:
                run += 1
                continue
            flush()
            while run > 15:
                w.symbol(0xF0)
                run -= 16
            w.symbol(run << 4 | abs(v).bit_length())
            w.signed(v)
            run = 0
        if run:
            ended += 1
    flush()
    return w.data()


def ac_refine(blocks, start, end, low):
    w, ended, waiting = Writer(), 0, []

    def flush():
        nonlocal ended, waiting
        if ended:
            n = ended.bit_length() - 1
            w.symbol(n << 4)
            w.put(ended - (1 << n), n)
            w.bits += waiting
            ended, waiting = 0, []

    for b in blocks:
        size = [abs(int(v)) >> low for v in b]
        last = max([k for k in range(start, end + 1) if size[k] == 1], default=start - 1)
        run, held = 0, []
        for k in range(start, end + 1):
            if not size[k]:
                run += 1
                continue
            while run > 15 and k <= last:
                flush()
                w.symbol(0xF0)
                w.bits += held
                held, run = [], run - 16
            if size[k] > 1:
                held.append(size[k] & 1)
                continue
            flush()
            w.symbol(run << 4 | 1)
            w.put(int(b[k] > 0), 1)
            w.bits += held
            held, run = [], 0
        if run or held:
            ended += 1
            waiting += held
    flush()
    return w.data()


def picture(sampling, width, height, seed, restart=0):
    """A progressive file of random coefficients and what must be read from it."""
    rng = np.random.default_rng(seed)
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    parts = []
    for a, b in sampling:
        c = np.where(rng.random((across * a * down * b, 64)) < 0.15, rng.integers(-60, 61, (across * a * down * b, 64)), 0)
        c[:, 0] = rng.integers(-300, 300, len(c))
        parts.append(c)
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([i + 1, a << 4 | b, 0]) for i, (a, b) in enumerate(sampling))
    out = b"\xff\xd8" + jpeg._segment(0xE0, b"JFIF") + jpeg._QUANTISATION + jpeg._segment(0xC2, frame) + tables()
    if len(parts) == 1:
        mcu = [(0, parts[0][(y * across + x)]) for y in range(-(-height // 8)) for x in range(-(-width // 8))]
    else:
        mcu = [(i, parts[i][(my * b + y) * across * a + mx * a + x]) for my in range(down) for mx in range(across) for i, (a, b) in enumerate(sampling) for y in range(b) for x in range(a)]
    every = [(i + 1, 0) for i in range(len(parts))]
    if restart:
        out += jpeg._segment(0xDD, restart.to_bytes(2, "big"))
    per_unit = 1 if len(parts) == 1 else sum(a * b for a, b in sampling)
    out += jpeg._scan(every, 0, 0, 0, 1) + dc_first(mcu, 1, restart * per_unit)
    if restart:
        out += jpeg._segment(0xDD, b"\x00\x00")
    out += jpeg._scan(every, 0, 0, 1, 0) + dc_refine(mcu, 0)
    seen = [np.zeros_like(c) for c in parts]
    for i, (a, b) in enumerate(sampling):
        rows, columns = -(-(-(-height * b // v)) // 8), -(-(-(-width * a // h)) // 8)
        places = [y * across * a + x for y in range(rows) for x in range(columns)]
        blocks = [parts[i][p] for p in places]
        seen[i][:, 0] = parts[i][:, 0]
        seen[i][places, 1:] = parts[i][places, 1:]
        for start, end in ((1, 5), (6, 63)):
            out += jpeg._scan([(i + 1, 0)], start, end, 0, 2) + ac_first(blocks, start, end, 2)
        for low in (1, 0):
            out += jpeg._scan([(i + 1, 0)], 1, 63, low + 1, low) + ac_refine(blocks, 1, 63, low)
    if len(parts) == 1:
        keep = np.zeros(len(parts[0]), bool)
        keep[[y * across + x for y in range(-(-height // 8)) for x in range(-(-width // 8))]] = True
        seen[0][~keep] = 0
    return out + b"\xff\xd9", seen


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)]])
@pytest.mark.parametrize("width,height,restart", [(8, 8, 0), (37, 21, 0), (50, 33, 2)])
def test_any_progressive_file(sampling, width, height, restart):
    data, want = picture(sampling, width, height, width + len(sampling), restart)
    frame = jpeg.read_coefficients(data)
    for c, w in zip(frame.components, want, strict=True):
        assert (c.coefficients == w).all()
    assert jpeg.rgb(frame).shape == (height, width, 3)


def test_inverse_transform_and_colours():
    block = np.random.default_rng(0).integers(-100, 100, 64)
    natural = np.zeros(64)
    natural[jpeg.ZIGZAG] = block
    f = natural.reshape(8, 8)
    c = [np.sqrt(0.5)] + [1.0] * 7
    want = [[sum(c[u] * c[v] / 4 * f[u][v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for y in range(8)] for x in range(8)]
    assert (block @ jpeg.BASIS).reshape(8, 8) == pytest.approx(np.array(want), abs=1e-3)
    assert jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and jpeg.ZIGZAG[-1] == 63
    data, _ = picture([(1, 1)], 8, 8, 1)
    grey = jpeg.rgb(jpeg.read_coefficients(data))
    assert (grey[:, :, 0] == grey[:, :, 2]).all()
    frame = jpeg.read_coefficients(jpeg.store(b"\x00"))
    for part, level in zip(frame.components, (400, 800, -400), strict=True):
        part.coefficients[:] = 0
        part.coefficients[:, 0] = level
    y, cb, cr = 128 + 50, 100, -50
    assert jpeg.rgb(frame)[0, 0].tolist() == [round(min(255, max(0, x))) for x in (y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)]


@pytest.mark.parametrize("size", [1, 62, 63, 64, 65, 378, 379, 5000, 63 * 40_000 * 6])
def test_bytes_round_trip(size):
    payload = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    assert jpeg.stored(jpeg.read_coefficients(jpeg.store(payload))) == payload


def test_texts_round_trip(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {}
    for r in media.text_media(docs.repartition(3)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert any((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])) for r in got[i])
    same = {(r.media_sha256, r.feature) for i in (1, 2) for r in got[i]}
    assert len(same) == 1 and media.text_media(empty(spark)).count() == 0


def test_tensors_and_damaged_files(spark):
    good, _ = picture([(2, 2), (1, 1), (1, 1)], 20, 10, 3)
    rows = [(1, good), (2, good[:-40]), (3, b"no picture"), (4, None), (5, b""), (6, good[:30]), (1, good)]
    got = media.rgb_tensors(spark.createDataFrame(rows, "key long, file binary"), "key", "file").collect()
    assert len(got) == len(rows)
    for r in got:
        if r.key == 1:
            assert (r.height, r.width, len(r.rgb), r.error) == (10, 20, 600, None)
        elif r.key > 2:
            assert r.rgb is None and r.error
