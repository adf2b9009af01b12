"""Progressive JPEG in numpy: scans accumulated into coefficient arrays, inverse transform, chroma, RGB tensors.

The decoder takes baseline and progressive Huffman files of 8-bit samples: any tables, sampling factors, restart
intervals and scan scripts. Entropy decoding is vectorised wherever a scan allows it whatever file it comes from:
refinement bits of whole end-of-band runs are read at once, runs of one-bit "no change" DC codes are skipped at once,
and a band whose table has one run-free symbol is read as an array of fixed-width numbers.

`store` writes bytes losslessly as the coefficients of a 4:2:0 progressive file: byte b is coefficient b + 256 at one
of the 63 AC places of a block (its size is then the same for all, so the scans are arrays of fixed-width numbers);
AC bands come first without their two low bits, which follow in refinement scans. `stored` reads them back.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np

_MARKER = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


class JpegError(ValueError):
    """A file that is damaged or of a kind that is not read."""


def _zigzag() -> np.ndarray:
    """Natural position of each zigzag place: diagonals in turn, up and down."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """[zigzag place, pixel]: what a coefficient adds to each pixel of its block."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * math.pi / 16) * np.where(u == 0, math.sqrt(1 / 8), 0.5)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = _basis()


@dataclass
class Component:
    number: int
    h: int
    v: int
    table: int
    width: int = 0  # in blocks: true size, and size with whole units
    height: int = 0
    stride: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))  # [blocks in rows, zigzag]


@dataclass
class Frame:
    width: int
    height: int
    progressive: bool
    components: list[Component]
    quantisation: dict[int, np.ndarray]
    comment: bytes = b""


class _Codes(dict):
    """{(length, code): symbol} of a canonical table, and what any 16 bits begin with."""

    @cached_property
    def ahead(self) -> list[int]:
        """Length in the high byte and symbol in the low one, by the next 16 bits; 0 where no code fits."""
        out = np.zeros(1 << 16, np.int64)
        for (length, code), symbol in self.items():
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
        return out.tolist()


@lru_cache(maxsize=256)
def _table(lengths: bytes, symbols: bytes) -> tuple[_Codes, tuple[tuple[int, int], ...]]:
    """The codes and the list of (symbol, length) of a canonical table."""
    codes, code, at, flat = _Codes(), 0, 0, []
    for length in range(1, 17):
        for _ in range(lengths[length - 1]):
            codes[length, code] = symbols[at]
            flat.append((symbols[at], length))
            code, at = code + 1, at + 1
        code <<= 1
    return codes, tuple(flat)


class _Bits:
    """The bits of one entropy-coded stretch without its stuffing."""

    def __init__(self, raw: bytes) -> None:
        self.data = raw.replace(b"\xff\x00", b"\xff")
        self.at, self.end = 0, 8 * len(self.data)
        self._all: np.ndarray | None = None
        self._ones: np.ndarray | None = None

    def array(self, n: int) -> np.ndarray:
        if self.at + n > self.end:
            raise JpegError("a scan ends too soon")
        if self._all is None:
            self._all = np.unpackbits(np.frombuffer(self.data, np.uint8))
        self.at += n
        return self._all[self.at - n : self.at]

    def take(self, n: int) -> int:
        if not n:
            return 0
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if self.at + n > self.end:
            raise JpegError("a scan ends too soon")
        word = int.from_bytes(self.data[first:last], "big")
        word = (word >> (8 * last - self.at - n)) & ((1 << n) - 1)
        self.at += n
        return word

    def symbol(self, codes: _Codes) -> int:
        first = self.at >> 3
        word = int.from_bytes(self.data[first : first + 3].ljust(3, b"\0"), "big")
        found = codes.ahead[word >> (8 - (self.at & 7)) & 0xFFFF]
        self.at += found >> 8
        if not found or self.at > self.end:
            raise JpegError("a scan ends too soon" if found else "no such code")
        return found & 255

    def zeros(self, most: int) -> int:
        """How many zero bits come next, up to `most`."""
        if self._ones is None:
            self.array(0)
            self._ones = np.flatnonzero(self._all)
        k = int(np.searchsorted(self._ones, self.at))
        nearest = int(self._ones[k]) if k < len(self._ones) else self.end
        return min(most, nearest - self.at)


def _extend(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _dc_first(bits: _Bits, unit: list[tuple[Component, int, np.ndarray]], units: int, tables: dict, low: int) -> None:
    """unit: for each block of a unit, its component, component's place in the scan, and block number by unit."""
    before = {id(c): 0 for c, _, _ in unit}
    skips = all((1, 0) in tables[k][0] and tables[k][0][1, 0] == 0 for _, k, _ in unit)
    values = {id(c): c.coefficients for c, _, _ in unit}
    total, at = units * len(unit), 0
    flat = np.zeros(total, np.int64)
    while at < total:
        if skips and (n := bits.zeros(total - at)):
            bits.at += n
            at += n
            continue
        c, k, _ = unit[at % len(unit)]
        size = bits.symbol(tables[k][0])
        flat[at] = _extend(bits.take(size), size)
        at += 1
    owner = np.array([list(before).index(id(c)) for c, _, _ in unit])
    for number, key in enumerate(before):
        mine = np.flatnonzero(owner == number)
        places = np.stack([unit[j][2] for j in mine], axis=1).reshape(-1)
        diffs = flat.reshape(units, len(unit))[:, mine].reshape(-1)
        values[key][places, 0] = np.cumsum(diffs) << low


def _dc_refine(bits: _Bits, unit: list, units: int, low: int) -> None:
    got = bits.array(units * len(unit)).reshape(units, len(unit)).astype(np.int32)
    for j, (c, _, places) in enumerate(unit):
        c.coefficients[places, 0] |= got[:, j] << low


def _ac_first(bits: _Bits, coefficients: np.ndarray, places: np.ndarray, table: tuple, start: int, end: int, low: int) -> None:
    codes, flat = table
    width = end - start + 1
    if len(flat) == 1 and flat[0][0] >> 4 == 0 and flat[0][0] & 15:
        size, length = flat[0][0] & 15, flat[0][1]
        if length + size == 8 and bits.at == 0:
            got = np.frombuffer(bits.data, np.uint8, len(places) * width).astype(np.int32)
            bits.at = 8 * len(got)
        else:
            got = bits.array(len(places) * width * (length + size)).reshape(-1, length + size).astype(np.int32) @ (1 << np.arange(length + size)[::-1]).astype(np.int32)
        if (got >> size).any():
            raise JpegError("no such code")
        value = np.where(got >> (size - 1), got, got - (1 << size) + 1)
        coefficients[places, start : end + 1] = value.reshape(len(places), width) << low
        return
    at, n = 0, len(places)
    while at < n:
        k = start
        row = coefficients[places[at]]
        while k <= end:
            symbol = bits.symbol(codes)
            run, size = symbol >> 4, symbol & 15
            if size:
                k += run
                if k > end:
                    raise JpegError("a run leaves its band")
                row[k] = _extend(bits.take(size), size) << low
                k += 1
            elif run == 15:
                k += 16
            else:
                at += (1 << run) - 1 + bits.take(run)  # this block and those that follow have ended
                break
        at += 1


def _corrected(bits: _Bits, coefficients: np.ndarray, places: np.ndarray, start: int, end: int, low: int) -> None:
    """One correction bit for every coefficient of the blocks that has come already."""
    band = coefficients[places, start : end + 1]
    known = band != 0
    got = bits.array(int(np.count_nonzero(known)))
    band[known] += np.where(band[known] > 0, 1 << low, -(1 << low)) * got
    coefficients[places, start : end + 1] = band


def _ac_refine(bits: _Bits, coefficients: np.ndarray, places: np.ndarray, codes: _Codes, start: int, end: int, low: int) -> None:
    at, n = 0, len(places)
    while at < n:
        k, row = start, coefficients[places[at]]
        ended = False
        while k <= end:
            symbol = bits.symbol(codes)
            run, size = symbol >> 4, symbol & 15
            if size == 0 and run < 15:
                length = (1 << run) + bits.take(run)
                if k > start:
                    _corrected(bits, coefficients, places[at : at + 1], k, end, low)
                    _corrected(bits, coefficients, places[at + 1 : at + length], start, end, low)
                else:
                    _corrected(bits, coefficients, places[at : at + length], start, end, low)
                at += length
                ended = True
                break
            value = 0
            if size:
                value = (1 << low) if bits.take(1) else -(1 << low)
            while k <= end:
                if row[k]:
                    if bits.take(1):
                        row[k] += (1 << low) if row[k] > 0 else -(1 << low)
                elif run:
                    run -= 1
                else:
                    break
                k += 1
            if size and k <= end:
                row[k] = value
            k += 1
        if not ended:
            at += 1


def _sequential(bits: _Bits, unit: list, units: int, dc: dict, ac: dict) -> None:
    before = {id(c): 0 for c, _, _ in unit}
    for n in range(units):
        for c, k, places in unit:
            row = c.coefficients[places[n]]
            size = bits.symbol(dc[k][0])
            before[id(c)] += _extend(bits.take(size), size)
            row[0], z = before[id(c)], 1
            while z < 64:
                symbol = bits.symbol(ac[k][0])
                run, size = symbol >> 4, symbol & 15
                if not size and run < 15:
                    break
                z += run
                if size:
                    if z > 63:
                        raise JpegError("a run leaves its block")
                    row[z] = _extend(bits.take(size), size)
                z += 1


def _frame(body: bytes, progressive: bool) -> Frame:
    precision, height, width, n = struct.unpack(">BHHB", body[:6])
    if precision != 8 or not width or not height or len(body) < 6 + 3 * n:
        raise JpegError("only 8-bit samples and known sizes are read")
    parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    if not parts or not all(1 <= c.h <= 4 and 1 <= c.v <= 4 for c in parts):
        raise JpegError("no such sampling")
    h, v = max(c.h for c in parts), max(c.v for c in parts)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    for c in parts:
        c.width, c.height = -(-(-(-width * c.h // h)) // 8), -(-(-(-height * c.v // v)) // 8)
        c.stride = across * c.h
        c.coefficients = np.zeros((across * c.h * down * c.v, 64), np.int32)
    return Frame(width, height, progressive, parts, {})


def _units(frame: Frame, parts: list[Component]) -> tuple[list[tuple[Component, int, np.ndarray]], int]:
    """The blocks of a scan's units, in the order they come in."""
    if len(parts) == 1:
        c = parts[0]
        places = (np.arange(c.height)[:, None] * c.stride + np.arange(c.width)[None, :]).reshape(-1)
        return [(c, 0, places)], len(places)
    h, v = max(c.h for c in frame.components), max(c.v for c in frame.components)
    across, down = -(-frame.width // (8 * h)), -(-frame.height // (8 * v))
    row, column = np.divmod(np.arange(across * down), across)
    return [(c, k, (row * c.v + y) * c.stride + column * c.h + x) for k, c in enumerate(parts) for y in range(c.v) for x in range(c.h)], across * down


def read_coefficients(data: bytes) -> Frame:
    """All scans of a file, accumulated."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("not a JPEG file")
    at, frame = 2, None
    quantisation: dict[int, np.ndarray] = {}
    tables: dict[int, tuple] = {}
    interval, comment = 0, b""
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise JpegError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisation[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.float32)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind in (0xC0, 0xC1, 0xC2):
            frame = _frame(body, kind == 0xC2)
        elif 0xC3 <= kind <= 0xCF and kind != 0xC8:
            raise JpegError("lossless, hierarchical and arithmetic files are not read")
        elif kind == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif kind == 0xFE:
            comment = body
        elif kind == 0xDA:
            if frame is None:
                raise JpegError("a scan comes before its frame")
            n = body[0]
            by_number = {c.number: c for c in frame.components}
            parts = [by_number[body[1 + 2 * i]] for i in range(n)]
            dc = {i: tables.get(body[2 + 2 * i] >> 4, ({}, ())) for i in range(n)}
            ac = {i: tables.get(16 + (body[2 + 2 * i] & 15), ({}, ())) for i in range(n)}
            start, end, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            stop = m.start() if (m := _MARKER.search(data, at)) else len(data)
            unit, units = _units(frame, parts)
            stretches = _RESTART.split(data[at:stop]) if interval else [data[at:stop]]
            at = stop
            for i, raw in enumerate(stretches):
                lo, hi = (i * interval, min(units, (i + 1) * interval)) if interval else (0, units)
                if lo >= hi:
                    break
                part = [(c, k, places[lo:hi]) for c, k, places in unit] if interval else unit
                bits = _Bits(raw)
                if not frame.progressive:
                    _sequential(bits, part, hi - lo, dc, ac)
                elif start == 0:
                    _dc_refine(bits, part, hi - lo, low) if high else _dc_first(bits, part, hi - lo, dc, low)
                elif high:
                    _ac_refine(bits, parts[0].coefficients, part[0][2], ac[0][0], start, end, low)
                else:
                    _ac_first(bits, parts[0].coefficients, part[0][2], ac[0], start, end, low)
    if frame is None:
        raise JpegError("no frame")
    frame.quantisation, frame.comment = quantisation, comment
    return frame


def planes(frame: Frame) -> list[np.ndarray]:
    """Samples 0..255 of each component, in whole units."""
    out = []
    for c in frame.components:
        scale = frame.quantisation.get(c.table)
        if scale is None:
            raise JpegError("a quantisation table is missing")
        blocks = (c.coefficients.astype(np.float32) * scale) @ BASIS + np.float32(128)
        rows = len(blocks) // c.stride
        out.append(np.clip(blocks, 0, 255).reshape(rows, c.stride, 8, 8).swapaxes(1, 2).reshape(rows * 8, c.stride * 8))
    return out


def rgb(frame: Frame) -> np.ndarray:
    """[height, width, 3] bytes at full resolution, chroma samples repeated."""
    h, v = max(c.h for c in frame.components), max(c.v for c in frame.components)
    full = []
    for c, plane in zip(frame.components, planes(frame), strict=True):
        if h % c.h or v % c.v:
            rows = np.arange(frame.height) * c.v // v
            columns = np.arange(frame.width) * c.h // h
            full.append(plane[rows][:, columns])
            continue
        if c.v != v:
            plane = np.repeat(plane, v // c.v, axis=0)
        if c.h != h:
            plane = np.repeat(plane, h // c.h, axis=1)
        full.append(plane[: frame.height, : frame.width])
    if len(full) < 3:
        grey = np.rint(full[0]).astype(np.uint8)
        return np.repeat(grey[:, :, None], 3, axis=2)
    y, cb, cr = full[0], full[1] - np.float32(128), full[2] - np.float32(128)
    out = np.empty((frame.height, frame.width, 3), np.uint8)
    for i, x in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        np.rint(x, out=x)
        np.clip(x, 0, 255, out=x)
        out[:, :, i] = x
    return out


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _huffman(kind: int, lengths: dict[int, int]) -> bytes:
    """A table with the symbols' code lengths given, in canonical order."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return _segment(0xC4, bytes([kind]) + counts + bytes(order))


def _scan(parts: list[tuple[int, int]], start: int, end: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes(p) for p in parts) + bytes([start, end, high << 4 | low]))


_QUANTISATION = _segment(0xDB, b"\x00" + b"\x01" * 64)
_LONGEST_RUN = 32767
_PLACES = 63
_SIZE = 7


@lru_cache(maxsize=4096)
def _runs(blocks: int) -> tuple[bytes, tuple[tuple[int, bytes, int], ...]]:
    """A table of end-of-band symbols for runs over `blocks` blocks, and each run's (blocks, code and extra bits, bits)."""
    lengths, runs = {}, []
    left = blocks
    while left:
        n = min(left, _LONGEST_RUN)
        size = n.bit_length() - 1
        runs.append((n, size))
        left -= n
    sizes = sorted({s for _, s in runs}, reverse=True)
    for s in sizes:
        lengths[s << 4] = (-s - 2) % 8 + 2  # code and extra bits fill whole bytes
    order = sorted(lengths, key=lambda x: (lengths[x], x))
    codes, code, last = {}, 0, 0
    for symbol in order:
        code <<= lengths[symbol] - last
        codes[symbol], last = code, lengths[symbol]
        code += 1
    out = []
    for n, s in runs:
        bits = lengths[s << 4] + s
        out.append((n, (codes[s << 4] << s | (n - (1 << s))).to_bytes(bits // 8, "big"), bits))
    return _huffman(0x11, lengths), tuple(out)


def _refinement(bits: np.ndarray, runs: tuple) -> bytes:
    """Runs with their correction bits [blocks, places], stuffed."""
    if len(runs) == 1:
        raw = runs[0][1] + np.packbits(bits).tobytes()
        if pad := -bits.size % 8:
            raw = raw[:-1] + bytes([raw[-1] | (1 << pad) - 1])
    else:
        parts, at = [], 0
        for n, head, _ in runs:
            parts += [np.unpackbits(np.frombuffer(head, np.uint8)), bits[at : at + n].reshape(-1)]
            at += n
        flat = np.concatenate(parts)
        raw = np.packbits(np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)])).tobytes()
    return raw.replace(b"\xff", b"\xff\x00")


@lru_cache(maxsize=4096)
def _head(units: int) -> tuple[bytes, int]:
    """Everything up to the first AC scan, for a picture of that many units; and the units it has room for."""
    across = math.isqrt(units - 1) + 1 if units > 1 else 1
    down = -(-units // across)
    if across > 4095:
        raise JpegError("too many bytes for one picture")
    frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00")
    tables = _huffman(0x00, {0: 1, 1: 2}) + _huffman(0x10, {_SIZE: 1})
    zeros = 6 * across * down
    level = _scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 0) + b"\x00" * (zeros // 8) + (bytes([(1 << (-zeros % 8)) - 1]) if zeros % 8 else b"")
    return _QUANTISATION + frame + tables + level, across * down


_BANDS = ((1, 1, 5), (1, 6, 63), (2, 1, 63), (3, 1, 63))


def store(payload: bytes) -> bytes:
    """A progressive 4:2:0 file that holds the payload in its AC coefficients."""
    blocks = max(1, -(-len(payload) // _PLACES))
    head, units = _head(-(-blocks // 6))
    values = np.zeros(6 * units * _PLACES, np.uint8)
    values[: len(payload)] = np.frombuffer(payload, np.uint8)
    values = values.reshape(-1, _PLACES)
    parts = {1: values[: 4 * units], 2: values[4 * units : 5 * units], 3: values[5 * units :]}
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), head]
    coarse = {k: x >> 2 | 64 for k, x in parts.items()}  # code 0, then seven bits of (b + 256) >> 2
    for k, start, end in _BANDS:
        out += [_scan([(k, 0)], start, end, 0, 2), coarse[k][:, start - 1 : end].tobytes()]
    for low in (1, 0):
        for k, x in parts.items():
            table, runs = _runs(len(x))
            out += [table, _scan([(k, 1)], 1, 63, low + 1, low), _refinement(x >> low & 1, runs)]
    return b"".join([*out, b"\xff\xd9"])


def stored(frame: Frame) -> bytes:
    """The payload of a file that store() made, from its accumulated coefficients."""
    (length,) = struct.unpack(">Q", frame.comment)
    values = np.concatenate([c.coefficients[:, 1:] for c in frame.components])
    return (values - 256).astype(np.uint8).tobytes()[:length]
