"""Vectorised text work on Arrow string buffers: lower-casing, words, 64-bit hashes.

Words are maximal runs of bytes other than space and 0x09-0x0D; since those are ASCII, working on
UTF-8 bytes equals working on characters. Hashes are 64 bits wide; equal hashes are taken as equal
words or shingles (for ten thousand million distinct ones a single collision has a chance of a few
in a thousand per thousand million pairs compared, and none is expected at the sizes tested).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from vedette.llm.common import text_column

U = np.uint64
_rng = np.random.default_rng(20240229)
#: One random 64-bit value for each byte value, and an odd base with its inverse modulo 2**64.
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of letters, digits and characters beyond ASCII.
SOLID = np.zeros(256, bool)
SOLID[48:58] = SOLID[65:91] = SOLID[97:123] = SOLID[128:] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length() if size < (1 << 22) else size
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows."""
    array = text_column(column)
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of codes[k] * BASE**k for i <= k < j; `codes` is overwritten."""
    out = np.zeros(len(codes) + 1, np.uint64)
    codes *= powers(BASE, len(codes))
    np.cumsum(codes, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free hashes of the spans [starts, ends)."""
    x = prefix[ends] - prefix[starts]
    x *= powers(BASE_INVERSE, len(prefix))[starts]
    return mix(x)


class Words:
    """The words of all rows of a string column: byte spans, row numbers and hashes."""

    def __init__(self, column: pa.Array, lower: bool = True, strip: bool = False) -> None:
        data, self.offsets = text_bytes(column)
        self.n_docs, n = len(self.offsets) - 1, len(data)
        self.data = LOWER[data] if lower else data
        if n:
            inside = ~SPACE[data]
            before = np.empty(n, bool)
            before[0], before[1:] = False, inside[:-1]
            heads = self.offsets[:-1]
            before[heads[heads < n]] = False
            after = np.empty(n, bool)
            after[-1], after[:-1] = False, inside[1:]
            tails = self.offsets[1:]
            after[tails[tails > 0] - 1] = False
            self.starts = np.flatnonzero(inside & ~before)
            self.ends = np.flatnonzero(inside & ~after) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        if strip and n:  # punctuation at either end goes, and words of nothing else
            solid = np.where(SOLID[self.data], np.arange(n), n)
            after = np.minimum.accumulate(solid[::-1])[::-1]
            before = np.maximum.accumulate(np.where(SOLID[self.data], np.arange(n), -1))
            starts, ends = after[self.starts], before[self.ends - 1] + 1
            keep = starts < ends
            self.starts, self.ends = starts[keep], ends[keep]
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs)
        self.prefix = prefix_hash(BYTE_CODE[self.data])
        self.hash = span_hash(self.prefix, self.starts, self.ends)

    def shingles(self, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of every run of k words of one row; a row with fewer (but some) words gives,
        if `whole`, its whole sequence as one shingle."""
        n = len(self.hash)
        first = np.cumsum(self.count) - self.count
        out = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            out = mix(out * U(3) + self.hash[j : n - k + 1 + j] + U(j + 1))
        keep = self.doc[: n - k + 1] == self.doc[k - 1 :] if n >= k else np.zeros(0, bool)
        out, doc = out[keep], self.doc[: max(0, n - k + 1)][keep]
        if whole:
            few = np.flatnonzero((self.count > 0) & (self.count < k))
            if len(few):
                extra = np.zeros(len(few), np.uint64)
                for i, d in enumerate(few):
                    for j in range(self.count[d]):
                        extra[i : i + 1] = mix(extra[i : i + 1] * U(3) + self.hash[first[d] + j] + U(j + 1))
                    extra[i : i + 1] = mix(extra[i : i + 1] + U(977 * self.count[d]))
                out, doc = np.concatenate([out, extra]), np.concatenate([doc, few])
        return out, doc


def sorted_sets(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each row, ascending: (hashes, rows, sizes by row)."""
    order = np.argsort(hashes)
    if n_docs <= 65536:
        by_doc = np.argsort(doc[order].astype(np.uint16), kind="stable")
    else:
        by_doc = np.argsort(doc[order], kind="stable")
    order = order[by_doc]
    h, d = hashes[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, d, np.bincount(d, minlength=n_docs)
