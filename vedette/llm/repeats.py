"""Suffix-array dedup: every repeat of LENGTH bytes and more, found on sparse suffixes with an interval tree.

Suffixes: of every window of LENGTH bytes the place with the smallest hash of GRAM bytes is an anchor (the leftmost
of equal ones). Equal windows have the same anchor at the same offset, so a repeat shows at its anchors; there is one
for about 23 bytes. (Longer grams give more anchors, of which fewer occur twice without a repeat of LENGTH bytes.)
Only anchors whose hash occurs twice go on, each with the REACH bytes before it and the LENGTH bytes from it on.

Interval tree: an anchor's suffixes are sorted, with longest common prefixes of neighbours (an enhanced suffix array),
and a stack scan gives each interval of suffixes that share a prefix. The bytes before them, read backwards, are tested
for diversity: where all agree the interval is one repeat group, else the groups that agree so far back that prefix
and left part make LENGTH bytes. Of a group every occurrence but the first (smaller document, then earlier place) is
marked. Suffixes of equal context on both sides are one leaf, however many there are.

Very frequent anchors (more than HOT occurrences) take another exact way, so that no task gathers them: their windows
themselves are compared by 128-bit hashes, of each window only the first occurrence in a batch of documents is sent
on, and only the first of those stays.

Buckets follow the bytes of the input (`bucket_count`), so what a task reads does not grow with it.

What moves: 11 bytes for each anchor, packed; then the texts of documents with repeated anchors only (a fixed-size
bitmap stops the others before the shuffle); then contexts, compressed. `removals` returns one row for each document.

Defined results: null text counts as empty; documents of fewer than LENGTH bytes have nothing removed; a null doc_id
comes before all others; rows that repeat a doc_id with the same text are one document, returned as often as it
comes; with another text they are documents of their own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vedette.llm.common import bucket_count, prepare, release, slices, table
from vedette.llm.minhash import FILTER_BITS, bitmap
from vedette.llm.textkit import BYTE_CODE, mix, prefix_hash, span_hash, text_bytes
from vedette.session import scratch, written

LENGTH = 100
GRAM = 57
REACH = LENGTH - GRAM  # an anchor lies at most so far into its window
HOT = 400
#: Contexts take more room than anchors, so they are dealt out to so many times as many buckets.
FINER = 3
#: Text bytes and documents whose anchors are packed together.
CHUNK_BYTES, CHUNK_DOCS = 16_000_000, 60_000
U = np.uint64
_BLOCK = 1 << 20
_SECOND_CODE = mix(BYTE_CODE ^ U(0xA5A5_5A5A_0F0F_F0F0))
_WEIGHTS = mix(np.arange(1, REACH + LENGTH + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
_NONE = 255  # a byte that UTF-8 does not have: before and after a document


def _code(grams: np.ndarray) -> np.ndarray:
    """Anchors are the least hashes of their windows, so they crowd at the low end: another mix spreads them again."""
    return mix(grams ^ U(0x3C3C_F00D_5A5A_1234))


def window_starts(offsets: np.ndarray) -> np.ndarray:
    """Every place where LENGTH bytes of one document begin."""
    count = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    return np.repeat(offsets[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram codes) of all anchors, places ascending."""
    starts = window_starts(offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n_grams = len(data) - GRAM + 1
    prefix = prefix_hash(BYTE_CODE[data])
    grams = span_hash(prefix, np.arange(n_grams), np.arange(GRAM, GRAM + n_grams))
    found = []
    for lo in range(0, len(data), _BLOCK):
        mine = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, lo + _BLOCK)] - lo
        if not len(mine):
            continue
        g = grams[lo : lo + _BLOCK + REACH]
        least = (g & ~U(2 * _BLOCK - 1)) | np.arange(len(g), dtype=np.uint64)
        width = 1
        while width < REACH + 1:  # the least of REACH + 1 grams, from those of shorter windows
            step = min(width, REACH + 1 - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        place = (least[mine] & U(2 * _BLOCK - 1)).astype(np.int64) + lo
        found.append(place[np.diff(place, prepend=-1) != 0])
    place = np.unique(np.concatenate(found))
    return place, _code(grams[place])


def _rows(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, span: range) -> np.ndarray:
    """[places, len(span)] bytes at the places plus span; _NONE outside [first, last)."""
    where = at[:, None] + np.array(span)[None, :]
    outside = (where < first[:, None]) | (where >= last[:, None])
    out = data[np.clip(where, 0, len(data) - 1)]
    out[outside] = _NONE
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows; _NONE is equal to nothing."""
    stop = np.ones((len(a), a.shape[1] + 1), bool)
    stop[:, :-1] = (a != b) | (a == _NONE)
    return stop.argmax(axis=1)


def _sorted(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    key = np.empty((len(h), 8 + rows.shape[1]), np.uint8)
    key[:, :8] = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    key[:, 8:] = rows
    return np.argsort(key.view(f"V{key.shape[1]}").reshape(-1), kind="stable")


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, common prefix, parent's common prefix) of each interval with two suffixes or more; lcp[i] is that
    of suffixes i - 1 and i, and lcp[0] is not looked at."""
    stack = [(0, 0)]  # (common prefix, first)
    n = len(lcp)
    for i in range(1, n + 1):
        now = int(lcp[i]) if i < n else 0
        first = i - 1
        while stack and stack[-1][0] > now:
            depth, first = stack.pop()
            yield first, i - 1, depth, max(now, stack[-1][0] if stack else 0)
        if not stack or stack[-1][0] < now:
            stack.append((now, first))


def _reached(left_rank: np.ndarray, rank: np.ndarray, back: np.ndarray, least: int, most: int) -> np.ndarray:
    """How far back each member agrees with an earlier one, up to `most`; -1 where it is less than `least`.

    left_rank: places in the order of what stands before; back[i]: how far neighbours i - 1 and i of that order agree;
    rank: order of occurrence."""
    order = np.argsort(left_rank)
    places = left_rank[order]
    agree = np.minimum.reduceat(np.append(back, 0), np.stack([places[:-1] + 1, places[1:] + 1], axis=1).reshape(-1))[::2] if len(places) > 1 else np.zeros(0, int)
    out = np.full(len(rank), -1)
    if agree.min(initial=most) >= most:  # no diversity on the left: one group
        out[rank != rank.min()] = most
        return out
    if agree.max(initial=-1) < least:
        return out
    inserted: list[int] = []
    for i in np.argsort(rank[order], kind="stable").tolist():
        k = bisect_left(inserted, i)
        reach = max(int(agree[inserted[k - 1] : i].min()) if k else -1, int(agree[i : inserted[k]].min()) if k < len(inserted) else -1)
        if reach >= least:
            out[order[i]] = min(reach, most)
        insort(inserted, i)
    return out


def repeated_spans(h: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrence, bytes before its anchor, bytes from it on) to be marked; `left` is read backwards from the anchor.

    rank: the order of occurrence of all anchors given."""
    code = np.zeros(len(h), np.uint64)
    for lo in range(0, len(h), 20_000):
        part = slice(lo, lo + 20_000)
        code[part] = mix((np.concatenate([left[part], right[part]], axis=1).astype(np.uint64) @ _WEIGHTS) ^ h[part])
    order = np.lexsort((rank, code, h))
    new = np.ones(len(h), bool)
    new[1:] = (code[order][1:] != code[order][:-1]) | (h[order][1:] != h[order][:-1])
    later, leaves = order[~new], order[new]
    before, after = (left[later] != _NONE).sum(axis=1), (right[later] != _NONE).sum(axis=1)
    long = before + after >= LENGTH
    out = [(later[long], before[long], after[long])]
    hl = h[leaves]
    alone = np.ones(len(hl), bool)
    alone[1:] &= hl[1:] != hl[:-1]
    alone[:-1] &= hl[1:] != hl[:-1]
    leaves = leaves[~alone]
    if len(leaves):
        by_right = leaves[_sorted(h[leaves], right[leaves])]
        by_left = leaves[_sorted(h[leaves], left[leaves])]
        r, ll, hr = right[by_right], left[by_left], h[by_right]
        same = np.concatenate([[False], hr[1:] == hr[:-1]])
        lcp = np.concatenate([[0], _common(r[1:], r[:-1])]) * same
        back = np.concatenate([[0], _common(ll[1:], ll[:-1])]) * same  # groups have the same places in both orders
        place = np.empty(len(h), np.int64)
        place[by_left] = np.arange(len(by_left))
        heads = np.flatnonzero(~same)
        ends = np.append(heads[1:], len(by_right))
        two = heads[ends - heads == 2]  # one interval of two suffixes
        a, b = by_right[two], by_right[two + 1]
        x = np.where(rank[a] > rank[b], a, b)
        long = (lcp[two + 1] + back[two + 1] >= LENGTH) & (lcp[two + 1] >= GRAM)
        out.append((x[long], back[two + 1][long], lcp[two + 1][long]))
        for lo, hi in zip(heads[ends - heads > 2].tolist(), ends[ends - heads > 2].tolist(), strict=True):
            for first, last, depth, above in intervals(lcp[lo:hi]):
                if depth < GRAM:
                    continue
                members = by_right[lo + first : lo + last + 1]
                reach = _reached(place[members], rank[members], back, LENGTH - depth, min(REACH, LENGTH - 1 - above))
                some = reach >= 0
                if some.any():
                    out.append((members[some], reach[some], np.full(int(some.sum()), depth)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _split(h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash and the edges of the buckets in it."""
    order = np.argsort(h, kind="stable")
    bucket = ((h[order] >> U(32)) * U(n_buckets) >> U(32)).astype(np.int64)
    return order, np.searchsorted(bucket, np.arange(n_buckets + 1))


def _ends(first: np.ndarray, n: int) -> np.ndarray:
    """Where runs that begin at `first` end."""
    return np.append(first[1:], n) if len(first) else first


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


_INT, _LONG, _BYTES = pa.int32(), pa.int64(), pa.binary()


def _anchor_records(n_buckets: int):
    """Packed anchors: a record for each bucket of every CHUNK_BYTES of text (and the chunk's documents once)."""
    names, kinds = ["bucket", "chunk", "hashes", "docs", "places", "head"], [_INT, _LONG, *[_BYTES] * 4]

    def packed(chunk: int, parts: list[tuple], heads: list[tuple]) -> pa.RecordBatch:
        h, docs, places = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, edge = _split(h, n_buckets)
        low = np.ascontiguousarray(h[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])  # the bucket knows the top bits; chance twins are told apart later
        docs, places = docs[order], places[order]
        head = b"".join(np.concatenate(x).astype("<i8").tobytes() for x in zip(*heads, strict=True))
        rows, own = [], chunk % n_buckets
        for b in np.union1d(np.flatnonzero(np.diff(edge)), [own]).tolist():
            lo, hi = edge[b], edge[b + 1]
            rows.append((b, chunk, low[lo:hi].tobytes(), docs[lo:hi].tobytes(), places[lo:hi].tobytes(), head if b == own else None))
        return _batch(rows, names, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size, n, parts, heads = TaskContext.get().partitionId(), 0, 0, 0, [], []
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(2))
            if parts and (size + len(data) > CHUNK_BYTES or n + batch.num_rows > CHUNK_DOCS):
                yield packed(part << 24 | number, parts, heads)
                number, size, n, parts, heads = number + 1, 0, 0, [], []
            place, h = anchors(data, offsets)
            if not len(h):
                continue
            doc = np.searchsorted(offsets, place, "right") - 1
            parts.append((h, (doc + n).astype("<u2"), (place - offsets[doc]).astype("<u4")))
            heads.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size, n = size + len(data), n + batch.num_rows
        if parts:
            yield packed(part << 24 | number, parts, heads)

    return run


def _each_bucket(merge):
    """A task's records, which `repartitionById` made those of one bucket, merged by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held)
            bucket = table.column("bucket").to_numpy()
            del held
            for b in np.unique(bucket):
                yield from merge(table.filter(pa.array(bucket == b))).combine_chunks().to_batches()
        release()

    return run


def _blobs(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py() or b"", kind) for x in column]


def _repeated(records: pa.Table) -> pa.Table:
    low = _blobs(records.column("hashes"), np.uint8)
    hashes = np.zeros((sum(map(len, low)) // 5, 8), np.uint8)
    hashes[:, :5] = np.concatenate(low).reshape(-1, 5)
    _, inverse, count = np.unique(hashes.view("<u8").reshape(-1), return_inverse=True, return_counts=True)
    times = np.split(count[inverse], np.cumsum([len(h) // 5 for h in low])[:-1])
    rows = []
    for c, n, d, p, head in zip(records.column("chunk"), times, _blobs(records.column("docs"), "<u2"), _blobs(records.column("places"), "<u4"), records.column("head"), strict=True):
        keep = n > 1
        if keep.any() or head.as_py():
            rows.append((c.as_py(), d[keep].tobytes(), p[keep].tobytes(), (n[keep] > HOT).astype(np.uint8).tobytes(), head.as_py()))
    names, kinds = ["chunk", "docs", "places", "hot", "head"], [_LONG, *[_BYTES] * 4]
    return pa.Table.from_batches([_batch(rows, names, kinds)] if rows else [], pa.schema(list(zip(names, kinds, strict=True))))


def _marks(key: tuple, parts: pa.Table) -> pa.Table:
    head = np.frombuffer(next(x.as_py() for x in parts.column("head") if x.as_py()), "<i8").reshape(2, -1)
    docs, places, hot = (np.concatenate(_blobs(parts.column(c), k)) for c, k in (("docs", "<u2"), ("places", "<u4"), ("hot", np.uint8)))
    order = np.lexsort((places, docs))
    docs, places, hot = docs[order], places[order], hot[order]
    which, first = np.unique(docs, return_index=True)
    ends = _ends(first, len(docs))
    return pa.table({
        "did": pa.array(head[0][which], _LONG), "tk": pa.array(head[1][which], _LONG),
        "places": pa.array([places[a:b].tobytes() for a, b in zip(first, ends, strict=True)], _BYTES), "hot": pa.array([hot[a:b].tobytes() for a, b in zip(first, ends, strict=True)], _BYTES),
    })


_CONTEXT = ["kind", "bucket", "did", "tk", "begin", "h1", "h2", "context"]
_CONTEXT_KINDS = [_INT, _INT, *[_BYTES] * 6]


def _runs(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans of the same documents, by document and place."""
    if not len(doc):
        return doc, begin, end
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    far = 1 << 40
    reach = np.maximum.accumulate(end + doc * far)  # documents are numbered from 0 and shorter than `far`
    new = np.ones(len(doc), bool)
    new[1:] = begin[1:] + doc[1:] * far > reach[:-1]
    head = np.flatnonzero(new)
    return doc[head], begin[head], reach[np.append(head[1:], len(doc)) - 1] - doc[head] * far


def _context_records(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):  # contexts are larger than texts, so a slice is enough for a record
            data, offsets = text_bytes(batch.column(2))
            did, tk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            places, hot = _blobs(batch.column(3), "<u4"), _blobs(batch.column(4), np.uint8)
            doc = np.repeat(np.arange(len(did)), [len(p) for p in places])
            at = np.concatenate(places).astype(np.int64) + offsets[doc]
            is_hot = np.concatenate(hot).astype(bool)
            prefix = prefix_hash(BYTE_CODE[data])
            cold, cd = at[~is_hot], doc[~is_hot]
            rows = []
            if len(cold):
                h = _code(span_hash(prefix, cold, cold + GRAM))
                order, edge = _split(h, n_buckets)
                h, cold, cd = h[order], cold[order], cd[order]
                for b in range(n_buckets):
                    s = slice(edge[b], edge[b + 1])
                    if s.start == s.stop:
                        continue
                    first, last = offsets[cd[s]], offsets[cd[s] + 1]
                    both = np.concatenate([_rows(data, cold[s], first, last, range(-1, -REACH - 1, -1)), _rows(data, cold[s], first, last, range(LENGTH))], axis=1)
                    rows.append((0, b, did[cd[s]].tobytes(), tk[cd[s]].tobytes(), (cold[s] - first).astype("<u4").tobytes(), h[s].tobytes(), None, pa.compress(both.tobytes(), codec="zstd", asbytes=True)))
            if is_hot.any():
                a, d = at[is_hot], doc[is_hot]
                turn = np.zeros(len(data) + 1, np.int32)
                np.add.at(turn, np.maximum(a - REACH, offsets[d]), 1)
                np.add.at(turn, a + 1, -1)
                starts = window_starts(offsets)
                starts = starts[np.cumsum(turn)[starts] > 0]
                d = np.searchsorted(offsets, starts, "right") - 1
                h1 = span_hash(prefix, starts, starts + LENGTH)
                h2 = span_hash(prefix_hash(_SECOND_CODE[data]), starts, starts + LENGTH)
                occurrence = np.empty(len(did), np.int64)
                occurrence[np.lexsort((tk, did))] = np.arange(len(did))
                order = np.lexsort((starts, occurrence[d], h2, h1))
                h1, h2, d, starts = h1[order], h2[order], d[order], starts[order]
                new = np.ones(len(h1), bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                begin = starts - offsets[d]
                gone = _runs(d[~new], begin[~new], begin[~new] + LENGTH)
                if len(gone[0]):
                    rows.append((2, int(mix(tk[gone[0][:1]].astype(np.int64).view(np.uint64))[0] % U(n_buckets)), did[gone[0]].tobytes(), tk[gone[0]].tobytes(), gone[1].astype("<u4").tobytes(), gone[2].astype("<u8").tobytes(), None, None))
                h1, h2, d, begin = h1[new], h2[new], d[new], begin[new]
                _, edge = _split(h1, n_buckets)
                for b in range(n_buckets):
                    s = slice(edge[b], edge[b + 1])
                    if s.start < s.stop:
                        rows.append((1, b, did[d[s]].tobytes(), tk[d[s]].tobytes(), begin[s].astype("<u4").tobytes(), h1[s].tobytes(), h2[s].tobytes(), None))
            if rows:
                yield _batch(rows, _CONTEXT, _CONTEXT_KINDS)

    return run


def _found(records: pa.Table, slots: int) -> pa.Table:
    """Spans to remove from one bucket's contexts and windows."""
    spans = []
    kind = records.column("kind").to_numpy()
    for k in (0, 1, 2):
        mine = records.filter(pa.array(kind == k))
        if not mine.num_rows:
            continue
        did, tk, begin, h1 = (np.concatenate(_blobs(mine.column(c), t)) for c, t in (("did", "<i8"), ("tk", "<i8"), ("begin", "<u4"), ("h1", "<u8")))
        begin = begin.astype(np.int64)
        if k == 2:
            spans.append((did, tk, begin, h1.astype(np.int64)))
            continue
        order = np.lexsort((begin, tk, did))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        if k == 0:
            both = np.concatenate([
                np.frombuffer(pa.decompress(c.as_py(), decompressed_size=len(h.as_py()) // 8 * (REACH + LENGTH), codec="zstd", asbytes=True), np.uint8).reshape(-1, REACH + LENGTH)
                for c, h in zip(mine.column("context"), mine.column("h1"), strict=True)
            ])
            which, before, after = repeated_spans(h1, both[:, :REACH], both[:, REACH:], rank)
            spans.append((did[which], tk[which], begin[which] - before, begin[which] + after))
        else:
            h2 = np.concatenate(_blobs(mine.column("h2"), "<u8"))
            order = np.lexsort((rank, h2, h1))
            again = np.zeros(len(order), bool)
            again[1:] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
            which = order[again]
            spans.append((did[which], tk[which], begin[which], begin[which] + LENGTH))
    did, tk, begin, end = (np.concatenate(x) for x in zip(*spans, strict=True))
    which, did, tk, begin, end = _by_document(did, tk, begin, end)
    did, tk = did[which], tk[which]
    # packed by a hash of the document: rows do not multiply with documents and buckets
    slot = (mix(tk.view(np.uint64)) % U(slots)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    used, first = np.unique(slot[order], return_index=True)
    parts = [order[a:b] for a, b in zip(first, _ends(first, len(order)), strict=True)]
    columns = [pa.array([x[p].astype("<i8").tobytes() for p in parts], _BYTES) for x in (did, tk, begin, end)]
    return pa.table([pa.array(used.astype(np.int32)), *columns], ["slot", "did", "tk", "begin", "end"])


def _by_document(did: np.ndarray, tk: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(which document, documents' did and tk, begin, end) of the united spans, by document and place."""
    order = np.lexsort((tk, did))
    new = np.ones(len(order), bool)
    new[1:] = (did[order][1:] != did[order][:-1]) | (tk[order][1:] != tk[order][:-1])
    doc = np.empty(len(order), np.int64)
    doc[order] = np.cumsum(new) - 1
    which, begin, end = _runs(doc, begin, end)
    return which, did[order][new], tk[order][new], begin, end


def _united(key: tuple, records: pa.Table) -> pa.Table:
    """A row for each document: its spans."""
    did, tk, begin, end = (np.concatenate(_blobs(records.column(c), "<i8")) for c in ("did", "tk", "begin", "end"))
    doc, did, tk, begin, end = _by_document(did, tk, begin, end)
    which, first = np.unique(doc, return_index=True)
    cuts = list(zip(first, _ends(first, len(doc)), strict=True))
    packed = [pa.array([x[a:b].astype("<i8").tobytes() for a, b in cuts], _BYTES) for x in (begin, end)]
    return pa.table([pa.array(did[which], _LONG), pa.array(tk[which], _LONG), *packed], ["did", "tk", "begins", "ends"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for did, tk, text, *ends in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            begin, end = (np.frombuffer(x, "<i8") for x in ends)
            raw, kept, at = text.encode("utf-8", "surrogatepass"), hashlib.sha256(), 0
            for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                kept.update(raw[at:b])
                at = e
            kept.update(raw[at:])
            rows.append((did, tk, begin.astype("<i8").tobytes(), end.astype("<i8").tobytes(), int((end - begin).sum()), len(begin), kept.hexdigest()))
        yield _batch(rows, ["did", "tk", "begins", "ends", "n_removed", "n_spans", "kept_sha256"], [_LONG, _LONG, _BYTES, _BYTES, _LONG, _LONG, pa.string()])


_FIRST = -(2**63)


def _identified(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(_FIRST)).alias("did"), F.xxhash64("text").alias("tk"), "text")


def repeats(docs: DataFrame) -> DataFrame:
    """did, tk (the document), begins and ends (packed 64-bit numbers) of the bytes to remove, with counts and the digest
    of what is left; documents with nothing to remove are absent."""
    spark = docs.sparkSession
    prepare(spark)
    rows = _identified(docs)
    n_buckets = bucket_count(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    finer, slots = FINER * n_buckets, max(8, n_buckets // 8)
    with scratch(spark) as keep:
        records = rows.select("did", "tk", "text").mapInArrow(_anchor_records(n_buckets), "bucket int, chunk long, hashes binary, docs binary, places binary, head binary")
        parts = records.repartitionById(n_buckets, "bucket").mapInArrow(_each_bucket(_repeated), "chunk long, docs binary, places binary, hot binary, head binary")
        marks = written(parts.repartition(n_buckets, "chunk").groupBy("chunk").applyInArrow(_marks, "did long, tk long, places binary, hot binary"), "repeat-marks").dropDuplicates(["did", "tk"])
        chosen = spark.sparkContext.broadcast(bitmap(marks, "tk"))

        def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(chosen.value[batch.column(3).to_numpy()])).select(["did", "tk", "text"])

        near = rows.select("did", "tk", "text", F.pmod(F.xxhash64("tk"), F.lit(1 << FILTER_BITS)).alias("bit")).mapInArrow(only, "did long, tk long, text string").dropDuplicates(["did", "tk"])
        marked = keep(written(near.join(marks.hint("merge"), ["did", "tk"]).select("did", "tk", "text", "places", "hot"), "repeat-texts"))
        contexts = marked.mapInArrow(_context_records(finer), "kind int, bucket int, did binary, tk binary, begin binary, h1 binary, h2 binary, context binary")
        found = contexts.repartitionById(finer, "bucket").mapInArrow(_each_bucket(lambda records: _found(records, slots)), "slot int, did binary, tk binary, begin binary, end binary")
        spans = keep(written(found.repartitionById(slots, "slot").groupBy("slot").applyInArrow(_united, "did long, tk long, begins binary, ends binary"), "repeat-spans"))
    return marked.select("did", "tk", "text").join(spans.hint("merge"), ["did", "tk"]).select("did", "tk", "text", "begins", "ends").mapInArrow(_removed, "did long, tk long, begins binary, ends binary, n_removed long, n_spans long, kept_sha256 string")


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of `docs`."""
    found = repeats(docs).select("did", "tk", "n_removed", "n_spans", F.col("kept_sha256").alias("left"))
    every = _identified(docs).select("doc_id", "did", "tk", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    out = every.join(found.hint("merge"), ["did", "tk"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("left", "whole").alias("kept_sha256"))


def op3_interval_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))
