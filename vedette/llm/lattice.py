"""LM scoring: the marginal probability of a text over all its segmentations into subword pieces.

The pieces and their first weights come from an existing vocabulary, all of it (a piece at rank r of its scores weighs
1 / (r + RANK_SHIFT)); EM_STEPS rounds of forward-backward over the training words' lattices turn them into
probabilities of this corpus. A word is preceded by a space, pieces do not cross words (those with white space inside
fit nowhere), and every single byte is a piece, so every text has a segmentation. F(w), the sum over all segmentations
of word w, is found by a forward recursion in log space; F adds up to 1 over all words (the empty one, a lone space, is
ruled out by division).

A word that was seen c > 0 times in the N training words has one more arc over its lattice, the whole word: its
probability is (c - D) / N + D V / N * F(w), V distinct words, D = n1 / (n1 + 2 n2) from the words seen once and twice
(absolute discounting with the lattice below it; the pieces are therefore fitted to distinct words). Words are drawn
until the end comes, each time with the share of ends among words and ends. `lattice_score` is the same without word
arcs: what the segmentations alone give.

Each distinct word of the corpus gets its lattice once, not each occurrence, and documents stay where they are until
the last step:

1. a task reduces every CHUNK_BYTES of text to a chunk: its distinct words with their counts, and for each the documents
   that hold it; written once to the shared folder;
2. chunks ask for their words: packed requests, dealt out by a hash of the word to so many buckets that each has about
   the same share of the input whatever the input's size (`bucket_count`);
3. each bucket merges its requests to distinct words with corpus counts, written too;
4. EM reads words and counts only; what the driver gets is one number for each piece of the vocabulary;
5. buckets answer: for each word of a request its count and log probabilities, packed by chunk, where they meet the
   chunk's documents. No answer is by document, so more buckets make no more of them.

Words of up to LONG bytes go through the recursion together with those of their length; a longer one, however long,
alone and by blocks of positions, in time linear in its length.

Words are compared by 64-bit hashes. Defined results: null text counts as empty and has the end only; a null doc_id
is trained on; repeated rows count and are scored each; with no training text all words have count 0 and the pieces
keep their first weights; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vedette.llm.common import bucket_count, prepare, release, slices, table
from vedette.llm.textkit import BYTE_CODE, Words, prefix_hash, span_hash
from vedette.llm.tokenise import vocabulary
from vedette.session import written

VOCABULARY = "piece_bpe_32k.model"
RANK_SHIFT = 10.0
EM_STEPS = 4
#: Text bytes and documents of a chunk at most, but for one document that is longer.
CHUNK_BYTES, CHUNK_DOCS = 8_000_000, 60_000
#: Bytes that come and go for each byte of text, about.
MOVED = 2
#: Longest word that is looked at together with others; positions of a longer one that are looked at together.
LONG, STRETCH = 64, 1 << 16
#: What each piece is seen beyond its expected count, in all.
SMOOTHING = 1.0
_LOG10 = np.log(10)
_FILTER_BITS = 19


@dataclass(frozen=True)
class Pieces:
    """Sorted hashes of the pieces, their numbers' log weights, a filter for look-ups, and the pieces' lengths."""

    texts: tuple[bytes, ...]
    first: np.ndarray
    hashes: np.ndarray
    numbers: np.ndarray
    filter: np.ndarray
    sizes: np.ndarray

    @property
    def longest(self) -> int:
        return int(self.sizes[-1])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        out = np.full(hashes.shape, -1, np.int32)
        at = np.nonzero(self.filter[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int32)])
        some = hashes[at]
        k = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        out[at] = np.where(self.hashes[k] == some, self.numbers[k], -1)
        return out


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """Pieces of a sentencepiece file that are text (a leading mark becomes a space), and every single byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rank: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        text, score = model.id_to_piece(i).replace("▁", " "), model.get_score(i)
        raw = text.encode()
        if raw and not any(c in raw[1:] for c in b" \t\n\r\v\f"):
            rank[raw] = min(-score, rank.get(raw, np.inf))
    ranked = [r for r in rank.values() if r < 1e8]
    worst = max(ranked, default=0.0)
    rank = {raw: min(r, worst + 1) for raw, r in rank.items()}  # pieces without a place of their own come last
    for b in range(256):
        rank.setdefault(bytes([b]), worst + 1)
    texts = tuple(sorted(rank))
    weight = 1 / (RANK_SHIFT + np.array([rank[t] for t in texts]))
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    hashes = span_hash(prefix_hash(BYTE_CODE[np.frombuffer(b"".join(texts), np.uint8)]), ends - sizes, ends)
    order = np.argsort(hashes)
    known = np.zeros(1 << _FILTER_BITS, bool)
    known[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Pieces(texts, np.log(weight / weight.sum()), hashes[order], order.astype(np.int32), known, np.unique(sizes))


def _groups(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cells: int = 1_500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words' numbers, their bytes after a space as a matrix) by length up to LONG, in bounded pieces."""
    order = np.argsort(sizes, kind="stable")[: int((sizes <= LONG).sum())]
    cut = np.flatnonzero(np.diff(sizes[order], prepend=-1)) if len(order) else order
    for lo, hi in zip(cut, np.append(cut[1:], len(order))[: len(cut)], strict=True):
        size = int(sizes[order[lo]])
        step = max(1, cells // (size + 1))
        for at in range(lo, hi, step):
            rows = order[at : min(hi, at + step)]
            text = np.full((len(rows), size + 1), 32, np.uint8)
            text[:, 1:] = data[starts[rows][:, None] + np.arange(size)[None, :]]
            yield rows, text


def _long_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(word's number, its bytes after a space) of those longer than LONG."""
    for i in np.flatnonzero(sizes > LONG).tolist():
        yield i, np.concatenate([np.array([32], np.uint8), data[starts[i] : starts[i] + sizes[i]]])


def _matches(pieces: Pieces, text: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, rows, piece numbers) of all pieces in words of one length, by end."""
    n, width = text.shape
    prefix = prefix_hash(BYTE_CODE[text.reshape(-1)])
    at = np.arange(n)[:, None] * width
    out = []
    for end in range(1, width + 1):
        begins = end - pieces.sizes[pieces.sizes <= end]
        found = pieces.find(span_hash(prefix, (at + begins[None, :]).reshape(-1), np.broadcast_to(at + end, (n, len(begins))).reshape(-1))).reshape(n, len(begins))
        for j, begin in enumerate(begins.tolist()):
            rows = np.flatnonzero(found[:, j] >= 0)
            if len(rows):
                out.append((begin, end, rows, found[rows, j]))
    return out


def _forward(matches: list, weights: np.ndarray, n: int, width: int) -> np.ndarray:
    alpha = np.full((width + 1, n), -np.inf)
    alpha[0] = 0
    for begin, end, rows, piece in matches:  # by end, so what begins there is complete
        alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[begin, rows] + weights[piece])
    return alpha


def _stretch(pieces: Pieces, raw: np.ndarray, lo: int, hi: int, mirrored: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, piece) of the pieces that end in (lo, hi] of one word, by end; `mirrored` counts from the word's end
    (and swaps begin and end)."""
    n, found = len(raw), []
    base = n - hi if mirrored else max(0, lo + 1 - pieces.longest)
    prefix = prefix_hash(BYTE_CODE[raw[base : min(n, n - lo + pieces.longest) if mirrored else hi]])
    for size in pieces.sizes.tolist():
        begins = np.arange(base, min(n - lo, n - size + 1)) if mirrored else np.arange(max(0, lo + 1 - size), hi - size + 1)
        piece = pieces.find(span_hash(prefix, begins - base, begins - base + size))
        some = np.flatnonzero(piece >= 0)
        found.append((begins[some], begins[some] + size, piece[some]))
    begin, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    if mirrored:
        begin, end = n - end, n - begin
    order = np.argsort(end, kind="stable")
    return begin[order], end[order], piece[order]


def _long_sums(pieces: Pieces, weights: np.ndarray, raw: np.ndarray, mirrored: bool = False) -> np.ndarray:
    """log of the sum over all segmentations up to every place of one word (`mirrored`: from its end): plain floats,
    whose scale is kept as a logarithm. What a rescaling may make infinite is too far back for any piece to reach."""
    n, reach = len(raw), pieces.longest
    out, scale, sums = np.zeros(n + 1), 0.0, [0.0] * (reach - 1) + [1.0]
    for lo in range(0, n, STRETCH):
        hi = min(lo + STRETCH, n)
        begin, end, piece = _stretch(pieces, raw, lo, hi, mirrored)
        source, weight = (begin - lo + reach - 1).tolist(), np.exp(weights[piece]).tolist()
        edge = np.searchsorted(end, np.arange(lo + 1, hi + 2)).tolist()
        values, scales = [], []
        for i in range(hi - lo):
            x = 0.0
            for k in range(edge[i], edge[i + 1]):
                x += sums[source[k]] * weight[k]
            if x < 1e-100:
                scale += math.log(x)
                for j in range(i, i + reach):
                    sums[j] /= x
                x = 1.0
            sums.append(x)
            values.append(x)
            scales.append(scale)
        out[lo + 1 : hi + 1] = np.log(values) + scales
        sums = sums[-reach:]
    return out


def word_log_probabilities(pieces: Pieces, weights: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log of each word's marginal probability."""
    out = np.zeros(len(starts))
    for rows, text in _groups(data, starts, sizes):
        out[rows] = _forward(_matches(pieces, text), weights, len(rows), text.shape[1])[-1]
    for i, raw in _long_words(data, starts, sizes):
        out[i] = _long_sums(pieces, weights, raw)[-1]
    return out


def expected_counts(pieces: Pieces, weights: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words."""
    out = np.zeros(len(weights))
    for rows, text in _groups(data, starts, sizes):
        n, width = text.shape
        matches = _matches(pieces, text)
        alpha = _forward(matches, weights, n, width)
        beta = np.full((width + 1, n), -np.inf)
        beta[width] = 0
        for begin, end, some, piece in reversed(matches):
            beta[begin, some] = np.logaddexp(beta[begin, some], beta[end, some] + weights[piece])
        total = alpha[width]
        for begin, end, some, piece in matches:
            share = np.exp(alpha[begin, some] + weights[piece] + beta[end, some] - total[some])
            out += np.bincount(piece, share, len(out))
    for _, raw in _long_words(data, starts, sizes):
        alpha, beta = _long_sums(pieces, weights, raw), _long_sums(pieces, weights, raw, mirrored=True)[::-1]
        for lo in range(0, len(raw), STRETCH):
            begin, end, piece = _stretch(pieces, raw, lo, min(lo + STRETCH, len(raw)), False)
            out += np.bincount(piece, np.exp(alpha[begin] + weights[piece] + beta[end] - alpha[-1]), len(out))
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """Counts in one or two bytes each where they fit, else in eight."""
    most = x.max(initial=0)
    return x.astype("<u1" if most < 256 else "<u2" if most < 65536 else "<u8")


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n if n else 1}")


_CHUNK = "chunk long, text_bytes long, train_docs long, head binary, hashes binary, sizes binary, letters binary, seen binary, n_docs binary, docs binary, times binary"
_CHUNK_KINDS = [pa.int64()] * 3 + [pa.binary()] * 8


def _gathered(letters: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The letters of the chosen words, one after the other."""
    at, size = (np.cumsum(sizes) - sizes)[chosen], sizes[chosen]
    return letters[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class _Chunk:
    """Slices of documents that are being reduced to one chunk."""

    def __init__(self) -> None:
        self.parts, self.heads, self.docs, self.bytes = [], [], 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        words = Words(batch.column(1))
        held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        # distinct (word, document) pairs with their numbers, by word
        order = np.argsort(words.hash, kind="stable")
        h, d = words.hash[order], words.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        pair = np.flatnonzero(new)
        times = np.diff(np.append(pair, len(h)))
        h, d = h[pair], d[pair]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        seen = np.add.reduceat(np.where(held[d], 0, times), first) if len(first) else np.zeros(0, np.int64)
        example = order[pair[first]]
        sizes = words.ends - words.starts
        letters = words.data[np.repeat(words.starts[example] - (np.cumsum(sizes[example]) - sizes[example]), sizes[example]) + np.arange(sizes[example].sum())]
        self.parts.append((h[first], sizes[example], letters, seen, np.diff(np.append(first, len(h))), d + self.docs, times))
        ids = batch.column(0)
        self.heads.append((ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null()), held, words.count))
        self.docs, self.bytes = self.docs + batch.num_rows, self.bytes + len(words.data)

    def row(self, chunk: int) -> pa.RecordBatch:
        ids, null, held, count = (np.concatenate(x) for x in zip(*self.heads, strict=True))
        head = np.array([len(ids)], "<i8").tobytes() + ids.astype("<i8").tobytes() + null.astype(np.uint8).tobytes() + held.astype(np.uint8).tobytes() + count.astype("<i8").tobytes()
        hashes, sizes, letters, seen, n_docs, docs, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        unique, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        word = np.repeat(inverse, n_docs)
        order = np.argsort(word, kind="stable")
        values = [
            chunk, self.bytes, int((~held).sum()), head, unique.tobytes(), sizes[example].astype("<u4").tobytes(), _gathered(letters, sizes, example).tobytes(),
            np.bincount(inverse, seen, len(unique)).astype("<u4").tobytes(), np.bincount(word, minlength=len(unique)).astype("<u2").tobytes(), docs[order].astype("<u2").tobytes(), _narrow(times[order]).tobytes(),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _CHUNK_KINDS, strict=True)], _CHUNK.replace(",", "").split()[::2])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, chunk = TaskContext.get().partitionId(), 0, _Chunk()
    for batch in slices(batches, rows=CHUNK_DOCS):
        size = batch.column(1).nbytes
        if chunk.docs and (chunk.bytes + size > CHUNK_BYTES or chunk.docs + batch.num_rows > CHUNK_DOCS):
            yield chunk.row(part << 24 | number)
            number, chunk = number + 1, _Chunk()
        chunk.add(batch)
    if chunk.docs:
        yield chunk.row(part << 24 | number)


_REQUEST = "bucket int, chunk long, hashes binary, sizes binary, letters binary, seen binary"


def _requests(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, hashes, sizes, letters, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, sizes, seen = np.frombuffer(hashes, "<u8"), np.frombuffer(sizes, "<u4"), np.frombuffer(seen, "<u4")
                bucket = ((h >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)  # ascending, as h is
                used, first = np.unique(bucket, return_index=True)
                at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                cuts = list(zip(first.tolist(), np.append(first[1:], len(h)).tolist(), strict=True)) if len(h) else []
                columns = [used, [chunk] * len(cuts), [h[a:b].tobytes() for a, b in cuts], [sizes[a:b].tobytes() for a, b in cuts], [letters[at[a] : at[b]] for a, b in cuts], [seen[a:b].tobytes() for a, b in cuts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.int64(), *[pa.binary()] * 4], strict=True)], ["bucket", "chunk", "hashes", "sizes", "letters", "seen"])

    return run


_MERGED = "stats array<long>, sizes binary, letters binary, counts binary, requests array<struct<chunk: bigint, bucket: int, words: binary>>"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All requests of a task, which are those of one bucket, as one row."""
    rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    if not rows:
        return
    bucket, chunk, hashes, sizes, letters, seen = zip(*rows, strict=True)
    hashes = [np.frombuffer(h, "<u8") for h in hashes]
    sizes, seen = (np.concatenate([np.frombuffer(x, "<u4") for x in y]).astype(np.int64) for y in (sizes, seen))
    unique, example, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    counts = np.bincount(inverse, seen, len(unique)).astype(np.int64)
    text = _gathered(np.frombuffer(b"".join(letters), np.uint8), sizes, example)
    words = np.split(inverse.astype("<u4"), np.cumsum([len(h) for h in hashes])[:-1])
    stats = [int(counts.sum()), int((counts > 0).sum()), int((counts == 1).sum()), int((counts == 2).sum())]
    requests = [{"chunk": c, "bucket": b, "words": w.tobytes()} for c, b, w in zip(chunk, bucket, words, strict=True)]
    inner = pa.struct([("chunk", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary())])
    values = [[stats], [sizes[example].astype("<u4").tobytes()], [text.tobytes()], [counts.astype("<i8").tobytes()], [requests]]
    kinds = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(inner)]
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["stats", "sizes", "letters", "counts", "requests"])


def _lattice_words(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.frombuffer(batch.column("sizes")[i].as_py(), "<u4").astype(np.int64)
    return np.frombuffer(batch.column("letters")[i].as_py(), np.uint8), np.cumsum(sizes) - sizes, sizes, np.frombuffer(batch.column("counts")[i].as_py(), "<i8")


def fit(merged: DataFrame, path: str, steps: int = EM_STEPS) -> np.ndarray:
    """Log probabilities of the pieces, from the distinct training words."""
    spark = merged.sparkSession
    weights = pieces_of(path).first
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, sums = pieces_of(path), np.zeros(shared.value.shape)
            for batch in batches:
                for i in range(batch.num_rows):
                    data, starts, sizes, counts = _lattice_words(batch, i)
                    some = np.flatnonzero(counts)
                    sums += expected_counts(known, shared.value, data, starts[some], sizes[some])
            which = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(sums[which])], ["piece", "expected"])

        found = merged.select("sizes", "letters", "counts").mapInArrow(run, "piece int, expected double").groupBy("piece").agg(F.sum("expected").alias("expected")).toArrow()  # a row for each piece
        expected = np.zeros(len(weights))
        expected[found.column("piece").to_numpy()] = found.column("expected").to_numpy()
        mass = expected + SMOOTHING * np.exp(weights)
        weights = np.log(mass / mass.sum())
    return weights


@dataclass(frozen=True)
class Model:
    """Piece weights; training documents, words, distinct words, those seen once and those seen twice."""

    weights: np.ndarray
    docs: int
    words: int
    distinct: int
    once: int
    twice: int

    def discount(self) -> float:
        return min(max(self.once / (self.once + 2 * self.twice), 0.05), 0.95) if self.once else 0.5

    def end(self) -> float:
        """Probability that a document ends, at each of its places."""
        return (self.docs + 1) / (self.docs + self.words + 2)

    def word_scores(self, known: Pieces, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of distinct words, with the chance to go on: with word arcs, and of the lattices alone."""
        lattice = word_log_probabilities(known, self.weights, data, starts, sizes) - np.log1p(-np.exp(self.weights[known.texts.index(b" ")]))
        score = lattice
        if self.words:
            with np.errstate(divide="ignore"):
                arc = np.log(np.maximum(counts - self.discount(), 0) / self.words)
            score = np.logaddexp(arc, lattice + np.log(self.discount() * self.distinct / self.words))
        on = np.log1p(-self.end())
        return (score + on) / _LOG10, (lattice + on) / _LOG10


_MEETING = "chunk long, bucket int, head binary, n_docs binary, docs binary, times binary, counts binary, score binary, lattice binary"


def _answers(path: str, shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces_of(path)
        for batch in batches:
            for i in range(batch.num_rows):
                data, starts, sizes, counts = _lattice_words(batch, i)
                score, lattice = shared.value.word_scores(known, data, starts, sizes, counts)
                requests = batch.column("requests")[i].as_py()
                words = [np.frombuffer(r["words"], "<u4") for r in requests]
                columns = [[r["chunk"] for r in requests], [r["bucket"] for r in requests], *[[None] * len(words)] * 4, [counts[w].astype("<i8").tobytes() for w in words], [score[w].tobytes() for w in words], [lattice[w].tobytes() for w in words]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int32(), *[pa.binary()] * 7], strict=True)], _MEETING.replace(",", "").split()[::2])

    return run


_DOCUMENT = "doc_id long, held_out boolean, n_words long, n_known long, base double, model double, lattice double"


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's chunks, one by one, with the answers to them."""
    held = list(batches)
    if held:
        table = pa.Table.from_batches(held)
        chunk = table.column("chunk").to_numpy()
        del held
        for c in np.unique(chunk):
            yield from _documents(table.filter(pa.array(chunk == c))).to_batches()
    release()


def _documents(parts: pa.Table) -> pa.Table:
    """A chunk and the answers to it, whose words follow each other by bucket as they do in the chunk."""
    bucket = parts.column("bucket").to_numpy()
    order = np.argsort(bucket, kind="stable").tolist()  # the chunk itself has bucket -1
    own = {c: parts.column(c)[order[0]].as_py() for c in ("head", "n_docs", "docs", "times")}
    counts, score, lattice = (np.frombuffer(b"".join(parts.column(c)[i].as_py() for i in order[1:]), t) for c, t in (("counts", "<i8"), ("score", "<f8"), ("lattice", "<f8")))
    head = own["head"]
    n = int(np.frombuffer(head, "<i8", 1)[0])
    ids, null, held = np.frombuffer(head, "<i8", n, 8), np.frombuffer(head, np.uint8, n, 8 + 8 * n), np.frombuffer(head, np.uint8, n, 8 + 9 * n)
    word, doc = np.repeat(np.arange(len(counts)), np.frombuffer(own["n_docs"], "<u2")), np.frombuffer(own["docs"], "<u2").astype(np.int64)
    times = _wide(own["times"], len(doc)).astype(float)
    total = lambda values: np.bincount(doc, times * values[word], n)
    columns = [pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(np.frombuffer(head, "<i8", n, 8 + 10 * n)), pa.array(total(counts > 0).astype(np.int64)), *(pa.array(total(x)) for x in (np.log10(counts + 1), score, lattice))]
    return pa.table(columns, ["doc_id", "held_out", "n_words", "n_known", "base", "model", "lattice"])


def lattice_scores(docs: DataFrame, held_out: Column | None = None, vocabulary_file: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and lattice_score (log10) of each row of `docs`.

    `held_out`: a condition for the rows not to learn from; none by default."""
    spark = docs.sparkSession
    prepare(spark)
    path = vocabulary(vocabulary_file or VOCABULARY)
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    chunks = written(rows.mapInArrow(_chunks, _CHUNK), "lattice-chunks")
    part, number = F.shiftright("chunk", 24), F.col("chunk").bitwiseAND(F.lit((1 << 24) - 1))
    text_bytes, train_docs, parts, most = chunks.agg(*(F.coalesce(c, F.lit(0)) for c in (F.sum("text_bytes"), F.sum("train_docs"), F.max(part) + 1, F.max(number) + 1))).first()
    n_buckets = bucket_count(MOVED * text_bytes)
    requests = chunks.select("chunk", "hashes", "sizes", "letters", "seen").mapInArrow(_requests(n_buckets), _REQUEST)
    merged = written(requests.repartitionById(n_buckets, "bucket").mapInArrow(_merge, _MERGED), "lattice-words")
    stats = merged.agg(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(4))).first()
    model = Model(fit(merged, path), int(train_docs), *map(int, stats))
    shared = spark.sparkContext.broadcast(model)
    answers = merged.select("sizes", "letters", "counts", "requests").mapInArrow(_answers(path, shared), _MEETING)
    own = chunks.select("chunk", F.lit(-1).alias("bucket"), "head", "n_docs", "docs", "times", *(F.lit(None).cast("binary").alias(c) for c in ("counts", "score", "lattice")))
    # chunks meet their answers in equal shares of their order: no two big ones by chance of a hash
    n_meetings = max(1, min(n_buckets, parts * most))
    place = F.floor((part * F.lit(most) + number) * F.lit(n_meetings) / F.lit(max(1, parts * most))).cast("int")
    met = own.union(answers).withColumn("place", place).repartitionById(n_meetings, "place").drop("place")
    found = met.mapInArrow(_meetings, _DOCUMENT)
    train_tokens, distinct = model.words + model.docs, model.distinct + (model.docs > 0)
    last = float(np.log10(model.end()))
    return found.select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_known") + int(model.docs > 0)).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(float(np.log10(model.docs + 1))) - (F.col("n_words") + 1) * F.lit(float(np.log10(train_tokens + distinct + 1)))).alias("base_score"),
        (F.col("model") + F.lit(last)).alias("score"), (F.col("lattice") + F.lit(last)).alias("lattice_score"),
    )


def op1_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
