"""Language identification: a linear-chain conditional random field labels every word by forward-backward.

A word's features are its prefixes and suffixes, its byte n-grams and the word itself (lexicon), hashed to one table of
weights per language; learned transitions tie neighbours, so words of code-switched text get a language each. A
document's language is the one with the greatest mean marginal probability over its words; that mean is its score.

Training, on the driver: TRAIN_ROWS labelled documents of TRAIN_CHARS characters at most (of each language in turn the
one with the next smallest hash of doc_id, so rare languages are learnt too; whole texts), cut in stretches, of which
some are joined across languages so that switches are seen. The conditional likelihood's gradient for features, first
labels and transitions is observed minus expected counts, all from the same forward-backward: a pair of neighbours
counts by alpha_i T e_j beta_j over its sum. Labelling is one pass without a shuffle. Inside a worker
long documents are cut in blocks whose transfer matrices are multiplied side by side, which gives the same marginals
as word after word.

Defined results: null texts and texts without a letter are `und` with score 0; where nothing can be learnt, all are.
Null languages are not learnt from, and of texts that share a doc_id and language the smallest only; repeated rows are
labelled each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vedette.llm.common import prepare, slices, table, text_column
from vedette.llm.textkit import Words, span_hash

TRAIN_ROWS = 600
TRAIN_CHARS = 10_000
STRETCH = 16
#: Bits of a hash's ranges in which the rows of a language are counted.
PART_BITS = 12
TABLE_BITS = 18
BLOCK = 64
U = np.uint64


def word_features(words: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, which of `rows`) of every feature of the words in `rows`, ordered by word."""
    starts, ends = words.starts[rows], words.ends[rows]
    size, which = ends - starts, np.arange(len(rows))
    kinds: list[tuple[np.ndarray, np.ndarray]] = []

    def add(s: np.ndarray, e: np.ndarray, salt: int, w: np.ndarray) -> None:
        kinds.append((((span_hash(words.prefix, s, e) ^ U(salt * 0x9E3779B9)) * U(0xD6E8FEB86659FD93)) >> U(64 - TABLE_BITS), w))

    add(starts, ends, 1, which)
    for k in (1, 2, 3, 4):
        long = size > k
        add(starts[long], starts[long] + k, 10 + k, which[long])
        add(ends[long] - k, ends[long], 20 + k, which[long])
    for k in (2, 3):
        n = np.maximum(size - k + 1, 0)
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        add(at, at + k, 30 + k, np.repeat(which, n))
    bucket, word = np.concatenate([x[0] for x in kinds]).astype(np.int64), np.concatenate([x[1] for x in kinds])
    order = np.argsort(word.astype(np.int32), kind="stable")
    return bucket[order], word[order]


def emissions(weights: np.ndarray, bucket: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Summed weights of each word, every one of which has features."""
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    return np.add.reduceat(weights[bucket], heads, axis=0) if n else np.zeros((0, weights.shape[1]))


def marginals(scores: np.ndarray, transition: np.ndarray, start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[words, labels] posterior probabilities; `counts` words in each sequence, one after the other.

    transition[i, j] and start[j] are log weights."""
    return forward_backward(scores, transition, start, counts)[0]


def forward_backward(scores: np.ndarray, transition: np.ndarray, start: np.ndarray, counts: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The marginals, and with `pairs` [labels, labels]: how often a label is expected next to another, over all
    neighbours in the sequences."""
    n, k = scores.shape
    expected = np.zeros((k, k))
    if not n:
        return scores, expected
    full = counts[counts > 0]
    blocks = -(-full // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    first_word = np.cumsum(full) - full
    within = np.arange(n) - np.repeat(first_word, full)
    block, place = np.repeat(first_block, full) + within // BLOCK, within % BLOCK
    total = int(blocks.sum())
    e = np.ones((total, BLOCK, k))
    e[block, place] = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    used = np.zeros((total, BLOCK), bool)
    used[block, place] = True
    is_first = np.zeros(total, bool)
    is_first[first_block] = True
    t = np.exp(transition - transition.max())
    pi = np.exp(start - start.max())
    begin = np.broadcast_to(pi, (k, k))
    # transfer matrix of each block
    m = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for j in range(BLOCK):
        live = used[:, j]
        if not live.any():
            break
        step = m[live] @ t if j else np.where(is_first[live][:, None, None], begin, t[None])
        step = step * e[live, j][:, None, :]
        m[live] = step / step.max(axis=(1, 2), keepdims=True)
    # what enters each block from the left, and from the right
    left, right = np.full((total, k), 1.0 / k), np.ones((total, k))
    order = np.argsort(-blocks, kind="stable")
    head, size = first_block[order], blocks[order]
    for j in range(1, int(size[0])):
        at = head[size > j] + j
        x = np.einsum("bi,bij->bj", left[at - 1], m[at - 1])
        left[at] = x / x.sum(axis=1, keepdims=True)
    for j in range(int(size[0]) - 2, -1, -1):
        at = head[size > j + 1] + j
        x = np.einsum("bij,bj->bi", m[at + 1], right[at + 1])
        right[at] = x / x.max(axis=1, keepdims=True)
    alpha, beta = np.empty((total, BLOCK, k)), np.empty((total, BLOCK, k))
    a = left
    for j in range(BLOCK):
        x = a @ t
        if j == 0:
            x[is_first] = pi
        x *= e[:, j]
        a = np.where(used[:, j][:, None], x / x.sum(axis=1, keepdims=True), a)
        alpha[:, j] = a
    b = right
    for j in range(BLOCK - 1, -1, -1):
        beta[:, j] = b
        x = (b * e[:, j]) @ t.T
        b = np.where(used[:, j][:, None], x / x.max(axis=1, keepdims=True), b)
    a, b = alpha[block, place], beta[block, place]
    if pairs:
        inner = np.flatnonzero(within > 0)
        into = (e[block, place] * b)[inner]
        from_ = a[inner - 1]
        total = np.einsum("ni,ij,nj->n", from_, t, into)
        expected = t * ((from_ / total[:, None]).T @ into)
    p = a * b
    return p / p.sum(axis=1, keepdims=True), expected


@dataclass(frozen=True)
class Field:
    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def label_words(self, column: pa.Array) -> tuple[Words, np.ndarray]:
        """Words (punctuation stripped) and their marginal probabilities."""
        words = Words(column, strip=True)
        _, rows, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        bucket, word = word_features(words, rows)
        return words, marginals(emissions(self.weights, bucket, word, len(rows))[inverse], self.transition, self.start, words.count)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each row."""
        n = len(column)
        texts = text_column(column)
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        words, p = self.label_words(texts)
        mean = np.stack([np.bincount(words.doc, p[:, j], n) for j in range(len(self.languages))], axis=1) / np.maximum(words.count, 1)[:, None]
        best = mean.argmax(axis=1)
        ascii_letter = np.zeros(256, bool)
        ascii_letter[97:123] = True
        seen = np.concatenate([[0], np.cumsum(ascii_letter[words.data])])
        letters = seen[words.offsets[1:]] > seen[words.offsets[:-1]]
        for i in np.flatnonzero(~letters):
            letters[i] = any(c.isalpha() for c in texts[int(i)].as_py())
        letters &= words.count > 0
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, mean[np.arange(n), best], 0.0)


def fit_field(texts: list[str], labels: list[str], steps: int = 30, rate: float = 0.5) -> Field:
    """Penalised maximum conditional likelihood by full-batch adaptive gradient steps."""
    languages = sorted(set(labels))
    k = len(languages)
    weights = np.zeros((1 << TABLE_BITS, k))
    if k == 0:
        return Field([], weights, np.zeros((0, 0)), np.zeros(0))
    words = Words(pa.array(texts, pa.large_string()), strip=True)
    _, rows, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    bucket, word = word_features(words, rows)
    truth = np.searchsorted(languages, labels)[words.doc] if len(words.doc) else np.zeros(0, np.int64)
    # stretches of one document; a third of them goes on in another language
    at = np.arange(len(words.doc)) - (np.cumsum(words.count) - words.count)[words.doc]
    heads = np.flatnonzero(at % STRETCH == 0)
    ends = np.append(heads[1:], len(at))
    rng = np.random.default_rng(13)
    chosen = rng.permutation(len(heads))
    by_language = [chosen[truth[heads[chosen]] == j] for j in range(k)]
    mixed, rest = chosen[: len(chosen) // 3], [x[~np.isin(x, chosen[: len(chosen) // 3])] for x in by_language]
    pieces = [np.arange(heads[i], ends[i]) for i in [*mixed, *np.concatenate(rest)]] if len(heads) else []
    sequence_of = np.concatenate([np.arange(len(mixed)) // 2, len(mixed) + np.concatenate([j * len(heads) + np.arange(len(x)) // 2 for j, x in enumerate(rest)])]) if len(heads) else np.zeros(0)
    order = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
    lengths = np.array([len(x) for x in pieces], np.int64)
    counts = np.bincount(np.unique(sequence_of, return_inverse=True)[1], lengths).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    y, which = truth[order], inverse[order]
    first = np.zeros(len(order), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    one = np.zeros((len(order), k))
    one[np.arange(len(order)), y] = 1
    transition, start = np.zeros((k, k)), np.zeros(k)
    seen = np.zeros((k, k))
    inner = np.flatnonzero(~first)
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    opened = one[first].sum(axis=0)
    squares, t_squares, s_squares = np.full(weights.shape, 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)
    n = max(1, len(order))
    for _ in range(steps):
        scores = emissions(weights, bucket, word, len(rows))[which]
        p, expected = forward_backward(scores, transition, start, counts, pairs=True)
        gap = np.stack([np.bincount(which, one[:, j] - p[:, j], len(rows)) for j in range(k)], axis=1)
        g = np.stack([np.bincount(bucket, gap[word, j], len(weights)) for j in range(k)], axis=1) / n - 1e-7 * weights
        squares += g * g
        weights += rate * g / np.sqrt(squares)
        tg = (seen - expected) / n - 1e-4 * transition / n
        t_squares += tg * tg
        transition += 0.3 * tg / np.sqrt(t_squares)
        sg = (opened - p[first].sum(axis=0)) / n - 1e-4 * start / n
        s_squares += sg * sg
        start += 0.3 * sg / np.sqrt(s_squares)
    return Field(languages, weights.astype(np.float32), transition, start)


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Field:
    able = F.col("lang").isNotNull() & (F.length("text") <= TRAIN_CHARS) & F.col("doc_id").isNotNull() & ~held_out()
    known = docs.where(able).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).distinct()
    # the first `rows` of each language by hash: counts by ranges of the hash tell which ranges hold them
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = known.withColumn("part", F.shiftright(order[0], 64 - PART_BITS))
    earlier = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # 2**PART_BITS counts of a language at most
    needed = known.groupBy("lang", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(F.col("before") < rows)
    known = known.join(needed.select("lang", "part"), ["lang", "part"]).withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("turn") <= rows)
    ids = known.orderBy("turn", *order, "lang").limit(rows).select("doc_id", "lang").collect()  # `rows` at most
    picked = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in ids], "doc_id long, lang string"))
    found = docs.where(able).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).join(picked, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    found = sorted(found, key=lambda r: (r["doc_id"], r["lang"]))
    return fit_field([r["text"] for r in found], [r["lang"] for r in found])


def languages(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, lang_pred, score."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, score = shared.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_conditional_random_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    found = languages(docs, train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.least("score", F.lit(1.0)).alias("score"))
