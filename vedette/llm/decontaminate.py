"""Benchmark decontamination: a BM25 index of the test items, searched with block-max WAND for every passage.

Index: the items' words (lower-cased, punctuation at the ends stripped) with BM25 impacts, each item's divided by
its sum, so a score is the share of an item's BM25 mass that a passage holds and one threshold fits items of any
length. Posting lists are cut in blocks that know their greatest impact.

Queries: every document is cut in overlapping passages, each twice as long as the longest item and beginning one
such length after the other, so every item that a document holds lies whole in a passage. A passage can only reach
the threshold for an item if its rare words alone bring threshold minus the item's whole mass in frequent words; this
upper bound is worked out for all passages of a batch together, and passages that can reach no item end there (none
does where an item reaches the threshold on frequent words alone, as repeated items may). The others are searched by block-max WAND, which gives every item above the threshold. Last the document's 5-word
shingles are compared with the item's: OVERLAP of those within the question, half of those that end in the answer
and OVERLAP of all must be there. (The answer is an item's last sentence; where there is but one sentence, its last
quarter.)

One pass over the documents without a shuffle. The index goes to the executors in blocks of ITEMS items, however
many there are, each built and sent before the next; what scores rest on (items that hold a word, their number and
mean length, the longest) is counted over all items first, so the blocks change no score and no match.

Defined results: null, empty or blank texts match nothing, nor do blank items; items that repeat a text all match;
rows with a null doc_id or item_id are matched and returned as such; an empty table gives no rows. Other columns are
ignored (kept by `decontaminated`).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vedette.llm.common import prepare, slices, table
from vedette.llm.textkit import Words

#: Items in one index (a few kB each), rows in a posting block, share of the BM25 mass, share of the shingles.
ITEMS = 20_000
BLOCK = 64
SHARE = 0.6
OVERLAP = 0.8
SHINGLE = 5
K1, B = 1.2, 0.75
_TABLE_BITS = 20


@dataclass(frozen=True)
class Collection:
    """Counts over all items that are not blank: how many, their words, the most words, items that hold each word."""

    n: int
    words: int
    longest: int
    terms: np.ndarray
    df: np.ndarray


def counted(blocks: Iterable[list[str]]) -> Collection:
    """The counts of items that come in blocks: 16 bytes for each distinct word are held, and one block."""
    n, total, longest, terms, df = 0, 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for texts in blocks:
        words = Words(pa.array(texts, pa.large_string()), strip=True)
        n, total, longest = n + int((words.count > 0).sum()), total + len(words.hash), max(longest, int(words.count.max(initial=0)))
        order = np.lexsort((words.doc, words.hash))
        h, d = words.hash[order], words.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        here, many = np.unique(h[new], return_counts=True)
        terms, inverse = np.unique(np.concatenate([terms, here]), return_inverse=True)
        df = np.bincount(inverse, np.concatenate([df, many]), len(terms)).astype(np.int64)
    return Collection(n, total, longest, terms, df)


class BlockMaxIndex:
    """Impact-ordered by item number, in blocks; search() is document-at-a-time block-max WAND.

    `whole`: the counts over all items, where these are but some of them."""

    def __init__(self, ids: list, texts: list[str], whole: Collection | None = None) -> None:
        whole = whole or counted([texts])
        words = Words(pa.array(texts, pa.large_string()), strip=True)
        keep = np.flatnonzero(words.count > 0)
        self.ids = [ids[i] for i in keep]
        number = np.full(len(texts), -1)
        number[keep] = np.arange(len(keep))
        self.n = len(keep)
        self.longest = whole.longest
        self.terms, term = np.unique(words.hash, return_inverse=True)
        item = number[words.doc]
        pair, tf = np.unique(item * max(1, len(self.terms)) + term, return_counts=True)
        p_item, p_term = np.divmod(pair, max(1, len(self.terms)))
        self.df = np.bincount(p_term, minlength=len(self.terms))
        everywhere = whole.df[np.searchsorted(whole.terms, self.terms)]
        idf = np.log1p((whole.n - everywhere + 0.5) / (everywhere + 0.5))
        length = words.count[keep].astype(float)
        norm = K1 * (1 - B + B * length / max(1.0, whole.words / max(1, whole.n)))
        impact = idf[p_term] * tf * (K1 + 1) / (tf + norm[p_item])
        impact /= np.bincount(p_item, impact, self.n)[p_item]
        order = np.lexsort((p_item, p_term))
        self.p_item, self.p_impact = p_item[order], impact[order]
        self.head = np.concatenate([[0], np.cumsum(self.df)])
        self.most = np.maximum.reduceat(self.p_impact, self.head[:-1]) if len(self.terms) else np.zeros(0)
        self.block_last, self.block_most, self.block_head = [], [], []
        for t in range(len(self.terms)):
            lo, hi = self.head[t], self.head[t + 1]
            cuts = np.arange(lo, hi, BLOCK)
            self.block_head.append(cuts)
            self.block_last.append(self.p_item[np.minimum(cuts + BLOCK, hi) - 1])
            self.block_most.append(np.maximum.reduceat(self.p_impact, cuts))
        # words in few items: what is needed of them before an item can reach the threshold
        self.rare = self.df <= max(8, self.n // 50)
        frequent = ~self.rare[p_term]
        self.common_mass = np.bincount(p_item[frequent], impact[frequent], self.n)
        self.filter = np.zeros(1 << _TABLE_BITS, bool)
        self.filter[(self.terms >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.shingles = self._shingles(words, [texts[i] for i in keep], keep)

    def _shingles(self, words: Words, texts: list[str], keep: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(words in a shingle, those within the question, those that end in the answer) of each item."""
        first = np.cumsum(words.count) - words.count
        out = []
        for text, i in zip(texts, keep, strict=True):
            n = int(words.count[i])
            k = min(SHINGLE, n)
            h, _ = shingle_hash(words.hash[first[i] : first[i] + n], k)
            sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if s.strip()]
            tail = int(Words(pa.array([sentences[-1]], pa.large_string()), strip=True).count[0]) if len(sentences) > 1 else 0
            tail = tail if 0 < tail < n else max(1, n // 4)
            at = np.arange(len(h)) + k > n - tail
            out.append((k, np.unique(h[~at]), np.unique(h[at])))
        return out

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, term numbers) of the hashes that are in the index."""
        at = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        good = self.terms[term] == hashes[at]
        return at[good], term[good]

    def possible(self, window: np.ndarray, term: np.ndarray, share: float) -> np.ndarray:
        """Windows (of distinct (window, term) pairs) whose upper bound reaches the share for some item."""
        if (self.common_mass >= share - 1e-9).any():  # items of frequent words alone: every window may hold them
            return np.unique(window)
        rare = self.rare[term]
        window, term = window[rare], term[rare]
        n = self.df[term]
        at = np.repeat(self.head[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(window, n) * self.n + self.p_item[at]
        key, where = np.unique(key, return_inverse=True)
        total = np.bincount(where, self.p_impact[at], len(key))
        return np.unique(key[total >= share - self.common_mass[key % self.n] - 1e-9] // self.n)

    def search(self, terms: np.ndarray, share: float) -> list[tuple[int, float]]:
        """Every (item, score) with a score of `share` or more for a set of distinct term numbers."""
        share -= 1e-9
        lists = [[int(self.p_item[self.head[t]]), int(self.head[t]), int(self.head[t + 1]), float(self.most[t]), int(t), 0] for t in terms]
        out = []
        while lists:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= share:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            # the blocks that would hold the pivot item
            bound, nearest = 0.0, self.n if pivot + 1 == len(lists) else lists[pivot + 1][0]
            for x in lists[: pivot + 1]:
                last, b = self.block_last[x[4]], x[5]
                while b < len(last) and last[b] < item:
                    b += 1
                x[5] = b
                if b < len(last):
                    bound += self.block_most[x[4]][b]
                    nearest = min(nearest, int(last[b]) + 1)
            if bound < share:
                target = max(nearest, item + 1)
            elif lists[0][0] == item:
                score = sum(self.p_impact[x[1]] for x in lists[: pivot + 1] if x[0] == item)
                if score >= share:
                    out.append((item, float(score)))
                target = item + 1
            else:
                target = item
            for x in lists[: pivot + 1]:
                if x[0] < target:
                    x[1] += int(np.searchsorted(self.p_item[x[1] : x[2]], target))
                    x[0] = int(self.p_item[x[1]]) if x[1] < x[2] else -1
            lists = [x for x in lists if x[0] >= 0]
        return out


def shingle_hash(hashes: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Hashes of all runs of k of the words."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : n + j]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out, k


def matches(index: BlockMaxIndex, column: pa.Array) -> list[tuple[int, int, float, float, float]]:
    """(row, item number, BM25 share, question overlap, answer overlap) of every verified match in a column."""
    if not index.n:
        return []
    words = Words(column, strip=True)
    at, term = index.lookup(words.hash)
    if not len(at):
        return []
    first = np.cumsum(words.count) - words.count
    stride = max(32, index.longest)
    here = (at - first[words.doc[at]]) // stride
    windows = np.maximum(1, -(-words.count // stride))  # of each row
    base = np.cumsum(windows + 1) - (windows + 1)
    window = base[words.doc[at]] + here
    # each word is in the passage that begins at its stretch and in the one before
    pair = np.unique(np.concatenate([(window + 1) * len(index.terms) + term, window * len(index.terms) + term]))
    window, term = np.divmod(pair, len(index.terms))
    found: dict[tuple[int, int], float] = {}
    heads = np.searchsorted(window, wanted := index.possible(window, term, SHARE))
    ends = np.searchsorted(window, wanted, "right")
    for w, lo, hi in zip(wanted.tolist(), heads.tolist(), ends.tolist(), strict=True):
        row = int(np.searchsorted(base, w, "right")) - 1
        for item, score in index.search(term[lo:hi], SHARE):
            found[row, item] = max(score, found.get((row, item), 0.0))
    out = []
    sets: dict[tuple[int, int], np.ndarray] = {}
    for (row, item), score in sorted(found.items()):
        k, question, answer = index.shingles[item]
        if (row, k) not in sets:
            sets[row, k] = np.unique(shingle_hash(words.hash[first[row] : first[row] + words.count[row]], k)[0])
        have = sets[row, k]
        q, a = (int(np.isin(x, have, assume_unique=True).sum()) for x in (question, answer))
        q_share, a_share = q / len(question) if len(question) else 1.0, a / len(answer) if len(answer) else 1.0
        if q_share >= OVERLAP and a_share >= 0.5 and q + a >= OVERLAP * (len(question) + len(answer)):
            out.append((row, item, score, q_share, a_share))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[Row]]:
    """All rows of the benchmark in order, ITEMS at a time."""
    block = []
    for row in benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).orderBy("item_id", "text").toLocalIterator():
        block.append(row)
        if len(block) == ITEMS:
            yield block
            block = []
    if block:
        yield block


def indexes(benchmark: DataFrame) -> Iterator[BlockMaxIndex]:
    """Indexes of ITEMS items each, over all rows of the benchmark; the driver holds one at a time."""
    whole = counted([r[1] for r in block] for block in _blocks(benchmark))
    for block in _blocks(benchmark):
        yield BlockMaxIndex([r[0] for r in block], [r[1] for r in block], whole)


_MATCH = "doc_id long, item_id long, bm25_share double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, bm25_share, question_overlap, answer_overlap for every item that a document holds."""
    spark = docs.sparkSession
    prepare(spark)
    out = None
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = matches(shared.value, batch.column(1))
                if found:
                    rows, items, *rest = map(list, zip(*found, strict=True))
                    ids = pa.array([shared.value.ids[i] for i in items], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), ids, *(pa.array(x, pa.float64()) for x in rest)], ["doc_id", "item_id", "bm25_share", "question_overlap", "answer_overlap"])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _MATCH)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], _MATCH) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Those rows of `docs`, all columns, that hold no item."""
    spark = docs.sparkSession
    prepare(spark)
    at = docs.columns.index("text")
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, batch_text):
                bad = {m[0] for m in matches(shared.value, batch.column(at))}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)])) if bad else batch

        batch_text = "text"
        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
