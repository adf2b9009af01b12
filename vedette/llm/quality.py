"""Quality classifier: a Bradley-Terry ranking learnt from preference pairs.

Every document becomes a vector of whole-text measures (shares of character kinds, lengths, repetition of words,
shingles and lines). A pair (better, worse) has the probability sigmoid(w . (x_better - x_worse)); w minimises the
ridge-penalised logistic loss over pairs of labelled documents, by Newton steps. The threshold is a quantile of the
training scores: the one that parts the labels best. Scores are mapped to 0..1 so that the threshold is 0.5.

The fit looks at all labelled documents, and at PAIRS_PER_ROW pairs for each. Their measures are written, each label's
rows are numbered in a seeded order and dealt to groups by these numbers, so that every group has rows of both labels
(the rarer ones stand in several groups where there are few), and pairs are made within groups. A Newton step is a pass
over the groups, of which the driver gets sums; the threshold comes from errors counted between quantiles of the scores.
Scoring is one pass without a shuffle.

Defined results: null text counts as empty and gets a score like any text; null labels are not learnt from; several
labels of a document count as their mean, rounded up; with labels of one kind only (or none), every score is 0.5.
Rows come back as they are, repeated ones too; other columns are kept, but for one named quality_score or
quality_predicted, which `quality_scores` replaces (`accepted` adds no column and keeps these too).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vedette.llm.common import prepare, slices, table
from vedette.llm.textkit import Words, sorted_sets, span_hash, text_bytes
from vedette.operators.fold import _matrix
from vedette.operators.points import quantile_buckets, shuffled
from vedette.session import scratch, written

PAIRS_PER_ROW = 8
#: Labelled documents of a group, and of each label there at least (or all that there are).
GROUP_ROWS = 4_000
LEAST_OF_LABEL = 8

#: Character kinds that are counted one by one.
_SIGNS = "!?.,;:|#*&%$@<>{}[]()=+/\\_-~\"'"


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.int64)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 3, 4
    kind[32], kind[10], kind[9] = 5, 6, 7
    for i, c in enumerate(_SIGNS):
        kind[ord(c)] = 8 + i
    return kind


_KIND = _kinds()
N_KINDS = 8 + len(_SIGNS)


def features(column: pa.Array) -> np.ndarray:
    """[rows, measures]: every one from the whole text."""
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    size = np.diff(offsets).astype(float)
    counts = np.bincount(doc * N_KINDS + _KIND[raw], minlength=n * N_KINDS).reshape(n, N_KINDS).astype(float)
    shares = counts / np.maximum(size, 1)[:, None]
    words = Words(column)
    count = words.count.astype(float)
    one = np.maximum(count, 1)
    length = (words.ends - words.starts).astype(float)
    mean = np.bincount(words.doc, length, n) / one
    spread = np.sqrt(np.maximum(np.bincount(words.doc, length**2, n) / one - mean**2, 0))
    plain = np.zeros(256, bool)
    plain[97:123], plain[128:] = True, True
    tail = plain[words.data[np.maximum(words.ends - 1, 0)]] if len(words.data) else np.zeros(0, bool)
    distinct = sorted_sets(words.hash, words.doc, n)[2] / one
    threes, at = words.shingles(3, whole=False)
    in_threes = np.maximum(np.bincount(at, minlength=n), 1)
    varied = np.where(count >= 3, sorted_sets(threes, at, n)[2] / in_threes, 1.0)
    cut = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([offsets[:-1][size > 0], cut + 1, offsets[1:][size > 0]]))
    starts = starts[starts < len(raw)]
    ends = np.append(starts[1:], len(raw)) if len(starts) else starts
    of = np.searchsorted(offsets, starts, "right") - 1
    lines = np.maximum(np.bincount(of, minlength=n), 1)
    lone = sorted_sets(span_hash(words.prefix, starts, ends), of, n)[2] / lines
    held = np.bincount(of, (ends - starts) < 40, n) / lines
    measures = [
        np.log1p(size), np.log1p(count), mean, spread, np.bincount(words.doc, tail, n) / one, distinct, distinct * np.log1p(count),
        varied, lone, held, np.log1p(lines), np.log1p(size / lines), (count == 0).astype(float), counts[:, 2] / np.maximum(counts[:, 1] + counts[:, 2], 1),
        (counts[:, 8:].sum(axis=1)) / one,
    ]
    return np.column_stack([np.sqrt(shares), shares, *measures])


@dataclass(frozen=True)
class Ranking:
    """Weights on standardised measures; `scale * (w . z - threshold)` is the log odds of the score."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.deviation, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (self.raw(x) - self.threshold), -35, 35)))


def best_quantile(raw: np.ndarray, label: np.ndarray) -> float:
    """The quantile of the training scores that parts the labels with the fewest errors; of equally good ones the
    one in the widest gap between two scores."""
    order = np.argsort(raw, kind="stable")
    s, y = raw[order], label[order] == 1
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum(~y[::-1])[::-1], [0]])
    gap = np.diff(s, prepend=s[0] - 1e-9, append=s[-1] + 1e-9)
    k = np.lexsort((-gap, wrong))[0]
    return float(np.clip(k / len(s), 0, 1))


def fit_ranking(x: np.ndarray, label: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Ranking:
    """Bradley-Terry weights from labelled vectors."""
    width = x.shape[1]
    mean, deviation = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(width), np.ones(width))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranking(mean, deviation, np.zeros(width), 0.0, 1.0)
    z = np.clip((x - mean) / deviation, -8, 8)
    diff = pairs_of(z, label, PAIRS_PER_ROW * len(x))
    w = np.zeros(width)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -35, 35)))
        gradient = diff.T @ (p - 1) + ridge * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff + ridge * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    threshold = float(np.quantile(raw, best_quantile(raw, label), method="hazen"))
    return Ranking(mean, deviation, w, threshold, 1.0)


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Fit on all labelled documents outside the held-out third."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.ceil(F.avg("quality")).cast("int").alias("quality"))
    texts = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(features(batch.column(1))), pa.list_(pa.float64()))], ["doc_id", "x"])

    with scratch(docs.sparkSession):
        measured = texts.mapInArrow(run, "doc_id long, x array<double>").join(known, "doc_id")  # measures are shuffled, no texts
        return _fit(written(measured, "quality-rows"))


def _fit(rows: DataFrame) -> Ranking:
    """Bradley-Terry weights from (doc_id, x, quality), however many; fit_ranking does it with rows in memory."""
    width = N_KINDS * 2 + 15

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            x = _matrix(batch.column(0)) if batch.num_rows else np.zeros((0, width))
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s]), pa.array([q])], ["n", "s", "q"])

    parts = rows.select("x").mapInArrow(moments, "n long, s array<double>, q array<double>").toArrow()  # a row for each task
    counts = {r[0]: r[1] for r in rows.groupBy("quality").agg(F.count("*")).collect() if r[0] in (0, 1)}
    n = sum(parts.column("n").to_pylist())
    if not n:
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)
    mean = np.sum(parts.column("s").to_pylist(), axis=0) / n
    deviation = np.sqrt(np.maximum(np.sum(parts.column("q").to_pylist(), axis=0) / n - mean**2, 0)) + 1e-6
    if len(counts) < 2:
        return Ranking(mean, deviation, np.zeros(width), 0.0, 1.0)
    groups = max(1, n // GROUP_ROWS)
    apart = F.when(F.col("quality") == 1, min(groups, max(1, counts[1] // LEAST_OF_LABEL))).otherwise(min(groups, max(1, counts[0] // LEAST_OF_LABEL))).cast("long")
    numbered = shuffled(rows.where("quality in (0, 1)"), 7, "doc_id", by="quality").withColumn("_m", apart).withColumn("_at", F.col("seq") % F.col("_m"))
    dealt = numbered.withColumn("grp", F.explode(F.sequence(F.col("_at"), F.lit(groups - 1).cast("long"), F.col("_m"))))
    own = F.col("grp") == F.col("_at")  # elsewhere the row is only there for others' pairs
    dealt = written(dealt.select("grp", "quality", "seq", "doc_id", own.alias("own"), "x"), "quality-groups")
    w = np.zeros(width)
    for _ in range(25):

        def step_sums(table: pa.Table) -> pa.Table:  # with w as it is now
            order = np.lexsort((table.column("doc_id").to_numpy(), table.column("seq").to_numpy(), table.column("quality").to_numpy()))
            y = table.column("quality").to_numpy()[order]
            z = np.clip((_matrix(table.column("x"))[order] - mean) / deviation, -8, 8)
            diff = pairs_of(z, y, PAIRS_PER_ROW * int(np.count_nonzero(table.column("own").to_numpy())))
            p = 1 / (1 + np.exp(-np.clip(diff @ w, -35, 35)))
            return pa.table({"gradient": pa.array([diff.T @ (p - 1)]), "hessian": pa.array([((diff * (p * (1 - p))[:, None]).T @ diff).reshape(-1)])})

        sums = dealt.groupBy("grp").applyInArrow(step_sums, "gradient array<double>, hessian array<double>")
        total = dict(sums.select(F.posexplode(F.concat("gradient", "hessian")).alias("i", "v")).groupBy("i").agg(F.sum("v")).collect())  # width (width + 1) numbers
        flat = np.array([total[i] for i in range(width * (width + 1))])
        step = np.linalg.solve(flat[width:].reshape(width, width) + np.eye(width), flat[:width] + w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    ranking = Ranking(mean, deviation, w, 0.0, 1.0)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(ranking.raw(_matrix(batch.column(0)))), batch.column(1)], ["raw", "quality"])

    scores = rows.where("quality in (0, 1)").select("x", "quality").mapInArrow(raw, "raw double, quality int")
    return Ranking(mean, deviation, w, _threshold(written(scores, "quality-raw")), 1.0)


def pairs_of(z: np.ndarray, label: np.ndarray, pairs: int) -> np.ndarray:
    """Differences better - worse of so many pairs; every row is in some pair where there are as many pairs."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    rng = np.random.default_rng(7)
    better = np.resize(rng.permutation(good), pairs)
    worse = np.concatenate([np.resize(rng.permutation(bad), len(bad)), rng.choice(bad, max(0, pairs - len(bad)))])[:pairs]
    return z[better] - z[worse]


def _threshold(scores: DataFrame) -> float:
    """What best_quantile and its quantile give, from (raw, quality) of any number."""
    placed = quantile_buckets(scores, "raw", "b")
    buckets = sorted(placed.groupBy("b").agg(F.sum(F.expr("int(quality = 1)")), F.count("*"), F.min("raw"), F.max("raw")).collect())  # P.ID_BUCKETS rows
    bad = sum(r[2] - r[1] for r in buckets)
    before, good_so_far, bad_so_far = {}, 0, 0
    for i, r in enumerate(buckets):
        before[r[0]] = (good_so_far + bad - bad_so_far, r[3] - 1e-9 if not i else buckets[i - 1][4], i == len(buckets) - 1)
        good_so_far, bad_so_far = good_so_far + r[1], bad_so_far + r[2] - r[1]

    def best(table: pa.Table) -> pa.Table:
        wrong, left, last = before[table.column("b")[0].as_py()]
        order = np.argsort(table.column("raw").to_numpy(), kind="stable")
        s, y = table.column("raw").to_numpy()[order], table.column("quality").to_numpy()[order] == 1
        errors = wrong + np.concatenate([[0], np.cumsum(np.where(y, 1, -1))])  # with so many of these below
        low, high = np.concatenate([[left], s]), np.concatenate([s, [s[-1] + 1e-9]])
        end = len(s) + 1 if last else len(s)
        k = np.lexsort((-(high - low)[:end], errors[:end]))[0]
        return pa.table({"wrong": pa.array([int(errors[k])]), "gap": pa.array([float(high[k] - low[k])]), "low": pa.array([float(low[k])]), "high": pa.array([float(high[k])])})

    found = placed.groupBy("b").applyInArrow(best, "wrong long, gap double, low double, high double").collect()
    _, low, high = min(((r["wrong"], -r["gap"]), r["low"], r["high"]) for r in found)
    first, end = buckets[0][3], buckets[-1][4]
    return first if high <= first else end if low >= end else (low + high) / 2


def quality_scores(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """All other columns of `docs` without change, and quality_score and quality_predicted."""
    docs = docs.drop("quality_score", "quality_predicted")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = ranking.score(features(batch.column(names.index("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*names, "quality_score", "quality_predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("quality_predicted", T.IntegerType())]))


def accepted(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """Those rows of `docs`, all columns whatever their names, that the ranking puts at its threshold or above."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(ranking.score(features(batch.column(at))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op10_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    ranking = train(docs, table(spark, sf_dir, "labels"))
    scored = quality_scores(docs.select("doc_id", "text"), ranking)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
