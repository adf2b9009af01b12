"""Nearest neighbours of points among reference vectors.

The references go to the executors in blocks of BLOCK_BYTES at most, however many they are; points stream past each
block once and carry their best k so far, so no pair becomes a row and nothing is shuffled, but for points that few files
hold, which are dealt over all cores first (spread). Within a block a matrix product, or boxes where there are few
dimensions, tells which references may be among the k nearest; only their distances are worked out, from the
differences, so the result is that of comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vedette.functions.columns import METRICS
from vedette.functions.columns import distance as distance_column
from vedette.operators.fold import _matrix, slack, squares
from vedette.session import ship, spread

BLOCK_BYTES = 64_000_000
#: Pairs that are looked at together at most; dimensions up to which boxes serve, and rows in a box.
PAIRS = 2_000_000
BOX_DIMENSIONS = 4
BOX = 64
#: References and points that one product in single precision compares: a table that stays in the cache.
TILE = 2_048
TILE_ROWS = 256
#: Rows and bytes of batches that are searched together at most: the more points, the smaller their boxes.
TOGETHER = 40_000, 4_000_000


def distances(x: np.ndarray, refs: np.ndarray, metric: str, p: float) -> np.ndarray:
    """[points, refs], each exact from the differences (no expansion of the square, so ties stay ties)."""
    out = np.empty((len(x), len(refs)))
    for i in range(len(x)):
        gap = refs - x[i]
        if metric == "euclidean":
            out[i] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        elif metric == "cityblock":
            out[i] = np.abs(gap).sum(axis=1)
        elif metric == "chebyshev":
            out[i] = np.abs(gap).max(axis=1, initial=0)
        else:
            out[i] = (np.abs(gap) ** p).sum(axis=1) ** (1 / p)
    return out


def _gaps(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """[points, refs]: squared distances from the differences, up to the order of the sum."""
    out = np.zeros((len(x), len(refs)))
    for j in range(x.shape[1]):
        gap = x[:, j, None] - refs[:, j]
        gap *= gap
        out += gap
    return out


def _boxes(x: np.ndarray) -> list[np.ndarray]:
    """Row numbers in groups of BOX at most that lie together: halved at the median of the widest dimension."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= BOX:
            out.append(rows)
            continue
        mine = x[rows]
        order = np.argpartition(mine[:, int(np.argmax(mine.max(axis=0) - mine.min(axis=0)))], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


class Search:
    """References of one block, ready to be searched."""

    def __init__(self, ids: np.ndarray, refs: np.ndarray, metric: str, p: float) -> None:
        self.ids, self.refs, self.metric, self.p = ids, refs, metric, p
        self.norms = np.einsum("ij,ij->i", refs, refs) if metric == "euclidean" else None
        self.boxes = self.narrow = None
        if metric != "euclidean" or not refs.size or not np.isfinite(self.norms).all():
            return
        if refs.shape[1] <= BOX_DIMENSIONS and len(refs) > 8 * BOX:
            self.boxes = _boxes(refs)
            self.sizes = np.array([len(b) for b in self.boxes])
            self.low = np.array([refs[b].min(axis=0) for b in self.boxes])
            self.high = np.array([refs[b].max(axis=0) for b in self.boxes])
        self.centre = refs.mean(axis=0)
        apart = refs - self.centre
        own = np.einsum("ij,ij->i", apart, apart)
        self.largest = float(own.max())
        if self.largest < 1e30:
            self.narrow = np.concatenate([-2 * apart, own[:, None]], axis=1).astype(np.float32)

    def best(self, x: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances, numbers), [points, min(k, references)], by (distance, number). Where a distance is above the
        point's bound, another may stand there that is above it too, or infinity."""
        keep = min(k, len(self.refs))
        d, o = np.full((len(x), keep), np.inf), np.full((len(x), keep), -1, np.int64)
        if self.boxes is not None and len(x) and np.isfinite(x).all():
            for rows in _boxes(x):
                self._in_boxes(x, rows, keep, bound, d, o)
            return d, o
        step = max(1, PAIRS // max(1, len(self.refs))) if self.narrow is None else max(TILE_ROWS, TILE * TILE_ROWS // len(self.refs))
        for lo in range(0, len(x), step):
            self._in_all(x[lo : lo + step], keep, bound[lo : lo + step], d[lo : lo + step], o[lo : lo + step])
        return d, o

    def _in_boxes(self, x: np.ndarray, rows: np.ndarray, keep: int, bound: np.ndarray, d: np.ndarray, o: np.ndarray) -> None:
        mine = x[rows]
        apart = np.maximum(0, np.maximum(self.low - mine.max(axis=0), mine.min(axis=0) - self.high))
        least = np.sqrt(np.einsum("ij,ij->i", apart, apart))
        order = np.argsort(least, kind="stable")
        first = order[: int(np.searchsorted(np.cumsum(self.sizes[order]), max(2 * keep, 4 * BOX))) + 1]
        among = np.concatenate([self.boxes[b] for b in first])
        gaps = _gaps(mine, self.refs[among])
        edge = np.sqrt(np.partition(gaps, keep - 1, axis=1)[:, keep - 1]) * (1 + 1e-12)
        reach = float(np.minimum(edge, bound[rows]).max()) * (1 + 1e-12)
        among = np.concatenate([self.boxes[b] for b in order[: int(np.searchsorted(least[order], reach, "right"))]] or [among])
        step = max(1, PAIRS // len(among))
        for lo in range(0, len(rows), step):
            part = _gaps(mine[lo : lo + step], self.refs[among])
            last = min(keep, len(among)) - 1
            at, col = np.divmod(np.flatnonzero(part <= (np.partition(part, last, axis=1)[:, last] * (1 + 1e-12))[:, None]), len(among))
            found = self._exact(mine[lo : lo + step], at, among[col])
            _place(at, found, self.ids[among[col]], rows[lo : lo + step], d, o)

    def _exact(self, x: np.ndarray, at: np.ndarray, col: np.ndarray) -> np.ndarray:
        """The distances of these pairs, from the differences."""
        found = np.empty(len(at))
        for lo in range(0, len(at), PAIRS // 16):
            gap = self.refs[col[lo : lo + PAIRS // 16]] - x[at[lo : lo + PAIRS // 16]]
            found[lo : lo + PAIRS // 16] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        return found

    def _among(self, x: np.ndarray, keep: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs (point, reference) that hold the k nearest of each point within its bound, from products in single
        precision, tile by tile; None where that leaves too much in doubt."""
        apart = x - self.centre
        own = np.einsum("ij,ij->i", apart, apart)
        most, far = float(own.max(initial=0)) + self.largest, float(np.einsum("ij,ij->i", x, x).max(initial=0) + self.norms.max())
        if not most < 1e30:  # NaN too
            return None
        more = slack(x.shape[1] + 1, 2 * most) * float(np.finfo(np.float32).eps / np.finfo(float).eps) + slack(x.shape[1], 2 * far)
        wide = np.concatenate([apart, np.ones((len(x), 1))], axis=1).astype(np.float32)
        limit = (bound * bound - own + more).astype(np.float32)
        best = np.full((len(x), keep), np.inf, np.float32)
        ats, cols, values, total = [], [], [], 0
        for lo in range(0, len(self.refs), TILE):
            near = wide @ self.narrow[lo : lo + TILE].T
            least = near.min(axis=1)[:, None] if keep == 1 else near
            while least.shape[1] % 2 == 0 and least.shape[1] >= 64 + 8 * keep:  # the least of groups of references
                half = least.shape[1] // 2
                least = np.minimum(least[:, :half], least[:, half:])
            best = np.partition(np.concatenate([best, least], axis=1), keep - 1, axis=1)[:, :keep]
            limit = np.minimum(limit, best[:, keep - 1] + np.float32(more))
            found = np.flatnonzero(near <= limit[:, None])
            total += len(found)
            if total > PAIRS // 2 and total > len(x) * (lo + TILE) // 8:
                return None
            at, col = np.divmod(found, near.shape[1])
            ats.append(at)
            cols.append(col + lo)
            values.append(near.reshape(-1)[found])
        at, col = np.concatenate(ats), np.concatenate(cols)
        some = np.concatenate(values) <= limit[at]
        return at[some], col[some]

    def _in_all(self, x: np.ndarray, keep: int, bound: np.ndarray, d: np.ndarray, o: np.ndarray) -> None:
        pairs = None if self.narrow is None else self._among(x, keep, bound)
        if pairs is not None:
            at, col = pairs
            _place(at, self._exact(x, at, col), self.ids[col], np.arange(len(x)), d, o)
            return
        near = None
        if self.metric == "euclidean":
            near = squares(x, self.refs, self.norms)
            more = slack(x.shape[1], float(np.einsum("ij,ij->i", x, x).max(initial=0) + self.norms.max(initial=0)))
            near = near if np.isfinite(near).all() and np.isfinite(more) else None
        exact = near is None
        if exact:
            near, more = distances(x, self.refs, self.metric, self.p), 0.0
        edge = np.minimum((near.min(axis=1) if keep == 1 else np.partition(near, keep - 1, axis=1)[:, keep - 1]) + more, bound if exact else bound * bound + more)
        at, col = np.nonzero(near <= edge[:, None]) if not exact else np.nonzero(~(near > edge[:, None]))
        _place(at, near[at, col] if exact else self._exact(x, at, col), self.ids[col], np.arange(len(x)), d, o)


def _place(at: np.ndarray, found: np.ndarray, ids: np.ndarray, rows: np.ndarray, d: np.ndarray, o: np.ndarray) -> None:
    """Puts the first candidates of each point, in order, into its row of d and o."""
    order = np.lexsort((ids, found, at))
    at = at[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at, "left")
    first = rank < d.shape[1]
    at, rank, order = rows[at[first]], rank[first], order[first]
    d[at, rank], o[at, rank] = found[order], ids[order]


def _blocks(refs: DataFrame, oid: str, vector: str, by: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (numbers, vectors, groups) of references in order of oid; the driver holds one at a time. Executors pack
    each batch of rows into the bytes of its arrays."""
    ship(refs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [batch.column(0).to_numpy().astype(np.int64), _matrix(batch.column(1)), batch.column(2).to_numpy().astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary()) for r in rows], ["ids", "rows", "groups"])

    parts, size = [], 0
    cut = lambda: tuple(np.concatenate(p) for p in zip(*parts, strict=True))
    packed = refs.select(oid, vector, F.col(by) if by else F.lit(0)).orderBy(oid).mapInArrow(pack, "ids binary, rows binary, groups binary")
    for r in packed.toLocalIterator(prefetchPartitions=True):
        ids, groups = np.frombuffer(r[0], np.int64), np.frombuffer(r[2], np.int64)
        rows = np.frombuffer(r[1]).reshape(len(ids), -1)
        step = max(1, BLOCK_BYTES // (8 * rows.shape[1] + 16))
        for lo in range(0, len(ids), step):
            some = slice(lo, lo + step)
            if parts and size + rows[some].nbytes + 16 * len(ids[some]) > BLOCK_BYTES:
                yield cut()
                parts, size = [], 0
            parts.append((ids[some], rows[some], groups[some]))
            size += rows[some].nbytes + 16 * len(ids[some])
    if parts:
        yield cut()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in fewer batches, none of them empty."""
    held: list[pa.RecordBatch] = []
    join = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and (sum(b.num_rows for b in held) + batch.num_rows > TOGETHER[0] or sum(b.nbytes for b in held) + batch.nbytes > TOGETHER[1]):
            yield join()
            held = []
        held.append(batch)
    if held:
        yield join()


def knn(points: DataFrame, refs: DataFrame, k: int, metric: str = "euclidean", p: float = 3.0, oid: str = "oid", vector: str = "o", x: str = "x", by: str | None = None) -> DataFrame:
    """`points` with nn: array<struct<d double, oid long>>, the k nearest references by (distance, oid); all of them
    where there are fewer. With `by`, a whole-number column of both, among the references of the same group."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}, not {metric!r}")
    spark = points.sparkSession
    ship(spark)
    out = spread(points).withColumn("nn", F.array().cast("array<struct<d: double, oid: bigint>>"))
    names, schema = out.columns, out.schema
    at, nn, group = names.index(x), names.index("nn"), names.index(by) if by else -1
    for block in _blocks(refs, oid, vector, by):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix, groups = shared.value
            parts = {int(g): Search(ids[groups == g], matrix[groups == g], metric, p) for g in (np.unique(groups) if by else [0])}
            for batch in _together(batches):
                n = batch.num_rows
                old = batch.column(nn)
                had = len(old.flatten()) // n
                old_d, old_o = old.flatten().field("d").to_numpy().reshape(n, had), old.flatten().field("oid").to_numpy().reshape(n, had)
                bound = old_d[:, k - 1] if had >= k else np.full(n, np.inf)
                x = _matrix(batch.column(at))
                new_d, new_o = np.full((n, min(k, len(ids))), np.inf), np.full((n, min(k, len(ids))), -1, np.int64)
                of = batch.column(group).to_numpy() if by else np.zeros(n, np.int64)
                for g in np.unique(of).tolist():
                    if g in parts:
                        mine = np.flatnonzero(of == g)
                        d, o = parts[g].best(x[mine], k, bound[mine])
                        new_d[mine, : d.shape[1]], new_o[mine, : d.shape[1]] = d, o
                d, o = (np.concatenate([old_d, new_d], axis=1), np.concatenate([old_o, new_o], axis=1)) if had else (new_d, new_o)
                keep = min(k, d.shape[1])
                order = np.lexsort((o, d), axis=1)[:, :keep]
                flat = pa.StructArray.from_arrays([pa.array(np.take_along_axis(d, order, 1).reshape(-1)), pa.array(np.take_along_axis(o, order, 1).reshape(-1))], ["d", "oid"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * keep + 1, max(1, keep), dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([lists if i == nn else batch.column(i) for i in range(len(names))], names)

        out = out.mapInArrow(run, schema)
    return out.withColumn("nn", F.filter("nn", lambda e: e["d"] < float("inf"))) if by else out


def knn_sql(points: DataFrame, refs: DataFrame, k: int, metric: str = "euclidean", p: float = 3.0, id: str = "id") -> DataFrame:
    """The same as rows (id, d, oid, rank) in plain DataFrame operations, for few references and as a check of knn()."""
    pairs = points.select(id, "x").crossJoin(F.broadcast(refs.select(F.col("oid").cast("long").alias("oid"), "o")))
    ranked = pairs.select(id, distance_column("x", "o", metric, p).alias("d"), "oid")
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(id).orderBy("d", "oid"))).where(F.col("rank") <= k)


MODES = ("median", "mean", "max", "min", "sum")


def reduce_distances(nn: Column | str, mode: str = "median") -> Column:
    """One number from the distances of a knn() result, nearest first."""
    d = F.transform(nn, lambda e: e["d"])
    n = F.size(d)
    total = F.aggregate(d, F.lit(0.0), lambda s, v: s + v)
    if mode == "sum":
        return total
    if mode == "mean":
        return total / n
    if mode == "min":
        return F.element_at(d, 1)
    if mode == "max":
        return F.element_at(d, -1)
    if mode != "median":
        raise ValueError(f"mode is one of {MODES}, not {mode!r}")
    return (F.element_at(d, F.floor((n + 1) / 2).cast("int")) + F.element_at(d, F.floor((n + 2) / 2).cast("int"))) / 2


def nearest(points: DataFrame, refs: DataFrame, metric: str = "euclidean", oid: str = "oid", vector: str = "o") -> DataFrame:
    """`points` with oid and distance of the nearest reference, lowest oid if tied."""
    found = knn(points, refs, 1, metric, oid=oid, vector=vector)
    return found.withColumns({"nearest": F.element_at("nn", 1)["oid"], "distance": F.element_at("nn", 1)["d"]}).drop("nn")
