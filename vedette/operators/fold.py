"""The ordered fold: one pass over a batch of points that builds its observers.

A point within the radius of its nearest observer (lowest number if tied) moves it: the centroid becomes the running
mean, the population grows by one and the radius shrinks by factor times the distance, not below zero. Another point
lets the nearest observer's radius grow by factor times the distance and becomes an observer with the initial radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vedette.session import ship

OBSERVERS = "oid int, o array<double>, population long, radius double"
#: Numbers of all observers up to which a point is compared with them directly; of distances that a block holds at most.
DIRECT = 4_096
BLOCK = 2_000_000


def slack(d: int, largest: float) -> float:
    """What the square of a distance and |x|^2 + |o|^2 - 2 x.o may differ by, twice over, where |x|^2 + |o|^2 <= largest."""
    return 8 * (d + 4) * float(np.finfo(float).eps) * largest


def squares(x: np.ndarray, refs: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
    """[points, refs]: squared distances by a matrix product, up to slack()."""
    out = x @ refs.T
    out *= -2
    out += np.einsum("ij,ij->i", x, x)[:, None]
    out += np.einsum("ij,ij->i", refs, refs) if norms is None else norms
    return out


class Fold:
    """The state of one batch; feed() takes points in order."""

    def __init__(self, radius: float, factor: float = 0.1, alpha: float = 1.0, observers: np.ndarray | None = None, population: np.ndarray | None = None, radii: np.ndarray | None = None) -> None:
        self.initial, self.factor, self.alpha = radius, factor, alpha
        self.k = 0 if observers is None else len(observers)
        self.o = np.zeros((16, 0)) if observers is None else np.array(observers, float)
        self.p = np.zeros(16, np.int64) if population is None else np.array(population, np.int64)
        self.r = np.zeros(16) if radii is None else np.array(radii, float)

    def _add(self, x: np.ndarray) -> None:
        if self.k == len(self.p) or self.o.shape[1] != len(x):
            size = max(16, 2 * self.k)
            o, p, r = np.zeros((size, len(x))), np.zeros(size, np.int64), np.zeros(size)
            if self.k:
                o[: self.k], p[: self.k], r[: self.k] = self.o[: self.k], self.p[: self.k], self.r[: self.k]
            self.o, self.p, self.r = o, p, r
        self.o[self.k], self.p[self.k], self.r[self.k] = x, 1, self.initial
        self.k += 1

    def feed(self, points: np.ndarray) -> Fold:
        at = 0
        while at < len(points):
            if self.k * points.shape[1] <= DIRECT:
                self._step(points[at])
                at += 1
            else:
                size = min(256, max(16, BLOCK // self.k))
                self._block(points[at : at + size])
                at += size
        return self

    def _step(self, x: np.ndarray, among: np.ndarray | None = None) -> int:
        """Takes one point, whose nearest observer is `among` these if given; which observer changed its place."""
        if not self.k:
            self._add(x)
            return 0
        gap = (self.o[: self.k] if among is None else self.o[among]) - x
        distances = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        i = int(distances.argmin())
        d = float(distances[i])
        i = i if among is None else int(among[i])
        if d <= self.r[i]:
            self.o[i] += self.alpha * (x - self.o[i]) / (self.p[i] + 1)
            self.p[i] += 1
            self.r[i] = max(0.0, self.r[i] - self.factor * d)
            return i
        self.r[i] = max(0.0, self.r[i] + self.factor * d)  # max(0, nan) is 0
        self._add(x)
        return self.k - 1

    def _block(self, x: np.ndarray) -> None:
        """The same for many observers: one matrix product tells which may be nearest to each point, and only these are
        compared with it. An observer that has changed is compared with the rest of the block anew."""
        k, d = self.k, x.shape[1]
        near = np.empty((len(x), k + len(x)))
        norms = np.einsum("ij,ij->i", self.o[:k], self.o[:k])
        near[:, :k] = squares(x, self.o[:k], norms)
        largest = float(np.einsum("ij,ij->i", x, x).max() + norms.max())
        for t in range(len(x)):
            row = near[t, : self.k]
            limit = float(row.min()) + slack(d, largest)
            i = self._step(x[t], np.flatnonzero(row <= limit) if np.isfinite(limit) else None)
            largest = max(largest, 2 * float(self.o[i] @ self.o[i]))
            gap = x[t + 1 :] - self.o[i]
            near[t + 1 :, i] = np.einsum("ij,ij->i", gap, gap)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.o[: self.k], self.p[: self.k], self.r[: self.k]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_groups(points: DataFrame, group: str, radius: float | DataFrame, factor: float = 0.1, alpha: float = 1.0) -> DataFrame:
    """(group, oid, o, population, radius): the fold over each group's points in order of `seq`.

    `radius`: one for all groups, or (group, radius) rows. Each group is one task's work and memory: `chunksize`
    is the lever, as it is in the model."""
    ship(points.sparkSession)
    kind = points.schema[group].dataType.simpleString()
    if isinstance(radius, DataFrame):
        rows = points.join(radius.select(group, F.col("radius").alias("_r")), group).select(group, "seq", "x", "_r")
    else:
        rows = points.select(group, "seq", "x", F.lit(float(radius)).alias("_r"))

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("seq").to_numpy(), kind="stable")
        x = _matrix(table.column("x"))[order]
        o, p, r = Fold(table.column("_r")[0].as_py(), factor, alpha).feed(x).rows()
        k = len(p)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, k * x.shape[1] + 1, max(1, x.shape[1]), dtype=np.int32)), pa.array(o.reshape(-1)))
        return pa.table({group: table.column(group).combine_chunks().take(pa.array(np.zeros(k, np.int64))), "oid": pa.array(np.arange(k, dtype=np.int32)), "o": flat, "population": pa.array(p), "radius": pa.array(r)})

    return rows.groupBy(group).applyInArrow(run, f"`{group}` {kind}, {OBSERVERS}")


def numbered(observers: DataFrame, batch: str = "batch") -> DataFrame:
    """Observers of all batches with oid counted on from batch to batch (batches are never merged)."""
    sizes = observers.groupBy(batch).agg(F.count("*").alias("_k"))
    before = sizes.select(batch, F.coalesce(F.sum("_k").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each batch
    return observers.join(before, batch).select(batch, (F.col("oid") + F.col("_before")).cast("int").alias("oid"), "o", "population", "radius")


def iterate(batches: Iterator[np.ndarray], radius: float, factor: float = 0.1) -> Fold:
    """The fold over a stream of matrices."""
    fold = Fold(radius, factor)
    for x in batches:
        fold.feed(x)
    return fold
