"""Reducers by class: each class is reduced to `size` rows of its own, all classes in the same passes.

A class is whatever `label` says; `sizes` are (label, no, n, size) rows, one for each class. Results are (oid, o, label)
with numbers that no two classes share. Apart from the fold and the neural gas, which are sequential by definition and so
one task's work for each class, no class has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vedette.functions.columns import uniform
from vedette.operators import points as P
from vedette.operators.fold import _matrix, fit_groups
from vedette.operators.knn import knn
from vedette.operators.radius import radius_by_group
from vedette.operators.reducers import SUM_ROWS, VariationalMixture, added, moments, neural_gas_nodes, one_hot, sum_rows
from vedette.operators.tasks import per_class_sizes, top_per_class
from vedette.session import scratch, ship, written

#: Numbers of one class are apart from the next one's by this.
APART = 1 << 40
#: Sums that classes are fitted with together at most (one class may have more): 8 bytes each, a few times at the driver.
AT_ONCE = 5_000_000


def class_sizes(df: DataFrame, rate: float, label: str = "label") -> DataFrame:
    """(label, no, n, size = max(int(n * rate / 100), 1))."""
    sizes = per_class_sizes(df, rate, label)
    return sizes.select(label, (F.row_number().over(Window.orderBy(label)) - 1).cast("int").alias("no"), "n", "size")  # a row for each class


def _oid(number: str) -> F.Column:
    return (F.col("no").cast("long") * F.lit(APART) + F.col(number)).cast("long").alias("oid")


def random_rows(df: DataFrame, sizes: DataFrame, seed: int, label: str = "label") -> DataFrame:
    """Draws with replacement: each class's draw j takes the row at the j-th seeded uniform number of its seeded order."""
    drawn = sizes.select(label, "no", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("draw"))
    drawn = drawn.withColumn("seq", F.least(F.floor(uniform(seed, F.concat_ws("|", F.col(label).cast("string"), "draw")) * F.col("n")).cast("long"), F.col("n") - 1))
    rows = P.shuffled(df.select("id", "x", label), seed, by=label)
    return drawn.join(rows, [label, "seq"]).select(_oid("draw"), F.col("x").alias("o"), label)


def observers(df: DataFrame, sizes: DataFrame, seed: int, label: str = "label", radius: float | DataFrame | None = None, factor: float = 0.1) -> DataFrame:
    """Observers of each class by its own fold: the most populous `size`, filled up with seeded rows of the class where
    the fold made fewer."""
    start = radius_by_group(df, label, 0.05, seed) if radius is None else radius
    folded = written(fit_groups(P.in_order(df.select("id", "x", label)), label, start, factor), "class-observers")
    kept = top_per_class(folded, sizes, label).join(sizes.select(label, "no"), label).select(_oid("oid"), "o", label)
    have = folded.groupBy(label).agg(F.count("*").alias("k"))
    short = sizes.join(have, label).where("k < size").select(F.col(label).alias("_label"), "no", "k", "size")
    extra = P.shuffled(df.select("id", "x", label), seed, by=label).join(F.broadcast(short), F.col(label) == F.col("_label")).where("seq < size - k")  # a row for each class
    return kept.unionByName(extra.select((F.col("no").cast("long") * F.lit(APART) + F.col("k") + F.col("seq")).alias("oid"), F.col("x").alias("o"), label))


def sparse_observers(df: DataFrame, sizes: DataFrame, seed: int, label: str = "label", x: int = 6, qv: float = 0.3) -> DataFrame:
    """Sparse data observers of each class: drawn rows, without those that few rows of the class observe."""
    drawn = written(random_rows(df, sizes, seed, label).join(sizes.select(label, "no"), label), "class-sdo")
    rows = df.select("id", "x", label).join(F.broadcast(sizes.select(label, "no")), label).select("id", "x", "no")
    hits = knn(rows, drawn, x, by="no").select(F.explode("nn.oid").alias("oid")).groupBy("oid").agg(F.count("*").alias("n"))
    counted = written(drawn.join(hits, "oid", "left").select("oid", "o", label, F.coalesce("n", F.lit(0)).alias("n")), "class-sdo")
    limits = counted.groupBy(label).agg(F.percentile("n", F.lit(qv)).alias("limit"))  # of a class's observers
    return counted.join(F.broadcast(limits), label).where("n >= limit").select("oid", "o", label)


class _Sums:
    """Passes over the rows that sum up, for each centre of each class, shares, shares times x and, if asked, times x x'."""

    def __init__(self, df: DataFrame, sizes: DataFrame, label: str) -> None:
        ship(df.sparkSession)
        classes = sizes.orderBy("no").collect()  # a row for each class
        self.labels, self.k = [r[label] for r in classes], np.array([r["size"] for r in classes], np.int64)
        self.head = np.concatenate([[0], np.cumsum(self.k)])
        self.rows = df.select("id", "x", label).join(F.broadcast(sizes.select(label, "no")), label).select("id", "no", "x")
        first = df.select("x").first()
        self.d = len(first[0]) if first else 0

    def pass_over(self, assign: Callable[[int, np.ndarray], np.ndarray], second: bool = False) -> tuple[np.ndarray, ...]:
        total, d, head = int(self.head[-1]), self.d, self.head
        width = 1 + d + d * d * second

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((total, width))
            for batch in batches:
                no, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                for c in np.unique(no).tolist():
                    mine = x[no == c]
                    moments(sums[head[c] : head[c + 1]], mine, assign(c, mine), second)
            yield sum_rows(sums)

        out = added(self.rows.select("no", "x").mapInArrow(run, SUM_ROWS), total, width)
        return (out[:, 0], out[:, 1 : 1 + d], out[:, 1 + d :].reshape(total, d, d)) if second else (out[:, 0], out[:, 1:])

    def seeds(self, sizes: DataFrame, seed: int, label: str, df: DataFrame) -> np.ndarray:
        """The first `size` rows of each class's seeded order."""
        ranked = P.shuffled(df.select("id", "x", label), seed, by=label).join(F.broadcast(sizes.select(F.col(label).alias("_l"), "no", "size")), F.col(label) == F.col("_l")).where("seq < size")
        rows = sorted(ranked.select("no", "seq", "x").collect())  # the centres
        return np.array([r[2] for r in rows], float).reshape(-1, self.d)

    def table(self, df: DataFrame, centres: np.ndarray, label: str) -> DataFrame:
        no = np.repeat(np.arange(len(self.k)), self.k)
        rows = [(int(c) * APART + int(i - self.head[c]), centres[i].tolist(), self.labels[c]) for i, c in enumerate(no)]
        return df.sparkSession.createDataFrame(rows, f"oid long, o array<double>, `{label}` {df.schema[label].dataType.simpleString()}")


def _nearest(centres: np.ndarray, head: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    return lambda c, x: one_hot(x, centres[head[c] : head[c + 1]], np.ones(len(x)))


def kmeans(df: DataFrame, sizes: DataFrame, seed: int, label: str = "label", steps: int = 20) -> DataFrame:
    """Centres of each class by Lloyd's algorithm from seeded rows: one pass a step for all classes."""
    sums = _Sums(df, sizes, label)
    centres = sums.seeds(sizes, seed, label, df)
    for _ in range(steps):
        n, total = sums.pass_over(_nearest(centres, sums.head))
        moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return sums.table(df, centres, label)


def mixture(df: DataFrame, sizes: DataFrame, seed: int, label: str = "label", steps: int = 20, tolerance: float = 1e-3) -> DataFrame:
    """Component means of a variational Gaussian mixture of each class; starts with Lloyd steps. A round is one pass for as
    many classes as have AT_ONCE sums."""
    with scratch(df.sparkSession):
        rows = written(df.select("id", "x", label), "class-rows")
        first = rows.select("x").first()
        width = 1 + len(first[0]) + len(first[0]) ** 2 if first else 1
        groups, left = [], 0
        for r in sizes.orderBy("no").collect():  # a row for each class
            left -= r["size"] * width
            if left < 0:
                groups, left = [*groups, []], AT_ONCE - r["size"] * width
            groups[-1].append(r)
        found = []
        for group in groups:
            mine = df.sparkSession.createDataFrame([(r[label], i, r["n"], r["size"]) for i, r in enumerate(group)], sizes.schema)
            some = rows.join(F.broadcast(mine.select(F.col(label).alias("_l"))), F.col(label) == F.col("_l")).drop("_l")
            found += [(r["no"] * APART + i, m, r[label]) for r, means in zip(group, _mixture(some, mine, seed, label, steps, tolerance), strict=True) for i, m in enumerate(means)]
    return df.sparkSession.createDataFrame(found, f"oid long, o array<double>, `{label}` {df.schema[label].dataType.simpleString()}")


def _mixture(df: DataFrame, sizes: DataFrame, seed: int, label: str, steps: int, tolerance: float) -> list[list[list[float]]]:
    """The means of each class, in order of `no`."""
    sums = _Sums(df, sizes, label)
    centres, head = sums.seeds(sizes, seed, label, df), sums.head
    for _ in range(3):
        n, total = sums.pass_over(_nearest(centres, head))
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    n, first, second = sums.pass_over(_nearest(centres, head), second=True)
    parts = [slice(head[c], head[c + 1]) for c in range(len(sums.k))]
    mixtures = []
    for s in parts:
        mean = first[s].sum(axis=0) / n[s].sum()
        covariance = second[s].sum(axis=0) / n[s].sum() - np.outer(mean, mean) + 1e-6 * np.eye(sums.d)
        mixtures.append(VariationalMixture(mean, covariance, s.stop - s.start))
        mixtures[-1].update(n[s], first[s], second[s])
    for _ in range(steps):
        before = [m.means for m in mixtures]
        n, first, second = sums.pass_over(lambda c, x: mixtures[c].responsibilities(x, np.ones(len(x))), second=True)
        for m, s in zip(mixtures, parts, strict=True):
            m.update(n[s], first[s], second[s])
        if all(np.abs(m.means - b).max() <= tolerance * np.sqrt(np.diag(m.prior_covariance)).max() for m, b in zip(mixtures, before, strict=True)):
            break
    return [m.means.tolist() for m in mixtures]


def neural_gas(df: DataFrame, sizes: DataFrame, seed: int, label: str = "label", epochs: int = 40) -> DataFrame:
    """Nodes of a growing neural gas of each class, two at least."""
    rows = df.select("id", "x", label).join(F.broadcast(sizes), label)
    nodes = neural_gas_nodes(rows, "size", seed, "no", epochs).withColumnRenamed("grp", "no")
    return nodes.join(F.broadcast(sizes.select(label, "no")), "no").select(_oid("oid"), "o", label)


#: By short names: (points with label, sizes, seed) -> (oid, o, label).
BY_CLASS: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {"OBS": observers, "RS": random_rows, "SDO": sparse_observers, "KMC": kmeans, "WGM": mixture, "GNG": neural_gas}
