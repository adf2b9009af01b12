"""Reducers: ways to replace a dataset by few rows, apart from the fold.

Weighted coresets (uniform, lightweight, sensitivity) by importance sampling, sparse data observers, and the
clustering-based ones (k-means, Gaussian mixture, growing neural gas, condensed nearest neighbour).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vedette.functions.columns import METRICS, distance, uniform, vector_sum
from vedette.operators import points as P
from vedette.operators.fold import _matrix, slack
from vedette.operators.knn import Search, _blocks, knn, reduce_distances
from vedette.operators.model import flag_outliers
from vedette.session import drop, scratch, ship, spread, written


def _weighted(df: DataFrame) -> DataFrame:
    return df if "w" in df.columns else df.withColumn("w", F.lit(1.0))


def uniform_p(df: DataFrame) -> DataFrame:
    """`df` with p = w / sum(w); equal weights where there is no w."""
    df = _weighted(df)
    return df.crossJoin(F.broadcast(df.agg(F.sum("w").alias("_sum")))).withColumn("p", F.col("w") / F.col("_sum")).drop("_sum")


def lightweight_p(df: DataFrame) -> DataFrame:
    """`df` with p: half from the weight, half from the squared distance of the weighted row to the weighted mean."""
    df = _weighted(df)
    dims = df.select("w", F.posexplode("x").alias("dim", "v")).groupBy("dim").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
    mean = dims.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda e: e["v"]).alias("_mean"))
    gap = F.zip_with("x", "_mean", lambda x, m: F.col("w") * x - m)
    q = df.crossJoin(F.broadcast(mean)).withColumn("_q", F.col("w") * vector_sum(F.transform(gap, lambda g: g * g))).drop("_mean")
    sums = q.agg(F.sum("_q").alias("_sq"), F.sum("w").alias("_sw"))
    raw = F.when(F.col("_sq") > 0, 0.5 * F.col("_q") / F.col("_sq") + 0.5 / F.col("_sw")).otherwise(1.0 / F.col("_sw"))
    q = q.crossJoin(F.broadcast(sums)).withColumn("_raw", raw)
    return q.crossJoin(F.broadcast(q.agg(F.sum("_raw").alias("_sr")))).withColumn("p", F.col("_raw") / F.col("_sr")).drop("_q", "_sq", "_sw", "_raw", "_sr")


def kmeans_seeds(df: DataFrame, k: int, seed: int) -> DataFrame:
    """(oid, o): k-means++ seeds of rows weighted by w (equal without). Each is drawn in one pass by the smallest
    -log(u) / (w d2), d2 the squared distance to the seeds so far (an exponential race), so no running sum over all rows
    is needed; the first by -log(u) / w. Rows of no weight are never drawn."""
    df = _weighted(df).where("w > 0")
    u = uniform(seed, F.concat_ws("|", F.lit("seed0"), "id")) + F.lit(2.0**-53)
    first = df.select((-F.log(u) / F.col("w")).alias("_e"), "id", "x").orderBy("_e", "id").first()
    seeds = [first["x"]] if first else []
    if not seeds:
        return df.sparkSession.createDataFrame([], "oid long, o array<double>")
    for i in range(1, k):
        known = F.array(*(F.array(*(F.lit(v) for v in s)) for s in seeds))
        d2 = F.array_min(F.transform(known, lambda s: F.pow(distance("x", s), F.lit(2.0))))
        u = uniform(seed, F.concat_ws("|", F.lit(f"seed{i}"), "id")) + F.lit(2.0**-53)
        race = df.withColumn("_d2", d2).where("_d2 > 0").withColumn("_e", -F.log(u) / (F.col("w") * F.col("_d2")))
        found = race.orderBy("_e", "id").select("x").first()
        if found is None:
            break
        seeds.append(found[0])
    return df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(seeds)], "oid long, o array<double>")


def sensitivity_p(df: DataFrame, seeds: DataFrame, alpha: float | None = None) -> DataFrame:
    """`df` with p from upper bounds of the k-means sensitivity, given seeds (oid, o).

    s(x) = 2 a d2(x) / c + 4 a D(cluster) / (n(cluster) c) + 4 n / n(cluster), c the mean cost, a = max(ln k, 1)."""
    k = seeds.count()
    a = max(math.log(k), 1.0) if alpha is None else alpha
    near = knn(_weighted(df), seeds, 1).withColumns({"_c": F.element_at("nn", 1)["oid"], "_d2": F.pow(F.element_at("nn", 1)["d"], F.lit(2.0))}).drop("nn")
    clusters = near.groupBy("_c").agg(F.sum(F.col("w") * F.col("_d2")).alias("_dc"), F.sum("w").alias("_nc"))  # k rows
    totals = clusters.agg(F.sum("_dc").alias("_d"), F.sum("_nc").alias("_n"))
    x = near.join(clusters, "_c").crossJoin(F.broadcast(totals))
    mean = F.col("_d") / F.col("_n")
    cost = F.when(mean > 0, 2 * a * F.col("_d2") / mean + 4 * a * F.col("_dc") / (F.col("_nc") * mean)).otherwise(F.lit(0.0))
    x = x.withColumn("_s", F.col("w") * (cost + 4 * F.col("_n") / F.col("_nc")))
    return x.crossJoin(F.broadcast(x.agg(F.sum("_s").alias("_ss")))).withColumn("p", F.col("_s") / F.col("_ss")).drop("_c", "_d2", "_dc", "_nc", "_d", "_n", "_s", "_ss")


def draws(df: DataFrame, size: int, seed: int, p: str | None = "p") -> DataFrame:
    """`size` draws with replacement: (draw, id, x, p). With p None all rows are equally likely.

    Rows stand on [0, 1) side by side; a row's place is the sum before its bucket of ids (P.ID_BUCKETS sums) plus the
    sum before it in the bucket. Draws find their bucket by binary search and their row by a join in the bucket."""
    rows = df.select("id", "x", F.col(p).alias("p")) if p else df.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n")))).select("id", "x", (1.0 / F.col("_n")).alias("p"))
    rows = P.quantile_buckets(rows, "id", "b")
    sums = dict(rows.groupBy("b").agg(F.sum("p")).collect())  # P.ID_BUCKETS rows
    keys = sorted(sums)
    if not keys:
        return df.sparkSession.createDataFrame([], "draw long, id long, x array<double>, p double")
    edges = np.concatenate([[0.0], np.cumsum([sums[b] for b in keys])])
    edges[-1] = np.inf
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = batch.column(1).to_numpy()
            at = np.searchsorted(edges, u, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(u - edges[at]), pa.array(np.array(keys, np.int32)[at])], ["draw", "v", "b"])

    ship(spark)
    drawn = spark.range(size).select(F.col("id").alias("draw"), uniform(seed, "id").alias("u")).mapInArrow(run, "draw long, v double, b int")
    w = Window.partitionBy("b").orderBy("id")
    placed = rows.withColumns({"lo": F.coalesce(F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "next": F.lead("id").over(w)})
    placed = placed.withColumn("hi", F.when(F.col("next").isNull(), F.lit(float("inf"))).otherwise(F.col("lo") + F.col("p")))
    return drawn.join(placed, (drawn.b == placed.b) & (F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi"))).select("draw", "id", "x", "p")


def coreset(df: DataFrame, size: int, seed: int) -> DataFrame:
    """Weighted coreset from rows with p: (draw, id, x, weight = 1 / (size p))."""
    return draws(df, size, seed).withColumn("weight", 1.0 / (F.lit(float(size)) * F.col("p"))).drop("p")


def pca_size(df: DataFrame) -> int:
    """Number of observers from the greatest variance along any direction (sample covariance), 1 % error, 95 % sure."""
    first = df.select("x").first()
    if first is None:
        return 0
    d = len(first[0])
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch.column(0)) - origin
            n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s]), pa.array([q.reshape(-1)])], ["n", "s", "q"])

    origin = np.array(first[0])
    parts = df.select("x").mapInArrow(run, "n long, s array<double>, q array<double>").toArrow()  # one row for each task
    n = int(np.sum(parts.column("n").to_numpy()))
    s, q = np.sum(parts.column("s").to_pylist(), axis=0), np.sum(parts.column("q").to_pylist(), axis=0).reshape(d, d)
    covariance = (q - np.outer(s, s) / n) / max(1, n - 1)
    return sdo_size(n, float(np.linalg.eigvalsh(covariance)[-1]))


def sdo_size(n: int, top_variance: float) -> int:
    z, var, err = 1.96, max(1.0, top_variance), 0.01 * top_variance
    return int((n * z**2 * var) // ((n - 1) * err + z**2 * var))


def snapped(df: DataFrame, k: int) -> DataFrame:
    """Distinct (id, x): each dimension snapped to the centre of one of round(20 log10 k) bins; flat ones stay.

    id is the smallest of the rows that snap together."""
    bins = float(round(20 * math.log10(k)))
    dims = df.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    box = dims.agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "hi"))).alias("_box"))
    centre = lambda v, e: F.when(e["hi"] > e["lo"], (F.floor((v - e["lo"]) / ((e["hi"] - e["lo"]) / bins)) + 0.5) * ((e["hi"] - e["lo"]) / bins) + e["lo"]).otherwise(v)
    return df.crossJoin(F.broadcast(box)).select("id", F.zip_with("x", "_box", centre).alias("x")).groupBy("x").agg(F.min("id").alias("id")).select("id", "x")


@dataclass(frozen=True)
class SDO:
    """Sparse data observers: k rows drawn as observers, of which those that many points are near stay.

    k: how many, or None for pca_size(). qv: quantile of the observations below which an observer is idle; q: a
    fixed number instead. x: neighbours that a point observes. hbs: draw from snapped rows. observers: ready ones
    (oid, o) instead of drawn ones."""

    k: int | None = None
    q: float | None = None
    qv: float = 0.3
    x: int = 6
    hbs: bool = False
    return_scores: bool = False
    contamination: float = 0.1
    metric: str = "euclidean"
    seed: int = 0
    observers: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(f"metric is one of {METRICS}")

    def get_params(self) -> dict[str, object]:
        return {k: v for k, v in asdict(self).items() if k != "observers"} if self.observers is None else {f: getattr(self, f) for f in self.__dataclass_fields__ if f != "observers"}

    def drawn(self, df: DataFrame) -> DataFrame:
        """(oid, o): the rows drawn, with replacement."""
        if self.observers is not None:
            return self.observers
        k = self.k or pca_size(df)
        source = snapped(df, k) if self.hbs else df
        return draws(source.select("id", "x"), k, self.seed, None).select(F.col("draw").alias("oid"), F.col("x").alias("o"))

    def counts(self, df: DataFrame, observers: DataFrame) -> DataFrame:
        """(oid, o, n): how many points have each observer among their x nearest."""
        hits = knn(df.select("id", "x"), observers, self.x, self.metric).select(F.explode("nn.oid").alias("oid")).groupBy("oid").agg(F.count("*").alias("n"))
        return observers.join(hits, "oid", "left").select("oid", "o", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    def active(self, counts: DataFrame) -> DataFrame:
        """Those with at least the idle threshold."""
        if self.q is not None:
            return counts.where(F.col("n") >= self.q)
        limit = counts.agg(F.percentile("n", F.lit(self.qv)).alias("_q"))
        return counts.crossJoin(F.broadcast(limit)).where("n >= _q").drop("_q")

    def fit(self, df: DataFrame) -> FittedSDO:
        observers = written(self.drawn(df), "sdo-drawn")
        return FittedSDO(self, written(self.active(self.counts(df, observers)), "sdo-active"))


@dataclass(frozen=True)
class FittedSDO:
    params: SDO
    observers: DataFrame

    def scores(self, df: DataFrame) -> DataFrame:
        """`df` with score: the median distance to the x nearest active observers."""
        return knn(df, self.observers, self.params.x, self.params.metric).withColumn("score", reduce_distances("nn", "median")).drop("nn")

    def predict(self, df: DataFrame) -> DataFrame:
        """Scores, or with return_scores False also is_outlier."""
        scored = self.scores(df)
        return scored if self.params.return_scores else flag_outliers(scored, self.params.contamination)


def fit_predict(params: SDO, df: DataFrame) -> DataFrame:
    return params.fit(df).predict(df)


def kmeans_centres(df: DataFrame, k: int, seed: int, steps: int = 20) -> DataFrame:
    """(oid, o): centres of pyspark.ml's k-means (k-means|| start)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, maxIter=steps, featuresCol="v").fit(df.select(array_to_vector("x").alias("v")))
    return df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "oid long, o array<double>")


def lloyd_step(df: DataFrame, centres: DataFrame) -> DataFrame:
    """(oid, o): the mean of the points nearest to each centre; a centre without points stays."""
    near = knn(df.select("id", "x"), centres, 1).select(F.element_at("nn", 1)["oid"].alias("oid"), "x")
    dims = near.select("oid", F.posexplode("x").alias("dim", "v")).groupBy("oid", "dim").agg(F.avg("v").alias("v"))
    means = dims.groupBy("oid").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda e: e["v"]).alias("mean"))
    return centres.join(means, "oid", "left").select("oid", F.coalesce("mean", "o").alias("o"))


def gaussian_means(df: DataFrame, k: int, seed: int, steps: int = 20) -> DataFrame:
    """(oid, o): means of a Gaussian mixture fitted by weighted EM (weights in w if there)."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    rows = _weighted(df).select(array_to_vector("x").alias("v"), "w")
    model = GaussianMixture(k=k, seed=seed, maxIter=steps, featuresCol="v", weightCol="w").fit(rows)
    return df.sparkSession.createDataFrame([(i, [float(v) for v in g.mean]) for i, g in enumerate(model.gaussians)], "oid long, o array<double>")


#: Points whose shares are worked out together; parts in which sums of tasks are added up.
SLICE = 1_000
PARTS = 64
#: Components whose covariances are worked out together.
FEW_COMPONENTS = 32


def one_hot(x: np.ndarray, centres: np.ndarray, w: np.ndarray) -> np.ndarray:
    """[points, centres]: each point's weight at its nearest centre (lowest number if tied)."""
    r = np.zeros((len(x), len(centres)))
    r[np.arange(len(x)), Search(np.arange(len(centres)), centres, "euclidean", 2.0).best(x, 1, np.full(len(x), np.inf))[1][:, 0]] = w
    return r


def moments(sums: np.ndarray, x: np.ndarray, r: np.ndarray, second: bool) -> None:
    """Adds to each row of `sums` a component's shares, shares times x and, if asked, times x x'. A share of 0 adds nothing."""
    d = x.shape[1]
    sums[:, 0] += r.sum(axis=0)
    sums[:, 1 : 1 + d] += r.T @ x
    for j in range(len(sums) if second else 0):
        some = np.flatnonzero(r[:, j])
        if len(some):
            mine = x[some]
            sums[j, 1 + d :] += ((mine * r[some, j : j + 1]).T @ mine).reshape(-1)


def sum_rows(sums: np.ndarray) -> pa.RecordBatch:
    """The rows of one task that are not 0, for added()."""
    some = np.flatnonzero(sums[:, 0])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * sums.shape[1] + 1, sums.shape[1], dtype=np.int32)), pa.array(sums[some].reshape(-1)))
    return pa.RecordBatch.from_arrays([pa.array((some % PARTS).astype(np.int32)), pa.array(some), lists], ["part", "at", "sums"])


SUM_ROWS = "part int, at long, sums array<double>"


def added(rows: DataFrame, total: int, width: int) -> np.ndarray:
    """[total, width]: the sums of all tasks, added up by the executors; the driver gets one row for each."""

    def add(table: pa.Table) -> pa.Table:
        at, sums = table.column("at").to_numpy(), _matrix(table.column("sums"))
        order = np.argsort(at, kind="stable")
        keys, starts = np.unique(at[order], return_index=True)
        flat = np.add.reduceat(sums[order], starts, axis=0)
        return pa.table({"at": pa.array(keys), "sums": pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, width, dtype=np.int32)), pa.array(flat.reshape(-1)))})

    out = np.zeros((total, width))
    found = rows.groupBy("part").applyInArrow(add, "at long, sums array<double>").toArrow()
    for batch in found.to_batches():
        if batch.num_rows:
            out[batch.column(0).to_numpy()] = _matrix(batch.column(1))
    return out


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma for positive numbers: recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


@dataclass
class VariationalMixture:
    """A Gaussian mixture under a stick-breaking prior on its weights and a normal-Wishart prior on its components.

    Priors: concentration 1 / k, mean and covariance of the data, one pseudo-observation of the mean, as many degrees of
    freedom as dimensions."""

    prior_mean: np.ndarray
    prior_covariance: np.ndarray
    k: int

    def update(self, n: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """From sums of responsibilities, of them times x, and of them times x x'."""
        d = len(self.prior_mean)
        n = n + 10 * np.finfo(float).eps
        mean = first / n[:, None]
        self.stick = 1 + n, 1 / self.k + np.append(np.cumsum(n[::-1])[-2::-1], 0)
        self.precision = 1 + n
        self.means = (self.prior_mean + n[:, None] * mean) / self.precision[:, None]
        self.freedom = d + n
        gap = mean - self.prior_mean
        a, b = self.stick
        whole = digamma(a + b)
        weights = digamma(a) - whole + np.append(0, np.cumsum(digamma(b) - whole)[:-1])
        self.whiten, log_det = np.empty((len(n), d, d)), np.empty(len(n))
        for lo in range(0, len(n), FEW_COMPONENTS):
            some = slice(lo, lo + FEW_COMPONENTS)
            spread = second[some] - n[some, None, None] * mean[some, :, None] * mean[some, None, :] + 1e-6 * n[some, None, None] * np.eye(d)
            scale = self.prior_covariance + spread + (n / self.precision)[some, None, None] * gap[some, :, None] * gap[some, None, :]
            root = np.linalg.cholesky(scale / self.freedom[some, None, None])
            self.whiten[some] = np.linalg.inv(root)
            log_det[some] = -2 * np.log(np.diagonal(root, axis1=1, axis2=2)).sum(axis=1)
        expected = d * np.log(2) + digamma(0.5 * (self.freedom[:, None] - np.arange(d))).sum(axis=1)
        self.constant = weights + 0.5 * (log_det - d * np.log(self.freedom) + expected - d / self.precision)

    def responsibilities(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """[points, components], each point's row adding up to its weight."""
        if len(x) > SLICE:
            return np.concatenate([self.responsibilities(x[i : i + SLICE], w[i : i + SLICE]) for i in range(0, len(x), SLICE)])
        log_r = np.stack([c - 0.5 * (((x - m) @ t.T) ** 2).sum(axis=1) for c, m, t in zip(self.constant, self.means, self.whiten, strict=True)], axis=1)
        r = np.exp(log_r - log_r.max(axis=1, keepdims=True))
        return r * (w / r.sum(axis=1))[:, None]


def bayesian_means(df: DataFrame, k: int, seed: int, steps: int = 30, tolerance: float = 1e-3) -> DataFrame:
    """(oid, o): component means of a variational Gaussian mixture of weighted points (weights in w if there).

    Starts with k-means. Each round is one pass that sums up responsibilities by task: what the driver gets is
    k (1 + d + d d) numbers in all."""
    ship(df.sparkSession)
    rows = _weighted(df).select("x", F.col("w").cast("double"))
    centres = np.array([r[1] for r in kmeans_centres(df, k, seed).orderBy("oid").collect()], float)
    k, d = centres.shape

    def sums(assign) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((k, 1 + d + d * d))
            for batch in batches:
                x, w = _matrix(batch.column(0)), batch.column(1).to_numpy()
                moments(out, x, assign(x, w), True)
            yield sum_rows(out)

        total = added(rows.mapInArrow(run, SUM_ROWS), k, 1 + d + d * d)
        return total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(k, d, d)

    def nearest(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return one_hot(x, centres, w)

    n, first, second = sums(nearest)
    if not n.sum():
        return df.sparkSession.createDataFrame([], "oid long, o array<double>")
    mean = first.sum(axis=0) / n.sum()
    covariance = second.sum(axis=0) / n.sum() - np.outer(mean, mean) + 1e-9 * np.eye(d)
    mixture = VariationalMixture(mean, covariance, k)
    mixture.update(n, first, second)
    for _ in range(steps):
        before = mixture.means
        mixture.update(*sums(mixture.responsibilities))
        if np.abs(mixture.means - before).max() <= tolerance * np.sqrt(np.diag(covariance)).max():
            break
    return df.sparkSession.createDataFrame([(i, m.tolist()) for i, m in enumerate(mixture.means)], "oid long, o array<double>")


def neural_gas(x: np.ndarray, max_nodes: int, seed: int, epochs: int = 40, step: float = 0.2, neighbour_step: float = 0.005, max_age: int = 50, every: int = 100, split_decay: float = 0.5, decay: float = 0.995, least_move: float = 0.01) -> np.ndarray:
    """Nodes of a growing neural gas (Fritzke's algorithm) over rows in seeded orders."""
    rng = np.random.default_rng(seed)
    nodes = x[rng.choice(len(x), 2, replace=len(x) < 2)].astype(float)
    norms = np.einsum("ij,ij->i", nodes, nodes)
    error = np.zeros(2)
    ages: list[dict[int, int]] = [{}, {}]  # of each node's edges, by the other node
    largest = float(np.einsum("ij,ij->i", x, x).max(initial=0))
    turn = 0
    for _ in range(epochs):
        moved = 0.0
        for v in x[rng.permutation(len(x))]:
            turn += 1
            if len(nodes) > 32:  # a matrix product tells which may be the nearest two
                near = norms - 2 * (nodes @ v)
                among = np.flatnonzero(~(near > np.partition(near, 1)[1] + slack(x.shape[1], 2 * largest)))
                d = ((nodes[among] - v) ** 2).sum(axis=1)
                order = np.argsort(d, kind="stable")
                a, b, least = int(among[order[0]]), int(among[order[1]]), d[order[0]]
            else:
                d = ((nodes - v) ** 2).sum(axis=1)
                a, b = (int(i) for i in np.argsort(d, kind="stable")[:2])
                least = d[a]
            error[a] += least
            shift = step * (v - nodes[a])
            nodes[a] += shift
            moved += float(np.sqrt((shift**2).sum()))
            mine = ages[a]
            others = list(mine)
            if others:
                nodes[others] += neighbour_step * (v - nodes[others])
                for other in others:
                    mine[other] += 1
                    ages[other][a] += 1
            mine[b] = ages[b][a] = 0
            at = [a, *others]
            norms[at] = np.einsum("ij,ij->i", nodes[at], nodes[at])
            old = [other for other in others if mine[other] > max_age]
            if old:
                for other in old:
                    del mine[other], ages[other][a]
                keep = [i for i, e in enumerate(ages) if e]
                if len(keep) < len(ages):
                    number = {i: new for new, i in enumerate(keep)}
                    nodes, norms, error = nodes[keep], norms[keep], error[keep]
                    ages = [{number[other]: n for other, n in ages[i].items()} for i in keep]
            if turn % every == 0 and len(nodes) < max_nodes:
                q = int(error.argmax())
                if ages[q]:
                    f = max(ages[q], key=lambda i: error[i])
                    new = len(nodes)
                    nodes = np.vstack([nodes, (nodes[q] + nodes[f]) / 2])
                    norms = np.append(norms, nodes[new] @ nodes[new])
                    del ages[q][f], ages[f][q]
                    ages.append({q: 0, f: 0})
                    ages[q][new] = ages[f][new] = 0
                    error[[q, f]] *= split_decay
                    error = np.append(error, error[q])
            error *= decay
        if moved / max(1, len(x)) < least_move * 1e-3:
            break
    return nodes


def neural_gas_nodes(df: DataFrame, max_nodes: int | str, seed: int, group: str | None = None, epochs: int = 40) -> DataFrame:
    """(grp, oid, o); max_nodes may name a column that tells each group's. The algorithm is sequential, so each group is
    one task's work; give groups to run in parallel."""
    ship(df.sparkSession)
    most = F.col(max_nodes) if isinstance(max_nodes, str) else F.lit(max_nodes)
    rows = df.select((F.col(group) if group else F.lit(0) * F.col("id").cast("int")).cast("int").alias("grp"), "id", "x", most.cast("long").alias("most"))

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("x"))[np.argsort(table.column("id").to_numpy(), kind="stable")]
        nodes = neural_gas(x, max(2, table.column("most")[0].as_py()), seed, epochs)
        return pa.table({"grp": pa.array([table.column("grp")[0].as_py()] * len(nodes), pa.int32()), "oid": pa.array(np.arange(len(nodes))), "o": pa.array([n.tolist() for n in nodes], pa.list_(pa.float64()))})

    return rows.groupBy("grp").applyInArrow(run, "grp int, oid long, o array<double>")


def condensed(df: DataFrame, label: str, seed: int, per_round: int = 200) -> DataFrame:
    """Rows of a condensed set: 1-NN among them labels every row right, but for rows that lie where one of another label
    does (the lowest id there decides).

    Starts with the first row of each label in seeded order; each round adds the first rows, in that order, that are
    still labelled wrong: `per_round`, or as many as the set has where that is more, so there are few rounds whatever
    the size. A round looks at its new rows only, in one pass: the table carries each row's nearest so far, with labels
    as numbers and the rows numbered in the seeded order, so that counts tell which are the first."""
    spark = df.sparkSession
    rows = df.select("id", "x", F.col(label).alias("label"))
    with scratch(spark) as last:
        numbered = written(P.shuffled(rows, seed), "condensed-rows")
        first = numbered.groupBy(F.col("label").alias("_label")).agg(F.min("seq").alias("_first"))  # a row for each label
        first = written(first.withColumn("code", F.row_number().over(Window.orderBy("_first")) - 1), "condensed-labels")
        state = numbered.join(F.broadcast(first), F.col("label").eqNullSafe(F.col("_label"))).select("id", "x", "label", "seq", "code", F.lit(math.inf).alias("d"), F.lit(-1).cast("long").alias("near"), F.lit(-1).alias("got"), F.lit(False).alias("chosen"), (F.col("seq") == F.col("_first")).alias("new"))
        state = written(spread(state), "condensed")
        count, size = numbered.count(), first.count()
        if not count:
            return rows.where("false")
        while True:
            before, state = state, written(_nearer(state.drop("new"), state.where("new").select("id", "x", "code")), "condensed")
            drop(before)
            wrong = state.where("got != code and not chosen and d > 0")  # where d is 0 the set has that point already
            width = 1 + count // P.BUCKETS
            counts = sorted(wrong.groupBy(F.floor(F.col("seq") / width)).agg(F.count("*")).collect())  # P.BUCKETS rows at most
            if not counts:
                last(state)
                return state.where("chosen").select("id", "x", "label")
            need = max(per_round, size)
            cut = count
            for bucket, n in counts:
                if need < n:
                    cut = sorted(r[0] for r in wrong.where(F.floor(F.col("seq") / width) == bucket).select("seq").collect())[need]
                    break
                need -= n
            size += min(sum(n for _, n in counts), max(per_round, size))
            state = _same_table(state, state.withColumn("new", F.expr("got != code and not chosen and d > 0") & (F.col("seq") < cut)))


def _same_table(table: DataFrame, made: DataFrame) -> DataFrame:
    """`made`, which reads the written `table`, as what drop() takes."""
    made.__dict__["_written"] = table.__dict__["_written"]
    return made


def _nearer(state: DataFrame, new: DataFrame) -> DataFrame:
    """`state` (x, d, near, got, chosen and more) with d, near and got of the nearest of `new` (id, x, code) where that is
    nearer, or as near with a lower id; chosen where it is the row itself."""
    spark = state.sparkSession
    ship(spark)
    names, schema = state.columns, state.schema
    places = [names.index(name) for name in ("id", "x", "d", "near", "got", "chosen")]
    for block in _blocks(new, "id", "x", "code"):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix, codes = shared.value
            search = Search(ids, matrix, "euclidean", 2.0)
            order = np.argsort(ids, kind="stable")
            for batch in batches:
                if not batch.num_rows:
                    continue
                id, d, near, got = (batch.column(places[i]).to_numpy() for i in (0, 2, 3, 4))
                chosen = batch.column(places[5]).to_numpy(zero_copy_only=False)
                found, oid = (a[:, 0] for a in search.best(_matrix(batch.column(places[1])), 1, d))
                closer = (found < d) | ((found == d) & (oid < near) & (oid >= 0))
                of = codes[order[np.minimum(np.searchsorted(ids, oid, sorter=order), len(ids) - 1)]]
                values = [None, None, np.where(closer, found, d), np.where(closer, oid, near), np.where(closer, of, got).astype(np.int32), chosen | ((found == 0) & (oid == id))]
                changed = {places[i]: pa.array(values[i]) for i in range(2, 6)}
                yield pa.RecordBatch.from_arrays([changed.get(i, batch.column(i)) for i in range(len(names))], names)

        state = state.mapInArrow(run, schema)
    return state
