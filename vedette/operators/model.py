"""The observer model: parameters, fit, and the three questions a fitted model answers."""

from __future__ import annotations

import json
import logging
import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vedette.functions.columns import order_key
from vedette.operators import points as P
from vedette.operators.fold import fit_groups, numbered
from vedette.operators.knn import MODES, knn, nearest, reduce_distances
from vedette.operators.metrics import quantile
from vedette.operators.radius import estimate_radius, radius_by_group
from vedette.session import written

log = logging.getLogger("vedette")

#: Points of one batch at most: a batch is folded point by point, in one task.
ONE_BATCH = 5_000_000


@dataclass(frozen=True)
class ObserverModel:
    """Parameters of a fit.

    factor: step of a radius, in parts of the distance. radius: the initial radius; 0 or None estimates it.
    sample_fraction: share of the points behind the estimate. max_observers: how many to keep (the most populous) or to
    pad to; 0 or None keeps all. alpha: scales the shift of a centroid. beta: scales the estimate.
    distance_estimation: `adtm` (mean distance to the mean) or `aid` (mean pairwise distance). radius_scope: `global`
    or `batch`. chunksize: points in a batch; batches are folded apart, in parallel, and not merged. seed; shuffle:
    fold in a seeded random order, else by id. k, mode, contamination: defaults of the questions. strict_compat: keep
    the empty-sample estimate (NaN) instead of a least sample."""

    factor: float = 0.1
    radius: float | None = None
    sample_fraction: float = 0.05
    max_observers: int | None = None
    alpha: float = 1.0
    beta: float = 1.0
    distance_estimation: str = "adtm"
    radius_scope: str = "global"
    chunksize: int | None = None
    seed: int = 0
    shuffle: bool = True
    k: int = 5
    mode: str = "median"
    contamination: float = 0.1
    strict_compat: bool = False

    def __post_init__(self) -> None:
        if self.distance_estimation not in ("adtm", "aid") or self.radius_scope not in ("global", "batch") or self.mode not in MODES:
            raise ValueError("distance_estimation, radius_scope or mode is none of the known ones")
        if self.k < 1 or not 0 <= self.contamination <= 1 or (self.chunksize is not None and self.chunksize < 1):
            raise ValueError("k, contamination or chunksize is out of range")

    def get_params(self) -> dict[str, object]:
        return asdict(self)

    def ordered(self, rows: DataFrame) -> DataFrame:
        """Rows with `seq` and `batch` as the fit takes them."""
        rows = P.shuffled(rows, self.seed) if self.shuffle else P.in_order(rows)
        n = rows.count()
        if n > ONE_BATCH and (not self.chunksize or n // max(1, n // self.chunksize) > ONE_BATCH):
            raise ValueError(f"a batch is one task's work, {ONE_BATCH} points at most: set a chunksize for {n} points")
        return P.with_batches(rows, n, self.chunksize)

    def initial_radius(self, rows: DataFrame) -> float | DataFrame:
        """One number, or (batch, radius) rows when it is each batch's own."""
        if self.radius:
            return float(self.radius)
        if self.radius_scope == "batch":
            return radius_by_group(rows, "batch", self.sample_fraction, self.seed, self.beta, self.distance_estimation)
        return estimate_radius(rows, self.distance_estimation, self.sample_fraction, self.seed, self.beta, self.strict_compat)

    def fit(self, rows: DataFrame) -> FittedModel:
        """`rows`: (id, x, ...) from points(). The observers are written to the shared folder: a model is fitted once,
        however many questions it answers."""
        ordered = self.ordered(rows.select("id", "x"))
        start = self.initial_radius(ordered)
        observers = written(numbered(fit_groups(ordered, "batch", start, self.factor, self.alpha)), "observers")
        if self.max_observers:
            observers = limited(observers, rows, self.max_observers, self.seed)
        log.info("fitted with radius %s", start if isinstance(start, float) else "by batch")
        return FittedModel(self, observers, start if isinstance(start, float) else math.nan)


def top_observers(observers: DataFrame, m: int) -> DataFrame:
    """The m most populous observers, numbered by rising population (equal ones as they were)."""
    from pyspark.sql import Window

    kept = observers.orderBy(F.desc("population"), F.desc("oid")).limit(m)
    number = F.row_number().over(Window.orderBy("population", "oid")) - 1  # m rows
    return kept.withColumn("oid", number.cast("int"))


def limited(observers: DataFrame, rows: DataFrame, m: int, seed: int) -> DataFrame:
    """Exactly m observers: the most populous, or all and seeded raw points (null population and radius) to fill up."""
    k = observers.count()
    if m <= k:
        return top_observers(observers, m)
    from pyspark.sql import Window

    extra = P.sample(rows, m - k, seed)
    number = F.row_number().over(Window.orderBy(order_key(seed, "id"), "id")) + F.lit(k - 1)
    padding = extra.select(F.lit(None).cast("int").alias("batch"), number.cast("int").alias("oid"), F.col("x").alias("o"), F.lit(None).cast("long").alias("population"), F.lit(None).cast("double").alias("radius"))
    return observers.unionByName(padding)


@dataclass(frozen=True)
class FittedModel:
    """observers: (batch, oid, o, population, radius)."""

    params: ObserverModel
    observers: DataFrame
    radius: float

    @property
    def population(self) -> DataFrame:
        return self.observers.select("oid", "population")

    @property
    def radii(self) -> DataFrame:
        return self.observers.select("oid", "radius")

    def get_params(self) -> dict[str, object]:
        return self.params.get_params() | {"fitted_radius": self.radius}

    def outlierness(self, rows: DataFrame, k: int | None = None, mode: str | None = None) -> DataFrame:
        """`rows` with score: the k nearest observers' distances reduced by mode."""
        found = knn(rows, self.observers, k or self.params.k)
        return found.withColumn("score", reduce_distances("nn", mode or self.params.mode)).drop("nn")

    def predict(self, rows: DataFrame, contamination: float | None = None, k: int | None = None, mode: str | None = None) -> DataFrame:
        """`rows` with score and is_outlier: above the (1 - contamination) quantile of the scores of these rows."""
        c = self.params.contamination if contamination is None else contamination
        return flag_outliers(self.outlierness(rows, k, mode), c)

    def labels(self, rows: DataFrame) -> DataFrame:
        """`rows` with label_oid: the nearest observer."""
        return nearest(rows, self.observers).withColumnRenamed("nearest", "label_oid")

    def save(self, path: str) -> None:
        self.observers.write.mode("overwrite").parquet(f"{path}/observers")
        spark = self.observers.sparkSession
        spark.createDataFrame([(json.dumps(self.get_params()),)], "params string").coalesce(1).write.mode("overwrite").text(f"{path}/params")


def load(spark: SparkSession, path: str) -> FittedModel:
    found = json.loads(spark.read.text(f"{path}/params").first()[0])
    radius = found.pop("fitted_radius")
    return FittedModel(replace(ObserverModel(), **found), spark.read.parquet(f"{path}/observers"), radius)


def flag_outliers(scored: DataFrame, contamination: float, score: str = "score") -> DataFrame:
    """is_outlier: score > quantile(1 - contamination), interpolated.

    The scores are written, as the threshold takes a few looks at them; no look scores the points again."""
    scored = written(scored, "scores")
    threshold = quantile(scored, score, 1.0 - contamination)
    return scored.withColumn("threshold", F.lit(threshold).cast("double")).withColumn("is_outlier", F.col(score) > F.col("threshold"))
