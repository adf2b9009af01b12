"""Initial radius estimates from a seeded sample of share rho."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vedette.functions.columns import distance
from vedette.operators.fold import _matrix
from vedette.operators.knn import _blocks
from vedette.operators.points import sample, shuffled
from vedette.session import ship


def _centroid(df: DataFrame, by: list[str]) -> DataFrame:
    exploded = df.select(*by, F.posexplode("x").alias("dim", "v")).groupBy(*by, "dim").agg(F.avg("v").alias("v"))
    return exploded.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda e: e["v"]).alias("centre"))


def sample_size(n: int, rho: float, least: int) -> int:
    """int(n * rho), at least `least` and at most n."""
    return min(n, max(least, int(n * rho)))


def mean_to_centroid(df: DataFrame) -> DataFrame:
    """One row: the mean distance of the points to their centroid (`adtm`)."""
    return df.crossJoin(F.broadcast(_centroid(df, []))).agg(F.avg(distance("x", "centre")).alias("radius"))  # one row is broadcast


def mean_pairwise(df: DataFrame) -> float:
    """Mean distance of all pairs of points (`aid`); NaN for fewer than two.

    Blocks of the points pass by all points, so no pair becomes a row and memory is bounded. The work grows with the
    square of the sample, as the estimate's definition has it; rho is the lever."""
    ship(df.sparkSession)
    rows = df.select("id", "x")
    total, count = 0.0, 0
    for block in _blocks(rows, "id", "x"):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, refs, _ = shared.value
            for batch in batches:
                part = 0.0
                for i, x in zip(batch.column(0).to_numpy(), _matrix(batch.column(1)), strict=True):
                    gap = refs[ids > i] - x
                    part += float(np.sqrt(np.einsum("ij,ij->i", gap, gap)).sum())
                yield pa.RecordBatch.from_arrays([pa.array([part])], ["total"])

        count += len(block[0])
        total += rows.mapInArrow(run, "total double").agg(F.sum("total")).first()[0] or 0.0
    return total / (count * (count - 1) / 2) if count > 1 else math.nan


def estimate_radius(df: DataFrame, method: str, rho: float, seed: int, beta: float = 1.0, strict: bool = False) -> float:
    """beta times the estimate over int(n * rho) sampled rows (at least one, two for `aid`, unless `strict`)."""
    if method not in ("adtm", "aid"):
        raise ValueError(f"distance_estimation is adtm or aid, not {method!r}")
    n = df.count()
    size = int(n * rho) if strict else sample_size(n, rho, 1 if method == "adtm" else 2)
    chosen = sample(df, size, seed)
    value = mean_to_centroid(chosen).first()[0] if method == "adtm" else mean_pairwise(chosen)
    return beta * (math.nan if value is None else value)


def _pairwise(x: np.ndarray) -> float:
    """Mean distance of all pairs of rows; NaN for fewer than two."""
    n, total = len(x), 0.0
    for i in range(n - 1):
        gap = x[i + 1 :] - x[i]
        total += float(np.sqrt(np.einsum("ij,ij->i", gap, gap)).sum())
    return total / (n * (n - 1) / 2) if n > 1 else math.nan


def radius_by_group(df: DataFrame, group: str, rho: float, seed: int, beta: float = 1.0, method: str = "adtm") -> DataFrame:
    """(group, radius): the estimate over each group's own sample, all groups in one plan.

    For `aid` a group's sample is one task's work, as the group's fold is."""
    least = 1 if method == "adtm" else 2
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    ranked = shuffled(df.select(group, "id", "x"), seed, "id", "_rank", group).join(sizes, F.col(group).eqNullSafe(F.col("_g")))
    chosen = ranked.where(F.col("_rank") < F.greatest(F.lit(least), F.floor(F.col("_n") * F.lit(float(rho))))).select(group, "id", "x")
    if method == "adtm":
        centres = _centroid(chosen, [group])
        return chosen.join(centres, group).groupBy(group).agg((F.lit(float(beta)) * F.avg(distance("x", "centre"))).alias("radius"))
    ship(df.sparkSession)
    kind = df.schema[group].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("x"))[np.argsort(table.column("id").to_numpy(), kind="stable")]
        return pa.table({group: table.column(group).slice(0, 1), "radius": pa.array([beta * _pairwise(x)])})

    return chosen.groupBy(group).applyInArrow(run, f"`{group}` {kind}, radius double")
