"""Points: the numeric rows every operator works on, as (id, seq, x[, label, ...]).

`seq` is the explicit row order; the fit depends on it. It is assigned without sending all rows to one task: rows
are numbered inside buckets of their order key, and a bucket's offset is the count of the rows before it. Buckets of ids
lie between quantiles of the ids that occur, so one far id does not fill a bucket with all others.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vedette.functions.columns import order_key

#: Buckets of a random order key (three hexadecimal digits); of ids, between so many quantiles.
BUCKETS = 4096
ID_BUCKETS = 512
#: Rows that a task may order at once; of a sample up to which it does, where counts would cost more.
FEW = 100_000
ORDERED = 5_000


def points(df: DataFrame, x: str | Sequence[str], id: str, keep: Sequence[str] = (), check: bool = True) -> DataFrame:
    """id and x (from an array column, or from numeric columns), with the columns in `keep`.

    With `check`, a null id, or a null, NaN or infinite number, or a vector of another length than the rest,
    stops the query that reads it with an error."""
    vector = F.col(x).cast("array<double>") if isinstance(x, str) else F.array(*(F.col(c).cast("double") for c in x))
    out = df.select(F.col(id).cast("long").alias("id"), vector.alias("x"), *keep)
    if not check:
        return out
    width = len(x) if not isinstance(x, str) else out.where(F.col("x").isNotNull()).select(F.size("x")).limit(1)
    if isinstance(width, DataFrame):
        first = width.first()
        width = first[0] if first else 0
    bad = F.col("id").isNull() | F.col("x").isNull() | (F.size("x") != width) | F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return out.withColumn("x", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("not a point: id "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))).otherwise(F.col("x")))


def quantile_buckets(df: DataFrame, column: str, name: str, buckets: int = ID_BUCKETS) -> DataFrame:
    """`df` with a whole number `name` that rises with a numeric column, for buckets of like size: between approximate
    quantiles of its values. Nulls and NaN come last."""
    from pyspark.ml.feature import Bucketizer

    value = F.col(column).cast("double")
    at = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    found = df.select(F.when(~F.isnan(value), value).alias("v")).agg(F.percentile_approx("v", at, F.lit(10 * buckets))).first()[0] or [0.0]
    edges = [-math.inf, *sorted({float(v) for v in found} - {-math.inf, math.inf} or {0.0}), math.inf]
    cut = Bucketizer(splits=edges, inputCol="_value", outputCol="_place", handleInvalid="keep").transform(df.withColumn("_value", value))
    return cut.withColumn(name, F.coalesce(F.col("_place").cast("int"), F.lit(len(edges)))).drop("_value", "_place")


def _numbered(df: DataFrame, order: list[Column], name: str, by: str | None = None) -> DataFrame:
    """0-based number of each row of `df`, which has _bucket, in the order of (_bucket, order), apart for each `by`."""
    keys = [by] if by else []
    counts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    before = counts.select(*(F.col(k).alias("_by") for k in keys), F.col("_bucket").alias("_b"), F.sum("_n").over(earlier).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    same = F.col("_bucket") == F.col("_b")
    joined = df.join(before, same & F.col(by).eqNullSafe(F.col("_by"))) if by else df.join(F.broadcast(before), same)
    return joined.withColumn(name, (within + F.coalesce("_before", F.lit(0))).cast("long")).drop("_bucket", "_before", "_b", "_by")


def _by_key(df: DataFrame, seed: int, id: str) -> tuple[DataFrame, list[Column]]:
    """`df` with _bucket by the seeded order key, and that order."""
    key = order_key(seed, id)
    return df.withColumn("_bucket", F.conv(F.substring(key, 1, 3), 16, 10).cast("int")), [key, F.col(id)]


def in_order(df: DataFrame, id: str = "id", name: str = "seq") -> DataFrame:
    """Rows numbered by a whole-number id."""
    return _numbered(quantile_buckets(df, id, "_bucket"), [F.col(id)], name)


def shuffled(df: DataFrame, seed: int, id: str = "id", name: str = "seq", by: str | None = None) -> DataFrame:
    """Rows numbered in a seeded random order (apart for each `by`); labels and other columns stay with their row."""
    return _numbered(*_by_key(df, seed, id), name, by)


def with_batches(df: DataFrame, n: int, chunksize: int | None, seq: str = "seq") -> DataFrame:
    """`batch`: max(1, n // chunksize) contiguous stretches of seq, as equal as can be, the longer ones first."""
    k = max(1, n // chunksize) if chunksize else 1
    if k == 1:
        return df.withColumn("batch", (F.col(seq) * 0).cast("int"))
    q, r = divmod(n, k)
    s, edge = F.col(seq), r * (q + 1)
    batch = F.when(s < edge, F.floor(s / F.lit(q + 1))).otherwise(F.lit(r) + F.floor((s - edge) / F.lit(max(1, q))))
    return df.withColumn("batch", batch.cast("int"))


def stratified_split(df: DataFrame, label: str, share: float, seed: int, id: str = "id") -> DataFrame:
    """`is_test`: the first round(share * n) rows of each label's seeded order."""
    sizes = df.groupBy(F.col(label).alias("_by")).agg(F.count("*").alias("_n"))
    ranked = shuffled(df, seed, id, "_rank", label).join(sizes, F.col(label).eqNullSafe(F.col("_by")))
    return ranked.withColumn("is_test", F.col("_rank") < F.floor(F.col("_n") * F.lit(float(share)) + 0.5)).drop("_rank", "_n", "_by")


def sample(df: DataFrame, size: int, seed: int, id: str = "id") -> DataFrame:
    """`size` rows without replacement: the first in a seeded order.

    For more than ORDERED rows counts by three digits of the key after the other tell which keys lie before the edge; only
    the few rows at the edge are ordered."""
    key, size = order_key(seed, id), int(size)
    if size <= min(FEW, ORDERED):
        return df.orderBy(key, id).limit(size)
    prefix, need = "", size
    while True:
        rest = df.where(key.startswith(prefix))
        counts = sorted(rest.groupBy(F.substring(key, len(prefix) + 1, 3)).agg(F.count("*")).collect())  # BUCKETS rows at most
        for digits, n in counts:
            if need <= n:
                break
            need -= n
        else:
            return df
        prefix += digits
        if n <= FEW or len(prefix) >= 30:
            return df.where(key < prefix).unionByName(df.where(key.startswith(prefix)).orderBy(key, id).limit(need))


def fix_rate(observers: DataFrame, rows: DataFrame, size: int, seed: int, id: str = "id") -> DataFrame:
    """Exactly `size` rows: a seeded sample of `observers` if there are more, seeded raw rows (of the same columns)
    added if there are fewer; no more rows than there are."""
    have = observers.count()
    if have >= size:
        return sample(observers, size, seed, id) if have > size else observers
    return observers.unionByName(sample(rows, size - have, seed, id).select(*observers.columns))


def coreset_size(n: Column | int, rate: float, least: int = 0) -> Column:
    """int(n * rate / 100), at least `least`."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.greatest(F.floor(n * F.lit(float(rate)) / 100.0), F.lit(least)).cast("long")
