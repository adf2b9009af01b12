"""Column builders: vector distances, seeded order keys and draws. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "cityblock", "chebyshev", "minkowski")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vector_sum(values: Column) -> Column:
    """Sum of an array of doubles, in order."""
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def distance(a: Column | str, b: Column | str, metric: str = "euclidean", p: float = 3.0) -> Column:
    """Distance of two arrays of the same length under one of METRICS; `p` is Minkowski's."""
    a, b = _col(a), _col(b)
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if metric == "euclidean":
        return F.sqrt(vector_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if metric == "cityblock":
        return vector_sum(gap)
    if metric == "chebyshev":
        return F.array_max(gap)
    if metric == "minkowski":
        return F.pow(vector_sum(F.transform(gap, lambda g: F.pow(g, F.lit(float(p))))), F.lit(1.0 / p))
    raise ValueError(f"metric is one of {METRICS}, not {metric!r}")


def order_key(seed: int, *columns: Column | str) -> Column:
    """A hash that orders rows at random, the same in every engine: md5 of seed|column|..."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(_col(c).cast("string") for c in columns)))


def uniform(seed: int, j: Column | str) -> Column:
    """Draw j of a seeded stream: uniform in [0, 1) with 52 bits."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("u"), _col(j).cast("string"))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(2**52))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for reports; minus zero becomes zero."""
    return F.round(_col(c), digits) + F.lit(0.0)
