"""Metrics: ranking, confusion, agreement of partitions, and summaries over datasets.

Ranked metrics need each row's place among all. Rows are dealt into buckets between approximate quantiles of the score,
and rows of one score, where it is a frequent one, between quantiles of the id, so buckets are of like size whatever
the scores look like; a bucket's offset is the sum over those before it, and no task sorts all rows. NaN ranks above all
numbers, null below.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vedette.operators.points import FEW, quantile_buckets

BUCKETS = 512
#: Accuracy of an approximate quantile: a rank is off by this part of all at most.
ACCURACY = 10_000


def _place(df: DataFrame, score: str, id: str) -> DataFrame:
    """rank (1-based, score descending, then id), cs (true outliers up to there)."""
    tagged = quantile_buckets(df.withColumn("_key", F.when(F.col(score).isNull(), -math.inf).otherwise(F.col(score))), "_key", "_b", BUCKETS)
    whole = tagged.groupBy("_b").agg(F.min("_key").alias("_lo"), F.max("_key").alias("_hi"))  # BUCKETS rows
    tied = F.broadcast(whole.select(F.col("_b").alias("_t"), (F.col("_lo") == F.col("_hi")).alias("_tied")))
    tagged = quantile_buckets(tagged, id, "_i", BUCKETS).join(tied, F.col("_b") == F.col("_t"))
    tagged = tagged.withColumns({"_b": -F.col("_b"), "_i": F.when(F.col("_tied"), F.col("_i")).otherwise(0)})
    sums = tagged.groupBy("_b", "_i").agg(F.count("*").alias("_n"), F.sum("y").alias("_y"))
    earlier = Window.orderBy("_b", "_i").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS squared rows at most
    before = sums.select("_b", "_i", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_y").over(earlier), F.lit(0)).alias("_y0"))
    w = Window.partitionBy("_b", "_i").orderBy(F.desc("_key"), id)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return tagged.join(F.broadcast(before), ["_b", "_i"]).select(id, score, "y", (F.row_number().over(w) + F.col("_n0")).alias("rank"), (F.sum("y").over(upto) + F.col("_y0")).alias("cs"))


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The exact q-quantile of a column, linear between neighbours; nulls don't count. `df` is read a few times.

    Approximate quantiles give bounds around the two neighbours' ranks; what lies outside is counted and left out, until
    few rows are left or they have few values. So no task and not the driver holds more than some FEW values."""
    rows = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n = rows.count()
    if not n:
        return None
    place = (n - 1) * q
    first, last = math.floor(place), math.ceil(place)
    below, left = 0, n
    while left > FEW:
        at = [min(1.0, max(0.0, (k - below) / left + d / ACCURACY)) for k, d in ((first, -2), (last + 1, 2))]
        lo, hi = rows.agg(F.percentile_approx("v", F.array(*map(F.lit, at)), F.lit(ACCURACY))).first()[0]
        lower, inside = rows.agg(F.count(F.when(F.col("v") < F.lit(lo), 1)), F.count(F.when(F.col("v").between(F.lit(lo), F.lit(hi)), 1))).first()
        if inside == left or not below + lower <= first <= last < below + lower + inside:
            break
        rows, below, left = rows.where(F.col("v").between(F.lit(lo), F.lit(hi))), below + lower, inside
    values: dict[int, float] = {}
    at = below
    for v, many in rows.groupBy("v").agg(F.count("*")).orderBy("v").toLocalIterator():
        values |= {k: v for k in (first, last) if at <= k < at + many}
        at += many
        if at > last:
            break
    return values[first] if first == last else (last - place) * values[first] + (place - first) * values[last]


def _adjusted(v: Column, share: Column) -> Column:
    return F.coalesce(F.try_divide(v - share, 1 - share), F.lit(0.0))


def ranking_metrics(df: DataFrame, score: str = "score", truth: str = "y", id: str = "id") -> DataFrame:
    """One row: patn, adj_patn, ap, adj_ap, maxf1, adj_maxf1, auc for truth 1 = outlier.

    ap is the mean over ranks 1..outliers of the precision there. What is undefined (no outliers, or nothing else) is 0.
    """
    rows = df.select(F.col(id).cast("long").alias(id), F.col(score).cast("double").alias(score), F.col(truth).cast("long").alias("y"))
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("n_out"))
    placed = _place(rows, score, id).crossJoin(F.broadcast(totals))
    r, cs, n_out = F.col("rank"), F.col("cs"), F.col("n_out")
    raw = placed.agg(
        F.max("n").alias("n"), F.max("n_out").alias("n_out"),
        F.max(F.when(r == n_out, cs)).alias("hits"), F.sum(F.when(r <= n_out, cs / r)).alias("precision"), F.max(cs / (r + n_out)).alias("f"),
    )
    auc = roc_auc(rows, score, "y")
    share = F.try_divide(F.col("n_out").cast("double"), F.col("n").cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = raw.select(
        zero(F.try_divide(F.col("hits").cast("double"), F.col("n_out").cast("double"))).alias("patn"), zero(F.try_divide(F.col("precision"), F.col("n_out").cast("double"))).alias("ap"),
        zero(F.when(F.col("n_out") > 0, 2 * F.col("f"))).alias("maxf1"), share.alias("share"),
    )
    return out.crossJoin(F.broadcast(auc)).select("patn", _adjusted(F.col("patn"), F.col("share")).alias("adj_patn"), "ap", _adjusted(F.col("ap"), F.col("share")).alias("adj_ap"), "maxf1", _adjusted(F.col("maxf1"), F.col("share")).alias("adj_maxf1"), "auc")


def roc_auc(df: DataFrame, score: str = "score", truth: str = "y") -> DataFrame:
    """One row, auc: the share of (outlier, other) pairs in the right order, ties half; 0 where there are none.

    From counts by distinct score, whose running sums go over buckets and within each."""
    by = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.sum(1 - F.col(truth).cast("long")).alias("q"))
    tagged = quantile_buckets(by, "s", "_b", BUCKETS)
    sums = tagged.groupBy("_b").agg(F.sum("q").alias("_q"))
    before = sums.select("_b", F.coalesce(F.sum("_q").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_q0"))
    w = Window.partitionBy("_b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = tagged.join(F.broadcast(before), "_b").select("p", "q", (F.coalesce(F.sum("q").over(w), F.lit(0)) + F.col("_q0")).alias("below"))
    pairs = F.sum("p").cast("double") * F.sum("q").cast("double")
    return below.agg(F.coalesce(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2.0)), pairs), F.lit(0.0)).alias("auc"))


def confusion(df: DataFrame, truth: str = "y", predicted: str = "predicted") -> DataFrame:
    """(y, predicted, n)."""
    return df.groupBy(F.col(truth).alias("y"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_metrics(df: DataFrame, truth: str = "y", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy, micro and macro precision and recall; macro over the labels of both columns, 0 if undefined."""
    cells = confusion(df, truth, predicted)
    by = F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("g")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("g"))))
    each = cells.withColumn("e", by).select("e.label", (F.col("n") * F.col("e.t")).alias("t"), (F.col("n") * F.col("e.g")).alias("g"), F.when((F.col("y") == F.col("predicted")) & (F.col("e.t") == 1), F.col("n")).otherwise(0).alias("hit"))
    labels = each.groupBy("label").agg(F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("hit").alias("hit"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    accuracy = F.coalesce(F.try_divide(F.sum("hit").cast("double"), F.sum("t").cast("double")), F.lit(0.0))
    return labels.agg(accuracy.alias("accuracy"), accuracy.alias("micro_precision"), F.coalesce(F.avg(share("hit", "g")), F.lit(0.0)).alias("macro_precision"), accuracy.alias("micro_recall"), F.coalesce(F.avg(share("hit", "t")), F.lit(0.0)).alias("macro_recall"))


def adjusted_rand(df: DataFrame, a: str = "y", b: str = "predicted") -> DataFrame:
    """One row, ari: the adjusted Rand index of two partitions; 1 where both are trivial and equal."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(c.cast("double") * (c - 1) / 2.0)
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("ra"))
    columns = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("cb"))
    both = cells.agg(pairs(F.col("n")).alias("both"), F.sum("n").alias("n"))
    x = both.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(columns))
    total = F.col("n").cast("double") * (F.col("n") - 1) / 2.0
    expected = F.col("ra") * F.col("cb") / total
    return x.select(F.coalesce(F.try_divide(F.col("both") - expected, (F.col("ra") + F.col("cb")) / 2.0 - expected), F.lit(1.0)).alias("ari"))


def mean_and_deviation(results: DataFrame, by: tuple[str, ...] = ("algorithm", "rate", "metric"), value: str = "value") -> DataFrame:
    """mean and population deviation over datasets, and both as text with two decimals."""
    out = results.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.withColumn("text", F.format_string("%.2f ± %.2f", "mean", "std"))


def mean_over_datasets(results: DataFrame) -> DataFrame:
    return results.groupBy("algorithm", "rate", "metric").agg(F.avg("value").alias("value"))


def to_long(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row for each metric."""
    return wide.unpivot(keys, metrics, "metric", "value")


def to_wide(long: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return long.groupBy(*keys).pivot("metric", metrics).agg(F.first("value"))
