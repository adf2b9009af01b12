"""Downstream tasks on a coreset: scoring, classification, clustering, labelling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vedette.operators.fold import _matrix, slack, squares
from vedette.operators.knn import PAIRS, Search, _blocks, distances, knn, reduce_distances
from vedette.session import ship


def knn_score(df: DataFrame, refs: DataFrame, k: int = 5) -> DataFrame:
    """`df` with score: the distance to the k-th nearest reference."""
    return knn(df, refs, k).withColumn("score", reduce_distances("nn", "max")).drop("nn")


def classify(df: DataFrame, refs: DataFrame, k: int = 5, label: str = "label") -> DataFrame:
    """`df` with predicted: the majority label of the k nearest references (oid, o, label); ties go to the smallest."""
    near = knn(df.select("id", "x"), refs, k)
    votes = near.select("id", F.explode("nn.oid").alias("oid")).join(refs.select(F.col("oid").cast("long").alias("oid"), F.col(label).alias("_vote")), "oid")
    counts = votes.groupBy("id", "_vote").agg(F.count("*").alias("_n"))
    best = counts.groupBy("id").agg(F.max_by("_vote", F.struct("_n", (-F.col("_vote")).alias("_s"))).alias("predicted"))
    return df.join(best, "id")


def nearest_centroids(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, o): the mean of each label's points."""
    dims = df.select(label, F.posexplode("x").alias("dim", "v")).groupBy(label, "dim").agg(F.avg("v").alias("v"))
    return dims.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda e: e["v"]).alias("o"))


def label_centres(centres: DataFrame, df: DataFrame, label: str = "label") -> DataFrame:
    """(oid, o, label): each centre with the label of its nearest point (lowest id if tied).

    Blocks of centres pass by the points; a batch of points gives one row for each centre of the block, its best."""
    ship(df.sparkSession)
    kind = df.schema[label].dataType.simpleString()
    rows, best = df.select("id", "x", F.col(label).alias("label")), None
    for block in _blocks(centres, "oid", "o"):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, refs, _ = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                order = np.argsort(batch.column(0).to_numpy(), kind="stable")
                d = distances(refs, _matrix(batch.column(1))[order], "euclidean", 2.0)  # [centres, points]
                at = d.argmin(axis=1)
                take = pa.array(order[at])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(d[np.arange(len(ids)), at]), batch.column(0).take(take), batch.column(2).take(take)], ["oid", "d", "id", "label"])

        part = rows.mapInArrow(run, f"oid long, d double, id long, label {kind}")
        best = part if best is None else best.unionByName(part)
    if best is None:
        return centres.withColumn(label, F.lit(None).cast(kind))
    best = best.groupBy("oid").agg(F.min_by("label", F.struct("d", "id")).alias(label))
    return centres.join(best, "oid").select("oid", "o", label)


def extend_labels(df: DataFrame, labelled: DataFrame, label: str = "label") -> DataFrame:
    """`df` with predicted: the label of the nearest centre (oid, o, label)."""
    near = knn(df, labelled, 1).withColumn("oid", F.element_at("nn", 1)["oid"]).drop("nn")
    return near.join(labelled.select(F.col("oid").cast("long").alias("oid"), F.col(label).alias("predicted")), "oid").drop("oid")


#: Clusters up to which all are compared with each other directly; those of one size that are searched apart.
FEW_CLUSTERS = 4_096
MANY_OF_A_SIZE = 1_024
#: How many of a cluster's nearest are remembered.
REMEMBERED = 8


def _nearest_clusters(rows: np.ndarray, c: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """[rows, k]: for each of `rows` the clusters that cost least to merge it with (lowest number first if tied), and those
    costs; -1 and infinity where there are fewer.

    Among clusters of one size these are the nearest ones. So where there are many clusters, those of each frequent size
    are searched as references are, and only the others are compared one by one."""
    if len(c) <= FEW_CLUSTERS:
        return _nearest_among(rows, np.arange(len(c)), c, size, k)
    values, of, counts = np.unique(size, return_inverse=True, return_counts=True)
    out, cost = _nearest_among(rows, np.flatnonzero(counts[of] < MANY_OF_A_SIZE), c, size, k)
    for v in np.argsort(-counts, kind="stable")[: int((counts >= MANY_OF_A_SIZE).sum())]:
        among = np.flatnonzero(of == v)
        reach = np.sqrt(cost[:, -1] * (size[rows] + values[v]) / (size[rows] * values[v])) * (1 + 1e-9)
        found = Search(among, c[among], "euclidean", 2.0).best(c[rows], k + 1, reach)[1]  # with itself
        out, cost = _first_of(np.concatenate([out, found], axis=1), np.concatenate([cost, _costs(rows, found, c, size)], axis=1), k)
    return out, cost


def _nearest_among(rows: np.ndarray, among: np.ndarray, c: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same among some clusters only, one by one."""
    if len(among) <= k + 1:
        found = np.concatenate([np.broadcast_to(among, (len(rows), len(among))), np.full((len(rows), k), -1)], axis=1)
        return _first_of(found, _costs(rows, found, c, size), k)
    out, cost = np.empty((len(rows), k), np.int64), np.empty((len(rows), k))
    theirs, sizes = c[among], size[among]
    norms, own = np.einsum("ij,ij->i", theirs, theirs), np.einsum("ij,ij->i", c, c)
    more = slack(c.shape[1], 2 * float(own.max()))
    place = np.full(len(c), -1)
    place[among] = np.arange(len(among))
    step = max(1, PAIRS // len(among))
    for lo in range(0, len(rows), step):
        mine = rows[lo : lo + step]
        low = squares(c[mine], theirs, norms)
        low -= more
        np.maximum(low, 0, out=low)
        low *= size[mine][:, None] * sizes / (size[mine][:, None] + sizes)
        itself = np.flatnonzero(place[mine] >= 0)
        low[itself, place[mine[itself]]] = np.inf
        first = among[np.argpartition(low, k - 1, axis=1)[:, :k]]
        at, col = np.nonzero(low <= _costs(mine, first, c, size).max(axis=1)[:, None])
        exact, col = _costs(mine[at], among[col][:, None], c, size)[:, 0], among[col]
        order = np.lexsort((col, exact, at))
        best = order[np.searchsorted(at[order], np.arange(len(mine)))[:, None] + np.arange(k)]
        out[lo : lo + step], cost[lo : lo + step] = col[best], exact[best]
    return out, cost


def _costs(rows: np.ndarray, found: np.ndarray, c: np.ndarray, size: np.ndarray) -> np.ndarray:
    """[rows, columns]: what merging each row with those found for it costs; infinity for -1 and itself."""
    cost = np.full(found.shape, np.inf)
    at, col = np.nonzero((found >= 0) & (found != rows[:, None]))
    for lo in range(0, len(at), PAIRS // 16):
        a, b = at[lo : lo + PAIRS // 16], col[lo : lo + PAIRS // 16]
        cost[a, b] = _merge_cost(c, size, rows[a], found[a, b])
    return cost


def _first_of(found: np.ndarray, cost: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k cheapest of each row by (cost, number), each number once."""
    found = np.where(np.isinf(cost), -1, found)
    order = np.lexsort((found, cost), axis=1)
    found, cost = np.take_along_axis(found, order, 1), np.take_along_axis(cost, order, 1)
    again = np.zeros(found.shape, bool)
    again[:, 1:] = (found[:, 1:] == found[:, :-1]) & (found[:, 1:] >= 0)  # one number costs the same each time
    if again.any():
        return _first_of(np.where(again, -1, found), np.where(again, np.inf, cost), k)
    return found[:, :k], cost[:, :k]


def _merge_cost(c: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    gap = c[i] - c[j]
    return size[i] * size[j] / (size[i] + size[j]) * np.einsum("ij,ij->i", gap, gap)


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Labels 0..k-1 of agglomerative clustering with Ward's criterion.

    Equal rows are merged first, at no cost. Then clusters that are each other's nearest are merged, many in a round: by
    this criterion a merger brings no cluster nearer to a third, so these are the mergers of the usual order, too, which
    are then taken by rising cost until k clusters are left. For the same reason a cluster that was not among the nearest
    of another, nor any part of it, doesn't become so: a few of the nearest are remembered, and all are searched again only
    where these have gone. Memory grows with the rows, not with their square."""
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    x = np.asarray(x, float).reshape(n, -1)
    _, first, of = np.unique(x, axis=0, return_index=True, return_inverse=True)
    of = first[of.reshape(-1)]
    merged = [(0.0, int(a), i) for i, a in enumerate(of.tolist()) if a != i]  # (cost, a row of the one, a row of the other)
    name = np.sort(first)
    c, size = x[name].copy(), np.bincount(of, minlength=n)[name].astype(float)
    k_near = REMEMBERED
    lists, beyond = np.full((len(c), k_near), -1), np.full(len(c), -np.inf)  # all that are not in its list cost `beyond` or more
    near, cost, stale = np.zeros(len(c), np.int64), np.zeros(len(c)), np.ones(len(c), bool)
    while len(c) > 1:
        rows = np.flatnonzero(stale)
        found, costs = _first_of(lists[rows], _costs(rows, lists[rows], c, size), k_near)
        doubt = np.flatnonzero(~(costs[:, 0] < beyond[rows] * (1 - 1e-9)))
        if len(doubt):
            found[doubt], costs[doubt] = _nearest_clusters(rows[doubt], c, size, k_near)
            beyond[rows[doubt]] = costs[doubt, -1]
        lists[rows], near[rows], cost[rows] = found, found[:, 0], costs[:, 0]
        i = np.flatnonzero((near[near] == np.arange(len(c))) & (np.arange(len(c)) < near))
        if not len(i):  # rounding only: the cheapest pair
            i = np.array([int(cost.argmin())])
        j = near[i]
        merged += zip(cost[i].tolist(), name[i].tolist(), name[j].tolist(), strict=True)
        total = size[i] + size[j]
        c[i] = (c[i] * size[i][:, None] + c[j] * size[j][:, None]) / total[:, None]
        either = np.minimum((size[i] * beyond[i] + size[j] * beyond[j]) / total, beyond[i] + beyond[j] - cost[i])
        size[i] = total
        gone = np.zeros(len(c), bool)
        gone[j] = True
        changed = gone.copy()
        changed[i] = True
        stale = (changed | changed[near])[~gone]
        to = np.arange(len(c) + 1)
        to[-1] = -1
        to[j] = i
        both = np.concatenate([to[lists[i]], to[lists[j]]], axis=1)
        both, costs = _first_of(both, _costs(i, both, c, size), k_near + 1)
        lists[i], beyond[i] = both[:, :-1], np.minimum(either, costs[:, -1])
        place = np.append(np.cumsum(~gone) - 1, -1)
        lists = place[to[lists[~gone]]]
        c, size, name, near, cost, beyond = c[~gone], size[~gone], name[~gone], place[near[~gone]], cost[~gone], beyond[~gone]
    owner = np.arange(n)

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = int(owner[i])
        return i

    for _, a, b in sorted(merged, key=lambda m: m[0])[: max(0, n - max(1, k))]:
        a, b = sorted((root(a), root(b)))
        owner[b] = a
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


def ward_clusters(coreset: DataFrame, k: int) -> DataFrame:
    """(oid, o, cluster) of a coreset, which is the driver's memory; the work grows with the square of its rows."""
    rows = coreset.select(F.col("oid").cast("long").alias("oid"), "o").toArrow()
    rows = rows.take(np.argsort(rows.column("oid").to_numpy(), kind="stable"))
    found = ward(_matrix(rows.column("o")), k) if rows.num_rows else []
    return coreset.sparkSession.createDataFrame(rows.append_column("cluster", pa.array(found, pa.int32())), "oid long, o array<double>, cluster int")


def distinct_classes(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n)."""
    return df.groupBy(label).agg(F.count("*").alias("n"))


def per_class_sizes(df: DataFrame, rate: float, label: str = "label") -> DataFrame:
    """(label, n, size = max(int(n * rate / 100), 1))."""
    return distinct_classes(df, label).withColumn("size", F.greatest(F.floor(F.col("n") * F.lit(float(rate)) / 100.0), F.lit(1)).cast("long"))


def top_per_class(observers: DataFrame, sizes: DataFrame, label: str = "label") -> DataFrame:
    """The `size` most populous observers of each class (which one task's fold made, so one task may order them)."""
    w = Window.partitionBy(label).orderBy(F.desc("population"), F.desc("oid"))
    return observers.join(sizes.select(label, "size"), label).withColumn("_r", F.row_number().over(w)).where("_r <= size").drop("_r", "size")
