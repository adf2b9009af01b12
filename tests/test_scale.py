"""What must not depend on how the data lie: ties, one label for all, far ids, and what small limits force."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vedette.operators import classes as C
from vedette.operators import metrics as M
from vedette.operators import points as P
from vedette.operators import reducers as R
from vedette.operators.model import ONE_BATCH, ObserverModel, flag_outliers
from vedette.operators.radius import radius_by_group
from vedette.session import scratch, written


def key(seed, i):
    import hashlib

    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


@pytest.mark.parametrize("kind", ["constant", "ties", "normal", "steep", "two"])
@pytest.mark.parametrize("few", [10, 100_000])
def test_exact_quantile(spark, monkeypatch, kind, few):
    monkeypatch.setattr(M, "FEW", few)
    rng = np.random.default_rng(3)
    x = {"constant": np.full(500, 2.5), "ties": rng.integers(0, 5, 700).astype(float), "normal": rng.normal(size=901), "steep": 10.0 ** rng.integers(-200, 200, 400), "two": np.array([1.0, 2.0])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    for q in (0.0, 0.3, 0.9, 1.0):
        assert M.quantile(df, "v", q) == pytest.approx(np.quantile(x, q), rel=1e-12)
    assert M.quantile(df.where("false"), "v", 0.5) is None


def test_flags_of_a_constant_score(spark):
    scored = flag_outliers(spark.range(300).withColumn("score", F.lit(1.5)), 0.1)
    assert scored.where("is_outlier").count() == 0 and scored.count() == 300


@pytest.mark.parametrize("buckets", [4, 512])
def test_ranks_of_tied_scores(spark, monkeypatch, buckets):
    monkeypatch.setattr(M, "BUCKETS", buckets)
    rng = np.random.default_rng(5)
    for score in (np.full(400, 1.0), np.where(rng.random(400) < 0.7, 0.5, rng.random(400)), np.where(rng.random(400) < 0.3, np.nan, 1.0)):
        ids = rng.permutation(400) * 7 + 2**60 * (np.arange(400) == 3)
        df = spark.createDataFrame([(int(i), float(s), int(i % 3 == 0)) for i, s in zip(ids, score, strict=True)], "id long, score double, y long")
        got = {r.id: (r["rank"], r.cs) for r in M._place(df, "score", "id").collect()}
        order = sorted(range(400), key=lambda n: (-math.inf if math.isnan(score[n]) else -score[n], ids[n]))
        total, want = 0, {}
        for place, n in enumerate(order):
            total += int(ids[n] % 3 == 0)
            want[int(ids[n])] = (place + 1, total)
        assert got == want


def test_numbering_and_draws_with_a_far_id(spark):
    ids = [*range(100, 160), 2**60, -(2**60)]
    df = spark.createDataFrame([(i, [float(n)], 1) for n, i in enumerate(ids)], "id long, x array<double>, label int")
    assert [r.id for r in P.in_order(df).orderBy("seq").collect()] == sorted(ids)
    assert max(r["count"] for r in P.quantile_buckets(df, "id", "b").groupBy("b").count().collect()) <= 4
    assert R.draws(df, 40, 3, None).count() == 40
    by = {r.id: r.seq for r in P.shuffled(df, 5, by="label").collect()}
    assert by == {i: n for n, i in enumerate(sorted(ids, key=lambda i: (key(5, i), i)))}


def test_split_and_radius_of_one_label(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], None if i % 10 == 0 else "a") for i in range(500)], "id long, x array<double>, label string")
    rows = P.stratified_split(df, "label", 0.3, 9).collect()
    assert len(rows) == 500
    for label in ("a", None):
        mine = sorted((r for r in rows if r.label == label), key=lambda r: (key(9, r.id), r.id))
        assert [r.is_test for r in mine] == [n < int(len(mine) * 0.3 + 0.5) for n in range(len(mine))]
    one = df.where("label = 'a'")
    chosen = sorted(range(500), key=lambda i: (key(4, i), i))
    chosen = [i for i in chosen if i % 10][: int(450 * 0.1)]
    x = np.array([[i % 7, i % 3] for i in chosen], float)
    assert radius_by_group(one, "label", 0.1, 4).first().radius == pytest.approx(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1)).mean())
    gaps = [math.dist(a, b) for n, a in enumerate(x) for b in x[n + 1 :]]
    assert radius_by_group(one, "label", 0.1, 4, 2.0, "aid").first().radius == pytest.approx(2 * np.mean(gaps))


@pytest.mark.parametrize("few", [5, 100_000])
def test_samples_at_any_limit(spark, monkeypatch, few):
    monkeypatch.setattr(P, "FEW", few)
    df = spark.range(3000)
    order = sorted(range(3000), key=lambda i: (key(2, i), i))
    for size in (0, 1, 7, 1200, 3000, 9000):
        assert sorted(r.id for r in P.sample(df, size, 2).collect()) == sorted(order[:size])


def test_condensed_set_is_consistent(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(400, 2)), 1)
    rows = [(i, [float(v) for v in p], int(rng.integers(0, 3))) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int")
    kept = {r.id: r for r in R.condensed(df, "label", 1, per_round=5).collect()}
    where = {}
    for i, p, label in rows:
        where.setdefault(tuple(p), set()).add(label)
    for i, p, label in rows:
        near = min(kept.values(), key=lambda r: (math.dist(r.x, p), r.id))
        assert near.label == label or len(where[tuple(p)]) > 1
    assert 3 <= len(kept) < 400 and R.condensed(df.where("false"), "label", 1).count() == 0


def test_weights_of_seeds(spark):
    df = spark.createDataFrame([(i, [float(i)], 0.0 if i < 90 else 1.0) for i in range(100)], "id long, x array<double>, w double")
    assert all(r.o[0] >= 90 for r in R.kmeans_seeds(df, 5, 3).collect()) and R.kmeans_seeds(df.where("w < 0"), 5, 3).count() == 0


@pytest.mark.parametrize("name", sorted(C.BY_CLASS))
def test_reducers_by_class(spark, name):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(10 * (i % 2), 1, 3)], "ab"[i % 2]) for i in range(120)] + [(999, [50.0, 50.0, 50.0], "c")]
    df = spark.createDataFrame(rows, "id long, x array<double>, label string")
    got = C.BY_CLASS[name](df, C.class_sizes(df, 10.0), 3).collect()
    sizes = {label: sum(r.label == label for r in got) for label in "abc"}
    assert len({r.oid for r in got}) == len(got) and set(sizes.values()) - {0}
    if name in ("OBS", "RS", "KMC", "WGM"):
        assert sizes == {"a": 6, "b": 6, "c": 1}
    for r in got:
        assert abs(np.mean(r.o) - {"a": 0, "b": 10, "c": 50}[r.label]) < 4


def test_a_batch_has_a_bound(spark, monkeypatch):
    rows = P.points(spark.range(50).select(F.col("id"), F.array(F.col("id").cast("double")).alias("v")), "v", "id")
    monkeypatch.setattr("vedette.operators.model.ONE_BATCH", 20)
    with pytest.raises(ValueError):
        ObserverModel(radius=1.0).fit(rows)
    assert ObserverModel(radius=1.0, chunksize=10).fit(rows).observers.count() > 0 and ONE_BATCH > 10**6


def test_scratch_keeps_what_it_is_told(spark):
    with scratch(spark) as keep:
        first = written(spark.range(5), "gone")
        kept = keep(written(first.where("id > 2"), "kept"))
    assert kept.count() == 2
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        first.count()


def test_folds_of_many_observers_are_those_point_by_point(monkeypatch):
    """flagship, observer_labels, outlierness_*: blocks of points give the bits that single points give, ties included."""
    import numpy as np

    from vedette.operators import fold

    rng = np.random.default_rng(0)
    for d, radius in ((1, 0.01), (2, 0.3), (64, 9.0)):
        x = np.round(rng.normal(size=(1500, d)) * 3, 1)
        monkeypatch.setattr(fold, "DIRECT", 1 << 60)
        want = fold.Fold(radius).feed(x).rows()
        monkeypatch.setattr(fold, "DIRECT", 0)
        calls = []
        monkeypatch.setattr(fold, "squares", lambda *a, inner=fold.squares: calls.append(1) or inner(*a))
        got = fold.Fold(radius).feed(x).rows()
        assert calls and all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))


def test_a_search_compares_few_pairs(monkeypatch):
    """knn_rows: boxes and matrix products give what all pairs give, with equal distances and numbers in any order; the
    exact distances of a small part of the pairs are worked out."""
    import numpy as np

    from vedette.operators import knn

    rng = np.random.default_rng(1)
    for d in (1, 2, 6):
        refs, x, ids = np.round(rng.normal(size=(4000, d)) * 9, 1), np.round(rng.normal(size=(3000, d)) * 9, 1), rng.permutation(4000)
        full = knn.distances(x, refs, "euclidean", 2.0)
        order = np.lexsort((np.broadcast_to(ids, full.shape), full), axis=1)[:, :3]
        pairs, inner = [], knn.distances
        monkeypatch.setattr(knn, "distances", lambda a, b, *more, inner=inner: pairs.append(len(a) * len(b)) or inner(a, b, *more))
        got_d, got_o = knn.Search(ids, refs, "euclidean", 2.0).best(x, 3, np.full(3000, np.inf))
        monkeypatch.setattr(knn, "distances", inner)
        assert np.array_equal(got_d, np.take_along_axis(full, order, 1)) and np.array_equal(got_o, ids[order])
        assert sum(pairs) < 3000 * 4000 / 2


def test_a_neural_gas_looks_at_the_winner_s_edges_only(monkeypatch):
    """by_class_gng: with more nodes than are compared one by one, matrix products tell the nearest two; the nodes are
    those of comparing all (slack without end)."""
    import numpy as np

    from vedette.operators import reducers as R

    x = np.round(np.random.default_rng(4).normal(size=(500, 8)), 1)
    calls, inner = [], R.slack
    monkeypatch.setattr(R, "slack", lambda *a: calls.append(1) or inner(*a))
    got = R.neural_gas(x, 80, 7, 20)
    monkeypatch.setattr(R, "slack", lambda *a: float("inf"))
    want = R.neural_gas(x, 80, 7, 20)
    assert len(got) == 80 and calls and np.array_equal(got, want)


def test_nearest_centres_of_a_batch_take_no_table_of_all_differences():
    """experiment_clustering, _hierarchical, _anomaly: 4,000 points and 500 centres took 1 GB, 10,000 and 1,025 5 GB."""
    import tracemalloc

    import numpy as np

    from vedette.operators import reducers as R

    rng = np.random.default_rng(5)
    x, centres = rng.normal(size=(4000, 64)), rng.normal(size=(500, 64))
    tracemalloc.start()
    r = R.one_hot(x, centres, np.full(4000, 2.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and (r.sum(axis=1) == 2).all()
    assert (r[:50].argmax(axis=1) == ((x[:50, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_mixtures_of_classes_one_by_one(spark, monkeypatch):
    """by_class_wgm: the driver holds the sums of a bounded number of classes."""
    import numpy as np

    from vedette.operators import classes as C

    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, (rng.normal(size=2) + 20 * (i % 3)).tolist(), i % 3) for i in range(90)], "id long, x array<double>, label int")
    calls, inner = [], C._mixture
    monkeypatch.setattr(C, "_mixture", lambda *a: calls.append(1) or inner(*a))
    monkeypatch.setattr(C, "AT_ONCE", 1)
    found = C.mixture(rows, C.class_sizes(rows, 10.0), 7, steps=3).collect()
    assert len(calls) == 3 and len({r.oid for r in found}) == len(found) == 9
    assert all(abs(v - 20 * r.label) < 5 for r in found for v in r.o)


def test_points_of_one_file_are_many_tasks(spark, tmp_path, monkeypatch):
    """knn_rows: 900,000 customers are one file of 19 MB, which was the work of one or two tasks."""
    from vedette import session
    from vedette.operators.knn import knn

    spark.range(3000).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("x")).coalesce(1).write.parquet(f"{tmp_path}/one")
    rows = spark.read.parquet(f"{tmp_path}/one")
    refs = rows.where("id % 7 = 0").select(F.col("id").alias("oid"), F.col("x").alias("o"))
    want = {r.id: r.nn for r in knn(rows, refs, 3).collect()}
    monkeypatch.setattr(session, "SPREAD", (0, 2**60))
    found = knn(rows, refs, 3).withColumn("task", F.spark_partition_id()).collect()
    assert {r.id: r.nn for r in found} == want and len(found) == 3000 and len({r.task for r in found}) > 4


def test_boxes_of_a_large_batch_and_few_candidates(monkeypatch):
    """knn_rows: of the references in reach only those as near as a point's own k-th go on to the exact distances."""
    from vedette.operators import knn

    rng = np.random.default_rng(2)
    x = np.repeat(np.stack([np.round(rng.random(800) * 11, 2), rng.integers(0, 25, 800)], axis=1), 6, axis=0)
    ids, pairs, inner = rng.permutation(len(x)), [], knn.Search._exact
    monkeypatch.setattr(knn.Search, "_exact", lambda self, a, at, col: pairs.append(len(at)) or inner(self, a, at, col))
    for k in (1, 3, 9):
        full = knn.distances(x[:1500], x, "euclidean", 2.0)
        order = np.lexsort((np.broadcast_to(ids, full.shape), full), axis=1)[:, :k]
        got_d, got_o = knn.Search(ids, x, "euclidean", 2.0).best(x[:1500], k, np.full(1500, np.inf))
        assert np.array_equal(got_d, np.take_along_axis(full, order, 1)) and np.array_equal(got_o, ids[order])
    assert sum(pairs) < 3 * 1500 * 30


def test_rounds_of_the_condensed_set(spark, monkeypatch):
    """cnn_coreset: the rounds in one pass each add the rows that comparing all pairs would add, one table is kept at a
    time, and the votes look for neighbours once."""
    from vedette import session
    from vedette.operators import tasks as T

    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(300, 2)), 1)
    label = [None if i % 13 == 0 else "abc"[rng.integers(0, 3)] for i in range(300)]
    order = sorted(range(300), key=lambda i: (key(3, i), i))
    new, d, near, chosen, size = {label[i]: i for i in reversed(order)}.values(), np.full(300, np.inf), np.full(300, -1), set(), 0
    while new:
        size += len(new)
        for i in range(300):
            best = min((math.dist(x[i], x[j]), j) for j in new)
            if best[0] < d[i] or best[0] == d[i] and best[1] < near[i]:
                d[i], near[i] = best
            chosen |= {i} if best == (0, i) else set()
        new = [i for i in order if label[near[i]] != label[i] and i not in chosen and d[i] > 0][: max(5, size)]
    df = spark.createDataFrame([(i, x[i].tolist(), label[i]) for i in range(300)], "id long, x array<double>, label string")
    rows, tables, inner = df, [], session._delete
    monkeypatch.setattr(session, "_delete", lambda spark, paths: tables.append([p for p in paths if "/condensed-" in p]) or inner(spark, paths))
    monkeypatch.setattr("vedette.operators.points.BUCKETS", 16)
    assert {r.id for r in R.condensed(rows, "label", 3, per_round=5).collect()} == chosen
    assert len(tables) > 3 and max(len(t) for t in tables) <= 2
    votes = T.classify(df.withColumn("label", F.lit(1)), df.select(F.col("id").alias("oid"), F.col("x").alias("o"), F.lit(1).alias("label")), 1)
    assert votes._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 and votes.count() == 300


def test_one_condensed_set_for_all_rates(spark, monkeypatch):
    """experiment_classification: the set does not depend on the rate, so it is not built for each."""
    from vedette.plans import experiments

    df = spark.createDataFrame([(i, [float(i % 2) * 9, float(i % 5)], i % 2) for i in range(60)], "id long, x array<double>, label int")
    calls = []
    monkeypatch.setattr(R, "condensed", lambda rows, label, seed: calls.append(1) or rows.where("id % 3 = 0"))
    cells = experiments.classification("few", df, ("CNN",), (20.0, 50.0)).collect()
    assert calls == [1] and {(r.algorithm, r.rate) for r in cells} == {("BASELINE", 100.0), ("CNN", 20.0), ("CNN", 50.0)}
    assert all(r.value == 1.0 for r in cells if r.metric == "accuracy")


def test_cells_side_by_side_find_whole_modules():
    """experiment_anomaly, _clustering: where nothing had used pyspark.ml before, the first threads imported its modules at
    once and found them half made."""
    import subprocess
    import sys

    code = """
import sys, threading
from vedette.operators import points, reducers
from vedette.session import side_by_side
assert "pyspark.ml" not in sys.modules
failed, at_once = [], threading.Barrier(6)
def cell(i):
    at_once.wait()
    try:
        if i % 2:
            from pyspark.ml.feature import Bucketizer
        else:
            from pyspark.ml.clustering import KMeans
            from pyspark.ml.functions import array_to_vector
    except Exception as e:
        failed.append(repr(e))
with side_by_side():
    ready = "pyspark.ml.clustering" in sys.modules
    threads = [threading.Thread(target=cell, args=(i,)) for i in range(6)]
    [t.start() for t in threads], [t.join() for t in threads]
print(ready, failed)
"""
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[1]).stdout == "True []\n"


def test_cells_of_one_task_begin_first(spark):
    """experiment_clustering: the neural gas of the highest rate came last and ran on alone; the rows keep their order."""
    from vedette.plans import experiments

    begun = []
    cell = lambda name, rate: begun.append((name, rate)) or {"rand": rate}
    found = experiments._cells(spark.range(1), "d", ("RS", "GNG"), (1.0, 10.0), cell, 1).collect()
    assert begun[:2] == [("GNG", 10.0), ("GNG", 1.0)] and begun[2:] == [("BASELINE", 100.0), ("RS", 1.0), ("RS", 10.0)]
    assert [(r.algorithm, r.value) for r in found] == [("BASELINE", 100.0), ("RS", 1.0), ("GNG", 1.0), ("RS", 10.0), ("GNG", 10.0)]


def test_a_mixture_is_updated_few_components_at_a_time():
    """experiment_clustering, _anomaly: covariances of all components at once took five times their sums on the driver."""
    import tracemalloc

    d, k = 32, 400
    x = np.random.default_rng(1).normal(size=(k, d))
    mixture = R.VariationalMixture(x.mean(axis=0), np.cov(x.T), k)
    second = np.ones(k)[:, None, None] * x[:, :, None] * x[:, None, :]
    tracemalloc.start()
    mixture.update(np.ones(k), x, second)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * second.nbytes
    for j in (0, 31, 32, 399):
        gap = x[j] - mixture.prior_mean
        covariance = (mixture.prior_covariance + 1e-6 * np.eye(d) + 0.5 * np.outer(gap, gap)) / (d + 1)
        assert np.allclose(mixture.whiten[j] @ covariance @ mixture.whiten[j].T, np.eye(d))


@pytest.mark.parametrize("kind", ["normal", "grid", "copies"])
def test_ward_remembers_the_nearest(monkeypatch, kind):
    """experiment_hierarchical: every round compared half of the clusters with all; the clusters are those of merging the
    cheapest pair again and again."""
    from vedette.operators import tasks as T

    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=(300, 4)), "grid": rng.integers(0, 5, size=(300, 3)) + 0.001 * rng.random((300, 3)), "copies": rng.normal(size=(40, 4))[rng.integers(0, 40, 300)]}[kind]
    c, size, members = x.copy(), np.ones(300), [{i} for i in range(300)]
    while len(c) > 7:
        cost = (size[:, None] * size / (size[:, None] + size)) * ((c[:, None] - c[None]) ** 2).sum(axis=2)
        np.fill_diagonal(cost, np.inf)
        i, j = sorted(divmod(int(cost.argmin()), len(c)))
        c[i], size[i], members[i] = (size[i] * c[i] + size[j] * c[j]) / (size[i] + size[j]), size[i] + size[j], members[i] | members[j]
        c, size = np.delete(c, j, axis=0), np.delete(size, j)
        del members[j]
    monkeypatch.setattr(T, "FEW_CLUSTERS", 16)
    monkeypatch.setattr(T, "MANY_OF_A_SIZE", 12)
    monkeypatch.setattr(T, "REMEMBERED", 4)
    searched, inner = [], T._nearest_clusters
    monkeypatch.setattr(T, "_nearest_clusters", lambda rows, *a: searched.append(len(rows)) or inner(rows, *a))
    labels = T.ward(x, 7)
    assert {frozenset(np.flatnonzero(labels == v).tolist()) for v in range(7)} == {frozenset(m) for m in members}
    assert sum(searched) < 3 * len(np.unique(x, axis=0))
