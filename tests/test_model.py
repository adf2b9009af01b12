import numpy as np
import pytest
from pyspark.sql import functions as F

from vedette.operators import points as P
from vedette.operators.knn import MODES, knn, knn_sql, nearest, reduce_distances
from vedette.operators.model import ObserverModel, flag_outliers, load, top_observers
from vedette.operators.radius import estimate_radius


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")


@pytest.fixture(scope="module")
def rows(spark):
    return vectors(spark, np.random.default_rng(0).normal(size=(120, 3)))


@pytest.mark.parametrize("d,mode,expected", [([1, 2, 3, 4, 10], "median", 3), ([1, 2, 3, 4, 10], "mean", 4), ([1, 2, 3, 4, 10], "min", 1), ([1, 2, 3, 4, 10], "max", 10), ([1, 2, 3, 4, 10], "sum", 20), ([1, 2, 3, 4, 5, 9], "median", 3.5)])
def test_modes(spark, d, mode, expected):
    df = spark.createDataFrame([([(float(v), i) for i, v in enumerate(d)],)], "nn array<struct<d double, oid long>>")
    assert df.select(reduce_distances("nn", mode)).first()[0] == expected
    with pytest.raises(ValueError):
        reduce_distances("nn", "other")


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "score double")
    flagged = flag_outliers(df, 0.1).where("is_outlier").collect()
    assert [(r.score, r.threshold) for r in flagged] == [(10.0, 9.0)]


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "chebyshev", "minkowski"])
def test_knn_is_the_plain_one(spark, rows, metric):
    refs = rows.where("id < 20").select(F.col("id").alias("oid"), F.col("x").alias("o"))
    got = {r.id: [(e.oid, round(e.d, 9)) for e in r.nn] for r in knn(rows.repartition(5), refs, 3, metric).collect()}
    want = {}
    for r in knn_sql(rows, refs, 3, metric).orderBy("id", "rank").collect():
        want.setdefault(r.id, []).append((r.oid, round(r.d, 9)))
    assert got == want


def test_knn_in_blocks_and_with_few_references(spark, rows, monkeypatch):
    refs = rows.where("id < 20").select(F.col("id").alias("oid"), F.col("x").alias("o"))
    whole = {r.id: [e.oid for e in r.nn] for r in knn(rows, refs, 4).collect()}
    monkeypatch.setattr("vedette.operators.knn.BLOCK_BYTES", 100)
    assert {r.id: [e.oid for e in r.nn] for r in knn(rows, refs, 4).collect()} == whole
    assert {len(r.nn) for r in knn(rows, refs, 50).collect()} == {20}


def test_ties_go_to_the_lowest(spark):
    refs = spark.createDataFrame([(0, [0.0]), (1, [2.0])], "oid long, o array<double>")
    assert nearest(vectors(spark, [[1]]), refs).first()["nearest"] == 0


def test_scores_are_ordered_by_mode(spark, rows):
    model = ObserverModel(radius=0.7, shuffle=False).fit(rows)
    by = {m: {r.id: r.score for r in model.outlierness(rows, 5, m).collect()} for m in MODES}
    for i in by["min"]:
        assert by["min"][i] <= by["median"][i] <= by["max"][i] and by["sum"][i] == pytest.approx(5 * by["mean"][i])
    assert sum(r.is_outlier for r in model.predict(rows, 0.1).collect()) <= 12


def test_shuffled_fit_pads_and_keeps(spark, rows, tmp_path):
    model = ObserverModel(radius=50.0, factor=0.0, max_observers=8, seed=3).fit(rows)
    got = model.observers.orderBy("oid").collect()
    assert [r.oid for r in got] == list(range(8)) and got[-1].population is None and got[-1].radius is None
    model.save(str(tmp_path / "m"))
    back = load(spark, str(tmp_path / "m"))
    assert back.params == model.params and back.radius == model.radius and back.observers.count() == 8
    assert back.get_params()["contamination"] == 0.1
    assert ObserverModel(radius=0.2, max_observers=0, shuffle=False).fit(rows).observers.count() > 8  # 0: no limit


def test_top_keeps_the_later_of_ties(spark):
    df = spark.createDataFrame([(0, i, [0.0], p, 1.0) for i, p in enumerate([3, 1, 3])], "batch int, oid int, o array<double>, population long, radius double")
    assert [(r.oid, r.population) for r in top_observers(df, 2).collect()] == [(0, 3), (1, 3)]


def test_radius(spark):
    two = vectors(spark, [[0, 0], [2, 0]])
    assert estimate_radius(two, "adtm", 1.0, 0) == 1 and estimate_radius(two, "aid", 1.0, 0) == 2
    ten = vectors(spark, np.arange(10)[:, None])
    assert np.isnan(estimate_radius(ten, "adtm", 0.05, 0, strict=True)) and estimate_radius(ten, "aid", 0.05, 0) > 0
    with pytest.raises(ValueError):
        estimate_radius(two, "other", 1.0, 0)


@pytest.mark.parametrize("bad", [[(0, None)], [(0, [1.0]), (1, [1.0, 2.0])], [(0, [float("nan")])], [(None, [1.0])], [(0, [float("inf")])]])
def test_points_are_checked(spark, bad):
    df = spark.createDataFrame([*bad, (9, [1.0])], "k long, v array<double>")
    with pytest.raises(Exception, match="not a point"):
        P.points(df, "v", "k").orderBy("id").collect()


def test_bad_parameters():
    for bad in ({"mode": "x"}, {"k": 0}, {"contamination": 2.0}, {"distance_estimation": "x"}, {"radius_scope": "x"}, {"chunksize": 0}):
        with pytest.raises(ValueError):
            ObserverModel(**bad)


def test_shuffle_is_a_permutation_with_its_labels(spark):
    df = spark.range(500).withColumn("label", F.col("id") * 2)
    got = P.shuffled(df, 1).collect()
    assert sorted(r.seq for r in got) == list(range(500)) and all(r.label == 2 * r.id for r in got)
    assert [r.seq for r in got] != [r.id for r in got]
