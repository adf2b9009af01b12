import numpy as np
import pytest
from pyspark.sql import functions as F

from vedette.operators import metrics as M
from vedette.operators import points as P
from vedette.operators import reducers as R
from vedette.operators import tasks as T


def ranked(spark, scores, y):
    return spark.createDataFrame([(i, float(s), int(t)) for i, (s, t) in enumerate(zip(scores, y, strict=True))], "id long, score double, y int")


def test_ranking_by_hand(spark):
    r = M.ranking_metrics(ranked(spark, [0.9, 0.8, 0.7, 0.6], [1, 0, 1, 0])).first().asDict()
    assert r == pytest.approx({"patn": 0.5, "adj_patn": 0, "ap": 0.75, "adj_ap": 0.5, "maxf1": 0.8, "adj_maxf1": 0.6, "auc": 0.75})


@pytest.mark.parametrize("y", [[0, 0, 0], [1, 1, 1]])
def test_ranking_without_a_contrast(spark, y):
    r = M.ranking_metrics(ranked(spark, [3, 2, 1], y)).first()
    assert r.auc == 0 and r.adj_patn == 0 and r.patn == (1.0 if y[0] else 0.0)


def test_ranking_against_plain_python(spark):
    rng = np.random.default_rng(4)
    s, y = np.round(rng.normal(size=300), 1), rng.integers(0, 2, 300)
    order = np.lexsort((np.arange(300), -s))
    cs, n = np.cumsum(y[order]), int(y.sum())
    r = M.ranking_metrics(ranked(spark, s, y)).first()
    assert r.patn == pytest.approx(cs[n - 1] / n) and r.ap == pytest.approx((cs[:n] / np.arange(1, n + 1)).sum() / n) and r.maxf1 == pytest.approx(2 * (cs / (np.arange(1, 301) + n)).max())
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert r.auc == pytest.approx(np.mean(pairs))


def test_empty_table(spark):
    r = M.ranking_metrics(ranked(spark, [], [])).first()
    assert r.auc == 0 and r.patn == 0


def test_confusion_with_a_missing_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "y int, predicted int")
    r = M.confusion_metrics(df).first()
    assert (r.accuracy, r.micro_precision, r.micro_recall) == (0.75, 0.75, 0.75)
    assert r.macro_precision == pytest.approx((2 / 3 + 0 + 1) / 3) and r.macro_recall == pytest.approx(2 / 3)


def test_adjusted_rand(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 1, 1], strict=True)), "y int, predicted int")
    assert M.adjusted_rand(df).first().ari == pytest.approx(0.324324, abs=1e-6)
    same = spark.createDataFrame([(1, 1), (1, 1)], "y int, predicted int")
    assert M.adjusted_rand(same).first().ari == 1


def test_summaries(spark):
    long = spark.createDataFrame([("a", "X", 1.0, "m", 1.0), ("b", "X", 1.0, "m", 3.0)], "dataset string, algorithm string, rate double, metric string, value double")
    r = M.mean_and_deviation(long).first()
    assert (r["mean"], r["std"], r["text"]) == (2.0, 1.0, "2.00 ± 1.00")
    assert M.to_wide(long, ["dataset"], ["m"]).orderBy("dataset").collect()[1].m == 3.0


def test_vote_ties_go_to_the_smallest_label(spark):
    refs = spark.createDataFrame([(0, [0.0], 5), (1, [2.0], 3)], "oid long, o array<double>, label int")
    rows = spark.createDataFrame([(0, [1.0])], "id long, x array<double>")
    assert T.classify(rows, refs, 2).first().predicted == 3


def test_ward_finds_clumps():
    x = np.concatenate([np.random.default_rng(i).normal(10 * i, 0.1, (8, 2)) for i in range(3)])
    labels = T.ward(x, 3)
    assert all(len(set(labels[8 * i : 8 * i + 8])) == 1 for i in range(3)) and len(set(labels)) == 3


def test_split_and_fix_rate(spark):
    df = spark.range(100).withColumn("label", (F.col("id") % 4).cast("int"))
    counts = P.stratified_split(df, "label", 0.3, 1).where("is_test").groupBy("label").count().collect()
    assert {r["count"] for r in counts} == {8}
    rows = df.select("id")
    assert P.fix_rate(rows.where("id < 10"), rows, 15, 1).count() == 15 and P.fix_rate(rows.where("id < 10"), rows, 4, 1).count() == 4


def points(spark, n=200, d=2, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


def test_weighted_draws_follow_p(spark):
    _, df = points(spark, 4)
    w = df.withColumn("w", F.element_at(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(7.0)), (F.col("id") + 1).cast("int")))
    got = {r.id: r["count"] for r in R.draws(R.uniform_p(w), 4000, 5).groupBy("id").count().collect()}
    assert 0 not in got and got[3] == pytest.approx(2800, rel=0.1) and sum(got.values()) == 4000


def test_lightweight_sums_to_one_and_handles_equal_points(spark):
    x, df = points(spark)
    p = np.array([r.p for r in R.lightweight_p(df).orderBy("id").collect()])
    q = ((x - x.mean(axis=0)) ** 2).sum(axis=1)
    assert p == pytest.approx((0.5 * q / q.sum() + 0.5 / len(x)))
    same = spark.createDataFrame([(i, [1.0]) for i in range(4)], "id long, x array<double>")
    assert [r.p for r in R.lightweight_p(same).collect()] == [0.25] * 4


def test_sdo(spark):
    x, df = points(spark, 150)
    fitted = R.SDO(k=30, x=4, seed=2).fit(df)
    n = fitted.observers.count()
    assert 0 < n <= 30 and fitted.predict(df).where("is_outlier").count() <= 15
    ready = R.SDO(observers=df.where("id < 9").select(F.col("id").alias("oid"), F.col("x").alias("o")), q=0)
    assert ready.fit(df).observers.count() == 9
    with pytest.raises(ValueError):
        R.SDO(metric="cosine")


def test_snapping_keeps_flat_columns(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 5.0]) for i in range(30)], "id long, x array<double>")
    got = R.snapped(df, 10).collect()
    assert len(got) == 3 and {r.x[1] for r in got} == {5.0}


def test_pca_size(spark):
    x, df = points(spark, 300, 3)
    assert R.pca_size(df) == R.sdo_size(300, float(np.linalg.eigvalsh(np.cov(x.T))[-1]))


def test_iterative_reducers(spark):
    x, df = points(spark, 120)
    labelled = df.withColumn("label", (F.col("x")[0] > 0).cast("int"))
    store = R.condensed(labelled, "label", 1)
    refs = store.select(F.col("id").alias("oid"), F.col("x").alias("o"), "label")
    assert store.count() < 120 and T.classify(labelled, refs, 1).where("label <> predicted").count() == 0
    assert R.kmeans_seeds(df, 5, 1).count() == 5 and R.kmeans_centres(df, 4, 1).count() == 4
    assert 2 <= R.neural_gas_nodes(df, 12, 1, epochs=12).count() <= 12 and R.gaussian_means(df, 3, 1).count() == 3


def test_digamma():
    assert R.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525890])


def test_variational_mixture_finds_clumps_and_minds_weights(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (80, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    means = np.array([r.o for r in R.bayesian_means(df, 3, 1).collect()])
    for c in ((0, 0), (6, 0), (0, 6)):
        assert np.abs(means - c).sum(axis=1).min() < 0.4
    heavy = df.withColumn("w", F.when(F.col("id") < 5, 200.0).otherwise(1.0))
    pulled = np.array([r.o for r in R.bayesian_means(heavy, 3, 1).collect()])
    assert np.abs(pulled - x[:5].mean(axis=0)).sum(axis=1).min() < 0.15


def test_ward_of_more_rows_than_a_matrix_of_distances_holds(spark):
    """ward_clusters: 5,000 rows were refused; the result is that of merging the cheapest pair again and again."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(20, 3)).repeat(2, axis=0)])
    sets = [frozenset([i]) for i in range(len(x))]
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[list(a)].mean(axis=0) - x[list(b)].mean(axis=0)) ** 2).sum()
    while len(sets) > 6:
        a, b = min(((a, b) for i, a in enumerate(sets) for b in sets[:i]), key=lambda e: cost(*e))
        sets = [s for s in sets if s not in (a, b)] + [a | b]
    got = T.ward(x, 6)
    assert {frozenset(np.flatnonzero(got == c).tolist()) for c in range(6)} == set(sets)
    many = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(5000, 2)))], "oid long, o array<double>")
    assert {r["cluster"] for r in T.ward_clusters(many, 10).collect()} == set(range(10))
