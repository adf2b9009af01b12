"""The registered queries of the engine: each applies an operator to a whole table of the fixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vedette.functions.columns import rounded
from vedette.operators import classes as C
from vedette.operators import metrics as M
from vedette.operators import points as P
from vedette.operators import reducers as R
from vedette.operators import tasks as T
from vedette.operators.fold import fit_groups
from vedette.operators.knn import knn, nearest, reduce_distances
from vedette.operators.model import ObserverModel, limited, top_observers
from vedette.operators.radius import estimate_radius, radius_by_group
from vedette.plans import experiments
from vedette.session import shared_dir, ship, written

SEED = 7
RADIUS = 0.95
FACTOR = 0.1
#: Cells of an experiment that run side by side.
AT_ONCE = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.points(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", ["label"])


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dimensions of similar size: account balance and nation."""
    df = table(spark, sf_dir, "customer")
    df = df.select("c_custkey", (F.col("c_acctbal") / 1000.0).alias("a"), F.col("c_nationkey").cast("double").alias("b"), (F.col("c_acctbal") + 1000.0).alias("w"))
    return P.points(df, ["a", "b"], "c_custkey", ["w"])


def sampled(rows: DataFrame, share: float) -> DataFrame:
    """(oid, o): a seeded sample of the rows, as references or centres."""
    return P.sample(rows, max(1, int(rows.count() * share)), SEED).select(F.col("id").alias("oid"), F.col("x").alias("o"))


def digest(observers: DataFrame, *keys: str) -> DataFrame:
    total = F.aggregate("o", F.lit(0.0), lambda s, v: s + v)
    return observers.select(*keys, F.col("oid").cast("long").alias("oid"), F.col("population").cast("long").alias("population"), rounded("radius", 9).alias("radius"), rounded(F.col("o")[0], 9).alias("first"), rounded(total, 9).alias("total"))


def fitted(spark: SparkSession, sf_dir: str, **params: object) -> DataFrame:
    given = {"radius": RADIUS, "factor": FACTOR, "shuffle": False, "seed": SEED} | params
    return ObserverModel(**given).fit(embeddings(spark, sf_dir)).observers


# Radius


@query
def radius_adtm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(estimate_radius(embeddings(spark, sf_dir), "adtm", 0.05, SEED),)], "r double").select(rounded("r").alias("radius"))


@query
def radius_aid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(estimate_radius(embeddings(spark, sf_dir), "aid", 0.05, SEED, beta=2.0),)], "r double").select(rounded("r").alias("radius"))


@query
def radius_adtm_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radius_by_group(embeddings(spark, sf_dir), "label", 0.1, SEED).select("label", rounded("radius").alias("radius"))


# Fit


@query
def fit_fixed_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(fitted(spark, sf_dir))


@query
def fit_estimated_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(fitted(spark, sf_dir, radius=None))


@query
def fit_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(fitted(spark, sf_dir, shuffle=True))


@query
def fit_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(fitted(spark, sf_dir, alpha=0.5))


@query
def fit_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(fitted(spark, sf_dir, chunksize=120), "batch")


@query
def fit_batch_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(fitted(spark, sf_dir, chunksize=120, radius=None, radius_scope="batch"), "batch")


@query
def fit_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(fit_groups(P.in_order(embeddings(spark, sf_dir)), "label", RADIUS, FACTOR), "label")


@query
def fit_customer_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(ObserverModel(radius=3.0, shuffle=False).fit(customers(spark, sf_dir)).observers)


@query
def fit_events_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = P.points(table(spark, sf_dir, "events").where("value is not null"), ["value"], "event_id", ["event_type"])
    return digest(fit_groups(P.in_order(df), "event_type", 10.0, FACTOR), "event_type")


@query
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = P.in_order(embeddings(spark, sf_dir))
    return P.with_batches(df, df.count(), 120).groupBy("batch").agg(F.count("*").alias("n"))


@query
def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.shuffled(embeddings(spark, sf_dir), SEED).select("id", "seq", "label")


@query
def top_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(top_observers(fitted(spark, sf_dir), 20))


@query
def pad_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(limited(fitted(spark, sf_dir, radius=1.2), embeddings(spark, sf_dir), 300, SEED))


@query
def observer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(embeddings(spark, sf_dir), fitted(spark, sf_dir)).select("id", F.col("nearest").alias("oid"), rounded("distance").alias("distance"))


@query
def observer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(embeddings(spark, sf_dir), fitted(spark, sf_dir)).groupBy(F.col("nearest").alias("oid")).agg(F.count("*").alias("n"))


def _outlierness(mode: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = knn(embeddings(spark, sf_dir), fitted(spark, sf_dir), 6)
        return found.select("id", rounded(reduce_distances("nn", mode)).alias("score"))

    run.__name__ = f"outlierness_{mode}"
    query(run)


for _mode in ("median", "mean", "max", "min", "sum"):
    _outlierness(_mode)


@query
def predict_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    return ObserverModel(radius=RADIUS, shuffle=False).fit(rows).predict(rows, 0.1).select("id", rounded("score").alias("score"), "is_outlier")


@query
def knn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir)
    near = knn(rows, sampled(rows, 0.1), 3).select("id", F.posexplode("nn").alias("rank", "e"))
    return near.select("id", (F.col("rank") + 1).alias("rank"), "e.oid", rounded("e.d").alias("d"))


@query
def get_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(ObserverModel(radius=RADIUS).get_params().items())], "name string, value string")


# Weighted coresets


@query
def coreset_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coreset(R.uniform_p(embeddings(spark, sf_dir)), 50, SEED).select("draw", "id", rounded("weight").alias("weight"))


@query
def coreset_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coreset(R.uniform_p(customers(spark, sf_dir)), 100, SEED).select("draw", "id", rounded("weight").alias("weight"))


@query
def lightweight_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lightweight_p(customers(spark, sf_dir)).select("id", rounded("p", 12).alias("p"))


@query
def coreset_lightweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coreset(R.lightweight_p(embeddings(spark, sf_dir).select("id", "x")), 50, SEED).select("draw", "id", rounded("weight", 4).alias("weight"))


@query
def sensitivity_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir)
    return R.sensitivity_p(rows, R.kmeans_seeds(rows, 6, SEED)).select("id", rounded("p", 12).alias("p"))


# Sparse data observers


def _sdo(spark: SparkSession, sf_dir: str, **more: object) -> tuple[DataFrame, R.SDO, DataFrame]:
    rows, params = embeddings(spark, sf_dir), R.SDO(**({"k": 60, "seed": SEED} | more))
    return rows, params, written(params.drawn(rows), "sdo")


@query
def sdo_size_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(R.pca_size(customers(spark, sf_dir)),)], "k long")


@query
def sdo_hbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.snapped(customers(spark, sf_dir), 20).select("id", rounded(F.col("x")[0]).alias("a"), rounded(F.col("x")[1]).alias("b"))


@query
def sdo_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, drawn = _sdo(spark, sf_dir)
    return drawn.select("oid", rounded(F.col("o")[0]).alias("first"))


@query
def sdo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, params, drawn = _sdo(spark, sf_dir)
    return params.counts(rows, drawn).select("oid", "n")


@query
def sdo_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, params, drawn = _sdo(spark, sf_dir)
    return params.active(params.counts(rows, drawn)).select("oid", "n")


@query
def sdo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, params, _ = _sdo(spark, sf_dir)
    return params.fit(rows).scores(rows).select("id", rounded("score").alias("score"))


@query
def sdo_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, params, _ = _sdo(spark, sf_dir)
    return R.fit_predict(params, rows).select("id", "is_outlier")


def _sdo_metric(metric: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, params, drawn = _sdo(spark, sf_dir, metric=metric)
        return R.FittedSDO(params, drawn).scores(rows).select("id", rounded("score").alias("score"))

    run.__name__ = f"sdo_metric_{metric}"
    query(run)


for _metric in ("cityblock", "chebyshev", "minkowski"):
    _sdo_metric(_metric)


# Ranking and confusion


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the fifth nearest of a sample; label 0 counts as the outliers."""
    rows = embeddings(spark, sf_dir)
    return T.knn_score(rows, sampled(rows, 0.2)).select("id", rounded("score").alias("score"), (F.col("label") == 0).cast("int").alias("y"))


@query
def ad_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)


@query
def ad_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.ranking_metrics(written(_ranked(spark, sf_dir), "ranked"))
    return found.select(*(rounded(c).alias(c) for c in found.columns))


@query
def ad_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents ranked by length."""
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return M.roc_auc(df.select(F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("y"))).select(rounded("auc").alias("auc"))


def _classified(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    split = P.stratified_split(embeddings(spark, sf_dir), "label", 0.3, SEED)
    refs = split.where("not is_test").select(F.col("id").alias("oid"), F.col("x").alias("o"), "label")
    return T.classify(split.where("is_test").select("id", "x", F.col("label").alias("y")), refs, k).select("id", "y", "predicted")


@query
def knn1_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, 1)


@query
def knn5_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, 5)


@query
def clf_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(_classified(spark, sf_dir, 5))


@query
def clf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.confusion_metrics(_classified(spark, sf_dir, 5))
    return found.select(*(rounded(c).alias(c) for c in found.columns))


@query
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    found = M.confusion_metrics(df.select(F.col("quality").alias("y"), (F.col("n_chars") > 500).cast("int").alias("predicted")))
    return found.select(*(rounded(c).alias(c) for c in found.columns))


# Clustering tasks


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(embeddings(spark, sf_dir), 0.02)


@query
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.nearest_centroids(embeddings(spark, sf_dir)).select("label", F.posexplode("o").alias("dim", "v")).select("label", F.col("dim").cast("long").alias("dim"), rounded("v").alias("v"))


@query
def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = R.lloyd_step(embeddings(spark, sf_dir), _centres(spark, sf_dir))
    return moved.select("oid", rounded(F.col("o")[0]).alias("first"), rounded(F.aggregate("o", F.lit(0.0), lambda s, v: s + v)).alias("total"))


@query
def centre_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = written(R.lloyd_step(embeddings(spark, sf_dir), _centres(spark, sf_dir)), "centres")
    return T.label_centres(moved, embeddings(spark, sf_dir)).select("oid", "label")


def _extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = written(R.lloyd_step(embeddings(spark, sf_dir), _centres(spark, sf_dir)), "centres")
    rows = embeddings(spark, sf_dir)
    return T.extend_labels(rows, written(T.label_centres(moved, rows), "labelled")).select("id", "label", "predicted")


@query
def label_extender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extended(spark, sf_dir)


@query
def ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.adjusted_rand(_extended(spark, sf_dir), "label").select(rounded("ari").alias("ari"))


# Splits and sizes


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))
    return P.stratified_split(df, "label", 0.3, SEED).select("id", "label", "is_test")


@query
def fix_rate_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).select("id", "x", "label")
    return P.fix_rate(P.sample(rows, 30, SEED + 1), rows, 45, SEED).select("id", "label")


@query
def fix_rate_less(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).select("id", "x", "label")
    return P.fix_rate(P.sample(rows, 30, SEED + 1), rows, 12, SEED).select("id", "label")


@query
def train_test_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vedette.sources.arrays import union_train_test

    part = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), rounded("s_acctbal").alias("v"))
    return union_train_test(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), rounded("c_acctbal").alias("v")), part)


@query
def coreset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.createDataFrame([(r,) for r in experiments.RATES], "rate double")
    sizes = T.distinct_classes(embeddings(spark, sf_dir)).crossJoin(F.broadcast(rates))
    return sizes.select("label", "rate", F.greatest(F.floor(F.col("n") * F.col("rate") / 100.0), F.lit(1)).cast("long").alias("size"))


@query
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.distinct_classes(embeddings(spark, sf_dir))


# Summaries


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics by year and status, in the shape of experiment results."""
    o = table(spark, sf_dir, "orders")
    by = o.groupBy(F.year("o_orderdate").cast("string").alias("dataset"), F.col("o_orderstatus").alias("algorithm"), F.col("o_orderpriority").alias("rate"))
    return by.agg(F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("max_price"), F.count("*").cast("double").alias("n"))


@query
def cube_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.to_long(_results(spark, sf_dir), ["dataset", "algorithm", "rate"], ["mean_price", "max_price", "n"]).withColumn("value", rounded("value", 4))


@query
def summary_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = M.to_long(_results(spark, sf_dir), ["dataset", "algorithm", "rate"], ["mean_price", "max_price", "n"])
    return M.mean_and_deviation(long).select("algorithm", "rate", "metric", rounded("mean", 4).alias("mean"), rounded("std", 4).alias("std"))


@query
def mean_over_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = M.to_long(_results(spark, sf_dir), ["dataset", "algorithm", "rate"], ["mean_price", "max_price", "n"])
    return M.mean_over_datasets(long).withColumn("value", rounded("value", 4))


# Iterative reducers: what must hold of their results, by reducer and class where there are such


def _within(centres: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """One row: whether there are 1 to k centres, each inside the rows' bounding box, and whether the rows' mean squared
    distance to the nearest is below that to their mean."""
    centres = written(centres.select(F.col("oid").cast("long").alias("oid"), "o"), "centres")
    box = rows.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.var_pop("v").alias("spread"))
    inside = centres.select(F.posexplode("o").alias("dim", "v")).join(box, "dim").agg(F.min(F.col("v").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9)).alias("inside"))
    cost = nearest(rows, centres).agg(F.avg(F.pow("distance", F.lit(2.0))).alias("cost"))
    count = centres.agg(F.count("*").between(1, k).alias("counted"))
    x = count.crossJoin(F.broadcast(inside)).crossJoin(F.broadcast(cost)).crossJoin(F.broadcast(box.agg(F.sum("spread").alias("spread"))))  # a row each
    return x.select("counted", "inside", (F.col("cost") < F.col("spread")).alias("closer"))


@query
def kmeans_coreset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    return _within(R.kmeans_centres(rows, 10, SEED), rows, 10)


@query
def kmeans_plus_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = R.kmeans_seeds(customers(spark, sf_dir), 6, SEED)
    return seeds.select("oid", rounded(F.col("o")[0]).alias("a"), rounded(F.col("o")[1]).alias("b"))


@query
def gmm_coreset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir)
    return _within(R.gaussian_means(rows, 6, SEED), rows, 6)


@query
def bayesian_coreset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir)
    return _within(R.bayesian_means(rows, 6, SEED), rows, 6)


@query
def gng_coreset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    return _within(R.neural_gas_nodes(rows, 25, SEED), rows, 25)


@query
def cnn_coreset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its label and that of its nearest in the condensed set, which must be the same."""
    rows = embeddings(spark, sf_dir)
    kept = written(R.condensed(rows, "label", SEED).select(F.col("id").alias("oid"), F.col("x").alias("o"), "label"), "condensed")
    return T.classify(rows, kept, 1).select("id", "label", "predicted")


@query
def ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten clusters of all observers."""
    found = T.ward_clusters(fitted(spark, sf_dir).select(F.col("oid").cast("long").alias("oid"), "o"), 10)
    return found.agg(F.countDistinct("cluster").alias("clusters"), F.count("*").alias("members"), F.countDistinct("oid").alias("observers"))


@query
def sdo_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(R.SDO(k=60, seed=SEED).get_params().items())], "name string, value string")


@query
def sdo_observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, params, _ = _sdo(spark, sf_dir)
    return params.fit(rows).observers.select("oid", rounded(F.col("o")[0]).alias("first"), rounded(F.aggregate("o", F.lit(0.0), lambda s, v: s + v)).alias("total"))


def _by_class(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """How many each class is reduced to, and whether all numbers differ, and whether all lie in the class's box."""
    rows = embeddings(spark, sf_dir)
    found = written(C.BY_CLASS[name](rows, C.class_sizes(rows, 10.0), SEED), "by-class")
    box = rows.select("label", F.posexplode("x").alias("dim", "v")).groupBy("label", "dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    inside = found.select("oid", "label", F.posexplode("o").alias("dim", "v")).join(box, ["label", "dim"]).groupBy("label").agg(F.min(F.col("v").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9)).alias("inside"))
    counts = found.groupBy("label").agg(F.count("*").alias("kept"), F.countDistinct("oid").alias("numbers")).join(C.class_sizes(rows, 10.0), "label")
    exact = name in ("OBS", "RS", "KMC", "WGM")  # the others may drop some
    return counts.join(inside, "label").select("label", (F.col("kept") == F.col("size") if exact else F.col("kept").between(1, F.greatest("size", F.lit(2)))).alias("sized"), (F.col("kept") == F.col("numbers")).alias("numbered"), "inside")


def _class_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _by_class(spark, sf_dir, name)

    run.__name__ = f"by_class_{name.lower()}"
    query(run)


for _name in C.BY_CLASS:
    _class_query(_name)


@query
def random_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the draws per class take."""
    rows = embeddings(spark, sf_dir)
    found = C.random_rows(rows, C.class_sizes(rows, 10.0), SEED)
    return found.select("label", (F.col("oid") % C.APART).alias("draw"), rounded(F.col("o")[0]).alias("first"))


@query
def stream_fit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from vedette.streaming.incremental import fit_stream, latest

    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque*")
    rows = events.where("value is not null").select("event_type", F.col("event_id").alias("seq"), F.array("value").alias("x"))
    path = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(df: DataFrame, trigger: int) -> None:
        df.withColumn("trigger", F.lit(trigger)).write.mode("append").parquet(f"{path}/out")

    fit_stream(rows, "event_type", 10.0).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return digest(latest(spark.read.parquet(f"{path}/out")).withColumnRenamed("key", "event_type"), "event_type")


def _cells(results: DataFrame) -> DataFrame:
    """Every cell of the results, and whether its value is one that the metric can have."""
    value = F.col("value")
    known = F.when(F.col("metric").isin("ext_time", "knn_time", "kmeans", "label_extender"), value >= 0).otherwise(value.between(-1.0, 1.0))
    return results.select("algorithm", "rate", "metric", known.alias("in_range"))


@query
def experiment_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).select("id", "x", (F.col("label") == 0).cast("int").alias("y"))
    return _cells(experiments.anomaly_detection("embeddings", rows, at_once=AT_ONCE))


@query
def experiment_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(experiments.clustering("embeddings", embeddings(spark, sf_dir), at_once=AT_ONCE))


@query
def experiment_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(experiments.clustering("embeddings", embeddings(spark, sf_dir), hierarchical=True, at_once=AT_ONCE))


@query
def experiment_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(experiments.classification("embeddings", embeddings(spark, sf_dir), at_once=AT_ONCE))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlier rate of each label under a model fitted on the embeddings."""
    ship(spark)
    rows = embeddings(spark, sf_dir)
    scored = ObserverModel(radius=RADIUS, shuffle=False).fit(rows).predict(rows)
    return scored.groupBy("label").agg(F.count("*").alias("n"), rounded(F.avg(F.col("is_outlier").cast("double"))).alias("outlier_rate")).orderBy("label")


query(flagship)
