import numpy as np
import pytest
from pyspark.sql import functions as F

from vedette.operators.fold import Fold
from vedette.sources import arrays as S
from vedette.streaming.incremental import fit_stream, latest


def test_npy_round_trip(spark, tmp_path):
    x, y = np.random.default_rng(0).normal(size=(25, 3)), np.arange(25) % 2
    np.save(tmp_path / "d.npy", x)
    np.save(tmp_path / "l.npy", y)
    df = S.read_dataset(spark, str(tmp_path / "d.npy"), str(tmp_path / "l.npy"))
    got = df.orderBy("id").collect()
    assert [r.x for r in got] == x.tolist() and [r.label for r in got] == y.tolist()
    S.write_npy(df, str(tmp_path / "back.npy"))
    assert (np.load(tmp_path / "back.npy") == x).all()
    with pytest.raises(ValueError):
        S.write_npy(df, str(tmp_path / "back.npy"), rows=3)


def test_pickled_objects_are_refused(spark, tmp_path):
    np.save(tmp_path / "o.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="pickle"):
        S.read_npy(spark, str(tmp_path / "o.npy")).collect()


def test_csv_parquet_union_report(spark, tmp_path):
    spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(5)], "k long, a double, b double").coalesce(1).write.csv(str(tmp_path / "c"), header=True)
    df = S.read_points(spark, str(tmp_path / "c"), ["a", "b"], "k", "csv")
    assert df.count() == 5 and df.orderBy("id").collect()[3].x == [3.0, 6.0]
    both = S.union_train_test(df, df)
    assert both.select("id").distinct().count() == 10 and both.where("is_test").agg(F.min("id")).first()[0] == 5
    long = spark.createDataFrame([("d1", "X", 1.0, "m", 1.0), ("d2", "X", 1.0, "m", 3.0)], "dataset string, algorithm string, rate double, metric string, value double")
    assert S.report(long, ["m"]).first().line == "X | 2.00 ± 1.00"
    assert S.cube(long, "X", ["d1", "d2"], ["m"], [1.0])[:, 0, 0].tolist() == [1.0, 3.0]
    assert S.best_by_metric(long).first().algorithm == "X"


def test_stream_equals_one_fold(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=60)
    for i in range(3):  # one file a trigger
        part = [("a", 20 * i + j, [float(v)]) for j, v in enumerate(x[20 * i : 20 * i + 20])]
        spark.createDataFrame(part, "k string, seq long, x array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, seq long, x array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def keep(df, n):
        df.withColumn("trigger", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))

    fit_stream(stream, "k", 0.5).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = latest(spark.read.parquet(str(tmp_path / "out"))).orderBy("oid").collect()
    o, p, r = Fold(0.5).feed(x[:, None]).rows()
    assert [g.population for g in got] == p.tolist() and [g.o[0] for g in got] == pytest.approx(o[:, 0].tolist())


def test_written_tables_can_be_discarded(spark):
    from vedette.session import discard, written

    df = written(spark.range(5), "here")
    assert df.count() == 5 and discard(spark) >= 1
    with pytest.raises(Exception, match="(?i)not exist|no such"):
        spark.read.parquet(*df.inputFiles()).count()
