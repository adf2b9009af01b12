"""Reading and writing: Parquet, CSV and .npy matrices in; tables, cubes and text reports out.

.npy files are read through Spark's own binary reader, so any store that Spark reaches will do. Files with pickled
objects are refused: reading one could run code."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vedette.operators.points import points
from vedette.session import ship


def read_points(spark: SparkSession, path: str, x: str | Sequence[str], id: str, format: str = "parquet", keep: Sequence[str] = (), schema: str | None = None) -> DataFrame:
    """points() of a Parquet or CSV (with header) source; only the columns that are needed are read."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.csv(path, header=True, inferSchema=schema is None) if format == "csv" else reader.format(format).load(path)
    return points(df, x, id, keep)


def read_npy(spark: SparkSession, path: str, column: str = "x") -> DataFrame:
    """(file, id, column): a row for each row of every .npy array at the path; 1-D arrays give one number a row."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                a = a.reshape(len(a), -1).astype(float)
                for lo in range(0, len(a), 10_000):
                    part = a[lo : lo + 10_000]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, max(1, a.shape[1]), dtype=np.int32)), pa.array(part.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(lo, lo + len(part))), lists], ["file", "id", column])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"file string, id long, {column} array<double>")


def read_dataset(spark: SparkSession, data_path: str, label_path: str) -> DataFrame:
    """(id, x, label) from a matrix file and a file of labels in the same order."""
    labels = read_npy(spark, label_path, "y").select("id", F.element_at("y", 1).cast("int").alias("label"))
    return read_npy(spark, data_path).drop("file").join(labels, "id")


def write_npy(df: DataFrame, path: str, x: str = "x", id: str = "id", rows: int = 1_000_000) -> None:
    """A local .npy file of a matrix of `rows` rows at most, by id: for handing coresets on, not for whole datasets."""
    found = df.select(id, x).orderBy(id).limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows; write Parquet instead")
    np.save(path, np.array([r[1] for r in found], float), allow_pickle=False)


def union_train_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """All rows of both with is_test, ids of the test rows moved behind the train rows'."""
    top = train.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_top"))
    moved = test.crossJoin(F.broadcast(top)).withColumn("id", F.col("id") + F.col("_top") + 1).drop("_top")
    return train.withColumn("is_test", F.lit(False)).unionByName(moved.withColumn("is_test", F.lit(True)))


def cube(results: DataFrame, algorithm: str, datasets: Sequence[str], metrics: Sequence[str], rates: Sequence[float]) -> np.ndarray:
    """[datasets, metrics, rates] of one algorithm; 0 where there is no result."""
    out = np.zeros((len(datasets), len(metrics), len(rates)))
    rows = results.where((F.col("algorithm") == algorithm) & F.col("dataset").isin(*datasets) & F.col("metric").isin(*metrics)).collect()
    for r in rows:  # a cell each
        if r["rate"] in rates:
            out[datasets.index(r["dataset"]), metrics.index(r["metric"]), rates.index(r["rate"])] = r["value"]
    return out


def report(results: DataFrame, metrics: Sequence[str], latex: bool = False) -> DataFrame:
    """(rate, algorithm, line): mean ± deviation of each metric over datasets, as table lines."""
    sums = results.groupBy("rate", "algorithm").pivot("metric", list(metrics)).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    cells = [F.format_string("%.2f ± %.2f" if not latex else "$%.2f \\pm %.2f$", F.col(f"`{m}_m`"), F.col(f"`{m}_s`")) for m in metrics]
    line = F.concat_ws(" & " if latex else " | ", "algorithm", *cells)
    return sums.select("rate", "algorithm", (F.concat(line, F.lit(" \\\\")) if latex else line).alias("line"))


def best_by_metric(results: DataFrame) -> DataFrame:
    """The algorithm with the greatest mean for each (rate, metric)."""
    means = results.groupBy("rate", "metric", "algorithm").agg(F.avg("value").alias("mean"))
    w = Window.partitionBy("rate", "metric").orderBy(F.desc("mean"), "algorithm")
    return means.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
