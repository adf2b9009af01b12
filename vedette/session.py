"""Session helpers: building a local session, shipping the package, shared work folders."""

from __future__ import annotations

import atexit
import importlib
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()
_WRITTEN: dict[tuple[str, int], list[str]] = {}  # by application and thread


def local_session(cpus: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vedette")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once per application, whatever its own PYTHONPATH is."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="vedette-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "vedette_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, os.path.join("vedette", path.relative_to(_PACKAGE)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local master gets a folder of its
    own; on a cluster there is none that all could see, so the call fails."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="vedette-shared-"))
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Spark's setting that removes a query's shuffle files when it has ended. It is the session's, so it stays as it is
#: while several threads use the session: another one's iterator may still read its files.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SIDE_BY_SIDE: list[int] = []


@contextmanager
def side_by_side() -> Iterator[None]:
    """Around code in which several threads use one session.

    pyspark.ml, which operators import when they need it, is imported before: its modules import each other in a circle,
    and threads that do so at once find them half made."""
    for name in ("clustering", "feature", "functions"):
        importlib.import_module(f"pyspark.ml.{name}")
    _SIDE_BY_SIDE.append(1)
    try:
        yield
    finally:
        _SIDE_BY_SIDE.pop()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends at replicated storage,
    so a lost executor costs no recomputation of what stands before. The write's shuffle files go when it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, None)
    if not _SIDE_BY_SIDE:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if not _SIDE_BY_SIDE:
            spark.conf.set(_TIDY, before) if before is not None else spark.conf.unset(_TIDY)
    _mine(spark).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written"] = path
    return out


#: Bytes of a table, by Spark's estimate, from which and up to which it is dealt over all cores; tasks for each core.
SPREAD = 2_000_000, 2_000_000_000
TASKS = 4


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores, for work that costs far more than moving the rows: a table of few bytes is in few files
    and so few tasks. A larger one is in many tasks by itself and is not moved."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism) if SPREAD[0] <= size <= SPREAD[1] else df


def _mine(spark: SparkSession) -> list[str]:
    """What this thread has written."""
    return _WRITTEN.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def drop(df: DataFrame) -> None:
    """Delete a table that this thread has written(), when nothing that rests on it is needed any more."""
    path = df.__dict__["_written"]
    _mine(df.sparkSession).remove(path)
    _delete(df.sparkSession, [path])


def discard(spark: SparkSession) -> int:
    """Delete the tables that this application has written() so far; call it when no result that was built on them is
    needed any more. Returns how many there were."""
    app = spark.sparkContext.applicationId
    paths = [p for key in [k for k in _WRITTEN if k[0] == app] for p in _WRITTEN.pop(key)]
    _delete(spark, paths)
    return len(paths)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written() inside, by this thread, are deleted at its end, but for those that the function it gives is called with: what is
    returned must rest on these alone."""
    every = _mine(spark)
    first, kept = len(every), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.__dict__["_written"])
        return df

    try:
        yield keep
    finally:
        gone = [p for p in every[first:] if p not in kept]
        every[first:] = [p for p in every[first:] if p in kept]
        _delete(spark, gone)
