"""What the operators share: session settings, table access, batching by bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from vedette.session import ship

#: Text bytes that a worker looks at together; a single longer document is still taken whole.
SLICE_BYTES = 1_000_000
#: Text bytes behind a bucket of a packed shuffle: least and most, and how many buckets come before it grows.
SMALL, LARGE, MANY = 16_000_000, 1_000_000_000, 4096


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound Arrow batches, by rows and (where Spark has the setting) by bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_count(text_bytes: int) -> int:
    """Buckets for a packed shuffle over so many bytes of text: one for SMALL bytes, up to MANY of them; from there on
    as many while their share grows to LARGE bytes; then one for LARGE bytes. So what a task reads does not follow the
    input, and packed records (one for each chunk and bucket) are not more than need be."""
    return max(1, -(-int(text_bytes) // min(max(int(text_bytes) // MANY, SMALL), LARGE)))


def text_column(column: pa.Array) -> pa.Array:
    """Null texts count as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def release() -> None:
    """Hand memory that a worker has done with back to the machine: idle workers are kept by Spark."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one piece has at most `limit` text bytes, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        first, total = 0, 0
        for i in range(n):
            if i > first and (total + sizes[i] > limit or i - first >= rows):
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += int(sizes[i])
        yield batch.slice(first)
    release()
