"""Packing: concatenate and cut.

All token streams (each document's ids, then one end id) are laid end to end in scan order and cut
every `length` tokens, so every sequence but the last is full. Two passes make the global positions
without any ordering shuffle:

1. every scan task tokenises its documents and records each one's start within the task's own stream;
   the result is written once to the shared folder, so no text is tokenised twice;
2. the tasks' totals (one row for each scan task) are summed up to offsets, and each document is cut at
   the fixed windows by arithmetic alone. A piece that goes on in the next or came from the previous
   sequence says so in its boundary columns.

Defined results: null and empty texts give one piece holding the end id; a null doc_id stays null;
repeated rows are packed once each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vedette.llm.common import prepare, slices, table, text_column
from vedette.llm.tokenise import Encoder
from vedette.session import written

#: Offsets of this many scan tasks at most are broadcast (16 bytes each); more are joined.
BROADCAST_TASKS = 500_000

_TOKENS = "part long, doc_id long, begin long, n_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, continues_before boolean, continues_after boolean, ids binary"


def tokenised(docs: DataFrame, encoder: Encoder, end_id: int = 0) -> DataFrame:
    """One row per document: its scan task, its place in that task's stream, its ids (16 bits each where they fit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        kind = np.dtype("<u2") if encoder.n_ids <= 65536 else np.dtype("<u4")
        for batch in slices(batches):
            ids = [np.asarray([*x, end_id], kind) for x in encoder.encode(text_column(batch.column(1)).to_pylist())]
            sizes = np.array([len(x) for x in ids], np.int64)
            begin = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int64)), batch.column(0), pa.array(begin), pa.array(sizes), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["part", "doc_id", "begin", "n_tokens", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _TOKENS)


def pack(docs: DataFrame, length: int = 1024, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of documents in sequences of `length` tokens; `ids` holds little-endian unsigned 32-bit ids."""
    spark = docs.sparkSession
    prepare(spark)
    encoder = Encoder(tokenizer)
    tokens = written(tokenised(docs, encoder, end_id), "pack-tokens")
    totals = np.array([(r[0], r[1]) for r in tokens.groupBy("part").agg(F.sum("n_tokens")).collect()], np.int64).reshape(-1, 2)  # a row for each scan task
    totals = totals[np.argsort(totals[:, 0])]
    base = np.cumsum(totals[:, 1]) - totals[:, 1]
    offsets = spark.createDataFrame(list(zip(totals[:, 0].tolist(), base.tolist(), strict=True)), "part long, base long")
    placed = tokens.join(F.broadcast(offsets) if len(totals) <= BROADCAST_TASKS else offsets, "part").select("doc_id", (F.col("base") + F.col("begin")).alias("at"), "n_tokens", "ids")
    wide = encoder.n_ids > 65536

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            at, n = (batch.column(i).to_numpy() for i in (1, 2))
            blobs = batch.column(3)
            first, last = at // length, (at + n - 1) // length
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            sequence = first[row] + k
            lo = np.maximum(sequence * length, at[row])
            hi = np.minimum((sequence + 1) * length, at[row] + n[row])
            start = lo - at[row]
            size = hi - lo
            ids = [np.frombuffer(blobs[i].as_buffer(), "<u4" if wide else "<u2").astype("<u4") for i in range(len(n))]
            pieces = [ids[r][s : s + z].tobytes() for r, s, z in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), *map(pa.array, (start, size, n[row], sequence, lo - sequence * length, start > 0, start + size < n[row])), pa.array(pieces, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "continues_before", "continues_after", "ids"],
            )

    return placed.mapInArrow(cut, _PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "continues_before", "continues_after")


def op6_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
