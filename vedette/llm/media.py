"""Media columns: progressive JPEG files decoded to full-resolution RGB tensors, and texts stored in such files.

Row by row, without a shuffle; a row's file and tensor are all that a task holds beside its batch.

Defined results: `rgb_tensors` gives null size and tensor, and the reason in `error`, for null, empty or damaged
files. `text_media` takes null text as empty; every text, even an empty one, is padded with at least one zero byte
group: bytes 0 up to a positive multiple of 64. Equal texts give equal rows; repeated rows are done each; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vedette.llm.common import prepare, slices, table, text_column
from vedette.llm.jpeg import JpegError, read_coefficients, rgb, store, stored

UNIT = 64


def rgb_tensors(files: DataFrame, key: str, column: str) -> DataFrame:
    """key, height, width, rgb (row by row, three bytes a pixel), error."""
    prepare(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            for i in range(batch.num_rows):  # a batch for each picture: a tensor can be large
                data, size, pixels, error = batch.column(1)[i].as_py(), (None, None), None, None
                try:
                    if not data:
                        raise JpegError("no file")
                    tensor = rgb(read_coefficients(data))
                    size, pixels = tensor.shape[:2], tensor.tobytes()
                except (JpegError, IndexError, KeyError, ValueError) as e:
                    error = str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([size[0]], pa.int32()), pa.array([size[1]], pa.int32()), pa.array([pixels], pa.binary()), pa.array([error], pa.string())],
                    [key, "height", "width", "rgb", "error"],
                )

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, F.col(column).cast("binary")).mapInArrow(run, f"`{key}` {kind}, height int, width int, rgb binary, error string")


def padded(text: str) -> tuple[bytes, int]:
    """UTF-8 with bytes 0 up to a positive multiple of UNIT, and the size without them."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def features(tensor: np.ndarray) -> str:
    """Size, mean of each channel, mean step between neighbours, and the share of samples at either end."""
    flat = tensor.reshape(-1, 3)
    mean = flat.sum(axis=0, dtype=np.int64) / len(flat)
    green = tensor[:, :, 1].astype(np.int16)
    step = np.abs(green[:, 1:] - green[:, :-1]).mean()
    ends = (np.count_nonzero(green == 0) + np.count_nonzero(green == 255)) / green.size
    return f"{tensor.shape[1]}x{tensor.shape[0]} rgb {mean[0]:.2f} {mean[1]:.2f} {mean[2]:.2f} step {step:.2f} ends {ends:.4f}"


def media_row(text: str) -> tuple[int, int, str, int, int, str, str]:
    payload, n = padded(text)
    data = store(payload)
    frame = read_coefficients(data)
    back = stored(frame)
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), features(rgb(frame))


_NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id and what is found in each text's file when it is read back."""
    prepare(docs.sparkSession)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [media_row(t) for t in text_column(batch.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *_NAMES])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
