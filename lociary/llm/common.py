"""What the operators share: stored intermediate tables, Arrow views of a text column, hash constants."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lociary.operators.keyed import shared_folder

HELD_OUT_REMAINDER = 1

_shipped: set[str] = set()


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later uses survive lost executors and repeat nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package where their import path does not already reach it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    reached = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if spark.sparkContext.master.startswith("local["):
        reached.append(os.getcwd())
    application = spark.sparkContext.applicationId
    if root not in reached and application not in _shipped:
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "lociary"), "zip", root, "lociary")
        spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def held_out(doc_id: Column) -> Column:
    """True for the documents no model may learn from: crc32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == HELD_OUT_REMAINDER, F.lit(True))


def column_of(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    column = batch.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and the n + 1 places where texts begin and end. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string()) if len(texts) else texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    joined = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return joined, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(count: int, seed: int) -> np.ndarray:
    """``count`` 64-bit numbers that depend on the seed alone."""
    return mix((np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))
