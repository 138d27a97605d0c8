"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy pass handles; longer texts are handled alone.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or the context's checkpoint folder.

    Only a local session, whose executors are this process, gets a temporary
    folder where neither is set; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if path:
        if not known.isDefined():
            sc.setCheckpointDir(path)
        return path
    if not known.isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder, so that lost executors don't lose it."""
    spark = df.sparkSession
    shared_dir(spark)
    release(spark)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the driver's JVM find out which shuffles no frame can read any more, so that executors drop their files before the next step."""
    gc.collect()
    # What the first collection frees may hold what only a second one finds.
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: survives lost executors, and takes less disk than `cut`."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    release(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column, without a copy of the bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated start, start + 1, ... of the given lengths."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
