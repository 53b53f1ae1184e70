"""What the operators share: the shared folder, staged tables, Arrow batching."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once inside an Arrow function.
CHUNK_BYTES = 4 << 20

#: Spark's setting to delete a query's shuffle files when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a temporary folder takes its place if all of
    Spark runs in this process; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage
    that survives lost executors.

    Once the table is there its shuffle files serve nothing, so Spark drops them
    at the end of the write and not at some later garbage collection.  What no
    caller deletes before goes when the driver ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_codec = pa.Codec("zstd", 1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8).ravel()
        squeezed = _codec.compress(raw, asbytes=True) if len(raw) else b""
        parts.append(np.array([len(raw), len(squeezed)], np.int64).tobytes() + squeezed)
    return b"".join(parts)


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    """The arrays of a blob, whose types the caller knows."""
    out, at = [], 0
    for t in types:
        n, m = np.frombuffer(blob, np.int64, 2, at)
        at += 16
        out.append(np.frombuffer(_codec.decompress(blob[at : at + m], int(n)), t) if n else np.zeros(0, t))
        at += int(m)
    return out


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys (given in sorted order) begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames no longer held."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Spark's setting of the rows of an Arrow batch, its default, and what the operators here ask for instead: texts are long.
BATCH_ROWS, BATCH_DEFAULT, BATCH_WANTED = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def small_batches(spark: SparkSession) -> None:
    """Ask for Arrow batches of fewer rows, unless the session names a number; tasks cut them by bytes anyway."""
    if spark.conf.get(BATCH_ROWS, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_ROWS, BATCH_WANTED)


def release() -> None:
    """Give freed memory of a Python worker back, so that idle workers stay small beside the next stage's."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        _, offs = text_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < n:
            end = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
            end = min(n, max(end, at + 1))
            yield batch.slice(at, end - at)
            at = end


def ragged(offs: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a flat array of the rows ``idx`` of a ragged one, and their lengths."""
    lens = offs[idx + 1] - offs[idx]
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(offs[idx] - (ends - lens), lens), lens
