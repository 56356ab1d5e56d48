"""What the corpus operators share: tables, shared storage, Arrow buffers and hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inside a Java, RE2 or Python character class: the six ASCII white-space bytes.
SPACE = r"\x20\x09-\x0D"
#: Bytes of text that the numpy kernels take at once; bounds their temporary arrays.
PIECE_BYTES = 1 << 20

#: Tables that this session has written to the shared folder.
_WRITTEN: list[str] = []

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever the optimizer collapses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``: the fold of a row."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all runs on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = found.get() if found.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="atriumq-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Removes all tables of this session from the shared folder; call it once results have been read."""
    for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, _WRITTEN):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN.clear()


def drop_table(df: DataFrame) -> None:
    """Removes a table made by written() whose rows are no longer read."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def frugal(run):
    """A kernel that gives the memory of its task back when it ends: workers wait for the next task beside the JVM."""

    @functools.wraps(run)
    def out(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` text bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def long_slices(data: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, bytes) of slices of ``limit`` bytes, each with the ``overlap`` bytes that follow it."""
    for start in range(0, max(1, len(data)), limit):
        yield start, data[start : start + limit + overlap]


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    h = (h ^ (h >> _U(30))) * _MIX[0]
    h = (h ^ (h >> _U(27))) * _MIX[1]
    return h ^ (h >> _U(31))


def _byte_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _MULT)


_TABLE = _byte_table()


def powers(n: int, base: np.uint64 = _MULT) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    out = np.full(n + 1, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which slice_hash() gives the hash of any slice."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_TABLE[data] * powers(len(data))[:-1], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:stop], the same wherever the bytes stand."""
    return mix((prefix[stop] - prefix[start]) * inverse[start] + (stop - start).astype(_U) * _MULT)


def inverse_powers(n: int) -> np.ndarray:
    return powers(n, _INV)
