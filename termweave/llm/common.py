"""What the operators share: tables, the shared folder, and packed exchanges.

A packed exchange sends one binary row for each pair of task and destination
instead of one row for each record: the arrays in it are transposed into byte
planes and compressed, so the JVM moves few and large rows.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import materialise, remove, shared_dir, shared_path  # noqa: F401

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError):  # another C library
    _LIBC = None

#: Bytes of text that one slice of an Arrow batch holds at most, single longer texts apart.
SLICE_BYTES = 4 << 20
#: The five primes of XXH64.
XXH_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
#: Bytes of text that one bucket of documents should hold.
BUCKET_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows, and how many buckets keep each near BUCKET_BYTES: one aggregate, one row to the driver."""
    rows, total = docs.select(F.count(F.lit(1)), F.sum(F.octet_length(column))).first()
    return rows, max(partitions(docs.sparkSession), -(-(total or 0) // BUCKET_BYTES))


def unused(name: str, columns: list[str]) -> str:
    """name, or a longer one if columns has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucket_column(n: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n).cast("long")).cast("int")


def bucket_of(n: int, *keys: np.ndarray) -> np.ndarray:
    """bucket_column() of 64-bit keys, outside Spark: XXH64 of 8 bytes, of the first with seed 42, of others with the hash so far."""
    h = np.uint64(42)
    for key in keys:
        h = _xxh64(key, h)
    return (h.view(np.int64) % n).astype(np.int32)


def _xxh64(key: np.ndarray, seed: np.uint64 | np.ndarray) -> np.ndarray:
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in XXH_PRIMES)

    def turn(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    h = (seed + p5 + np.uint64(8)) ^ (turn(key.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def text_slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold up to limit bytes of text, so memory follows a text and not a batch."""
    column = batch.column(batch.schema.get_field_index("text"))
    ends = np.cumsum(np.fromiter((0 if x is None else len(x) for x in map(_buffer, column)), dtype=np.int64, count=len(column)))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _buffer(value):
    return value.as_buffer() if value.is_valid else None


def trim(spark: SparkSession | None = None) -> None:
    """Hand freed memory back to the system: idle Python workers would keep what their largest task took, and so would
    the driver's Java process (given spark), whose compilers free it on hundreds of threads."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)
    if spark is not None:
        try:
            name = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
            spark._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(name, "systemTrimNativeHeap", None, None)
        except Py4JError:  # another Java machine, or one that cannot
            pass


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null as empty."""
    return [b"" if (x := _buffer(v)) is None else x.to_pybytes() for v in column]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length each, of any dtype, as compressed byte planes."""
    heads, bodies = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        code = a.dtype.str.encode().ljust(4)
        heads.append(struct.pack("<4sQ", code, len(a)))
        bodies.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return struct.pack("<B", len(arrays)) + b"".join(heads) + zstandard.ZstdCompressor(level=1).compress(b"".join(bodies))


def unpack(blob: bytes) -> list[np.ndarray]:
    count = blob[0]
    heads = [struct.unpack_from("<4sQ", blob, 1 + 12 * k) for k in range(count)]
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1 + 12 * count :]), dtype=np.uint8)
    out, at = [], 0
    for code, n in heads:
        dtype = np.dtype(code.decode().strip())
        size = n * dtype.itemsize
        out.append(np.ascontiguousarray(body[at : at + size].reshape(dtype.itemsize, n).T).view(dtype).ravel() if n else np.empty(0, dtype))
        at += size
    return out


def merge_blobs(blobs: list[bytes], dtypes: list) -> list[np.ndarray]:
    parts = [unpack(b) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, t) for k, t in enumerate(dtypes)]


def cut_by(dest: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Arrays grouped by dest, order kept within a destination."""
    if not len(dest):
        return
    order = np.argsort(dest, kind="stable")
    dest = dest[order]
    edges = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1], True])
    arrays = [a[order] for a in arrays]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(dest[a]), [x[a:b] for x in arrays]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
