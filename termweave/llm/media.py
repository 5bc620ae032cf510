"""Media columns: lossless pictures in archives, and a data source that reads them.

A payload (UTF-8, filled up with bytes 0 to a positive multiple of 64) becomes an
8-bit grey PNG 64 pixels wide. Tasks put pictures into ZIP archives, stored as
they are, in one folder; the names are those of the task, and an archive appears
under its name when it is whole, so a repeated task replaces what it wrote.

The source "termweave_media" lists the folder and plans byte ranges, without
reading directories; a task reads its archive's central directory and takes the
members whose header lies in its range. Opening and the directory are tried RETRIES
times too; an archive that stays unreadable is one row with its error, of its first
range. Members are read and checked one by one, by offset; one that fails is read
again from a new handle, and after RETRIES comes out with its error instead of a
payload. Batches of about BATCH_BYTES go
through Arrow.

The folder must be one that pyarrow opens (local or shared mounts, HDFS, S3).

Nulls: a null text is empty (payload of 64 bytes 0), as an empty one; a null doc_id
stays null. Repeated rows and equal ids are members of their own. An empty table
gives no archives and no rows. A very long text is one picture, held whole by its
task. Other columns, of any names, are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import shared_path, text_slices, texts_of

WIDTH = 64
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, RETRIES = 32 << 20, 8 << 20, 4 << 20, 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # each line starts with filter 0
    lines[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """Pixels of a grey PNG whose lines all have filter 0; every chunk is checked."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body = 8, None, []
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, chunk = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + chunk):
            raise ValueError("chunk CRC differs")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + n
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey picture")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(head[1], head[0] + 1)
    if lines[:, 0].any():
        raise ValueError("unknown filter")
    return lines[:, 1:].tobytes()


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":", "://", 1))


def write_archives(docs: DataFrame, folder: str) -> int:
    """Pictures of docs(doc_id, text) in archives in the folder; how many."""

    def put(name: str, held: list[tuple[str, bytes]]) -> None:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for k, x in held:
                z.writestr(zipfile.ZipInfo(k), x)
        store, base = open_folder(folder)
        store.create_dir(base, recursive=True)
        hidden = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(hidden) as f:
            f.write(out.getbuffer())
        if store.get_file_info(f"{base}/{name}").is_file:  # of an earlier attempt; not every store replaces
            store.delete_file(f"{base}/{name}")
        store.move(hidden, f"{base}/{name}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, archives, members, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        for batch in batches:
            for rows in text_slices(batch):
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts_of(rows.column("text")), strict=True):
                    held.append((f"{members}/{doc_id}/{len(text)}.png", to_png(padded(text))))
                    members += 1
                    size += len(held[-1][1])
                    if size >= ARCHIVE_BYTES:
                        put(f"{part:06d}-{archives:06d}.zip", held)
                        archives, held, size = archives + 1, [], 0
        if held:
            put(f"{part:06d}-{archives:06d}.zip", held)
        yield pa.RecordBatch.from_arrays([pa.array([members], pa.int64())], names=["members"])

    slim = docs.select(F.col("doc_id").cast("long"), "text")
    return slim.mapInArrow(write, "members long").agg(F.sum("members")).first()[0] or 0


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class MediaReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Range]:
        store, base = open_folder(self.folder)
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        files = sorted((x.path, x.size) for x in found if x.is_file and x.base_name.endswith(".zip") and not x.base_name.startswith("."))
        return [Range(p, a, min(n, a + RANGE_BYTES)) for p, n in files for a in range(0, n, RANGE_BYTES)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = open_folder(self.folder)
        name, members = partition.path.rpartition("/")[2], None
        for _ in range(RETRIES):
            try:
                file = store.open_input_file(partition.path)
                with zipfile.ZipFile(file) as z:
                    members = [m for m in z.infolist() if partition.start <= m.header_offset < partition.end]
                break
            except (OSError, ValueError, struct.error, zipfile.BadZipFile) as e:
                error = f"{type(e).__name__}: {e}"[:200]
        if members is None:
            if not partition.start:
                yield _batch([(name, 0, None, None, error)])
            return
        rows, held = [], 0
        for m in sorted(members, key=lambda m: m.header_offset):
            media, error = None, None
            for _ in range(RETRIES):
                try:
                    media, error = read_member(file, m), None
                    break
                except (OSError, ValueError, struct.error) as e:
                    error = f"{type(e).__name__}: {e}"[:200]
                    try:
                        file = store.open_input_file(partition.path)
                    except OSError:
                        continue
            rows.append((name, m.header_offset, m.filename, media, error))
            held += len(media or b"")
            if held >= BATCH_BYTES or len(rows) >= 5000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def read_member(file, m: zipfile.ZipInfo) -> bytes:
    """The bytes of one stored member, by the offset of its header; its CRC must hold."""
    file.seek(m.header_offset)
    head = file.read(30)
    if head[:4] != b"PK\3\4":
        raise ValueError("no member header")
    if m.compress_type != zipfile.ZIP_STORED:
        raise ValueError("member is not stored")
    names, extra = struct.unpack_from("<HH", head, 26)
    file.seek(m.header_offset + 30 + names + extra)
    data = file.read(m.file_size)
    if len(data) != m.file_size or zlib.crc32(data) != m.CRC:
        raise ValueError("member CRC differs")
    return data


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "offset", "member", "media", "error"])


class MediaArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "termweave_media"

    def schema(self) -> str:
        return "archive string, offset long, member string, media binary, error string"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"])


def read_media(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, offset, member, media, error) of the archives in a folder."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format(MediaArchives.name()).load(folder)


FEATURES = "member string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature_of(payload: bytes) -> str:
    """Mean, deviation, mean step along the samples, and entropy."""
    x = np.frombuffer(payload, dtype=np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    level = np.arange(256)
    mean = float(share @ level)
    deviation = float(np.sqrt(max(0.0, share @ (level - mean) ** 2)))
    step = float(np.abs(np.diff(x.astype(np.int16))).mean())
    p = share[share > 0]
    return f"{mean:.6f} {deviation:.6f} {step:.6f} {abs(float(-(p * np.log2(p)).sum())):.6f}"


def features(media: DataFrame) -> DataFrame:
    """FEATURES of each picture of read_media()."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member, data in zip(*batch.columns, strict=True):
                data = data.as_py()
                payload = from_png(data)
                rows.append((member.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(payload)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in FEATURES.split(", ")])

    return media.select("member", "media").mapInArrow(add, FEATURES)


def round_trip(docs: DataFrame) -> DataFrame:
    """Documents stored as pictures, read back, and described; a member that can't be read fails the query."""
    spark = docs.sparkSession
    folder = shared_path(spark, "media")
    write_archives(docs, folder)
    whole = F.when(F.col("error").isNull(), F.col("media")).otherwise(F.raise_error(F.concat(F.coalesce("member", "archive"), F.lit(": "), "error")).cast("binary"))
    out = features(read_media(spark, folder).select("member", whole.alias("media")))
    part = F.split("member", "[/.]")
    return out.select(part[1].try_cast("long").alias("doc_id"), part[2].cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
