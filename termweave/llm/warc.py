"""WARC archives: writing with revisits, and a reader that salvages damaged ones.

Archives are kept as rows (archive, blob) of at most about ARCHIVE_BYTES each, so
that any store which Spark writes holds them; archive_files() reads files that
are there already. Records are plain, or in gzip members of one or more records,
and one archive may hold both kinds.

The reader goes from record to record. Where a check fails (member CRC, version
line, Content-Length, record end, block digest), it searches for the next member
or version line, whichever comes first, that starts a valid record, goes on from
there, and logs the bytes between as a gap with the reason. A gap reaches to the
end if nothing valid follows. What does not parse within a sound member is a gap
of that member.

Which page refers to which is found on ids and digests; the pages themselves meet
what they refer to by their own id, and copies of one payload are dealt to SALTS
tasks.

Nulls: a null payload is empty; a null page_id is written as such, is a response
unless a row with an id has an equal payload, and is not referred to. Rows that
repeat a page_id each get a record; those of the largest page_id are responses. An
empty table gives no archive and no rows. A very long page is one record, held whole
by its task; 2 GB are the most that one value holds. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, text_slices

ARCHIVE_BYTES = 4 << 20
#: The most bytes that one Arrow value holds; a member of more is a gap that says so.
MEMBER_BYTES = (1 << 31) - 1
SALTS = 32
_STEP = 1 << 16
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC = b"\x1f\x8b\x08"
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2020-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit without payload that refers to another page's response."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    heads = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url or ""),
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        heads |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    heads["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


@dataclass
class Record:
    """place: where the record starts in its member's bytes; 0 for plain ones."""

    offset: int
    length: int
    heads: dict[str, str]
    block: bytes
    place: int = 0


@dataclass
class Gap:
    offset: int
    length: int
    reason: str = field(default="")


class Damaged(ValueError):
    pass


def _parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record that starts at a place; where it ends."""
    if not (m := _VERSION.match(data, at)):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", m.end())
    if end < 0:
        raise Damaged("headers do not end")
    heads = {}
    for line in data[m.end() : end].decode("utf-8", "replace").split("\r\n"):
        key, colon, value = line.partition(":")
        if not colon:
            raise Damaged("bad header line")
        heads[key.strip().lower()] = value.strip()
    size = heads.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        raise Damaged("no content length")
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where its length says")
    block = data[start:stop]
    kind, _, want = heads.get("warc-block-digest", "").partition(":")
    if kind.lower() == "sha1" and base32_sha1(block) != want.upper():
        raise Damaged("block digest differs")
    return Record(at, stop + 4 - at, heads, block), stop + 4


def _member(data: bytes, at: int) -> tuple[list[Record | Gap], int]:
    """What the member that starts at a place holds; where it ends."""
    unpacker = zlib.decompressobj(31)
    view = memoryview(data)
    out, size, used = [], 0, at
    try:
        while not unpacker.eof and used < len(data):
            out.append(unpacker.decompress(view[used : used + _STEP]))
            size += len(out[-1])
            used += _STEP
            if size > MEMBER_BYTES:
                raise Damaged("member does not fit one value")
    except zlib.error as e:
        raise Damaged(f"member: {str(e)[:60]}") from None
    if not unpacker.eof:
        raise Damaged("member is cut off")
    end = min(used, len(data)) - len(unpacker.unused_data)
    held = list(_through(b"".join(out), _VERSION, _plain))
    if not any(isinstance(x, Record) for x in held):
        raise Damaged(held[0].reason if held else "empty member")
    inside = [Record(at, end - at, x.heads, x.block, x.offset) if isinstance(x, Record) else Gap(at, end - at, f"in member at {x.offset}: {x.reason}") for x in held]
    return inside, end


def _plain(data: bytes, at: int) -> tuple[list[Record], int]:
    record, end = _parse(data, at)
    return [record], end


def _either(data: bytes, at: int) -> tuple[list[Record | Gap], int]:
    return _member(data, at) if data[at : at + 3] == _MAGIC else _plain(data, at)


def _through(data: bytes, start: re.Pattern, read) -> Iterator[Record | Gap]:
    """What read() finds from place to place; bytes up to the next start that it can read are a gap."""
    at = 0
    while at < len(data):
        try:
            found, end = read(data, at)
        except Damaged as e:
            place = at
            while m := start.search(data, place + 1):
                place = m.start()
                try:
                    found, end = read(data, place)
                    break
                except Damaged:
                    continue
            else:
                yield Gap(at, len(data) - at, str(e))
                return
            yield Gap(at, place - at, str(e))
        yield from found
        at = end


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records that are whole, and the gaps between them, in order."""
    return _through(data, _START, _either)


def with_roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages(page_id, url, html) with refers_to: of equal payloads of at least `least` bytes all but the largest page_id refer to it."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    every = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(body).alias("digest"))
    slim = pages.select(F.col("page_id").cast("long"), F.sha1(body).alias("digest"), F.octet_length(body).alias("n")).where(F.col("n") >= least)
    slim = materialise(slim.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("rows")), "digests")
    several = slim.groupBy("digest").agg(F.max("page_id").alias("largest"), F.sum("rows").alias("rows")).where("rows > 1 AND largest IS NOT NULL")
    several = several.select("digest", "largest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = slim.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    refers = dealt.join(several, ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("largest")))
    refers = materialise(refers.select(F.col("page_id").alias("of"), F.col("digest").alias("with"), F.col("largest").alias("refers_to")), "revisits")
    return every.join(refers, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("with")), "left").select("page_id", "url", "html", "refers_to")


def write_archives(roles: DataFrame, packed: bool = True) -> DataFrame:
    """Archives of the rows of with_roles(), as rows (archive, blob) written in the shared folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for rows in text_slices(batch):
                for page, url, html, refers in zip(*(rows.column(c).to_pylist() for c in ("page_id", "url", "text", "refers_to")), strict=True):
                    record = page_record(page, url, (html or "").encode(), refers)
                    held.append(member(record) if packed else record)
                    size += len(held[-1])
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{count:06d}"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "blob"])
                        count, held, size = count + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{count:06d}"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "blob"])

    return materialise(roles.withColumnRenamed("html", "text").mapInArrow(write, "archive string, blob binary"), "warc")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, blob) of the WARC files under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("archive"), F.col("content").alias("blob"))


READ = "archive string, offset long, length long, kind string, reason string, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record (kind 'record') and each quarantined gap (kind 'gap') of archives(archive, blob)."""
    names = [c.split()[0] for c in READ.split(", ")]

    def row(archive: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            return (archive, x.offset, x.length, "gap", x.reason, None, None, None, None, None, None, None)
        kind, h = x.heads.get("warc-type"), x.heads
        _, _, payload = x.block.partition(b"\r\n\r\n") if "application/http" in h.get("content-type", "") else (b"", b"", x.block)
        digest = h.get("warc-payload-digest", "").partition(":")[2].upper() or None
        size, why = len(payload), None
        if kind == "revisit":
            size = int(h["x-payload-length"]) if h.get("x-payload-length", "").isdigit() else None
        elif digest is None:
            digest = base32_sha1(payload)
        elif digest != base32_sha1(payload):
            why = "payload digest differs"
        return (archive, x.offset, x.length, "record", why, h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-refers-to"), digest, size, payload if with_payload else None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, blob in zip(*batch.columns, strict=True):
                rows, held = [], 0
                for x in salvage(blob.as_py() or b""):
                    rows.append(row(archive.as_py(), x))
                    held += len(rows[-1][-1] or b"")
                    if held > ARCHIVE_BYTES or len(rows) >= 5000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k.split()[1]]) for c, k in zip(zip(*rows, strict=True), READ.split(", "), strict=True)], names=names)

    return archives.select("archive", "blob").mapInArrow(read, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to archives and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    return whole(read_archives(write_archives(with_roles(pages)), with_payload=False))


def whole(back: DataFrame) -> DataFrame:
    """The pages among records read back; a gap, or a record that fails its checks, fails the query."""
    fault = F.concat(F.lit("archive "), "archive", F.lit(" does not read back at "), F.col("offset").cast("string"), F.lit(": "), F.coalesce("reason", "kind"))
    back = back.where(F.when((F.col("kind") == "record") & F.col("reason").isNull(), True).otherwise(F.raise_error(fault).cast("boolean")))
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1).try_cast("long")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS d FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM b
"""
