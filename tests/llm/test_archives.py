import hashlib
import random
import struct
import zipfile
import zlib

import duckdb
import pytest

from termweave.llm import media as M
from termweave.llm import warc as W


def test_warc_round_trip(spark):
    pages = [(1, "u1", "same"), (5, "u5", "same"), (3, "u3\r\nX: y", "é" * 70000), (4, None, None), (2, "u", ""), (9, "u", "<p>\r\n\r\nWARC/1.1\r\n</p>"), (5, "again", "same"), (None, "n", "same"), (None, "m", "alone")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id int, url string, html string, digest string")
    got = sorted(map(tuple, W.round_trip(df).collect()), key=str)
    top = {"same": 5, "é" * 70000: 3, "": 4, pages[5][2]: 9, "alone": None}
    want = []
    for p, _, h in pages:
        h = h or ""
        refers = None if p == top[h] else top[h]
        want.append((p, len(h.encode()), W.base32_sha1(h.encode()), "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=str)
    assert W.round_trip(df.where("false")).collect() == []


def test_warc_sql(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    want = duckdb.sql(W.SQL.replace("FROM pages", f"FROM '{path}'")).fetchall()
    assert sorted(map(tuple, W.round_trip(spark.read.parquet(path)).collect())) == sorted(want)


def test_salvage():
    r = random.Random(4)
    records = [W.page_record(i, "u", bytes(r.randrange(256) for _ in range(r.randint(0, 3000))), None) for i in range(20)]
    for packed in (True, False):
        parts = [W.member(x) if packed else x for x in records]
        starts = [sum(map(len, parts[:i])) for i in range(21)]
        whole = list(W.salvage(b"".join(parts)))
        assert [x.heads["warc-record-id"] for x in whole] == [f"<urn:page:{i}>" for i in range(20)]
        bad = [bytearray(p) for p in parts]
        bad[4][len(bad[4]) // 2] ^= 0xFF
        bad[0][0] ^= 1
        bad[11][1] ^= 1
        bad[12][2] ^= 1
        data = b"".join(bad)
        for cut in (len(data), len(data) - 3):
            out = list(W.salvage(data[:cut]))
            lost = {0, 4, 11, 12} | ({19} if cut < len(data) else set())
            assert [x.heads["warc-record-id"] for x in out if isinstance(x, W.Record)] == [f"<urn:page:{i}>" for i in range(20) if i not in lost], (packed, cut)
            gaps = [(x.offset, x.length) for x in out if isinstance(x, W.Gap)]
            want = [(starts[0], len(parts[0])), (starts[4], len(parts[4])), (starts[11], len(parts[11]) + len(parts[12]))]
            assert gaps == want + ([(starts[19], len(parts[19]) - 3)] if cut < len(data) else [])
            assert sum(x.length for x in out) == cut
    assert list(W.salvage(b"")) == [] and [type(x) for x in W.salvage(b"rubbish")] == [W.Gap]


def test_gaps_are_rows(spark):
    blob = W.member(W.page_record(1, "u", b"x", None)) + b"rubbish" + W.member(W.page_record(2, "u", b"y", None))
    rows = W.read_archives(spark.createDataFrame([("a", bytearray(blob)), ("b", None)], "archive string, blob binary")).collect()
    assert [(r.kind, r.length if r.kind == "gap" else bytes(r.payload)) for r in rows] == [("record", b"x"), ("gap", 7), ("record", b"y")]


def test_round_trip_fails_on_gaps(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * 50) for i in range(20)], "page_id long, url string, html string")
    good = W.write_archives(W.with_roles(pages))
    assert W.whole(W.read_archives(good, with_payload=False)).count() == 20
    bad = spark.createDataFrame([(r.archive, bytes(r.blob[:-9])) for r in good.select("archive", "blob").collect()], "archive string, blob binary")
    with pytest.raises(Exception, match="does not read back"):
        W.whole(W.read_archives(bad, with_payload=False)).collect()


def test_png():
    for n in (0, 1, 63, 64, 65, 100_000):
        text = bytes(i * 7 % 251 for i in range(n))
        payload = M.padded(text)
        png = M.to_png(payload)
        assert len(payload) % 64 == 0 and payload and payload.startswith(text) and M.from_png(png) == payload
        at = png.index(b"IHDR")
        assert struct.unpack(">II", png[at + 4 : at + 12]) == (64, len(payload) // 64)


def test_media_round_trip(spark, monkeypatch):
    docs = [(1, "hello"), (2, None), (3, ""), (None, "hello"), (4, "x" * 64), (5, "é" * 200_000), (1, "hello"), (-7, "neg")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id int, text string, media string").repartition(2)
    got = M.round_trip(df).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(d), len((t or "").encode())) for d, t in docs)
    by = {(r.doc_id, r.n_bytes): r for r in got}
    for d, t in docs:
        r, p = by[d, len((t or "").encode())], M.padded((t or "").encode())
        png = M.to_png(p)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(png), hashlib.sha256(png).hexdigest(), M.feature_of(p))
    assert M.round_trip(df.where("false")).collect() == []


def test_ranges_and_retries(spark, tmp_path, monkeypatch):
    names = [f"{i}/{i}/3.png" for i in range(40)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in names:
            z.writestr(n, M.to_png(M.padded(n.encode() * 20)))
    monkeypatch.setattr(M, "RANGE_BYTES", 1000)
    reader = M.MediaReader(str(tmp_path))
    parts = reader.partitions()
    assert len(parts) > 3
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["member"] for r in rows) == sorted(names) and not any(r["error"] for r in rows)
    calls, real = {}, M.read_member

    def flaky(file, m):
        calls[m.filename] = calls.get(m.filename, 0) + 1
        if m.filename == names[3] and calls[m.filename] < 3 or m.filename == names[5]:
            raise OSError("lost")
        return real(file, m)

    monkeypatch.setattr(M, "read_member", flaky)
    rows = {r["member"]: r for p in parts for b in reader.read(p) for r in b.to_pylist()}
    assert len(rows) == 40 and rows[names[3]]["error"] is None and rows[names[5]]["media"] is None and "lost" in rows[names[5]]["error"]
    assert calls[names[3]] == 3 and calls[names[4]] == 1


def test_salvage_of_both_kinds():
    record = lambda i: W.page_record(i, "u", b"payload %d" % i * 30, None)
    ids = lambda out: [int(x.heads["warc-record-id"][10:-1]) for x in out if isinstance(x, W.Record)]
    mixed = W.member(record(1)) + record(2) + W.member(record(3)) + record(4) + record(5)
    assert ids(W.salvage(mixed)) == [1, 2, 3, 4, 5] and not any(isinstance(x, W.Gap) for x in W.salvage(mixed))
    # after damage the next record of either kind is found
    bad = bytearray(W.member(record(1)))
    bad[20] ^= 0xFF
    out = list(W.salvage(bytes(bad) + record(2) + b"rubbish" + W.member(record(3))))
    assert ids(out) == [2, 3] and [(x.offset, x.length) for x in out if isinstance(x, W.Gap)] == [(0, len(bad)), (len(bad) + len(record(2)), 7)]
    # several records in one member, one of them damaged
    third = bytearray(record(3))
    third[-10] ^= 1
    out = list(W.salvage(W.member(record(1) + record(2) + bytes(third) + record(4)) + W.member(record(5))))
    assert ids(out) == [1, 2, 4, 5] and [x.place for x in out if isinstance(x, W.Record)] == [0, len(record(1)), len(record(1) + record(2)) + len(third), 0]
    gap = next(x for x in out if isinstance(x, W.Gap))
    assert gap.offset == 0 and gap.reason.startswith(f"in member at {len(record(1) + record(2))}: block digest")
    assert [type(x) for x in W.salvage(W.member(b"no record"))] == [W.Gap]


def test_png_by_another_reader():
    """The stored form is a PNG that any reader opens: checked by the chunk layout and filters of the format, here with numpy alone."""
    import numpy as np

    payload = M.padded(bytes(range(256)) * 5)
    png, at, body = M.to_png(payload), 8, b""
    while at < len(png):
        (n,) = struct.unpack(">I", png[at : at + 4])
        kind, data, crc = png[at + 4 : at + 8], png[at + 8 : at + 8 + n], png[at + 8 + n : at + 12 + n]
        assert zlib.crc32(kind + data) == struct.unpack(">I", crc)[0]
        body += data if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, 65)
    assert png[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10]) and not lines[:, 0].any() and lines[:, 1:].tobytes() == payload


def test_archive_that_does_not_open(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("0/0/3.png", M.to_png(M.padded(b"abc")))
    (tmp_path / "b.zip").write_bytes(b"rubbish" * 400)
    monkeypatch.setattr(M, "RANGE_BYTES", 1000)
    reader, tries, real = M.MediaReader(str(tmp_path)), [], M.zipfile.ZipFile

    def flaky(file, *a):
        tries.append(1)
        if len(tries) == 1:
            raise OSError("lost")
        return real(file, *a)

    monkeypatch.setattr(M.zipfile, "ZipFile", flaky)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["archive"], r["member"], r["error"] is None) for r in rows] == [("a.zip", "0/0/3.png", True), ("b.zip", None, False)]
