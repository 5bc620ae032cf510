import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from termweave.llm import suffix_dedup as S
from termweave.llm.common import bucket_column, bucket_of

SCHEMA = "doc_id long, text string"


def brute(rows):
    """By the definition: a byte goes if a 100-byte string over it starts earlier too. Rows of one doc_id stand by hash, then by text."""
    salt = lambda t: xxhash.xxh64_intdigest(t, 42) >> 64 - S.SALT
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, salt((r[1] or "").encode()), (r[1] or "").encode()))
    seen, out = set(), []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            s = b[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = S.remove_repeats(df, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted(map(tuple, got.collect()), key=str)


def words(r, n):
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(n))


def corpus(seed):
    r = random.Random(seed)
    passages = [words(r, r.randint(15, 80)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [words(r, r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 3)
            parts += [p[a : len(p) - r.randint(0, 20)], words(r, r.randint(0, 10))]
        rows.append((i * 7 % 1000, " ".join(parts)))
    rows += [(2000 + i, rows[i][1]) for i in range(30)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    long = "ab" * 30000
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 99), (5, "y" * 100), (6, "y" * 101), (7, long), (8, "\x00" * 150), (9, "q" + "\x00" * 150)]
    rows += [(10, "z" * 120 + "unique"), (10, "z" * 120 + "unique"), (10, "other " + "z" * 130), (None, "y" * 100), (None, "y" * 100), (-5, "y" * 100)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_clashing(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a", 5, 6), (2, "é" * 60 + "ab", 7, 8), (3, "cc" + "é" * 60, 9, 1)], "doc_id int, text string, bucket int, n_bytes int")
    got = {r["doc_id"]: r for r in S.remove_repeats(df).collect()}
    assert got[2]["n_bytes"] == 122 and got[3]["n_removed"] == 120 and got[3]["kept_text"] == "cc"


def test_bucket_matches_spark(spark):
    ids = [0, 1, -1, 2**62, -(2**63), 2**63 - 1, 12345]
    df = spark.createDataFrame([(i,) for i in ids], "x long").select("x", bucket_column(37, F.col("x")).alias("b"), bucket_column(37, F.col("x"), F.col("x") % 1000).alias("c"))
    x = np.array(ids)
    assert {r.x: r.b for r in df.collect()} == dict(zip(ids, bucket_of(37, x).tolist()))
    assert {r.x: r.c for r in df.collect()} == dict(zip(ids, bucket_of(37, x, np.fmod(x, 1000)).tolist()))


def test_rows_without_or_with_one_id(spark):
    r = random.Random(11)
    passages = [words(r, 40) for _ in range(4)]
    texts = [" ".join([words(r, r.randint(0, 30)), r.choice(passages), words(r, r.randint(0, 30))]) for _ in range(60)]
    rows = [(None, t) for t in texts[:30]] + [(7, t) for t in texts[20:50]] + [(7, texts[25])] * 3 + [(None, texts[3])] * 2 + [(1, texts[55]), (9, texts[56])]
    assert run(spark, rows) == brute(rows)


def test_stage_keeps_columns_of_any_name(spark):
    p = "".join(chr(0x100 + i) for i in range(60))
    df = spark.createDataFrame([(1, "a", 5, 6, 7, 1), (2, p + "ab", 7, 8, 9, 62), (3, "cc" + p, 9, 1, 2, 62), (4, p, 1, 1, 1, 60)], "doc_id int, text string, bucket int, n_bytes int, others int, n_chars int")
    got = sorted(map(tuple, S.keep_unrepeated(df).collect()))
    assert got == [(1, "a", 5, 6, 7, 1), (2, p + "ab", 7, 8, 9, 62), (3, "cc", 9, 1, 2, 2)]


def test_loser_tree_is_a_sort():
    r = random.Random(3)
    for k in (1, 2, 5, 9):
        runs, every = [], []
        for _ in range(k):
            x = sorted(bytes(r.choice(b"ab") for _ in range(6)) for _ in range(r.randint(0, 40)))
            every += x
            n = [0] + [next((j for j in range(6) if a[j] != b[j]), 6) for a, b in zip(x, x[1:])]
            runs.append((b"".join(x), n[: len(x)]))
        order, shared = S.loser_tree(runs, 6)
        at, got = [0] * k, []
        for q in order:
            got.append(runs[q][0][6 * at[q] : 6 * at[q] + 6])
            at[q] += 1
        assert got == sorted(every)
        assert shared[1:] == [next((j for j in range(6) if a[j] != b[j]), 6) for a, b in zip(got, got[1:])]


def test_front_coding_round_trip():
    r = np.random.default_rng(5)
    rows = np.sort(r.integers(0, 3, (200, S.WIDTH), dtype=np.uint8).view(f"S{S.WIDTH}"), axis=0).view(np.uint8).reshape(200, S.WIDTH)
    out = S.decode_run(S.encode_run(rows, np.arange(200), np.arange(200)))
    assert out[0] == rows.tobytes() and (out[2] == np.arange(200)).all()
