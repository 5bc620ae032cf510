import random
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from termweave.llm import mixing as M


def slow_targets(size):
    """By the words of the contract: share, cap, share the excess again."""
    names = sorted((s for s in size if s is not None), key=lambda s: s) + ([None] if None in size else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, full, out = Fraction(sum(size.values())), set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        w = sum(weight[s] for s in open_)
        out |= {s: left * weight[s] / w for s in open_}
        over = [s for s in open_ if out[s] > 3 * size[s]]
        if not over:
            return out
        for s in over:
            out[s] = Fraction(3 * size[s])
            left -= out[s]
            full.add(s)


def rows(seed, n=600):
    r = random.Random(seed)
    names = ["b", "a", None, "é", "Z", "hot", "tiny", "none"]
    out = []
    for i in range(n):
        s = "hot" if r.random() < 0.35 else r.choice(names[:5])
        out.append((i, s, r.choice([" ", "\n", "\t "]).join("w" * r.randint(1, 3) for _ in range(r.randint(0, 200)))))
    return out + [(9000, "tiny", "one two"), (9001, "none", None), (9002, "none", " "), (None, "a", "x y"), (3, "a", "x"), (3, "a", "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_contract(spark, seed, monkeypatch):
    monkeypatch.setattr(M, "SHARD_ROWS", 40)
    data = rows(seed)
    df = spark.createDataFrame(data, "doc_id long, source string, text string").repartition(5)
    got = M.mix(df).collect()
    size = defaultdict(int)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, s, t in data:
        size[s] += count(t)
    want = slow_targets(size)
    assert len(got) == len(data)
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in got) == sorted((str(d), str(s), count(t)) for d, s, t in data)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - float(want[r.source])) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - float(want[s])) <= max(M.BLOCK * 1.5, 0.002 * float(want[s])), s
    again = M.mix(df.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_highest_quotients(spark):
    votes = {1: 53.0, 2: 24.0, 3: 23.0, 4: 0.0, 5: 1.0}
    for blocks in (1, 2, 7, 20, 101):
        df = spark.createDataFrame([(k, v, 0) for k, v in votes.items()], "unit long, v double, g int")
        got = {r.unit: r.quota for r in M.apportion(df, "v", F.lit(blocks), ["g"], [F.col("unit")]).collect()}
        best = sorted(((-v / (2 * k + 1), u) for u, v in votes.items() for k in range(blocks)))[:blocks]
        assert got == {u: sum(1 for _, x in best if x == u) for u in votes}


def test_empty(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []
    one = M.mix(spark.createDataFrame([(1, None, None, 7)], "doc_id long, source string, text string, size int")).collect()
    assert [(r.size, r.target, r.taken) for r in one] == [(0, 0.0, 0)]


def test_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    want = duckdb.sql(M.TARGET_SQL.replace("FROM documents", f"FROM '{path}'")).fetchall()
    got = M.mix(spark.read.parquet(path)).select("doc_id", "size", "source_size", "target").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_columns_asked_for(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], " ".join("w" * (k % 5)), k) for k in range(40)], "doc_id int, source string, text string, size int")
    got = M.mixed(df).collect()
    assert got and all(r.kept.text == " ".join("w" * (r.doc_id % 5)) and r.kept.size == r.doc_id and r.passes * r["size"] + r.head_words == r.taken and r.head_words < r["size"] for r in got)


def test_rows_without_ids_fill_many_shards(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_ROWS", 20)
    data = [(None, "a", " ".join(["w"] * (1 + k % 7)) + f" x{k}") for k in range(200)] + [(5, "b", f"y{k} z") for k in range(100)]
    got = M.mix(spark.createDataFrame(data, "doc_id long, source string, text string")).collect()
    assert len(got) == 300
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= M.BLOCK * 1.5 and all(r.taken <= 3 * r["size"] for r in mine)
