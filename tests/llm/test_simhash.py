import random

import numpy as np
import xxhash

from termweave.llm import simhash as S


def slow_fp(text):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(rows):
    fps = [slow_fp(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                comp[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", low.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in S.near_duplicates(df).collect()), key=str)


def corpus(seed, n=160):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeÉf") for _ in range(r.randint(1, 7)))
    bases = [[word() for _ in range(r.randint(1, 400))] for _ in range(25)]
    rows = []
    for i in range(n):
        b = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            b[r.randrange(len(b))] = word()
        rows.append((r.randrange(10**6), r.choice([" ", "\n", "\t "]).join(b)))
    return rows


def test_fingerprints():
    texts = ["", " \n", "One", "a b c", "a b c d", "A B C D e f", "x " * 3000, "é b c d e\u0085f g"]
    assert S.fingerprints([t.encode() for t in texts]).tolist() == [slow_fp(t) for t in texts]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed) + [(None, "a b"), (None, None), (5, ""), (3, None), (5, "")]
        assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_planted_distances(monkeypatch):
    r = np.random.default_rng(7)
    base = r.integers(0, 2**63, 50, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base.tolist():
        for d in (1, 2, 3, 4, 5):
            for _ in range(30):
                fps.add(x ^ sum(1 << int(b) for b in r.choice(64, d, replace=False)))
    fps = np.array(sorted(fps), dtype=np.uint64)
    want = {(a, b) for i, a in enumerate(fps.tolist()) for b in fps[:i].tolist() if (a ^ b).bit_count() <= 4}

    def closed(pairs):
        a, b = S.stars(np.array([p[0] for p in pairs], dtype=np.uint64).view(np.int64), np.array([p[1] for p in pairs], dtype=np.uint64).view(np.int64))
        return sorted(zip(a.tolist(), b.tolist()))

    for segments in (2, 3):
        import pyarrow as pa

        out = pa.Table.from_batches(S._filed(segments, 1)([pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], names=["fp"])]))
        got = S._met(out)
        assert sorted(zip(got["a"].to_pylist(), got["b"].to_pylist())) == closed(sorted(want))


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(4, text, "x"), (2, text, "y"), (2, text, "y"), (9, "something else altogether here", "z"), (None, None, "n")]
    df = spark.createDataFrame(rows, "doc_id int, text string, fp string")
    assert sorted(map(tuple, S.keep_one(df).collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_keep_one_decides_by_row(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base), " ".join([*base[:299], "x"]), "quite another text of some words", "and a third one with no relation"]
    rows = [(None, texts[2]), (None, texts[3]), (None, texts[3]), (7, texts[0]), (8, texts[1]), (8, texts[2] + " again"), (9, "one more that shares its id"), (9, "with this one of other words")]
    want = [rows[k] for k in (0, 1, 3, 5, 6, 7)]
    assert (slow_fp(texts[0]) ^ slow_fp(texts[1])).bit_count() <= 4
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, S.keep_one(df).collect()), key=str) == sorted(want, key=str)


def test_many_under_one_value(monkeypatch):
    """Entries beyond MANY are parted by pieces; the components stay those of all pairs."""
    monkeypatch.setattr(S, "MANY", 20)
    r = np.random.default_rng(3)
    base = r.integers(0, 2**43, 60, dtype=np.uint64)
    fps = sorted({int(x) ^ sum(1 << int(b) for b in r.choice(43, int(d), replace=False)) for x in base for d in r.integers(0, 6, 8)})
    brute = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4]
    got = [(int(x), int(y)) for a, b in S._connected(np.array(fps, dtype=np.uint64), list(range(64))) for x, y in zip(a, b)]
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    closed = lambda p: sorted(zip(*(z.tolist() for z in S.stars(np.array([x for x, _ in p], dtype=np.int64), np.array([y for _, y in p], dtype=np.int64)))))
    assert closed(got) == closed(brute)


def test_keep_one_with_clashing_names(spark):
    rows = [(1, "a text of some words here", 5, 6, 7), (2, "a text of some words here", 8, 9, 1), (2, "a text of some words here", 8, 9, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_rows int, KEPT_ID int, unit int")
    assert list(map(tuple, S.keep_one(df).collect())) == rows[:1]


def test_components_of_hubs(spark, monkeypatch):
    from termweave.llm import components as C

    monkeypatch.setattr(C, "HUB", 5)
    r = random.Random(4)
    edges = [(k, 1000) for k in range(300)] + [(2000 + k, 2000) for k in range(1, 200)] + [(r.randrange(3000, 3100), r.randrange(3000, 3100)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = sorted((x, find(x)) for x in root if sum(x in e and e[0] != e[1] for e in edges))
    assert sorted(map(tuple, C.components(spark.createDataFrame(edges, "a long, b long")).collect())) == want


def test_components_plan_one_star_at_a_time(spark, monkeypatch):
    """Edges that are stars take no round, and no plan reads the edges more often than one star does: plans fill the driver."""
    from termweave.llm import components as C

    seen, real = [], C.materialise

    def noted(df, tag):
        seen.append((tag, df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")))
        return real(df, tag)

    monkeypatch.setattr(C, "materialise", noted)
    star = spark.createDataFrame([(1, 5), (1, 6), (7, 3), (8, 3)], "a long, b long")
    assert sorted(map(tuple, C.components(star).collect())) == [(1, 1), (3, 3), (5, 1), (6, 1), (7, 3), (8, 3)]
    assert [tag for tag, _ in seen] == ["edges", "components"]
    seen.clear()
    path = spark.createDataFrame([(k, k + 1) for k in range(9)], "a long, b long")
    assert sorted(map(tuple, C.components(path).collect())) == [(k, 0) for k in range(10)]
    assert len(seen) > 3 and max(n for _, n in seen) <= 8
    assert C.components(path.limit(0)).isEmpty()
