import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from termweave.llm import near as N


def plain(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    """Indices of rows to keep, by all pairs."""
    sets, comp = [plain(t) for _, t in rows], list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        both, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if 5 * both >= 4 * every and comp[i] != comp[j]:
            comp = [comp[i] if c == comp[j] else c for c in comp]
    return sorted((min((d for (d, _), c in zip(rows, comp) if c == k)) for k in set(comp)))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    rows = []
    for _ in range(30):
        base = [word() for _ in range(r.randint(3, 400))]
        rows.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            copy = list(base)
            for _ in range(round(len(base) * r.choice([0, 0.005, 0.01, 0.02, 0.03]))):
                copy[r.randrange(len(copy))] = word()
            rows.append(r.choice([" ", "\n"]).join(copy))
    return [(i, t) for i, t in enumerate([*rows, "", None])]


def test_stage_against_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = corpus_pipeline.near_dedup_stage(spark, df, "").collect()
        assert sorted(x.doc_id for x in got) == kept(rows)


def test_copies_that_only_meet_beside_the_centre(spark):
    """A chain under one band: neighbours are near copies, its ends are not."""
    at = lambda k: np.arange(10 * k, 10 * k + 100, dtype=np.uint32).tobytes()
    order = (5, 0, 3, 1, 4, 2)
    rows = [(k, k, u, 100, at(k), [7]) for u, k in enumerate(order)]
    marked = spark.createDataFrame(rows, "doc_id long, text_hash long, unit long, n long, hashes binary, keys array<long>")
    assert sorted(map(tuple, N.near_copies(marked).collect())) == [(u, 0) for u in range(6)]


def test_threshold():
    a = np.arange(9, dtype=np.uint32)
    assert N.similar(a[:8], a[:8]) and N.similar(a[:4], a[:5]) and not N.similar(a[:7], a) and N.similar(a[:0], a[:0]) and not N.similar(a[:0], a)


def test_group_links_against_all_pairs():
    r = np.random.default_rng(5)
    for _ in range(40):
        base = np.arange(60, dtype=np.uint32)
        sets = [np.unique(np.r_[base[r.random(60) > r.choice([0.02, 0.1, 0.25])], r.integers(100, 400, r.integers(0, 12)).astype(np.uint32)]) for _ in range(25)]
        own = r.integers(0, 20, 25).tolist()
        comp = list(range(20))
        join = lambda a, b: [b if c == a else c for c in comp]
        for i, j in combinations(range(25), 2):
            if N.similar(sets[i], sets[j]):
                comp = join(max(comp[own[i]], comp[own[j]]), min(comp[own[i]], comp[own[j]]))
        want, comp = comp, list(range(20))
        for i, j in N.group_links(own, sets):
            assert N.similar(sets[i], sets[j])
            comp = join(max(comp[own[i]], comp[own[j]]), min(comp[own[i]], comp[own[j]]))
        assert comp == want


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP", 7)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup_stage(spark, df, "").collect()) == kept(rows)


def test_simhash_links_without_bands(spark):
    """Fingerprints alone lead to near copies, and what they lead to is verified."""
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(900)]
    rows = [(0, " ".join(base)), (1, " ".join([*base[:450], "other", *base[451:]])), (2, " ".join(base + base[:3])), (3, " ".join(f"v{k}" for k in range(700))), (4, ""), (5, "one"), (6, None)]
    marked = N.materialise(N._marked(spark.createDataFrame(rows, "doc_id long, text string")), "marked")
    unit = {x.doc_id: x.unit for x in marked.collect()}
    alike = {}
    for x in N.simhash_groups(marked).collect():
        alike.setdefault(x.key, set()).add(x.unit)
    assert [unit[0], unit[1], unit[2]] and {unit[0], unit[1], unit[2]} in alike.values()
    alone = marked.withColumn("keys", N.F.expr("array(unit)"))
    found = {x.node: x.component for x in N.near_copies(alone).collect()}
    assert len({found[unit[k]] for k in (0, 1, 2)}) == 1 and unit[3] not in found
    # one fingerprint given to sets that have nothing in common links nothing
    forced = marked.where("doc_id IN (0, 3, 5)").withColumn("fp", N.F.lit(7).cast("long")).withColumn("keys", N.F.expr("array(unit)"))
    assert N.near_copies(forced).collect() == []
