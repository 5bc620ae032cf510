import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termweave.llm import quality as Q
from termweave.llm import toxicity as X

DATA = "/root/testdata/sf0.1"


# of the rows marked toxic here about one in sixteen holds none of the expressions that mark the others
@pytest.mark.parametrize(("module", "label", "recall"), [(Q, "quality", 0.95), (X, "toxic", 0.9)])
def test_held_out_accuracy(spark, module, label, recall):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = module.score(docs, labels)
    assert got.count() == docs.count()
    pdf = got.join(labels, "doc_id").where("held_out").select("predicted", "score", F.col(label).alias("y")).toPandas()
    pos, neg = pdf[pdf.y == 1], pdf[pdf.y == 0]
    print(label, len(pdf), (pos.predicted == 1).mean(), (neg.predicted == 0).mean())
    assert (pos.predicted == 1).mean() > recall and (neg.predicted == 0).mean() > 0.9
    assert pdf.score.between(0, 1).all()


@pytest.mark.parametrize("module", [Q, X])
def test_edges(spark, module):
    docs = [(i, f"good plain words number {i} here", "x", 0.5) for i in range(60)] + [(100 + i, f"FOUL ### {i} rot rot rot", "y", 0.1) for i in range(60)]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 1) for i in range(60)] + [(3, 1, 0), (None, 0, 1), (5, None, None), (99999, 0, 1)]
    docs += [(None, None, None, None), (500, None, "z", None), (501, "", "z", None), (3, "good plain words number 3 here", "x", 0.2), (502, "w " * 50000, "z", None)]
    d, la = spark.createDataFrame(docs, "doc_id int, text string, held_out string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = module.score(d, la).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].held_out is False and by[500].score == by[501].score
    assert by[10].predicted != by[110].predicted
    none = spark.createDataFrame([], la.schema)
    assert {r.score for r in module.score(d, none).collect()} == {0.5}
    assert module.score(spark.createDataFrame([], d.schema), la).collect() == []


def test_repeated_ids_are_learnt_once(spark):
    docs = spark.createDataFrame([(7, f"text {i % 3}") for i in range(300)] + [(8, None), (9, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 1), (9, 0)], "doc_id long, toxic int")
    assert X.labelled_sample(docs, labels, "toxic", F.lit(True)) == [(7, 1, "text 0"), (9, 0, "x")]


def test_lasso_is_sparse_and_rules_compile(spark):
    r = np.random.default_rng(1)
    x = r.random((800, len(Q.STATISTICS)))
    y = ((x[:, 2] > 0.6) & (x[:, 4] <= 0.5)).astype(int)
    b, kept = Q.fit(x, y)
    assert kept and len(kept) < len(Q.extract_rules(x, y.astype(float)))
    rows = spark.createDataFrame([tuple(map(float, v)) for v in x[:50]], list(Q.STATISTICS))
    got = np.array([v[0] for v in rows.select(Q.compile_rules(b, kept)).collect()])
    want = 1 / (1 + np.exp(-(b + Q.fires([k for _, k in kept], x[:50]) @ [w for w, _ in kept])))
    assert np.allclose(got, want) and ((got > 0.5) == (y[:50] == 1)).mean() > 0.9


def test_shared_backoff():
    m = X.Model({b"the": 50, b"there": 9}, {b"the": 40, b"vile": 12})
    says = dict(zip([b"vile", b"the", b"unseen", b"vilest"], m.of([b"vile", b"the", b"unseen", b"vilest"])))
    assert says[b"vile"] > 1 and says[b"vilest"] > 0.5 and abs(says[b"the"]) < 1
    # a first byte that neither class has seen speaks by what each leaves to the backoff there
    assert says[b"unseen"] == pytest.approx(np.log(2 * X.TOP_DISCOUNT / 52) - np.log(X.TOP_DISCOUNT / 59))


def _kneser_ney(ordinary, toxic):
    """log P(byte | context, toxic) - log P(byte | context, ordinary) by its definition, with dictionaries."""
    seqs = {w: [1, *w, 1] for w in {*ordinary, *toxic}}
    gram = lambda q, i, n: tuple(q[max(0, i - n + 1) : i + 1])
    kinds: dict = {}  # of each order: gram -> the grams one byte longer that end in it
    for n in range(1, X.ORDER):
        kinds[n] = {}
        for q in seqs.values():
            for i in range(1, len(q)):
                kinds[n].setdefault(gram(q, i, n), set()).add(gram(q, i, n + 1))

    def low(n, q, i):
        if n == 0:
            return 1 / 256
        g = gram(q, i, n)
        # grams that follow the same context of n - 1 bytes
        same = {h: k for h, k in kinds[n].items() if (h[:-1], len(h)) == (g[:-1], len(g))}
        total = sum(map(len, same.values()))
        return (len(same.get(g, ())) - X.DISCOUNT + X.DISCOUNT * len(same) * low(n - 1, q, i)) / total

    counts = []
    for c in (ordinary, toxic):
        mine: dict = {}
        for w, k in c.items():
            for i in range(1, len(seqs[w])):
                h, g = gram(seqs[w], i - 1, X.ORDER - 1), gram(seqs[w], i, X.ORDER)
                mine.setdefault(h, {}).setdefault(g, 0)
                mine[h][g] += k
        counts.append(mine)

    def says(word):
        q, out = [1, *word, 1], 0.0
        for i in range(1, len(q)):
            h, g = gram(q, i - 1, X.ORDER - 1), gram(q, i, X.ORDER)
            seen = any(g in c.get(h, {}) for c in counts)
            p = []
            for c in counts:
                here = c.get(h, {})
                total = sum(here.values())
                rest = sum(min(k, X.TOP_DISCOUNT) for k in here.values())
                own = max(here.get(g, 0) - X.TOP_DISCOUNT, 0)
                # of an unseen byte the shared lower orders cancel
                p.append((own + rest * (low(X.ORDER - 1, q, i) if seen else 1.0)) / total if total else (low(X.ORDER - 1, q, i) if seen else 1.0))
            out += np.log(p[1]) - np.log(p[0])
        return out

    return says


def test_model_is_kneser_ney():
    ordinary = {b"cat": 9, b"cater": 4, b"dog": 7, b"a": 30, b"an": 3, b"category": 2}
    toxic = {b"cat": 2, b"catnip": 8, b"dolt": 6, b"a": 12, b"dogs": 3}
    model, says = X.Model(ordinary, toxic), _kneser_ney(ordinary, toxic)
    words = [*ordinary, *toxic, b"cats", b"dot", b"dolts", b"zebra", b"an", b"categories", b"catnap"]
    assert np.allclose(model.of(words), [says(w) for w in words], atol=1e-9)
    assert says(b"cats") != 0 and says(b"zebra") != 0


def test_foreign_labels_take_no_place(spark, monkeypatch):
    monkeypatch.setattr(Q, "MAX_PER_CLASS", 40)
    good, bad = "The calm water of the lake was clear and still. ", "@@ ## 9 9 9 9 ~~ %% 0 0 \n"
    docs = spark.createDataFrame([(i, (good, bad)[i % 2] * (2 + i % 5)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(60)] + [(10**6 + i, i % 2, i % 2) for i in range(2000)], "doc_id long, quality int, toxic int")
    assert len({round(r.score, 6) for r in Q.score(docs, labels).collect()}) > 1
    rows = X.labelled_sample(docs, labels, "toxic", F.lit(True), per_class=40)
    assert len(rows) == 60


def test_drop_toxic_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a text", "mine")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert list(map(tuple, X.with_score(docs, X.fit([]), "s").drop("s").collect())) == [(1, "a text", "mine")]
    assert X.drop_toxic(docs, labels).columns == docs.columns


def test_every_labelled_text_is_learnt_from_whole(spark, monkeypatch):
    """More texts of a class than a sample would hold, and texts beyond 20,000 characters."""
    monkeypatch.setattr(X, "COUNTED", 50)
    seen = []
    monkeypatch.setattr(X.Model, "counted", classmethod(lambda cls, w, a, b: seen.append({k: (int(m), int(n)) for k, m, n in zip(w.to_pylist(), a, b)}) or cls({b"plain": 9}, {b"vile": 9})))
    rows = [(i, f"plain w{i}", 0) for i in range(1500)] + [(2000 + i, "vile " * 5000 + f"v{i}", 1) for i in range(30)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert X.trained(docs, labels).model is not None
    learnt = {r.doc_id for r in docs.where(~X.held_out("doc_id", 5, 0) & ~X._turn(0)).select("doc_id").collect()}
    want = {b"plain": (sum(i < 1500 for i in learnt), 0), b"vile": (0, 5000 * sum(i >= 2000 for i in learnt))}
    want |= {f"w{i}".encode() if i < 1500 else f"v{i - 2000}".encode(): (int(i < 1500), int(i >= 2000)) for i in learnt}
    assert len(learnt) > 700 and seen == [want]


def test_shards_build_the_same_model(spark, monkeypatch):
    """More words than the driver takes: none comes to it, and the model is that of all words at once."""
    r = np.random.default_rng(3)
    rows = [(bytes(r.choice(list(b"abcdeno\xc3\xa9"), r.integers(1, 18))), int(r.integers(0, 9)), int(r.integers(0, 9)) * int(k % 3 == 0)) for k in range(3000)]
    rows = list({w: (w, a, b) for w, a, b in rows if a + b}.values())
    words = spark.createDataFrame(rows, "word binary, ordinary long, toxic long").repartition(5)
    monkeypatch.setattr(X, "DEALT", 100)
    monkeypatch.setattr(X, "SHARD_BYTES", 1000)
    whole = X.Model.counted(pa.array([w for w, _, _ in rows], pa.binary()), *(np.array(c) for c in list(zip(*rows, strict=True))[1:]))
    got = X._sharded(words, sum(len(w) for w, _, _ in rows))
    for name in ("grams", "contexts"):
        assert len(getattr(got, name)) > 500 and np.array_equal(getattr(got, name), getattr(whole, name))
    assert np.allclose(got.says, whole.says, atol=1e-9) and np.allclose(got.rest, whole.rest, atol=1e-9)


def test_many_words_do_not_come_to_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"good plain words n{i} here" if i % 2 else f"foul rot rot f{i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(300)], "doc_id long, toxic int")
    here = {r.doc_id: r.score for r in X.score(docs, labels).collect()}
    monkeypatch.setattr(X, "AT_DRIVER", 10)
    monkeypatch.setattr(X.Model, "counted", classmethod(lambda cls, *a: 1 / 0))
    there = {r.doc_id: r.score for r in X.score(docs, labels).collect()}
    assert there == pytest.approx(here, abs=1e-6) and len({round(x, 3) for x in here.values()}) > 1
