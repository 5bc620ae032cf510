"""run() held against plain versions of its stages, each on the stage's own input."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from termweave.llm import decontam, toxicity

from .test_decontam import split
from .test_simhash import brute as components_of
from .test_suffix_dedup import brute as repeats_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, out = random.Random(5), tmp_path_factory.mktemp("tables")
    word = lambda: "".join(r.choice(["ba", "do", "ki", "lu", "mé", "no"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(30) for _ in range(5)]
    passage = text(60)
    rows, labels = [], []
    for i in range(240):
        t, toxic = text(r.randint(5, 120)), int(i % 8 == 0)
        if toxic:
            t = " ".join(w + (" vilescum" if k % 4 == 0 else "") for k, w in enumerate(t.split()))
        if i % 11 == 1:
            t += " " + passage + " " + text(5)
        if i % 13 == 2:
            t += " " + r.choice(items) + " " + text(9)
        if i % 17 == 3 and rows:
            t = rows[-2][1]
        rows.append((i, t, "en", r.choice(["a", "b", None]), len(t)))
        labels.append((i, 1, toxic))
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0), (901, "", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, sorted(map(tuple, docs.collect()), key=str)
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        after = sorted(map(tuple, docs.collect()), key=str)
        results.append((name, before, after))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            docs = spark.createDataFrame(after, docs.schema)
        before = after
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = results
    assert b == [x for x in a if "vilescum" not in (x[1] or "")], "toxicity"
    comp = components_of([(x[0], x[1]) for x in b])
    assert sorted(x[0] for x in c) == sorted({z for _, _, z in comp}) and all(x in b for x in c), "near copies"
    want = {x[0]: x[1:4] for x in repeats_of([(x[0], x[1]) for x in c])}
    by = {x[0]: x for x in d}
    for x in c:
        n, removed, _ = want[x[0]]
        if not removed:
            assert by[x[0]] == x
        elif x[0] in by:
            assert n - removed - 6 <= len(by[x[0]][1].encode()) <= n - removed and by[x[0]][4] == len(by[x[0]][1])
        else:
            assert n == removed
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in map(split, items) for i in range(len(w) - 9)}
    leaks = lambda t: any(tuple(split(t)[i : i + 10]) in windows for i in range(len(split(t)) - 9))
    assert any(leaks(x[1]) for x in d) and not any(leaks(x[1]) for x in e)
    assert [x for x in e if decontam.CUT.decode() not in (x[1] or "")] == [x for x in d if not leaks(x[1])]
    assert f and {x[0] for x in f} <= {x[0] for x in e}


def test_run(spark, folder):
    """run() gives what the stages give that test_stages holds against plain versions."""
    got = sorted(map(str, __spark_entry__.queries()["pipeline"](spark, folder).collect()))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, folder)
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    assert len(got) > 50 and got == sorted(map(str, docs.collect()))


def test_columns_of_any_name_and_null_ids(spark, folder):
    names = ["bucket", "n_bytes", "others", "kept_rows", "cut", "toxicity", "unit", "size", "kept", "salt", "taken"]
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(k if k % 3 else None, text(20), "en", "a", None, *range(k, k + len(names))) for k in range(12)] + [(7, text(9), "en", None, 1, *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns[-len(names) :] == names and sorted(map(tuple, docs.collect()), key=str) == sorted(rows, key=str), name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert out and all(tuple(x.kept) in rows for x in out)


def test_toxicity_model_is_needed(spark, folder):
    assert toxicity.trained(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).model is not None


def test_empty_table(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
