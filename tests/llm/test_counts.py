import math

import duckdb
import pytest

from termweave.llm import licenses as L
from termweave.llm import rollup as R

SMALL = "/root/testdata/sf0.001/documents.parquet"


def rows_of(sql):
    return sorted(duckdb.sql(sql.replace("FROM documents", f"FROM '{SMALL}'")).fetchall(), key=str)


def same(a, b):
    return len(a) == len(b) and all(all((x is None and y is None) or (math.isclose(x, y) if isinstance(x, float) and isinstance(y, float) else x == y) for x, y in zip(p, q)) for p, q in zip(a, b))


def test_sql(spark):
    docs = spark.read.parquet(SMALL)
    assert same(sorted(map(tuple, L.scan(docs).collect()), key=str), rows_of(L.SQL))


def slow(text):
    best, hits = {}, 0
    for k, unit in enumerate([text or "", *(text or "").split("\n")]):
        g, found = L.bigrams(unit.encode()), False
        for name, t in L.TEMPLATES.items():
            h = L.bigrams(t.encode())
            d = 2 * len(g & h) / (len(g) + len(h)) if g else 0
            if d >= L.THRESHOLD:
                best[name], found = max(d, best.get(name, 0)), True
        hits += bool(k and found)
    top = min(best, key=lambda k: (-best[k], k), default=None)
    return hits, top, best.get(top), ",".join(sorted(best))


def test_licenses_against_all_templates(spark):
    t = L.TEMPLATES
    texts = [None, "", "a", t["MIT"], t["MIT"].upper().replace(" ", "\n"), "x\n" + t["MIT (line)"] + "\nAll rights, reserved", t["ISC"].replace("copies", "cases"), t["GPL-3.0 (line)"] + " " + t["Apache-2.0 (line)"], "word " * 100_000, t["BSD-2-Clause"][:400], "\n".join(t.values())]
    docs = spark.createDataFrame([(i, x, "MIT") for i, x in enumerate(texts)], "doc_id int, text string, license string")
    assert sorted(map(tuple, L.scan(docs).collect())) == sorted((i, *slow(x)) for i, x in enumerate(texts))
    assert L.scan(docs.where("false")).collect() == []


def every_run(text):
    w, best = L.words(text.encode()), {}
    for name, t in L.TEMPLATES.items():
        h = L.bigrams(t.encode())
        for i in range(len(w) - 1):
            g = set()
            for j in range(i, len(w) - 1):
                g.add((w[j], w[j + 1]))
                d = 2 * len(g & h) / (len(g) + len(h))
                if d >= L.THRESHOLD:
                    best[name] = max(d, best.get(name, 0))
    return best


def test_notices_inside_longer_texts(spark):
    t, code = L.TEMPLATES, "int main ( int n ) { return call ( n ) ; } "
    wrap = lambda x: "\n".join(" * " + " ".join(x.split()[i : i + 9]) for i in range(0, len(x.split()), 9))
    texts = [f"/*\n{wrap(t['ISC'])}\n */\n{code * 9}", "Copyright 2020 X. All rights reserved.", f"{code}{t['GPL-3.0 (line)']} {t['Apache-2.0 (line)']}", f"{code * 3}\n{wrap(t['Apache-2.0'])}\n{code * 3}", code]
    matcher = L.Matcher(t)
    assert [matcher.text(x.encode(), windows=True)[1] for x in texts] == [every_run(x) for x in texts]
    got = L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), windows=True)
    assert [r.license for r in got.orderBy("doc_id").collect()] == ["ISC", "rights reserved (line)", "Apache-2.0 (line)", "Apache-2.0", None]


def test_windows_of_the_tables(spark):
    docs = spark.read.parquet(SMALL)
    assert same(sorted(map(tuple, L.scan(docs, windows=True).collect()), key=str), rows_of(L.SQL))


COLUMNS = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"


def test_rollup(spark, tmp_path):
    book = R.Rollup(spark, f"file://{tmp_path}/book")
    assert book.totals().collect() == []
    first = spark.createDataFrame([("insert", "a", "en", "t1", 5, None), ("insert", "a", "en", "t1", 7, None), ("insert", None, None, "t1", 3, None), ("insert", "a", "en", "t2", None, None)], COLUMNS)
    second = spark.createDataFrame([("revise", "a", "en", "t1", 9, 7), ("delete", "a", "en", "t1", 5, None), ("delete", None, None, "t1", 3, None)], COLUMNS)
    assert book.commit("b1", first) and not book.commit("b1", first)
    assert book.commit("b2", second) and book.commit("b3", second.where("false"))
    want = [("a", "en", "t1", 1, 9), ("a", "en", "t2", 1, 0)]
    assert sorted(map(tuple, book.totals().collect())) == want
    with pytest.raises(Exception, match="unknown op"):
        book.commit("b4", spark.createDataFrame([(None, "a", "en", "t1", 9, 7)], COLUMNS))
    assert book.committed() == {"b1", "b2", "b3"} and sorted(map(tuple, book.totals().collect())) == want
    book.compact()
    assert sorted(map(tuple, book.totals().collect())) == want and not book.commit("b2", second)
    assert book.commit("b5", first) and sorted(map(tuple, book.totals().collect()), key=str)[0][3:] == (3, 21)
    with pytest.raises(ValueError):
        book.commit("../x", first)


def test_rollup_times(spark, tmp_path):
    book = R.Rollup(spark, f"file://{tmp_path}/book")
    rows = [("insert", "a", "en", "t", 5, None, 3), ("revise", "a", "en", "t", 4, 5, 2), ("delete", "a", "en", "t", 4, None, None)]
    assert book.commit("b1", spark.createDataFrame(rows, COLUMNS + ", times long"))
    assert list(map(tuple, book.totals().collect())) == [("a", "en", "t", 2, 9)]


def coders():
    return {name: R.Counter(v).coder for name, v in R.vocabularies().items()}


def brute_history(rows):
    """(source, lang, tokenizer, docs, tokens) of what stays: of equal texts the least (doc_id, source, lang), nulls first."""
    first = lambda v: (v is not None, v)
    stay = {}
    for d, t, s, g in rows:
        k = (first(d), first(s), first(g))
        stay[t or ""] = min(stay.get(t or "", k), k)
    out = {}
    for name, coder in coders().items():
        for t, (_, (_, s), (_, g)) in stay.items():
            n, k = out.get((s, g, name), (0, 0))
            out[s, g, name] = n + 1, k + len(coder.encode_ordinary(t.strip()))
    return sorted(((*k, *v) for k, v in out.items()), key=str)


def test_history_of_copies(spark):
    """Nulls, ties, rows that repeat, white space at the ends, and an empty table."""
    rows = [(1, "a b", "x", "en"), (1, "a b", "x", "en"), (2, "a b", None, None), (3, None, "x", "en"), (None, "", None, "en"), (4, "  - c, don't \n", "x", "en"), (5, "  - c, don't \n", "y", "en"), (6, " ", "x", "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, lang string, tokens int")
    assert sorted(map(tuple, R.history(docs).collect()), key=str) == brute_history(rows)
    assert R.history(docs.where("false")).collect() == []


def test_history_of_the_table(spark):
    docs = spark.read.parquet(SMALL)
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()]
    assert sorted(map(tuple, R.history(docs).collect()), key=str) == brute_history(rows)


def test_token_counts_of_long_texts():
    for name, v in R.vocabularies().items():
        c = R.Counter(v)
        for t in ("hello world", "", "x" + " " * 9000 + "y", "\n" * 5000, "a\u3000" + "\t" * 6000 + "\u00e9 b", " " * 4096 + "z" + " " * 5000, "w " * 20_000):
            assert c.count(t) == len(c.coder.encode_ordinary(t)), (name, t[:9])
        assert c.count("x" + " " * 2_000_000 + "y") > 1 and c.count("ab" * 500_000) > 1


def test_compaction_survives_a_crash(spark, tmp_path, monkeypatch):
    book = R.Rollup(spark, f"file://{tmp_path}/book")
    rows = lambda n: spark.createDataFrame([("insert", "a", "en", "t", n, None)], COLUMNS)
    assert book.commit("b1", rows(5)) and book.commit("b2", rows(7))
    # before the rename: an attempt that lies about counts nothing
    spark.createDataFrame([("a", "en", "t", 9, 99)], R.DELTA).write.parquet(f"{tmp_path}/book/_attempt-sum/totals")
    assert list(map(tuple, book.totals().collect())) == [("a", "en", "t", 2, 12)]
    # after the rename: what it covers is still there, and ignored
    with monkeypatch.context() as m:
        m.setattr(R.Rollup, "clean", lambda self: None)
        book.compact()
    assert {"batch=b1", "batch=b2", "sum=0"} <= set(book._names(book.path))
    assert list(map(tuple, book.totals().collect())) == [("a", "en", "t", 2, 12)]
    assert book.committed() == {"b1", "b2"} and not book.commit("b1", rows(5))
    assert book.commit("b3", rows(1))
    book.compact()
    assert [n for n in book._names(book.path) if "=" in n] == ["sum=1"] and not book.commit("b3", rows(1))
    assert list(map(tuple, book.totals().collect())) == [("a", "en", "t", 3, 13)]
