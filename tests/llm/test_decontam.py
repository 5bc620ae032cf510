import hashlib
import random
import re

from termweave.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, ids = split(t), set(), set()
        for item, text in items:
            x = split(text)
            m = min(10, len(x))
            for i in range(len(x) - m + 1 if m else 0):
                for j in range(len(w) - m + 1):
                    if w[j : j + m] == x[i : i + m]:
                        hit |= {*range(j, j + m)}
                        ids.add("" if item is None else str(item))
        ids = sorted(ids)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def data(seed):
    r = random.Random(seed)
    vocab = ["alpha", "b", "c3", "Đelta", "e", "éf", "g", "H"]
    sent = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "-", "\n", "_"]) for _ in range(n))
    items = [(i, sent(r.choice([1, 4, 9, 10, 11, 25]))) for i in range(3, 18)] + [(99, ""), (100, None), (None, "alpha beta gamma"), (10, "zz top")]
    docs = []
    for i in range(60):
        t = sent(r.randint(0, 50))
        if r.random() < 0.4:
            p = r.choice(items)[1] or ""
            t = t[: len(t) // 2] + " ! " + p.upper() + " " + t[len(t) // 2 :]
        docs.append((i, t))
    return docs + [(7, "ZZ top"), (None, None), (8, ""), (9, "x " * 5000 + (items[2][1] or ""))], items


def test_against_brute_force(spark):
    docs, items = data(1)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sorted(map(tuple, D.digest(D.report(d, b)).collect()), key=str) == want
    assert sorted(map(tuple, D.digest(D.report(d, b, max_words=40)).collect()), key=str) == want, "in blocks"


def test_empty(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.report(d, b).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert tuple(D.digest(D.report(one, b)).first()) == (1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)


def test_spans_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Keep this, {item.upper()}! and that.", 5, "s"), (2, item, 3, None), (3, "clean text", 10, "x"), (4, None, None, None), (5, "one two three four five " + item + " six seven eight nine ten eleven", 1, "")]
    d = spark.createDataFrame(rows, "doc_id int, text string, n_chars int, item_ids string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in D.remove_spans(d, b).collect()}
    assert sorted(got) == [1, 3, 4, 5]
    assert got[1].text == "Keep this, \u2042! and that." and got[1].n_chars == len(got[1].text)
    assert tuple(got[3]) == rows[2] and got[4].text is None
    again = D.report(D.remove_spans(d, b), b)
    assert again.where("n_hit > 0").count() == 0


def test_columns_of_any_name(spark):
    item = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, f"Keep {item} this", True, "x"), (2, "clean", False, "y")], "doc_id long, text string, cut boolean, _decontam_cut string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted(map(tuple, D.remove_spans(d, b).collect()))
    assert got == [(1, "Keep \u2042 this", True, "x"), (2, "clean", False, "y")] and D.remove_spans(d, b).columns == d.columns


def test_items_of_one_id_fill_many_blocks(spark):
    r = random.Random(9)
    items = [(7, " ".join(f"w{r.randrange(500)}" for _ in range(12))) for _ in range(60)] + [(8, items_text) for items_text in ["a b", "c"]]
    docs = [(k, " x ".join(t for _, t in r.sample(items, 2))) for k in range(30)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert max(map(len, D.blocks_of(b, 50))) < 30
    assert sorted(map(tuple, D.digest(D.report(d, b, max_words=50)).collect()), key=str) == brute(docs, items)
