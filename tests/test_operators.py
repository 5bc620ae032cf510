"""Operators on small fixtures with expectations worked out by hand."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from termweave import schemas
from termweave.functions import text as X
from termweave.operators import assist, graph, inspect, matching, projects, qa, seed, tm
from termweave.sources import files, sinks
from termweave.streaming.learn import Learner


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    lit = F.lit
    cases = [
        (X.clean_text(lit("<b>A</b>  &amp; B")), "A & B"), (X.fold_diacritics(lit("Čšžé")), "csze"),
        (X.boundary_match(lit("telo"), lit("telefonski")), False), (X.boundary_match(lit("telo"), lit("Telo2")), True), (X.boundary_match(lit("telo"), lit("telo.")), True), (X.boundary_match(lit("telo"), lit("xtelo telo")), True),
        (X.escape_xml(lit('<&">')), "&lt;&amp;&quot;&gt;"), (X.word_at(lit("ma mačka je"), lit(5)), "mačka"), (X.word_at(lit("ab"), lit(9)), ""), (X.splice(lit("one two"), lit(4), lit(7), lit("2")), "one 2"),
        (X.highlight(lit("the cat Theme"), F.array(lit("the"), lit("theme"), lit("t"))), "<mark>the</mark> cat <mark>Theme</mark>"), (X.highlight_entities(lit("a <span> b"), F.array(lit("span"), lit("b"))), 'a &lt;<span class="kg-term">span</span>&gt; <span class="kg-term">b</span>'),
        (X.strip_trailing_marks(lit("word).")), "word"), (X.percent_done(lit(2), lit(3)), 66), (X.length_ratio(lit(""), lit("a")), 10.0), (X.append_word(lit("a"), lit("b")), "a b"),
        (X.node_size(lit(0)), 4.0), (X.node_size(lit(10**9)), 24.0), (X.first_words(lit("a b c"), 2), "a b"),
    ]
    for c, want in cases:
        assert one(spark, c) == want
    assert one(spark, X.node_size(lit(1))) == pytest.approx(6.079442, abs=1e-6)
    assert one(spark, X.indel_ratio(lit("kitten"), lit("sitting"))) == pytest.approx(61.538462, abs=1e-6)
    assert one(spark, X.indel_ratio(lit("this is a test"), lit("this is a test!"))) == pytest.approx(96.551724, abs=1e-6)
    assert one(spark, X.scan_phrases(lit("small red ring"))) == ["red ring", "ring", "small", "small red", "small red ring"]


def test_keyword_matching(spark):
    words = spark.createDataFrame([("male gaze",), ("gaze",), ("the male",)], "keyword string")
    texts = spark.createDataFrame([(1, "Male gaze, the male  gaze"), (2, None), (3, "")], "qid long, text string")
    got = matching.keyword_hits(texts, "qid", "text", words).orderBy("start").collect()
    assert [r.keyword for r in got] == ["male gaze", "the male", "gaze"]
    ma = spark.createDataFrame([("ma",), ("člen",)], "keyword string")
    t = spark.createDataFrame([(1, "mačka člen")], "qid long, text string")
    assert [r.keyword for r in matching.keyword_hits(t, "qid", "text", ma).collect()] == ["člen"]
    assert [r.keyword for r in matching.keyword_hits(t, "qid", "text", ma, mode="ascii_compat").orderBy("start").collect()] == ["ma", "člen"]


def test_memory(spark):
    m = spark.createDataFrame([(1, "small red ring", "x", "", "", ""), (2, "abxxxxxxcdx", "", "", "", ""), (3, "ab" + "x" * 23, "the small red ring", "", "", "")], schemas.TM)
    q = spark.createDataFrame([(1, "red ring"), (2, "ab cd"), (3, "x")], "qid long, text string")
    got = {(r.qid, r.entry_id): round(r.relevance, 3) for r in tm.concordance(q, m).collect()}
    assert got[1, 1] == 100.0 and got[2, 2] == 60.0 and (2, 3) not in got
    p = spark.createDataFrame([(1, "sm"), (2, "s")], "qid long, prefix string")
    assert [tuple(r) for r in tm.prefix(p, m).collect()] == [(1, "small red ring")]


def test_fuzzy_against_all_pairs(spark):
    import random

    r = random.Random(2)
    base = ["".join(r.choice("abcd ") for _ in range(r.randint(1, 40))) for _ in range(12)]
    texts = base + [b[:k] + r.choice("abx") + b[k + r.randint(0, 1) :] for b in base for k in (0, len(b) // 2, len(b))] + base[:3]
    m = spark.createDataFrame([(i, t, f"t{i}", "", "", "") for i, t in enumerate(texts)], schemas.TM)
    q = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    got = sorted((x.qid, x.entry_id, x["rank"]) for x in tm.fuzzy(q, m, 80.0, 3).collect())
    want, first = [], {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    for i, t in enumerate(texts):
        hits = sorted((-200 * X.lcs_length(t, s) / (len(t) + len(s)), j) for s, j in first.items())
        want += [(i, j, k + 1) for k, (s, j) in enumerate([h for h in hits[:15] if -h[0] >= 80.0][:3])]
    assert got == sorted(want)


def test_fuzzy_leaves_few_pairs_to_compare(monkeypatch):
    """Texts of one length and one alphabet are told apart without being compared, and pairs that reach the threshold are kept."""
    import random

    import pyarrow as pa

    r = random.Random(7)
    syllables = ["th", "er", "on", "in", "an", "re", "he", "ti", "ou", "st", "a ", " o", "f ", ". "]
    texts = sorted({"".join(r.choice(syllables) for _ in range(40)) for _ in range(400)})
    texts += [x[:k] + "z" + x[k + 2 :] for x in texts[:40] for k in (3, 50)]
    compared, real = [], tm._lcs
    monkeypatch.setattr(tm, "_lcs", lambda a, b: compared.extend(a) or real(a, b))
    q = pa.table({"text": texts})
    s = pa.table({"source": texts, "entry_id": list(range(len(texts))), "copies": [1] * len(texts)})
    got = {(x["text"], x["source"], x["score"]) for x in tm._alike(90.0, 15)(q, s).to_pylist()}
    want = {(a, b, v) for a in texts for b in texts if (v := 200.0 * X.lcs_length(a, b) / (len(a) + len(b))) >= 90.0}
    assert got == want and len(want) > len(texts)
    assert len(compared) < 0.02 * len(texts) ** 2


def test_fuzzy_tells_long_texts_apart_by_pieces(monkeypatch):
    """Long texts of one kind are hardly ever compared whole, and edits at the ends, in one place or spread lose no pair."""
    import random

    import pyarrow as pa

    r = random.Random(9)
    syllables = ["th", "er", "on", "in", "an", "re", "he", "the ", "and ", "of ", "ti", "e "]
    texts = ["".join(r.choice(syllables) for _ in range(r.choice([60, 110, 115, 120, 210, 220]))) for _ in range(150)]
    for x in texts[:40]:
        k, cut = r.randrange(len(x)), len(x) // 11
        texts += [x[cut:], x[:-cut], x[cut:] + "q" * cut, "é" * cut + x, x[:k] + x[k + cut :] + x[:cut], "".join(c for i, c in enumerate(x) if i % 11), x[: k + 1] + "z" * cut + x[k + 1 :]]
    texts = sorted(set(texts))
    compared, real = [], tm._lcs
    monkeypatch.setattr(tm, "_lcs", lambda a, b: compared.extend(a) or real(a, b))
    s = pa.table({"source": texts, "entry_id": list(range(len(texts))), "copies": [1] * len(texts)})
    got = {(x["text"], x["source"], x["score"]) for x in tm._alike(90.0, 50)(pa.table({"text": texts}), s).to_pylist()}
    fit = [(a, b) for a in texts for b in texts if abs(len(a) - len(b)) <= 0.1 * (len(a) + len(b))]
    want = {(a, b, v) for a, b in fit if (v := 200.0 * X.lcs_length(a, b) / (len(a) + len(b))) >= 90.0}
    assert got == want and len(want) > 2 * len(texts)
    assert len(compared) < len(want) + 0.01 * len(fit)


def test_best_of_known_texts_is_not_searched(spark, monkeypatch):
    m = spark.createDataFrame([(1, "small red ring here", "a", "", "", ""), (2, "small red ring her", "b", "", "", ""), (3, "small red ring here", "c", "", "", "")], schemas.TM)
    q = spark.createDataFrame([(1, "small red ring here"), (2, "small red ring hers"), (3, "small red ring her")], "qid long, text string")
    asked, real = [], tm.by_blocks
    monkeypatch.setattr(tm, "by_blocks", lambda a, *x, **k: asked.extend(r.text for r in a.select("text").distinct().collect()) or real(a, *x, **k))
    got = sorted((r.qid, r.entry_id, r.target, round(r.score, 3), r["rank"]) for r in tm.fuzzy(q, m, 90.0, 1).collect())
    assert got == [(1, 1, "a", 100.0, 1), (2, 2, "b", 97.297, 1), (3, 2, "b", 100.0, 1)]
    assert asked == ["small red ring hers"]


def test_lcs_of_many_pairs():
    import random

    r = random.Random(3)
    for longest in (5, 64, 130, 1100):
        a = ["".join(r.choice("abcdeé 𝄞") for _ in range(r.randint(1, longest))) for _ in range(60)]
        b = ["".join(r.choice("abcdeé z") for _ in range(r.randint(1, longest))) if r.random() < 0.5 else x[1:] + "q" for x in a]
        assert tm._lcs(a, b).tolist() == [X.lcs_length(x, y) for x, y in zip(a, b, strict=True)]


def test_qa(spark):
    s = spark.createDataFrame([(1, "a 12 b 7", "x 7"), (2, "A Ring", "x"), (3, "a.", "b"), (4, "a", "b!"), (5, "a.", "b?"), (6, "a 1.", "  "), (7, "a", None)], "seg_id long, source string, target string")
    hits = spark.createDataFrame([(2, "ring", "prstan"), (6, "a", "b")], "seg_id long, source_term string, target_term string")
    got = sorted((r.seg_id, r.type, r.message) for r in qa.check(s, hits).collect())
    assert got == [
        (1, "warning", "Number mismatch. Missing: 12."), (2, "error", "Glossary violation: 'ring' should be translated as 'prstan'."),
        (3, "warning", "Source ends with punctuation, target does not."), (4, "warning", "Target ends with punctuation, source does not."),
    ]


def _graph(spark):
    return spark.createDataFrame([], schemas.NODES), spark.createDataFrame([], schemas.EDGES)


def test_graph(spark, tmp_path):
    nodes, edges = _graph(spark)
    pairs = spark.createDataFrame([(1, "test", "testna", "en", "sl"), (2, "cat", "mačka", "en", "sl"), (3, " ", "x", "en", "sl")], "pos long, source string, target string, source_lang string, target_lang string")
    nodes, edges = graph.promote_pairs(nodes, edges, pairs)
    ids = {r.id for r in nodes.collect()}
    assert ids == {"concept:test", "concept:cat", "term:en:test", "term:sl:testna", "term:en:cat", "term:sl:mačka"}
    e = {(r.src, r.dst): r for r in edges.collect()}
    assert e["term:en:test", "term:sl:testna"].verified and e["term:sl:testna", "term:en:test"].confidence == 1.0 and e["term:en:cat", "concept:cat"].relation == "instantiates_concept"
    sinks.save_graph(nodes, edges, str(tmp_path / "g"))
    n2, e2 = sinks.load_graph(spark, str(tmp_path / "g"))
    assert n2.count() == 6 and e2.where("NOT (src LIKE 'term:%' OR src LIKE 'concept:%')").isEmpty()
    t = spark.createDataFrame([(1, "A test, please")], "qid long, text string")
    found = graph.entities(t, n2)
    assert [r.node_id for r in found.collect()] == ["term:en:test"]
    assert [r.term for r in graph.translations(n2, e2, found, "sl").collect()] == ["testna"]
    h = graph.hints(spark.createDataFrame([(1, "te", "a test")], "qid long, prefix string, text string"), n2, e2, "sl").collect()
    assert [(r.term, r.confidence) for r in h] == [("testna", 1.0)]
    (tmp_path / "doc").mkdir()
    (tmp_path / "doc" / "k.json").write_text(sinks.graph_document(n2, e2).first().value)
    n3, e3 = files.read_graph(spark, str(tmp_path / "doc"))
    assert {r.id for r in n3.collect()} == ids and e3.count() == e2.count()


def test_upserts(spark):
    nodes, edges = _graph(spark)
    calls = spark.createDataFrame([(1, "Lep", "sl", False, "lepi"), (2, "lep", "sl", True, "lepa"), (3, "lep", "sl", False, "LEP")], "pos long, term string, lang string, is_phrase boolean, display_form string")
    r = graph.upsert_terms(nodes, calls).first()
    assert (r.id, r.frequency, r.is_phrase, r.display_form, sorted(r.variants)) == ("term:sl:lep", 3, True, "lepi", ["lepa", "lepi"])
    nodes = graph.insert_absent(nodes, spark.createDataFrame([("a", "term"), ("b", "term")], "id string, type string"))
    links = "pos long, src string, dst string, confidence double, verified boolean, provenance string, context string"
    three = spark.createDataFrame([(i, "a", "b", 0.8, False, "auto", None) for i in range(3)] + [(9, "a", "zz", 0.5, False, "auto", None)], links)
    got = graph.upsert_links(nodes, edges, three)
    assert sorted((x.src, x.dst, round(x.confidence, 6)) for x in got.collect()) == [("a", "b", 0.9), ("b", "a", 0.9)]
    high = spark.createDataFrame([(i, "a", "b", 1.0, True, "manual", None) for i in range(2)], links)
    assert {round(x.confidence, 6) for x in graph.upsert_links(nodes, edges, high).collect()} == {0.99}
    assert {(round(x.confidence, 6), x.verified) for x in graph.upsert_links(nodes, got, high).collect()} == {(0.99, False)}


def test_neighbours(spark):
    e = spark.createDataFrame([("1", "2", "r", 0), ("2", "3", "r", 1), ("3", "1", "r", 2), ("1", "3", "r", 3)], "src string, dst string, relation string, pos long")
    got = sorted(map(tuple, graph.neighbours(e, spark.createDataFrame([("1",)], "id string"), 2).collect()))
    assert got == [("1", "2", 1, "r"), ("1", "3", 1, "r")]


def test_seed(spark):
    p = spark.createDataFrame([("s", "t1", 6), ("s", "t2", 3), ("s", "t3", 1)], "s string, t string, n long")
    assert sorted((r.t, round(r.confidence, 6)) for r in seed.confidence(p).collect()) == [("t1", 0.6), ("t2", 0.3)]
    w = "array<struct<id:int,text:string,lemma:string,upos:string,head:int,deprel:string>>"
    s = spark.createDataFrame([(1, [(1, "Lepa", "lep", "ADJ", 2, "amod"), (2, "hiša", "hiša", "NOUN", 0, "root"), (3, ".", ".", "PUNCT", 2, "punct")])], f"doc_id long, words {w}")
    assert [tuple(r) for r in seed.dependency_phrases(s).collect()] == [(1, "lepa hiša", "lep hiša")]


def test_views(spark):
    e = spark.createDataFrame([("a", "b", "translates_to", 0.5, False, 0), ("b", "a", "translates_to", 0.5, False, 1), ("auto", "b", "translates_to", 0.5, False, 2)], "src string, dst string, relation string, confidence double, verified boolean, pos long")
    assert inspect.visual_links(e.where("src <> 'auto'")).count() == 1
    r = inspect.integrity(e).first()
    assert (r.total, r.corrupted, r.targets, r.verdict, r.sample) == (3, 1, 1, "CORRUPTED", "b") and inspect.repaired(e).count() == 2
    assert inspect.integrity(e.where("false")).first().verdict == "EMPTY"


def test_suggestions_merge(spark):
    part = lambda terms: spark.createDataFrame([(1, t, i) for i, t in enumerate(terms)], "qid long, term string, at long")
    got = assist.merge_suggestions([("glossary", part("ab")), ("kg", part("bc")), ("tm", part("d"))]).orderBy("rank").collect()
    assert [(r.term, r.origin) for r in got] == [("a", "glossary"), ("b", "glossary"), ("c", "kg")]


def test_prompt(spark):
    memory = spark.createDataFrame([(1, "small red ring here", "majhen rdeč prstan", "", "", ""), (2, "blue", "moder", "", "", "")], schemas.TM)
    terms = spark.createDataFrame([(1, "ring", "prstan", "en", "sl", "", ""), (2, "red", "rdeč", "en", "sl", "", "")], schemas.GLOSSARY)
    nodes, edges = _graph(spark)
    nodes, _ = graph.promote_pairs(nodes, edges, spark.createDataFrame([(1, "ring", "prstan", "en", "sl")], "pos long, source string, target string, source_lang string, target_lang string"))
    segments = spark.createDataFrame([(1, "small red ring here"), (2, "zzz")], "qid long, text string")
    got = dict(map(tuple, assist.prompt(assist.context(segments, memory, terms, nodes, "en", "sl")).collect()))
    h = assist.HEADINGS
    assert got[1] == (
        f"{h['glossary_lines']}\n- 'red' => 'rdeč'\n- 'ring' => 'prstan'\n\n{h['kg_lines']}\n- Entity: ring\n\n"
        f"{h['memory_lines']}\nOld Source: small red ring here\nOld Target: majhen rdeč prstan\n\n"
        f"{h['example_lines']}\nSample: small red ring here -> majhen rdeč prstan\n\n{assist.LAST_HEADING}\nsmall red ring here"
    )
    assert got[2] == f"{assist.LAST_HEADING}\nzzz"
    assert assist.context(segments, memory, terms, None, "en", "sl").where("kg_lines IS NOT NULL").isEmpty()


def test_consistency(spark):
    nodes, edges = _graph(spark)
    pairs = [(1, "ring", "prstan", "en", "sl"), (2, "ring", "obroč", "en", "sl"), (3, "cat", "mačka", "en", "sl")]
    nodes, edges = graph.promote_pairs(nodes, edges, spark.createDataFrame(pairs, "pos long, source string, target string, source_lang string, target_lang string"))
    rows = [(1, "a ring", "en prstan", "done"), (2, "the ring", "ta obroč", "done"), (3, "ring", "nič", "pending"), (4, "cat", "mačka", "done"), (5, "a cat", "mačka je", "done")]
    segments = spark.createDataFrame(rows, "qid long, text string, target string, status string")
    got = [(r.term, set(r.used.split("|")), r.segments) for r in assist.consistency(segments, nodes, edges, "sl").collect()]
    assert got == [("ring", {"prstan", "obroč"}, "1,2")]
    unknown = segments.union(spark.createDataFrame([(6, "cat", "pes", "done")], segments.schema))
    got = {r.term: (r.used, r.recommended, r.segments) for r in assist.consistency(unknown, nodes, edges, "sl").collect()}
    assert got["cat"] == ("?|mačka", "mačka", "4,5,6")


def test_exports(spark):
    s = spark.createDataFrame([("p", 0, "s1", "x ", "done"), ("p", 1, "s2", "", "pending")], "project_id string, id int, source string, target string, status string")
    assert projects.export_text(s).first().body == "x\n\ns2"
    paragraphs = spark.createDataFrame([(0, " s1 "), (1, "s2"), (2, "other")], "at int, text string")
    assert [r.text for r in projects.export_paragraphs(paragraphs, s).orderBy("at").collect()] == ["x ", "s2", "other"]
    d = projects.as_documents(s, spark.createDataFrame([("p", "f", "en->sl", 0, "2020")], "id string, filename string, lang_pair string, active_index int, saved_at string")).first()
    assert (d.total, d.done, len(d.segments)) == (2, 1, 2)


def test_files(spark, tmp_path):
    t = tmp_path / "tm"
    t.mkdir()
    unit = lambda a, b: f'<tu><tuv xml:lang="x"><seg>{a}</seg></tuv><tuv xml:lang="y"><seg>{b}</seg></tuv></tu>'
    (t / "a.tmx").write_text(f'<tmx><header srclang="en-GB"/><body>{unit("<i>A</i> &amp;amp; b", "C")}{unit("d", "")}</body></tmx>')
    (t / "sl.tmx").write_text(f'<tmx><header srclang="SL"/><body>{unit("mačka", "cat")}</body></tmx>')
    got = sorted((r.source, r.target, r.origin) for r in files.read_tmx(spark, str(t)).collect())
    assert got == [("A & b", "C", "a.tmx"), ("cat", "mačka", "sl.tmx")]
    g = tmp_path / "g"
    g.mkdir()
    entry = lambda a, b, tag="": f'<termEntry{tag}><langSet xml:lang="en"><tig><term>{a}</term></tig></langSet><langSet xml:lang="sl"><tig><term>{b}</term></tig></langSet></termEntry>'
    (g / "terms.tbx").write_text(f"<x>{entry('one', 'ena')}{entry('bad', '<')}{entry('attr', 'a', ' id=\"1\"')}</x>{entry('late', 'pozno')}\ntail\trep\n")
    (g / "glossary-SL-EN.tsv").write_text("a\tb\tnote\n\nonly\n")
    (g / "g.csv").write_text("source,target,sl,tl\nhund,dog,de,en\n,x,,\nkat,cat,,\n")
    (g / "bom.tsv").write_bytes("﻿q\tw\n".encode())
    one_way = {(r.source_term, r.target_term, r.source_lang, r.target_lang) for r in files.read_glossary(spark, str(g)).where("entry_id % 2 = 0").collect()}
    assert one_way == {("one", "ena", "en", "sl"), ("late", "pozno", "en", "sl"), ("tail", "rep", "en", "sl"), ("a", "b", "sl", "en"), ("hund", "dog", "de", "en"), ("kat", "cat", "en", "sl"), ("q", "w", "en", "sl")}
    p = tmp_path / "p"
    p.mkdir()
    for k, at in (("p1", "2020"), ("p2", "2021")):
        (p / f"{k}.json").write_text(json.dumps({"id": k, "filename": "f", "lang_pair": "en->sl", "active_index": 0, "saved_at": at, "total": 1, "done": 0, "segments": [{"id": 0, "source": "s", "target": "", "status": "pending"}]}))
    (p / "bad.json").write_text("{")
    x = files.read_projects(spark, str(p))
    assert [r.id for r in x.collect()] == ["p2", "p1"] and files.project_segments(x).count() == 2
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>')
    assert [(r.id, r.source) for r in files.read_docx(spark, str(tmp_path)).orderBy("id").collect()] == [(0, "One two"), (1, "three")]


def test_stream(spark, tmp_path):
    schema = "pos long, source string, target string, source_lang string, target_lang string"
    spark.createDataFrame([(1, "dog", "pes", "en", "sl")], schema).write.parquet(str(tmp_path / "in"))
    learner = Learner(str(tmp_path / "graph"))
    q = learner.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint"))
    q.processAllAvailable()
    q.stop()
    nodes, edges = learner.graph(spark, 0)
    assert nodes.count() == 3 and edges.where("verified").count() == 2
    more = lambda n, *p: learner.apply(spark.createDataFrame([(10 * n + k, a, b, "en", "sl") for k, (a, b) in enumerate(p)], schema), n)
    state = lambda: sorted((r.id, r.frequency) for r in learner.graph(spark)[0].collect())
    more(1, ("dog", "pes"), ("cat", "mačka"))
    more(1, ("dog", "pes"), ("cat", "mačka"))  # a batch that is repeated
    before = state()
    assert dict(before)["term:en:dog"] == 2 and dict(before)["term:en:cat"] == 1
    learner.compact(spark)
    assert state() == before and not (tmp_path / "graph" / "log=0").exists()
    more(2, ("dog", "kuža"))
    learner.compact(spark)
    assert dict(state())["term:en:dog"] == 3 and [p.name for p in sorted((tmp_path / "graph").iterdir())] == ["base=2"]
    e = {(r.src, r.dst): r.confidence for r in learner.graph(spark)[1].where("relation = 'translates_to'").collect()}
    assert e["term:en:dog", "term:sl:pes"] == pytest.approx(0.99) and e["term:en:dog", "term:sl:kuža"] == 1.0


def test_terms_of_many_words(spark):
    from termweave.operators import glossary as G

    entries = [(1, "black cat", "a"), (2, "the quick brown fox, that jumps over it", "b"), (3, "one two three four", "c")]
    terms = spark.createDataFrame([(*e, "en", "de", "", "x") for e in entries], "entry_id long, source_term string, target_term string, source_lang string, target_lang string, note string, origin string")
    texts = spark.createDataFrame([(1, "See The Quick brown fox, that jumps over it."), (2, "a black cat: one two three four")], "qid long, text string")
    for mode in ("unicode", "ascii_compat"):
        found = G.lookup(texts, terms, "en", "de", mode=mode).collect()
        assert sorted((r.qid, r.target_term) for r in found) == [(1, "b"), (2, "a"), (2, "c")]


def _small_graph(spark):
    nodes, edges = _graph(spark)
    pairs = [(1, "ring", "prstan", "en", "sl"), (2, "ring", "obroč", "en", "sl"), (3, "cat", "mačka", "en", "sl")]
    return graph.promote_pairs(nodes, edges, spark.createDataFrame(pairs, "pos long, source string, target string, source_lang string, target_lang string"))


def test_graph_views(spark):
    nodes, edges = _small_graph(spark)
    q = spark.createDataFrame([(1, "Ring"), (2, "nothing")], "qid long, term string")
    r = graph.tooltip(nodes, edges, q, "en", "sl").collect()
    assert [(x.qid, x.node_id, x.frequency, x.translations, x.concept) for x in r] == [(1, "term:en:ring", 2, "prstan, obroč", "concept:ring")]
    same = spark.createDataFrame([("term:sl:prstan", "term:sl:obroč", "related_to", 9)], "src string, dst string, relation string, pos long")
    ids = spark.createDataFrame([("term:sl:prstan",)], "id string")
    assert [tuple(x) for x in graph.related(nodes, same, ids).collect()] == [("term:sl:prstan", "obroč")]
    n, e = graph.subgraph(nodes, edges, spark.createDataFrame([("term:en:cat",), ("term:sl:mačka",)], "id string"))
    assert n.count() == 2 and sorted((x.src, x.dst) for x in e.collect()) == [("term:en:cat", "term:sl:mačka"), ("term:sl:mačka", "term:en:cat")]
    v = graph.add_variants(nodes, spark.createDataFrame([("term:en:cat", "cats"), ("term:en:cat", "cats")], "id string, variant string")).where("id = 'term:en:cat'").first()
    assert v.variants == ["cats"]
    found = graph.entities(spark.createDataFrame([(1, "two cats")], "qid long, text string"), graph.add_variants(nodes, spark.createDataFrame([("term:en:cat", "cats")], "id string, variant string")))
    assert [x.node_id for x in found.collect()] == ["term:en:cat"]
    segments = graph.insert_absent(nodes, spark.createDataFrame([("segment:1", "tm_segment", "a cat", "mačka")], "id string, type string, source_text string, target_text string"))
    at = spark.createDataFrame([("term:en:cat", "segment:1", "appears_in_segment", 1)], "src string, dst string, relation string, pos long")
    assert [tuple(x) for x in graph.examples(segments, at, spark.createDataFrame([("term:en:cat",)], "node_id string")).collect()] == [("term:en:cat", "a cat", "mačka", 1)]


def test_two_nodes_of_one_keyword(spark):
    rows = [("term:en:a", "term", "same", "2021"), ("term:en:z", "term", "Same", "2020")]
    nodes = spark.createDataFrame(rows, "id string, type string, term string, created_at string").withColumns({"variants": F.lit(None).cast("array<string>"), "phrase": F.lit(None).cast("string")})
    assert [tuple(r) for r in graph.keywords(nodes).collect()] == [("same", "term:en:a")]


def test_inspector_views(spark):
    nodes, edges = _small_graph(spark)
    chosen = inspect.select_nodes(nodes, edges)
    inner = inspect.select_edges(chosen, edges)
    shown, links = inspect.visual_nodes(chosen, inner), inspect.visual_links(inner)
    assert {r.id: r.verified for r in shown.collect()}["term:en:cat"] and shown.where("color = '#3b82f6'").count() == 2
    n, e = inspect.view(shown, links, lang="en")
    assert sorted(r.id for r in n.collect()) == ["concept:cat", "concept:ring", "term:en:cat", "term:en:ring"] and e.where("relation <> 'instantiates_concept'").isEmpty()
    n, _ = inspect.view(shown, links, text="mač")
    assert sorted(r.id for r in n.where("type = 'term'").collect()) == ["term:sl:mačka"]
    assert {r.id for r in inspect.around(links, "term:en:cat").collect()} == {"term:sl:mačka", "concept:cat"}
    assert [tuple(r) for r in inspect.detail(links, shown, "term:en:cat").collect()] == [("mačka", 1.0)]
    assert inspect.stats(nodes, edges).where("metric = 'verified_nodes'").first().value == 5
    d = json.loads(inspect.document(shown, links).first().value)
    assert len(d["nodes"]) == shown.count() and {x["source"] for x in d["links"]} <= {x["id"] for x in d["nodes"]}


def test_repair(spark, tmp_path):
    nodes, edges = _small_graph(spark)
    path = str(tmp_path / "g")
    sinks.save_graph(nodes, edges, path)
    assert sinks.repair_graph(spark, path, "1") is None and not (tmp_path / "g.backup-1").exists()
    bad = spark.createDataFrame([("auto", "term:sl:x", "translates_to")], "src string, dst string, relation string")
    sinks.save_graph(nodes, edges.unionByName(bad, allowMissingColumns=True), path)
    copy = sinks.repair_graph(spark, path, "2")
    assert sinks.load_graph(spark, copy)[1].where("src = 'auto'").count() == 1
    assert sinks.load_graph(spark, path)[1].where("src = 'auto'").isEmpty() and sinks.load_graph(spark, path)[1].count() == edges.count()


def test_search_of_substrings(spark):
    nodes, edges = _small_graph(spark)
    q = spark.createDataFrame([(1, "RI"), (2, "ač"), (3, "x")], "qid long, text string")
    assert sorted((r.qid, r.id, r.neighbours) for r in graph.search(nodes, edges, q).collect()) == [(1, "concept:ring", 0), (1, "term:en:ring", 3), (2, "term:sl:mačka", 2)]
    texts = spark.createDataFrame([("a", "one two"), ("b", "two"), ("c", None), ("d", "")], "id string, text string")
    patterns = spark.createDataFrame([(1, "two"), (2, "o"), (3, None), (4, "e t")], "qid long, pattern string")
    assert sorted(map(tuple, matching.containing(texts, patterns).collect())) == [("a", 1), ("a", 2), ("a", 4), ("b", 1), ("b", 2)]


def test_dictionary_in_blocks(spark):
    import random

    r = random.Random(7)
    words = ["ab", "cd", "Ef", "gh", "i9", "č"]
    terms = sorted({" ".join(r.choice(words) for _ in range(r.randint(1, 8))).lower() for _ in range(60)})
    texts = [(k, r.choice([" ", ", "]).join(r.choice(words) for _ in range(r.randint(0, 60)))) for k in range(30)]
    d, t = spark.createDataFrame([(x,) for x in terms], "keyword string"), spark.createDataFrame(texts, "qid long, text string")

    def brute(text):
        import re

        runs, at, out = re.findall(r"\w+|\W+", text.lower()), 0, []
        while at < len(runs):
            best = max((n for n in range(1, 16) if at + n <= len(runs) and "".join(runs[at : at + n]) in terms), default=0)
            out += [("".join(runs[at : at + best]), at + 1)] if best else []
            at += best or 1
        return out

    want = sorted((k, w, p) for k, x in texts for w, p in brute(x))
    for limit in (8 << 20, 200):
        assert sorted(map(tuple, matching.keyword_hits(t, "qid", "text", d, limit=limit).collect())) == want


def test_reversed_glossary(spark):
    from termweave.operators import glossary as G

    one = spark.createDataFrame([(0, "a", "x", "en", "sl", "", ""), (1, "b", "X", "en", "sl", "", ""), (2, "b", "x", "en", "sl", "", ""), (3, "one two three four five six", "ena dve tri", "en", "sl", "", "")], schemas.GLOSSARY)
    both = G.with_reverse(one)
    q = spark.createDataFrame([(1, "an x and b, One two three four five six: ena dve tri")], "qid long, text string")
    assert sorted((r.source_term, r.target_term) for r in G.lookup(q, both, "en", "sl").collect()) == [("b", "X"), ("one two three four five six", "ena dve tri")]
    assert sorted((r.source_term, r.target_term) for r in G.lookup(q, both, "sl", "en").collect()) == [("ena dve tri", "one two three four five six"), ("x", "a")]


def test_blocks_of_both_sides(spark, monkeypatch):
    """Fuzzy and concordance search give the same rows whatever the blocks."""
    import random

    r = random.Random(5)
    text = lambda: " ".join(r.choice(["red", "ring", "small", "a", "blue", "the"]) for _ in range(r.randint(1, 9)))
    m = spark.createDataFrame([(k, text(), text(), "", "", "") for k in range(80)], schemas.TM)
    q = spark.createDataFrame([(k, text()) for k in range(40)] + [(99, "red  Ring x")], "qid long, text string")
    want = [sorted((x.qid, x.entry_id, x["rank"]) for x in f(q, m).collect()) for f in (lambda a, b: tm.fuzzy(a, b, 70.0), tm.concordance)]
    real = matching.by_blocks
    monkeypatch.setattr(tm, "by_blocks", lambda *a, **k: real(*a, **k | {"rows": 7}))
    got = [sorted((x.qid, x.entry_id, x["rank"]) for x in f(q, m).collect()) for f in (lambda a, b: tm.fuzzy(a, b, 70.0), tm.concordance)]
    assert got == want and all(want)
    entries = {x.entry_id: x for x in m.collect()}

    def relevance(words, size, e):
        ratio = len(e.source) / size
        share = sum(w in e.source or w in e.target for w in words) / len(words) * 100
        return share * (0 if ratio > 10 else 0.3 if ratio > 4 else 0.6 if ratio > 2 else 1)

    for x in q.collect():
        words = [w for w in x.text.lower().split() if len(w) > 1]
        top = sorted((-v, k) for k, e in entries.items() if words and (v := relevance(words, len(x.text), e)) > 20)[:5]
        assert [k for _, k in top] == [k for i, k, _ in sorted((a for a in got[1] if a[0] == x.qid), key=lambda a: a[2])]


def test_concordance_meets_numbers(spark, monkeypatch):
    """Entries and queries meet as numbers of words, in several blocks of words and rows; long, repeated and inner words count as in all pairs."""
    import random

    r, far = random.Random(11), "x" * 30 + "Ä" * 50
    parts = ["red", "RING", "ring-", "small", "är", "the", "there", "a", far, f"y{far}z", far[:64], far[:63] + "q"]
    text = lambda n: r.choice([" ", "\u00a0", "\n"]).join(r.choice(parts) for _ in range(r.randint(0, n)))
    rows = [(k, text(9), text(4), "", "", "") for k in range(60)] + [(7, "red ring", "small", "", "", ""), (70, None, "red", "", "", ""), (71, "there" * 40, "", "", "", "")]
    asked = [(k, text(6)) for k in range(40)] + [(40, "the the red"), (41, None), (42, far), (43, "red " * 300)]
    cells, real = [], tm.by_blocks
    monkeypatch.setattr(tm, "by_blocks", lambda a, b, *x, **k: cells.append(a.dtypes + b.dtypes) or real(a, b, *x, **k | {"rows": 16}))
    m, q = spark.createDataFrame(rows, schemas.TM), spark.createDataFrame(asked, "qid long, text string")
    got = sorted((x.qid, x["rank"], x.entry_id, x.source, x.target, x.relevance) for x in tm.concordance(q, m, 3, limit=150).collect())
    assert not [c for c, kind in cells[0] if kind == "string"]
    want = []
    for qid, t in asked:
        words = [w.lower() for w in (t or "").split() if len(w) > 1]
        hits = []
        for e, a, b, *_ in rows if words else []:
            if a is not None:
                ratio = len(a) / len(t)
                v = sum(w in a.lower() or w in b.lower() for w in words) / len(words) * 100 * (0.0 if ratio > 10 else 0.3 if ratio > 4 else 0.6 if ratio > 2 else 1.0)
                hits += [(-v, e, a, b)] if v > 20 else []
        want += [(qid, -v, e) for v, e, *_ in sorted(hits)[:3]]
    assert sorted((x[0], x[5], x[2]) for x in got) == sorted(want) and len(want) > 60
    assert all((e, a, b, "", "", "") in rows for _, _, e, a, b, _ in got)


def test_links_of_numbers(spark):
    import random

    r = random.Random(4)
    side = lambda name: spark.createDataFrame(sorted({(e, f"{name}{r.randint(0, 4)}"): r.randint(1, 3) for e in range(30) for _ in range(3) if e % 7 or name == "s"}.items()), "k struct<entry_id:long,phrase:string>, weight long").select("k.*", "weight")
    a, b = side("s"), side("t")
    got, want = (sorted(map(tuple, x.collect())) for x in (seed.links(a, b, 20), seed.confidence(seed.cooccurrence(a, b), 20)))
    assert got == want and 0 < len(want) < 25


def test_seed_graph(spark, tmp_path):
    rows = [(k, "red ring red ring", "prstan rdeč", "", "en", "sl") for k in range(4)] + [(9, "blue sky", "nebo", "", "en", "sl")]
    nodes, edges = seed.seed(spark.createDataFrame(rows, schemas.TM), "en", "sl")
    # matches are leftmost, longest: "red ring red" and "ring" in each entry
    assert {(r.term, r.frequency) for r in nodes.where("type = 'term'").collect()} == {("red ring red", 4), ("ring", 4), ("prstan rdeč", 4)}
    assert {(r.src, r.dst, r.confidence) for r in edges.where("relation = 'translates_to' AND src LIKE 'term:en%'").collect()} == {(f"term:en:{t}", "term:sl:prstan rdeč", 0.95) for t in ("red ring red", "ring")}
    (tmp_path / "tm").mkdir()
    unit = "<tu><tuv><seg>red ring</seg></tuv><tuv><seg>prstan</seg></tuv></tu>"
    (tmp_path / "tm" / "a.tmx").write_text(f'<tmx><header srclang="en"/><body>{unit * 3}</body></tmx>')
    assert seed.seeding_job(spark, str(tmp_path / "tm"), str(tmp_path / "graph"))
    n, e = sinks.load_graph(spark, str(tmp_path / "graph"))
    assert {r.id for r in n.collect()} == {"term:en:red ring", "term:sl:prstan", "concept:red_ring"} and e.count() == 3
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "b.tmx").write_text("<tmx><body></body></tmx>")
    assert not seed.seeding_job(spark, str(tmp_path / "none"), str(tmp_path / "other")) and not (tmp_path / "other").exists()


def test_noun_chunks(spark):
    w = "array<struct<text:string,upos:string>>"
    rows = [([("The", "DET"), ("Red", "ADJ"), ("ring", "NOUN"), (".", "PUNCT")],), ([("it", "PRON")],), ([("42", "NUM")],), ([("1234", "NUM")],)]
    got = [r.x for r in spark.createDataFrame(rows, f"words {w}").select(seed.noun_chunks(F.col("words")).alias("x")).collect()]
    assert got == ["red ring ", None, None, None]
    assert "biti" in seed.STOP_LEMMAS and len(set(seed.STOP_LEMMAS)) == len(seed.STOP_LEMMAS)


def test_panel_and_messages(spark):
    memory = spark.createDataFrame([(1, "small red ring", "majhen rdeč prstan", "", "", ""), (2, "a red ring there", "rdeč prstan tam", "", "", "")], schemas.TM)
    terms = spark.createDataFrame([(1, "ring", "prstan", "en", "sl", "", "")], schemas.GLOSSARY)
    q = spark.createDataFrame([(1, "small red ring")], "qid long, text string")
    got = sorted((r.section, r["rank"], r.source) for r in assist.panel(q, memory, terms, "en", "sl").collect())
    assert got == [("concordance", 1, "a red ring there"), ("glossary", 1, "ring"), ("memory", 1, "small red ring")]
    like = assist.unlike_fuzzy(tm.fuzzy(q, memory), tm.concordance(q, memory))
    assert [r.source for r in like.collect()] == ["a red ring there"]
    assert assist.system_message("en", "sl").startswith("You are a professional translator expert in sl. Translate from en to sl.\n\nSTRICT RULES:\n1. ")
    assert "standard Slovenian. CRITICAL" in assist.system_message("English", "Slovenian")
    m = assist.messages(spark.createDataFrame([(1, "p")], "qid long, prompt string"), "en", "sl").first()
    assert m.user == "p" and m.plain == f"System: {m.system}\nUser: p\nAssistant:"
    s = spark.createDataFrame([(2, "b", "", "pending"), (1, "small red ring", None, "pending"), (3, "c", "x", "pending"), (4, "d", "", "done")], "qid long, text string, target string, status string")
    d = assist.draft(s, assist.context(s.select("qid", "text"), memory, terms, None, "en", "sl"), F.concat(F.lit(" t"), "qid", F.lit(" ")))
    assert [(r.qid, r.draft) for r in d.collect()] == [(1, "t1"), (2, "t2")]
    assert [r.target for r in assist.drafted(s, d).orderBy("qid").collect()] == ["t1", "t2", "x", ""]
    nodes, edges = _small_graph(spark)
    h = {r.term for r in assist.highlight_terms(spark.createDataFrame([(1, "ring")], "qid long, text string"), terms, nodes, edges, "en", "sl").collect()}
    assert {"ring", "prstan", "obroč"} <= h


def test_confirm(spark):
    s = spark.createDataFrame([("p", 0, "s0", " ", "pending"), ("p", 1, "s1", "t1", "pending"), ("p", 2, "s2", "t2", "pending"), ("q", 0, "z", "t", "pending")], "project_id string, id int, source string, target string, status string")
    done, pairs = projects.confirm(s, spark.createDataFrame([("p", 0), ("p", 1)], "project_id string, id int"), "en", "sl")
    assert sorted((r.project_id, r.id, r.status, r.next_id) for r in done.collect()) == [("p", 0, "pending", 1), ("p", 1, "done", 2), ("p", 2, "pending", None), ("q", 0, "pending", None)]
    assert [tuple(r)[1:] for r in pairs.collect()] == [("s1", "t1", "en", "sl")]
    assert {r.next_id for r in assist.next_open(s.where("project_id = 'p'")).collect()} == {1, 2, None}
    assert sorted(r.word for r in projects.vocabulary(spark.createDataFrame([("p", "the cat, the mačka", "je")], "project_id string, source string, target string")).collect()) == ["cat", "mačka", "the"]


def test_writers(spark, tmp_path):
    m = spark.createDataFrame([(1, 'a "b" <c>', "č & d", "", "en", "sl"), (2, "two", "dve", "", "en", "sl")], schemas.TM).coalesce(1)
    sinks.write_tmx(m, str(tmp_path / "out"), "en")
    (tmp_path / "tm").mkdir()
    for k, p in enumerate(sorted((tmp_path / "out").glob("part-*"))):
        (tmp_path / "tm" / f"{k}.tmx").write_text(p.read_text())
    assert sorted((r.source, r.target) for r in files.read_tmx(spark, str(tmp_path / "tm")).collect()) == [('a "b"', "č & d"), ("two", "dve")]
    for k in range(2):
        sinks.append_pairs(m.select(F.col("entry_id") + 10 * k, "source"), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 4
    g = spark.createDataFrame([(1, "a", "b", "en", "sl", "n", ""), (2, "", "x", "en", "sl", "", "")], schemas.GLOSSARY)
    sinks.write_glossary(g, str(tmp_path / "g"))
    sinks.write_glossary(g, str(tmp_path / "g"))
    assert [r.value for r in spark.read.text(str(tmp_path / "g")).collect()] == ["a\tb\tn"] * 2
    assert [r.value[:9] for r in sinks.tmx_units(m).orderBy("entry_id").collect()] == ["<tu><tuv "] * 2 and sinks.graph_lines(*_small_graph(spark)).count() == 7 + 11


def test_project_store(spark, tmp_path):
    s = spark.createDataFrame([("p", 0, "s1", "x ", "done"), ("q", 0, "s2", "", "pending")], "project_id string, id int, source string, target string, status string")
    heads = spark.createDataFrame([(k, "f", "en->sl", 0, "2020") for k in "pq"], "id string, filename string, lang_pair string, active_index int, saved_at string")
    path = str(tmp_path / "projects")
    sinks.save_projects(projects.as_documents(s, heads), path)
    assert files.read_project(spark, path, "p").first().done == 1 and files.read_project(spark, path, "zz").collect() == []
    sinks.save_projects(projects.as_documents(s.withColumn("status", F.lit("done")), heads).where("id = 'q'"), path)
    assert files.read_project(spark, path, "q").first().done == 1 and files.read_project(spark, path, "p").count() == 1
    assert sinks.delete_project(spark, path, "p") and not sinks.delete_project(spark, path, "p")
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text(json.dumps({"id": "a", "filename": "f", "lang_pair": "en->sl", "saved_at": "1", "segments": []}))
    assert files.read_project(spark, str(tmp_path / "json"), "a").first().filename == "f"


def test_docx_export(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr/><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("word/styles.xml", "<s/>")
    docs = spark.createDataFrame([("p", bytearray((tmp_path / "d.docx").read_bytes())), ("bad", bytearray(b"x"))], "project_id string, content binary")
    s = spark.createDataFrame([("p", 0, "One two", "old"), ("p", 1, "One two", "ena & dve"), ("p", 2, "three", " ")], "project_id string, id int, source string, target string")
    got = sinks.export_docx(docs, s).collect()
    assert [r.project_id for r in got] == ["p"]
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "n.docx").write_bytes(bytes(got[0].content))
    assert [r.source for r in files.read_docx(spark, str(tmp_path / "new")).orderBy("id").collect()] == ["ena & dve", "three"]
    assert zipfile.ZipFile(tmp_path / "new" / "n.docx").read("word/styles.xml") == b"<s/>"


def test_more_text(spark):
    assert one(spark, X.text_ngrams(F.lit("A well-known don't x ab"), 2)) == ["well-known don't", "don't ab"]
    assert sorted(one(spark, X.vocabulary(F.lit("the mačka, je the")))) == ["mačka", "the"]
    assert one(spark, X.timestamp(F.lit("2024-01-02 03:04:05.5").cast("timestamp"))) == "2024-01-02T03:04:05.500000"
    a, b = X.language_pair(F.lit("en->sl"))
    assert (one(spark, a), one(spark, b)) == ("en", "sl")


def test_seed_from_an_annotator(spark):
    rows = [(k, "the red ring", "lep hiša in lepa hiša", "", "en", "sl") for k in range(3)]
    left = spark.createDataFrame([(k, "red ring") for k in range(3)], "entry_id long, phrase string")
    right = spark.createDataFrame([(0, "lep hiša", "lepa hiša", 1), (1, "lep hiša", "lepe hiše", 2), (2, "lep hiša", "lepa hiša", 3)], "entry_id long, phrase string, surface string, pos long")
    nodes, edges = seed.seed(spark.createDataFrame(rows, schemas.TM), "en", "sl", found=(left, right))
    got = {(r.id, r.frequency, r.display_form) for r in nodes.where("type = 'term'").collect()}
    assert got == {("term:en:red ring", 3, None), ("term:sl:lep hiša", 3, "lepa hiša")}
    assert edges.where("relation = 'translates_to'").count() == 2


def test_collocations_and_domains(spark):
    nodes, edges = _graph(spark)
    calls = spark.createDataFrame([(2, "Red  ring", "en", "d", 5), (1, "red ring", "en", "d", 3), (3, "cat", "sl", "", None)], "pos long, phrase string, lang string, domain string, frequency long")
    nodes = graph.upsert_collocations(nodes, calls)
    assert sorted((r.id, r.phrase, r.frequency) for r in nodes.collect()) == [("coll:en:red_ring", "red ring", 4), ("coll:sl:cat", "cat", 1)]
    nodes = graph.upsert_collocations(nodes, calls.where("pos = 3"))
    assert {r.id: r.frequency for r in nodes.collect()} == {"coll:en:red_ring": 4, "coll:sl:cat": 2}
    assert [r.node_id for r in graph.entities(spark.createDataFrame([(1, "A red ring.")], "qid long, text string"), nodes).collect()] == ["coll:en:red_ring"]
    d = spark.createDataFrame([("domain:a", "A", ""), ("domain:b", "B", "domain:a"), ("domain:c", "C", "domain:zz")], "id string, label string, parent string")
    for _ in range(2):
        nodes, edges = graph.insert_domains(nodes, edges, d)
    assert nodes.where("type = 'domain'").count() == 3 and [(r.src, r.dst, r.relation) for r in edges.collect()] == [("domain:b", "domain:a", "subclass_of")]


def test_cleaning_is_that_of_its_sql(spark, tmp_path):
    """Unfinished, other and nested entities, white space of all kinds, tags across lines."""
    import duckdb

    from termweave import catalogue

    spaces = "".join(map(chr, [9, 10, 11, 12, 13, 0x1C, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0xFEFF]))
    html = ["a &amp b &am c &amp;lt; &amp;amp; &lt;b&gt; &eacute; &#8217; &nbsp;x &quot;&#39;&copy;&middot; &copy", *(f"{x}a{x}{x}b<i\nj>{x}" for x in spaces), f"{spaces} a", "<>", "&am<b>p;lt;", "", None]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(map(tuple, catalogue.QUERIES["clean_text"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(catalogue.SQL["clean_text"]).fetchall())


def test_only_hits_of_prefixes_leave_the_tasks(spark):
    """Many words an entry are no rows; prefixes of several lengths and blocks, case, the cap and ties of places."""
    rows = [(k, "x", f"Theory {'the ' * 3}ΣΟΣ thé{k} a th", "", "", "") for k in range(30)] + [(99, "x", "", "", "", ""), (98, "x", None, "", "", "")]
    m = spark.createDataFrame(rows, schemas.TM)
    q = spark.createDataFrame([(1, "th"), (2, "THÉ"), (3, "thé29"), (4, "t"), (5, "σος"), (6, "theoryx"), (7, None)], "qid long, prefix string")
    for limit in (8, 1 << 20):
        found = tm.prefix(q, m, limit=limit)
        got = {}
        for r in found.collect():
            got.setdefault(r.qid, set()).add(r.suggestion)
        assert got == {1: {"Theory the the"}, 2: {f"thé{k} a th" for k in range(11)}, 3: {"thé29 a th"}, 5: {f"ΣΟΣ thé{k} a" for k in range(11)}}
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert tm.prefix(q.where("false"), m).collect() == []
