"""Seeding a term graph from a translation memory by counted co-occurrence.

Annotators are columns: the default one takes runs of 1 to 3 words. A tagged
source can be given instead: noun_chunks() and dependency_phrases() work on
arrays of words from any pipeline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ngrams, strip_trailing_marks, tokens
from ..plans.shared import materialise
from ..schemas import EDGES, NODES
from .graph import concept_id, term_id
from .matching import keyword_hits

MIN_FREQ, MAX_PHRASES, LEAST = 3, 15_000, 3

#: Fragments that are no terms of the target language.
NOISE = ("kot", "ali", "del", "anja", "anje", "ov", "ova", "ev", "eva", "ega", "eni", "emu", "ila", "ilo", "en", "ena", "eno")
#: Lemmas of function words, pronouns, prepositions and fragments that are no terms of the target language.
STOP_LEMMAS = (
    "kot", "ali", "ne", "pa", "še", "se", "je", "bil", "biti", "bi", "ta",
    "on", "ona", "ono", "oni", "one", "jaz", "ti", "mi", "vi", "kdo", "kar", "ki", "da",
    "v", "na", "z", "s", "po", "od", "pri", "za", "o", "ob", "do", "brez", "proti", "med", "nad", "pod", "pred", "čez", "skozi", "okrog", "zunaj", "notri", "gor", "dol",
    "tukaj", "tam", "zdaj", "potem",
    "del", "delo", "anje", "eni", "ega", "emu", "ilo", "ila", "anj", "anja", "ov", "ova", "ovo", "ev", "eva", "evo", "en", "ena", "eno", "ene", "enega", "enemu", "enim",
)
#: Dependency relations that join a phrase's head.
PHRASE_RELATIONS = ("amod", "nmod", "det", "flat", "compound", "nummod", "advmod", "nmod:poss")


def phrases_of(words: Column, longest: int = 3) -> Column:
    every = ngrams(words, 1)
    for n in range(2, longest + 1):
        every = F.concat(every, ngrams(words, n))
    return every


def occurrences(tm: DataFrame, column: str) -> DataFrame:
    """(entry_id, phrase, at), every occurrence."""
    words = tm.select("entry_id", tokens(column).alias("words"))  # a column of its own: within a lambda it would be cut again for each run
    return words.select("entry_id", F.posexplode(phrases_of(F.col("words"))).alias("at", "phrase"))


def significant(found: DataFrame, min_freq: int = MIN_FREQ, max_phrases: int = MAX_PHRASES, mode: str = "df", noise: tuple[str, ...] = ()) -> DataFrame:
    """(phrase, frequency, first_entry): phrases by number of entries (df) that reach min_freq; the max_phrases most frequent.

    Mode "reference" counts runs of several words once in all, so that only single words can become frequent.
    """
    counted = found.groupBy("phrase").agg(F.count_distinct("entry_id").alias("frequency"), F.min("entry_id").alias("first_entry"))
    if mode == "reference":
        counted = counted.withColumn("frequency", F.when(F.contains("phrase", F.lit(" ")), F.lit(1)).otherwise(F.col("frequency")))
    kept = counted.where((F.col("frequency") >= min_freq) & (F.length("phrase") >= LEAST))
    if noise:
        kept = kept.where(~F.col("phrase").isin(*noise))
    return kept.orderBy(F.desc("frequency"), "first_entry", "phrase").limit(max_phrases)


def mode_surface(found: DataFrame) -> DataFrame:
    """found(lemma, surface, pos) to (lemma, surface): the most frequent form, of equal ones the first seen."""
    c = found.groupBy("lemma", "surface").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return c.groupBy("lemma").agg(F.max_by("surface", F.struct(F.col("n"), -F.col("first"))).alias("surface"))


def weighted(tm: DataFrame, column: str, kept: DataFrame) -> DataFrame:
    """(entry_id, phrase, weight): how often each of kept(phrase) is matched in an entry: leftmost, longest, without overlaps."""
    hits = keyword_hits(tm.select("entry_id", column), "entry_id", column, kept.select(F.col("phrase").alias("keyword")))
    return hits.groupBy("entry_id", F.col("keyword").alias("phrase")).agg(F.count(F.lit(1)).alias("weight"))


def cooccurrence(left: DataFrame, right: DataFrame) -> DataFrame:
    """(s, t, n): pairs of phrases of one entry, with multiplicity, from (entry_id, phrase, weight).

    An entry's phrases are bounded by its two texts, so the join is within entries
    and its rows are summed before they are shuffled by pair.
    """
    pairs = left.select("entry_id", F.col("phrase").alias("s"), F.col("weight").alias("ws")).join(right.select("entry_id", F.col("phrase").alias("t"), F.col("weight").alias("wt")), "entry_id")
    return pairs.groupBy("s", "t").agg(F.sum(F.col("ws") * F.col("wt")).cast("long").alias("n"))


def confidence(pairs: DataFrame, min_freq: int = MIN_FREQ) -> DataFrame:
    """(s, t, n, confidence): n over all of s, up to 0.95; pairs below min_freq count in the sum and are left out."""
    total = pairs.groupBy("s").agg(F.sum("n").alias("total"))
    return pairs.where(F.col("n") >= min_freq).join(total, "s").select("s", "t", "n", F.least(F.lit(0.95), F.col("n") / F.col("total")).alias("confidence"))


def links(left: DataFrame, right: DataFrame, min_freq: int = MIN_FREQ) -> DataFrame:
    """confidence() of cooccurrence(): pairs are counted by numbers of phrases, and what all pairs of an s sum up to is had from its entries."""

    def numbered(side: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        own = materialise(side.select("phrase").distinct().select(F.col("phrase").alias(name), F.monotonically_increasing_id().alias(f"{name}_at")), "phrases")
        return own, side.join(own, F.col("phrase") == F.col(name)).select("entry_id", f"{name}_at", F.col("weight").alias(f"{name}_weight"))

    (s, a), (t, b) = numbered(left, "s"), numbered(right, "t")
    n = F.sum(F.col("s_weight") * F.col("t_weight")).cast("long")
    pairs = a.join(b, "entry_id").groupBy("s_at", "t_at").agg(n.alias("n")).where(F.col("n") >= min_freq)
    total = a.join(b.groupBy("entry_id").agg(F.sum("t_weight").alias("t_weight")), "entry_id").groupBy("s_at").agg(n.alias("total"))
    return pairs.join(total, "s_at").join(s, "s_at").join(t, "t_at").select("s", "t", "n", F.least(F.lit(0.95), F.col("n") / F.col("total")).alias("confidence"))


def sides(tm: DataFrame, min_freq: int = MIN_FREQ, noise: tuple[str, ...] = NOISE, found: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> tuple[DataFrame, DataFrame]:
    """weighted() of the significant phrases of source and target, as an annotator found them (entry_id, phrase), or of runs of words."""
    both = (("source", (), found[0]), ("target", noise, found[1]))
    return tuple(weighted(tm, c, significant(occurrences(tm, c) if own is None else own, min_freq, noise=x)) for c, x, own in both)


def seed(tm: DataFrame, source_lang: str, target_lang: str, min_freq: int = MIN_FREQ, domain: str = "", found: tuple[DataFrame | None, DataFrame | None] = (None, None), matches: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (in the columns of schemas.py that have values) from a memory.

    found: phrases of source and target from an annotator, (entry_id, phrase) a side, such as
    noun_chunks() or dependency_phrases() give. Where a side has surface and pos too, its phrases are
    lemmas, and the most frequent surface is shown. Without, runs of words are taken.
    A term's frequency counts its matches; every seeded term is a phrase. Edges are
    made at one time, so their pos is one number. The two sides are written once, unless
    matches has them as sides() gives them.
    """
    left, right = matches or (materialise(x, "matches") for x in sides(tm, min_freq, found=found))
    sure = links(left, right, min_freq)
    text = lambda c: F.lit(None).cast("string").alias(c)

    def terms(matched: DataFrame, lang: str, own: DataFrame | None) -> DataFrame:
        kept = matched.groupBy("phrase").agg(F.sum("weight").cast("long").alias("frequency")).withColumn("surface", F.lit(None).cast("string"))
        if own is not None and {"surface", "pos"} <= {*own.columns}:
            shown = mode_surface(own.select(F.col("phrase").alias("lemma"), "surface", "pos")).withColumnRenamed("lemma", "phrase")
            kept = kept.drop("surface").join(shown, "phrase", "left")
        return kept.select(term_id(F.lit(lang), F.col("phrase")).alias("id"), F.lit("term").alias("type"), F.col("phrase").alias("term"), text("label"), F.lit(lang).alias("lang"), F.lit(True).alias("is_phrase"), "frequency", F.lit(domain).alias("domain"), F.when(F.lower("surface") != F.lower("phrase"), F.col("surface")).alias("display_form"))

    phrases = left.select("phrase").distinct()
    concepts = phrases.select(concept_id(F.col("phrase")).alias("id"), F.lit("concept").alias("type"), text("term"), F.col("phrase").alias("label"), text("lang"), F.lit(False).alias("is_phrase"), F.lit(None).cast("long").alias("frequency"), F.lit(domain).alias("domain"), text("display_form"))
    nodes = terms(left, source_lang, found[0]).unionByName(terms(right, target_lang, found[1])).unionByName(concepts)
    s, t = term_id(F.lit(source_lang), F.col("s")), term_id(F.lit(target_lang), F.col("t"))
    there = sure.select(s.alias("src"), t.alias("dst"), F.lit("translates_to").alias("relation"), "confidence")
    back = sure.select(t.alias("src"), s.alias("dst"), F.lit("translates_to").alias("relation"), "confidence")
    of = phrases.select(term_id(F.lit(source_lang), F.col("phrase")).alias("src"), concept_id(F.col("phrase")).alias("dst"), F.lit("instantiates_concept").alias("relation"), F.lit(None).cast("double").alias("confidence"))
    edges = there.unionByName(back).unionByName(of).withColumns({"verified": F.lit(False), "provenance": F.lit("auto"), "pos": F.lit(0).cast("long")})
    return nodes, edges


def seeding_job(spark: SparkSession, tm_path: str, graph_path: str, source_lang: str = "en", target_lang: str = "sl", min_freq: int = MIN_FREQ, domain: str = "") -> bool:
    """Reads the memory's TMX files, seeds a graph and saves it; False, and nothing saved, if the memory is empty."""
    from ..sources import files, sinks

    tm = materialise(files.read_tmx(spark, tm_path), "memory")
    if tm.isEmpty():
        return False
    nodes, edges = seed(tm, source_lang, target_lang, min_freq, domain)
    sinks.save_graph(padded(nodes, NODES), padded(edges, EDGES), graph_path)
    return True


def padded(df: DataFrame, schema: str) -> DataFrame:
    """df in the columns of a schema, null where it has none."""
    fields = T._parse_datatype_string(schema).fields
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def noun_chunks(words: Column) -> Column:
    """A chunk, array<struct<text, upos>>, as a phrase: without leading determiners and pronouns, lowered, at least
    LEAST characters and not all digits; null if nothing is left."""
    heads = F.transform(words, lambda w, i: F.when(~w["upos"].isin("DET", "PRON"), i))
    start = F.array_min(heads)
    text = strip_trailing_marks(F.lower(F.array_join(F.transform(F.slice(words, start + 1, F.size(words)), lambda w: w["text"]), " ")))
    return F.when(start.isNotNull() & (F.length(text) >= LEAST) & ~F.regexp_like(text, F.lit(r"(?U)^\d+\z")), text)


def dependency_phrases(sentences: DataFrame, stop: tuple[str, ...] = STOP_LEMMAS) -> DataFrame:
    """sentences(doc_id, words array<struct<id,text,lemma,upos,head,deprel>>) to (doc_id, surface, lemma): each noun with
    the direct children that belong to its phrase, in order; the first of each lemma in a document."""
    x = sentences.select("doc_id", "words", F.explode("words").alias("h")).where(F.col("h.upos").isin("NOUN", "PROPN"))
    own = F.filter("words", lambda w: (w["id"] == F.col("h.id")) | ((w["head"] == F.col("h.id")) & w["deprel"].isin(*PHRASE_RELATIONS) & (w["upos"] != "PUNCT")))
    part = F.array_sort(F.transform(own, lambda w: F.struct(w["id"].alias("id"), w["text"].alias("text"), w["lemma"].alias("lemma"))))
    joined = lambda k: strip_trailing_marks(F.lower(F.array_join(F.transform(part, lambda w: w[k]), " ")))
    y = x.select("doc_id", F.col("h.id").alias("at"), joined("text").alias("surface"), joined("lemma").alias("lemma")).where(F.length("lemma") >= LEAST)
    if stop:
        y = y.where(~F.col("lemma").isin(*stop))
    first = Window.partitionBy("doc_id", "lemma").orderBy("at")
    return y.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("doc_id", "surface", "lemma")
