"""The term graph: nodes and edges of schemas.py, one edge for each ordered pair (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nonempty
from .matching import containing, first_hits, keyword_hits, top_k


def term_id(lang: Column, term: Column) -> Column:
    return F.concat(F.lit("term:"), lang, F.lit(":"), F.lower(term))


def concept_id(phrase: Column) -> Column:
    return F.concat(F.lit("concept:"), F.replace(phrase, F.lit(" "), F.lit("_")))


def collocation_id(lang: Column, phrase: Column) -> Column:
    return F.concat(F.lit("coll:"), lang, F.lit(":"), F.regexp_replace(F.lower(phrase), r"(?U)\s+", "_"))


def _padded(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in like.schema])


def insert_absent(nodes: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Concepts, segments and domains: the first of each new id, unless it is there."""
    order = "pos" if "pos" in new.columns else key
    first = new.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_rn = 1").drop("_rn")
    return nodes.unionByName(_padded(first, nodes).join(nodes.select(key), key, "left_anti").select(nodes.columns))


def upsert_terms(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """calls(pos, term, lang, is_phrase, display_form): each adds 1 to its term's frequency.

    is_phrase never goes back; display_form is set when a term is made, later forms
    become variants; a form that equals the term in another case is nothing.
    """
    form = F.when(F.lower("display_form") != F.lower("term"), nonempty("display_form"))
    c = calls.select("pos", term_id(F.col("lang"), F.col("term")).alias("id"), F.lower("term").alias("term"), "lang", F.coalesce("is_phrase", F.lit(False)).alias("is_phrase"), form.alias("form"))
    summed = c.groupBy("id").agg(
        F.first("term").alias("n_term"), F.first("lang").alias("n_lang"), F.count(F.lit(1)).alias("n_freq"), F.bool_or("is_phrase").alias("n_phrase"),
        F.min_by("form", "pos").alias("first_form"), F.array_sort(F.collect_set("form")).alias("forms"),
    )
    x = nodes.join(summed, "id", "full_outer")
    fresh = F.col("type").isNull()
    keep = lambda c: F.col(c)
    made = {
        "type": F.coalesce("type", F.lit("term")), "term": F.coalesce("term", "n_term"), "lang": F.coalesce("lang", "n_lang"),
        "frequency": F.when(F.col("n_freq").isNull(), F.col("frequency")).when(fresh, F.col("n_freq")).otherwise(F.coalesce("frequency", F.lit(1)) + F.col("n_freq")),
        "is_phrase": F.when(F.col("n_phrase").isNull(), F.col("is_phrase")).otherwise(F.coalesce("is_phrase", F.lit(False)) | F.col("n_phrase")),
        "display_form": F.when(fresh, F.col("first_form")).otherwise(F.col("display_form")),
        "variants": F.when(F.size("forms") > 0, F.array_union(F.coalesce("variants", F.array().cast("array<string>")), F.col("forms"))).otherwise(F.col("variants")),
    }
    return x.select(*[made.get(c, keep(c)).alias(c) for c in nodes.columns])


def upsert_collocations(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """calls(pos, phrase, lang, domain, frequency): the first makes a collocation with its frequency, each further one adds 1."""
    c = calls.select("pos", "phrase", "lang", "domain", F.coalesce("frequency", F.lit(1)).cast("long").alias("frequency"), collocation_id(F.col("lang"), F.col("phrase")).alias("id"))
    first = c.groupBy("id").agg(F.min_by(F.struct("phrase", "lang", "domain", "frequency"), "pos").alias("_first"), F.count(F.lit(1)).alias("_calls"))
    x = nodes.join(first, "id", "full_outer")
    fresh = F.col("type").isNull()
    made = {c: F.when(fresh, F.col(f"_first.{c}")).otherwise(F.col(c)) for c in ("phrase", "lang", "domain")}
    made |= {
        "type": F.coalesce("type", F.lit("collocation")),
        "frequency": F.when(fresh, F.col("_first.frequency") + F.col("_calls") - 1).otherwise(F.col("frequency") + F.coalesce("_calls", F.lit(0))),
    }
    return x.select(*[made.get(c, F.col(c)).alias(c) for c in nodes.columns])


def insert_domains(nodes: DataFrame, edges: DataFrame, domains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """domains(id, label, parent): absent ones are made, and each is a subclass of its parent, where there is such a node."""
    nodes = insert_absent(nodes, domains.withColumn("type", F.lit("domain")))
    under = domains.where("parent <> ''").join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi")
    under = under.select(F.col("id").alias("src"), F.col("parent").alias("dst")).distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return nodes, edges.unionByName(_padded(under.withColumn("relation", F.lit("subclass_of")), edges))


def add_variants(nodes: DataFrame, variants: DataFrame) -> DataFrame:
    """variants(id, variant) appended where absent."""
    v = variants.groupBy("id").agg(F.array_sort(F.collect_set("variant")).alias("_v"))
    x = nodes.join(v, "id", "left").withColumn("variants", F.when(F.col("_v").isNotNull(), F.array_union(F.coalesce("variants", F.array().cast("array<string>")), F.col("_v"))).otherwise(F.col("variants")))
    return x.select(nodes.columns)


def upsert_links(nodes: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """calls(pos, src, dst, confidence, verified, provenance, context): links both ways between nodes that exist.

    The first call makes a link, each further one adds 0.05 up to 0.99 and leaves
    the rest; n calls in closed form. A first confidence over 0.99 falls to it.
    """
    known = nodes.select("id")
    ok = calls.join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi")
    both = ok.select("pos", "src", "dst", "confidence", "verified", "provenance", "context").unionAll(ok.select("pos", F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence", "verified", "provenance", "context"))
    s = both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("confidence", "verified", "provenance", "context"), "pos").alias("first"), F.min("pos").alias("n_pos"))
    x = edges.join(s, ["src", "dst"], "full_outer")
    fresh, again = F.col("relation").isNull(), F.col("n").isNotNull()
    raised = lambda start, k: F.least(F.lit(0.99), start + 0.05 * k)
    made = {
        "relation": F.coalesce("relation", F.lit("translates_to")),
        "confidence": F.when(fresh, F.when(F.col("n") == 1, F.col("first.confidence")).otherwise(raised(F.col("first.confidence"), F.col("n") - 1))).when(again, raised(F.coalesce("confidence", F.lit(0.5)), F.col("n"))).otherwise(F.col("confidence")),
        "verified": F.when(fresh, F.coalesce("first.verified", F.lit(False))).otherwise(F.col("verified")),
        "provenance": F.when(fresh, F.col("first.provenance")).otherwise(F.col("provenance")),
        "context": F.when(fresh, F.col("first.context")).otherwise(F.col("context")),
        "pos": F.coalesce("pos", "n_pos"),
    }
    return x.select(*[made.get(c, F.col(c)).alias(c) for c in edges.columns])


def promote_pairs(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs(pos, source, target, source_lang, target_lang): confirmed pairs become phrases of one concept with a verified link."""
    from ..functions.text import strip

    p = pairs.select("pos", strip("source").alias("s"), strip("target").alias("t"), "source_lang", "target_lang").where("s <> '' AND t <> ''")
    concepts = p.select("pos", concept_id(F.col("s")).alias("id"), F.lit("concept").alias("type"), F.col("s").alias("label"))
    nodes = insert_absent(nodes, concepts)
    calls = p.select((2 * F.col("pos")).alias("pos"), F.col("s").alias("term"), F.col("source_lang").alias("lang"), F.lit(True).alias("is_phrase"), F.lit(None).cast("string").alias("display_form"))
    calls = calls.unionByName(p.select((2 * F.col("pos") + 1).alias("pos"), F.col("t").alias("term"), F.col("target_lang").alias("lang"), F.lit(True).alias("is_phrase"), F.lit(None).cast("string").alias("display_form")))
    nodes = upsert_terms(nodes, calls)
    links = p.select("pos", term_id(F.col("source_lang"), F.col("s")).alias("src"), term_id(F.col("target_lang"), F.col("t")).alias("dst"), F.lit(1.0).alias("confidence"), F.lit(True).alias("verified"), F.lit("manual").alias("provenance"), F.lit(None).cast("string").alias("context"))
    of = p.select("pos", term_id(F.col("source_lang"), F.col("s")).alias("src"), concept_id(F.col("s")).alias("dst")).unionAll(p.select("pos", term_id(F.col("target_lang"), F.col("t")).alias("src"), concept_id(F.col("s")).alias("dst")))
    of = of.groupBy("src", "dst").agg(F.min("pos").alias("pos")).withColumn("relation", F.lit("instantiates_concept"))
    edges = edges.unionByName(_padded(of.join(edges, ["src", "dst"], "left_anti"), edges))
    return nodes, upsert_links(nodes, edges, links)


def keywords(nodes: DataFrame) -> DataFrame:
    """(keyword, node_id) of terms, their variants and collocations; of two nodes with one keyword the last made has it, of those made at one time the last by id."""
    forms = F.concat(F.array("term"), F.coalesce("variants", F.array().cast("array<string>")))
    made = (F.col("created_at") if "created_at" in nodes.columns else F.lit(None).cast("string")).alias("made")
    t = nodes.where("type = 'term'").select("id", made, F.explode(forms).alias("k"))
    c = nodes.where("type = 'collocation'").select("id", made, F.col("phrase").alias("k"))
    return t.unionAll(c).where("k <> ''").groupBy(F.lower("k").alias("keyword")).agg(F.max(F.struct("made", "id")).alias("n")).select("keyword", F.col("n.id").alias("node_id"))


def translations(nodes: DataFrame, edges: DataFrame, terms: DataFrame, lang: str) -> DataFrame:
    """(node_id, term, confidence, verified, rank) for terms(node_id): distinct texts, the first link of each, by confidence."""
    out = edges.where("relation = 'translates_to'").join(terms.select("node_id").distinct(), F.col("src") == F.col("node_id"), "left_semi")
    to = nodes.where(F.col("lang") == lang).select(F.col("id").alias("dst"), F.coalesce(nonempty("display_form"), nonempty("term")).alias("text"))
    x = out.join(to, "dst").where("text IS NOT NULL")
    first = x.groupBy("src", "text").agg(F.min_by(F.struct(F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("verified", F.lit(False)).alias("verified"), "pos"), "pos").alias("e"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("e.confidence"), "e.pos", "text")))
    return ranked.select(F.col("src").alias("node_id"), F.col("text").alias("term"), "e.confidence", "e.verified", "rank")


def examples(nodes: DataFrame, edges: DataFrame, terms: DataFrame, limit: int = 3) -> DataFrame:
    """(node_id, source_text, target_text, rank) of segments that a term appears in."""
    e = edges.where("relation = 'appears_in_segment'").join(terms.select("node_id").distinct(), F.col("src") == F.col("node_id"), "left_semi")
    x = e.join(nodes.where("type = 'tm_segment'").select(F.col("id").alias("dst"), "source_text", "target_text"), "dst")
    return top_k(x, ["src"], [F.asc("pos"), F.asc("dst")], limit).select(F.col("src").alias("node_id"), "source_text", "target_text", "rank")


def entities(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, node_id, term, lang, is_phrase, frequency, rank) of the nodes a text names: phrases first, then by frequency, then id."""
    hits = first_hits(keyword_hits(texts, "qid", "text", keywords(nodes)), "qid").join(keywords(nodes), "keyword").select("qid", "node_id").distinct()
    n = nodes.select(F.col("id").alias("node_id"), F.coalesce("term", "phrase").alias("term"), "lang", F.coalesce("is_phrase", F.lit(False)).alias("is_phrase"), F.coalesce("frequency", F.lit(0)).alias("frequency"))
    x = hits.join(n, "node_id")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("is_phrase"), F.desc("frequency"), "node_id")))


def neighbours(edges: DataFrame, starts: DataFrame, max_depth: int = 1) -> DataFrame:
    """(start, node, depth, relation): shortest directed distance up to max_depth; the relation of direct edges only."""
    out = edges.groupBy("src", "dst").agg(F.max_by("relation", "pos").alias("relation"))
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("node"))
    seen = front.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        step = front.join(out, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = step.join(seen, ["start", "node"], "left_anti")
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    found = seen.where("depth > 0")
    direct = out.select(F.col("src").alias("start"), F.col("dst").alias("node"), "relation")
    return found.join(direct, ["start", "node"], "left").select("start", "node", "depth", F.when(F.col("depth") == 1, F.col("relation")).alias("relation"))


def related(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, term): direct neighbours that are terms of the start's language."""
    n = nodes.where("type = 'term'").select("id", "lang", F.coalesce(nonempty("display_form"), "term").alias("term"))
    own = nodes.select(F.col("id").alias("start"), F.col("lang").alias("own"))
    return neighbours(edges, starts).join(n, F.col("node") == F.col("id")).join(own, "start").where("lang = own").select("start", "term").distinct()


def search(nodes: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, label, neighbours): nodes whose label holds the query, and how many they lead to."""
    label = F.coalesce(nonempty("term"), nonempty("label"), nonempty("id"))
    q = queries.where(F.length("text") >= 2).select("qid", F.lower("text").alias("pattern"))
    labels = nodes.select("id", label.alias("label"))
    hits = containing(labels.select("id", F.lower("label").alias("text")), q).join(labels, "id")
    degree = edges.where("src <> dst").groupBy("src").agg(F.count_distinct("dst").alias("n"))
    return hits.join(degree, F.col("id") == F.col("src"), "left").select("qid", "id", "label", F.coalesce("n", F.lit(0)).cast("long").alias("neighbours"))


def prefix(nodes: DataFrame, queries: DataFrame, lang: str) -> DataFrame:
    """(qid, term): of each term or collocation the first of term, display form and phrase that starts with the prefix."""
    q = queries.where(F.length("prefix") >= 2).select("qid", F.lower("prefix").alias("p"), F.left(F.lower("prefix"), F.lit(2)).alias("key"))
    n = nodes.where(F.col("type").isin("term", "collocation") & (F.col("lang") == lang)).select("id", F.posexplode(F.array("term", "display_form", "phrase")).alias("at", "form")).where("form IS NOT NULL")
    hits = n.withColumn("key", F.left(F.lower("form"), F.lit(2))).join(q, "key").where(F.startswith(F.lower("form"), F.col("p")))
    return hits.groupBy("qid", "id").agg(F.min_by("form", "at").alias("term")).select("qid", "term").distinct()


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value): totals, and counts by type and relation."""
    n = nodes.groupBy(F.concat(F.lit("node_"), F.coalesce("type", F.lit("unknown"))).alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    e = edges.groupBy(F.concat(F.lit("edge_"), F.coalesce("relation", F.lit("unknown"))).alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    total = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
    return n.unionByName(e).unionByName(total(nodes, "total_nodes")).unionByName(total(edges, "total_edges"))


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of ids(id) and the edges among them."""
    inner = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.join(ids.select("id"), "id", "left_semi"), inner.select(edges.columns)


def hints(queries: DataFrame, nodes: DataFrame, edges: DataFrame, lang: str, max_hints: int = 6, least: int = 2) -> DataFrame:
    """queries(qid, prefix, text) to (qid, term, confidence, source_term, verified, rank): translations of the
    text's entities of which a word starts with the prefix; verified ones gain 0.1, up to 1."""
    q = queries.where(F.length("prefix") >= least)
    found = entities(q.select("qid", "text"), nodes)
    t = translations(nodes, edges, found.select("node_id"), lang)
    x = found.select("qid", "node_id", F.col("term").alias("source_term"), F.col("rank").alias("entity_rank")).join(t, "node_id").join(q.select("qid", F.lower("prefix").alias("p")), "qid")
    x = x.where(F.exists(F.split(F.lower("term"), r"(?U)\s+"), lambda w: F.startswith(w, F.col("p"))))
    first = x.withColumn("_rn", F.row_number().over(Window.partitionBy("qid", F.lower("term")).orderBy("entity_rank", "rank"))).where("_rn = 1")
    first = first.withColumn("confidence", F.when(F.col("verified"), F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence")))
    return top_k(first.drop("rank"), ["qid"], [F.desc("confidence"), F.asc("entity_rank"), F.asc("term")], max_hints).select("qid", "term", "confidence", "source_term", "verified", "rank")


def tooltip(nodes: DataFrame, edges: DataFrame, queries: DataFrame, lang: str, target_lang: str) -> DataFrame:
    """queries(qid, term) to (qid, node_id, frequency, translations, concept, examples): by exact id, else by keyword."""
    q = queries.select("qid", F.lower("term").alias("keyword"), term_id(F.lit(lang), F.col("term")).alias("exact"))
    ids = q.join(nodes.select(F.col("id").alias("exact"), F.lit(True).alias("there")), "exact", "left").join(keywords(nodes), "keyword", "left")
    ids = ids.select("qid", F.when(F.col("there"), F.col("exact")).otherwise(F.col("node_id")).alias("node_id")).where("node_id IS NOT NULL")
    t = translations(nodes, edges, ids, target_lang).groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("translations"))
    c = edges.where("relation = 'instantiates_concept'").groupBy(F.col("src").alias("node_id")).agg(F.min_by("dst", F.struct("pos", "dst")).alias("concept"))
    x = examples(nodes, edges, ids).groupBy("node_id").agg(F.array_sort(F.collect_list("source_text")).alias("examples"))
    return ids.join(nodes.select(F.col("id").alias("node_id"), "frequency"), "node_id").join(t, "node_id", "left").join(c, "node_id", "left").join(x, "node_id", "left").select("qid", "node_id", "frequency", F.coalesce("translations", F.lit("")).alias("translations"), "concept", "examples")
