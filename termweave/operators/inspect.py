"""Views, statistics and integrity of a term graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EDGE_STYLES, OTHER_STYLE, lookup, node_colour, node_label, node_size


def select_nodes(nodes: DataFrame, edges: DataFrame, limit: int = 300, lang: str | None = None, min_freq: int = 1) -> DataFrame:
    """The most frequent terms, and the concepts that they lead to."""
    t = nodes.where((F.col("type") == "term") & (F.coalesce("frequency", F.lit(1)) >= min_freq))
    if lang is not None:
        t = t.where(F.col("lang") == lang)
    t = t.orderBy(F.desc(F.coalesce("frequency", F.lit(0))), "id").limit(limit)
    to = edges.where("relation = 'instantiates_concept'").join(t.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return t.unionByName(nodes.join(to, "id", "left_semi").join(t.select("id"), "id", "left_anti").select(nodes.columns))


def select_edges(selected: DataFrame, edges: DataFrame) -> DataFrame:
    ids = selected.select("id")
    return edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


def visual_nodes(selected: DataFrame, inner: DataFrame) -> DataFrame:
    """(id, label, type, lang, freq, is_phrase, domain, verified, color, size)."""
    v = inner.where("relation = 'translates_to' AND verified")
    seen = v.select(F.col("src").alias("id")).union(v.select(F.col("dst").alias("id"))).distinct().withColumn("v", F.lit(True))
    return selected.join(seen, "id", "left").select(
        "id", node_label().alias("label"), F.coalesce("type", F.lit("term")).alias("type"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("frequency", F.lit(1)).alias("freq"),
        F.coalesce("is_phrase", F.lit(False)).alias("is_phrase"), F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("v", F.lit(False)).alias("verified"),
        node_colour(F.col("type"), F.col("lang")).alias("color"), node_size(F.col("frequency")).alias("size"),
    )


def visual_links(inner: DataFrame) -> DataFrame:
    """(source, target, relation, confidence, verified, color, width, dashed): a translation is left out where its pair has an earlier edge."""
    pair = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy("pos", "src", "dst")
    x = inner.withColumn("relation", F.coalesce("relation", F.lit("related_to"))).withColumn("_rn", F.row_number().over(pair)).where("_rn = 1 OR relation <> 'translates_to'")
    style = [lookup(F.col("relation"), {k: v[i] for k, v in EDGE_STYLES.items()}, OTHER_STYLE[i]).alias(n) for i, n in enumerate(("color", "width", "dashed"))]
    return x.select(F.col("src").alias("source"), F.col("dst").alias("target"), "relation", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("verified", F.lit(False)).alias("verified"), *style)


def view(nodes: DataFrame, links: DataFrame, lang: str | None = None, phrases_only: bool = True, verified_only: bool = False, text: str = "") -> tuple[DataFrame, DataFrame]:
    """What a reader sees of visual_nodes() and visual_links(): filters hold for terms; concepts stay as sources of a link, or as targets of a visible one."""
    ok = F.contains(F.lower("label"), F.lit(text.lower()))
    if lang:
        ok = ok & (F.col("lang") == lang)
    if phrases_only:
        ok = ok & F.col("is_phrase")
    if verified_only:
        ok = ok & F.col("verified")
    terms, concepts = nodes.where((F.col("type") != "concept") & ok), nodes.where("type = 'concept'")
    from_ = links.select(F.col("source").alias("id"))
    to = links.join(terms.select(F.col("id").alias("source")).union(concepts.select(F.col("id").alias("source"))), "source", "left_semi").select(F.col("target").alias("id"))
    shown = terms.unionByName(concepts.join(from_.union(to).distinct(), "id", "left_semi").select(nodes.columns))
    ids = shown.select("id")
    inner = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return shown, inner.select(links.columns)


def around(links: DataFrame, node_id: str) -> DataFrame:
    """(id): what a node is linked to in either direction."""
    return links.where(F.col("source") == node_id).select(F.col("target").alias("id")).union(links.where(F.col("target") == node_id).select(F.col("source").alias("id"))).distinct()


def detail(links: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """(label, confidence) of a node's outgoing translations in view, by confidence."""
    x = links.where((F.col("source") == node_id) & (F.col("relation") == "translates_to"))
    return x.join(nodes.select(F.col("id").alias("target"), "label"), "target").select("label", "confidence").orderBy(F.desc("confidence"), "label")


def stats(nodes: DataFrame, edges: DataFrame, limit: int = 300, lang: str | None = None, min_freq: int = 1) -> DataFrame:
    """(metric, value) of the view: totals, counts by language, type and the ten largest domains."""
    chosen = select_nodes(nodes, edges, limit, lang, min_freq)
    inner = select_edges(chosen, edges)
    shown, links = visual_nodes(chosen, inner), visual_links(inner)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
    by = lambda df, name, c: df.groupBy(F.concat(F.lit(name), c).alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    terms = chosen.where("type = 'term'")
    parts = [one(nodes, "total_nodes_in_kg"), one(edges, "total_edges_in_kg"), one(chosen, "showing_nodes"), one(links, "showing_edges"), one(terms, "term_nodes"), one(chosen.where("type = 'concept'"), "concept_nodes"), one(terms.where("is_phrase"), "phrase_nodes"), one(shown.where("verified"), "verified_nodes")]
    parts += [by(terms, "lang_", F.coalesce("lang", F.lit("?"))), by(nodes, "type_", F.coalesce("type", F.lit("unknown"))), by(chosen.where("domain <> ''"), "domain_", F.col("domain")).orderBy(F.desc("value"), "metric").limit(10)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by type, edges by relation."""
    n = nodes.groupBy(F.lit("node").alias("kind"), F.coalesce("type", F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.coalesce("relation", F.lit("(none)")).alias("name")).agg(F.count(F.lit(1)).alias("n")))


def integrity(edges: DataFrame, sample: int = 5) -> DataFrame:
    """One row: translations that lost their source to the word 'auto', what they touch, and a verdict."""
    link, bad = F.coalesce(F.col("relation") == "translates_to", F.lit(False)), F.coalesce(F.col("src") == "auto", F.lit(False))
    one = edges.agg(
        F.count_if(link).alias("total"), F.count_if(link & bad).alias("corrupted"), F.count_if(link & ~bad).alias("intact"),
        F.count_distinct(F.when(link & bad, F.col("dst"))).alias("targets"), F.count_distinct(F.when(link & bad, F.col("src"))).alias("sources"), F.count_if(~link & bad).alias("others"),
    )
    few = edges.where(link & bad).orderBy("pos", "dst").limit(sample).agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("sample"))
    verdict = F.when(F.col("corrupted") > 0, "CORRUPTED").when(F.col("total") == 0, "EMPTY").otherwise("HEALTHY")
    # both sides are one row
    return one.join(F.broadcast(few), how="cross").withColumns({"pct": F.col("corrupted") / F.greatest(F.lit(1), F.col("total")) * 100, "verdict": verdict})


def repaired(edges: DataFrame) -> DataFrame:
    """Edges without the corrupted ones, to write in place of them after a copy is kept."""
    return edges.where("NOT (relation = 'translates_to' AND src = 'auto') OR relation IS NULL")


def document(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(value): visual_nodes() and visual_links() as one JSON document {nodes, links}; a view is limited, so it fits a row."""
    one = lambda df, order, name: df.agg(F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")))).alias(name)).select(F.transform(name, lambda x: x["j"]).alias(name))
    both = one(nodes, ("id",), "n").join(F.broadcast(one(links, ("source", "target"), "l")), how="cross")
    return both.select(F.concat(F.lit('{"nodes": ['), F.array_join("n", ", "), F.lit('], "links": ['), F.array_join("l", ", "), F.lit("]}")).alias("value"))
