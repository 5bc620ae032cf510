"""Logical stores derived from the driver's tables, as DataFrames and as SQL for the oracle.

Stores that many queries share are written once for each application and source folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import glossary as G
from ..operators import seed as S
from .shared import stored

SOURCE, TARGET = "src", "tgt"
#: Characters that an end of a sentence is freed of.
BLANK = " \t\r\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the assistant's next one are a pair."""

    def build() -> DataFrame:
        c = table(spark, sf_dir, "conversations")
        user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
        reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
        pairs = user.join(reply, ["conv_id", "turn"]).where("source <> '' AND target <> ''")
        return pairs.select((F.col("conv_id") * 1000 + F.col("turn")).alias("entry_id"), "source", "target", F.lit("conversations").alias("origin"), F.lit(SOURCE).alias("source_lang"), F.lit(TARGET).alias("target_lang"))

    return stored(spark, sf_dir, "tm", build)


def tm_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of each whole document, two by two; the last of an odd number has an empty target."""
    ends = F.regexp_extract_all("text", F.lit(r"([^.!?\n]+[.!?]*)"), F.lit(1))
    s = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.transform(ends, lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "").alias("s"))
    two = s.select("doc_id", "s", F.posexplode(F.expr("sequence(1, size(s), 2)")).alias("k", "at")).where("size(s) > 0")
    return two.select((F.col("doc_id") * 1_000_000 + F.col("k")).alias("entry_id"), F.expr("s[at - 1]").alias("source"), F.coalesce(F.get("s", F.col("at")), F.lit("")).alias("target"), F.lit("documents").alias("origin"), F.lit(SOURCE).alias("source_lang"), F.lit(TARGET).alias("target_lang"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Matched phrases of source and target, from which links and graph are made."""
    made: list[DataFrame] = []

    def build(k: int) -> DataFrame:
        made.extend(() if made else S.sides(tm(spark, sf_dir)))
        return made[k]

    return stored(spark, sf_dir, "matches_source", lambda: build(0)), stored(spark, sf_dir, "matches_target", lambda: build(1))


def _seeded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return S.seed(tm(spark, sf_dir), SOURCE, TARGET, domain="conversations", matches=sides(spark, sf_dir))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's nodes alone; its edges take far longer."""
    nothing = {"variants": F.array().cast("array<string>"), "phrase": F.lit(None).cast("string")}
    return stored(spark, sf_dir, "nodes", lambda: _seeded(spark, sf_dir)[0].withColumns(nothing))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes with display_form and variants (none here), and edges."""
    return nodes(spark, sf_dir), stored(spark, sf_dir, "edges", lambda: _seeded(spark, sf_dir)[1])


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return S.links(*sides(spark, sf_dir))

    return stored(spark, sf_dir, "links", build)


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source phrase with its most confident target phrase, in both directions."""

    def build() -> DataFrame:
        best = links(spark, sf_dir).groupBy("s").agg(F.min_by("t", F.struct((-F.col("confidence")).alias("c"), "t")).alias("t"))
        one = best.select(F.pmod(F.xxhash64("s"), F.lit(2**62)).alias("entry_id"), F.col("s").alias("source_term"), F.col("t").alias("target_term"), F.lit(SOURCE).alias("source_lang"), F.lit(TARGET).alias("target_lang"), F.lit("").alias("note"), F.lit("conversations").alias("origin"))
        return G.with_reverse(one)

    return stored(spark, sf_dir, "glossary", build)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a conversation are a project; two thirds of the projects are done."""
    t = tm(spark, sf_dir).withColumn("project_id", F.floor(F.col("entry_id") / 1000))
    return t.select("project_id", F.col("entry_id").alias("id"), "source", "target", F.when(F.col("project_id") % 3 != 0, "done").otherwise("pending").alias("status"))


def matches_sql(texts: str, dictionary: str, x: str = "") -> str:
    """WITH-list for every{x} and first hits{x}(qid, keyword, start) of dictionary(keyword) in texts(qid, text); names end in x."""
    return f"""
runs{x} AS (SELECT qid, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS r FROM {texts}),
starts{x} AS (SELECT qid, r, unnest(range(1, len(r) + 1)) AS start FROM runs{x}),
wide{x} AS (SELECT qid, start, start + n AS stop, array_to_string(r[start:start + n - 1], '') AS span FROM starts{x}, (VALUES (1), (3), (5)) v(n)
  WHERE start + n - 1 <= len(r) AND regexp_matches(r[start], '^[\\p{{L}}\\p{{N}}_]')),
words{x} AS (SELECT keyword, row_number() OVER (ORDER BY keyword) AS k FROM (SELECT DISTINCT keyword FROM {dictionary})),
found{x} AS (SELECT qid, start, stop, k FROM wide{x} JOIN words{x} ON span = keyword),
folded{x} AS (SELECT qid, list_reduce(list_prepend([0::BIGINT], list([start, stop, k] ORDER BY start, stop DESC)),
  lambda a, h: CASE WHEN h[1] >= a[1] THEN list_concat([h[2]], list_concat(a[2:], [h[1], h[3]])) ELSE a END) AS f FROM found{x} GROUP BY qid),
every{x} AS (SELECT qid, keyword, start FROM (SELECT qid, f[2 * i] AS start, f[2 * i + 1] AS k
  FROM (SELECT qid, f, unnest(range(1, (len(f) - 1) // 2 + 1)) AS i FROM folded{x})) JOIN words{x} USING (k)),
hits{x} AS (SELECT qid, keyword, min(start) AS start FROM every{x} GROUP BY qid, keyword)"""


_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def _phrases(side: str) -> str:
    noise = "" if side == "source" else " AND phrase NOT IN ({})".format(", ".join(f"'{x}'" for x in S.NOISE))
    return f"""
w_{side} AS (SELECT entry_id, {_TOKENS.format(side)} AS w FROM tm),
o_{side} AS (SELECT DISTINCT entry_id, unnest(list_concat(w, list_concat(
    CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) ELSE [] END,
    CASE WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) ELSE [] END))) AS phrase FROM w_{side}),
p_{side} AS (SELECT phrase, count(*) AS frequency FROM o_{side} GROUP BY phrase HAVING count(*) >= 3 AND length(phrase) >= 3{noise}
    ORDER BY frequency DESC, min(entry_id), phrase LIMIT 15000),
{matches_sql(f"(SELECT entry_id AS qid, {side} AS text FROM tm)", f"(SELECT phrase AS keyword FROM p_{side})", "_" + side).strip()},
k_{side} AS (SELECT qid AS entry_id, keyword AS phrase, count(*) AS weight FROM every_{side} GROUP BY ALL),
t_{side} AS (SELECT phrase, sum(weight)::BIGINT AS frequency FROM k_{side} GROUP BY phrase)"""


#: WITH-lists; each builds on those before it.
TM_SQL = """
tm AS (SELECT u.conv_id * 1000 + u.turn AS entry_id, u.text AS source, a.text AS target FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant' AND u.text <> '' AND a.text <> '')"""
DOCS_SQL = """
sentences AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: x <> '') AS s FROM documents),
tm_docs AS (SELECT doc_id * 1000000 + k AS entry_id, s[2 * k + 1] AS source, coalesce(s[2 * k + 2], '') AS target FROM (SELECT doc_id, s, unnest(range(0, (len(s) + 1) // 2)) AS k FROM sentences))"""
SEED_SQL = (
    TM_SQL
    + ","
    + _phrases("source")
    + ","
    + _phrases("target")
    + """,
pairs AS (SELECT a.phrase AS s, b.phrase AS t, sum(a.weight * b.weight)::BIGINT AS n FROM k_source a JOIN k_target b USING (entry_id) GROUP BY ALL),
links AS (SELECT s, t, n, least(0.95::DOUBLE, n::DOUBLE / total) AS confidence FROM (SELECT *, sum(n) OVER (PARTITION BY s) AS total FROM pairs) WHERE n >= 3)"""
)
GLOSSARY_SQL = (
    SEED_SQL
    + """,
best AS (SELECT s, t FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY confidence DESC, t) AS rn FROM links) WHERE rn = 1),
glossary AS (SELECT s AS source_term, t AS target_term, 'src' AS source_lang, 'tgt' AS target_lang FROM best
  UNION ALL SELECT t, s, 'tgt', 'src' FROM best)"""
)
GRAPH_SQL = (
    GLOSSARY_SQL
    + """,
nodes AS (SELECT 'term:src:' || phrase AS id, 'term' AS type, phrase AS term, NULL AS label, 'src' AS lang, true AS is_phrase, frequency FROM t_source
  UNION ALL SELECT 'term:tgt:' || phrase, 'term', phrase, NULL, 'tgt', true, frequency FROM t_target
  UNION ALL SELECT 'concept:' || replace(phrase, ' ', '_'), 'concept', NULL, phrase, NULL, false, NULL FROM t_source),
edges AS (SELECT 'term:src:' || s AS src, 'term:tgt:' || t AS dst, 'translates_to' AS relation, confidence FROM links
  UNION ALL SELECT 'term:tgt:' || t, 'term:src:' || s, 'translates_to', confidence FROM links
  UNION ALL SELECT 'term:src:' || phrase, 'concept:' || replace(phrase, ' ', '_'), 'instantiates_concept', NULL FROM t_source)"""
)
SEGMENT_SQL = (
    TM_SQL
    + """,
segments AS (SELECT entry_id // 1000 AS project_id, entry_id AS id, source, target, CASE WHEN (entry_id // 1000) % 3 <> 0 THEN 'done' ELSE 'pending' END AS status FROM tm)"""
)
