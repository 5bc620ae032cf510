"""Readers of the interchange formats: TMX, TBX, TSV, CSV, graph and project JSON, DOCX.

Files are read whole, one row a file, and parsed by expressions; ids follow file
name and place in the file, so a rerun gives the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import clean_text, html_unescape, nonempty, strip
from ..schemas import EDGE_JSON, EDGES, NODE_JSON, NODES, PROJECT


def _whole(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, body) of the files right in a folder; a byte order mark goes."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.regexp_replace(F.col("content").cast("string"), "^﻿", "").alias("body"))


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """entry_id by file and place: a count of rows before each file, and the place in it."""
    sizes = df.groupBy("file").agg(F.max("place").alias("n"))
    offsets = sizes.select("file", F.coalesce(F.sum(F.col("n") + 1).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))  # a row a file
    return df.join(offsets, "file").withColumn("entry_id", F.col("offset") + F.col("place")).drop("offset", "place", *order)


def _decoded(c: str):
    """The characters of an XML fragment, without its inline tags."""
    return html_unescape(F.regexp_replace(c, r"<[^>]+>", ""))


def read_tmx(spark: SparkSession, path: str) -> DataFrame:
    """tm of all *.tmx: the first two variants of each unit, cleaned; units with an empty side go; files whose header says sl are turned round."""
    f = _whole(spark, path, "*.tmx")
    lang = F.coalesce(nonempty(F.regexp_replace(F.lower(F.regexp_extract("body", r'srclang\s*=\s*"([^"]+)"', 1)), "-.*$", "")), F.lit("en"))
    units = f.select("file", lang.alias("lang"), F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<tu[\s>](.*?)</tu>"), F.lit(1))).alias("place", "unit"))
    segs = F.regexp_extract_all("unit", F.lit(r"(?s)<tuv[\s>].*?<seg[^>]*>(.*?)</seg>"), F.lit(1))
    x = units.select("file", "lang", "place", F.get(segs, 0).alias("a"), F.get(segs, 1).alias("b")).select("file", "lang", "place", clean_text(_decoded("a")).alias("a"), clean_text(_decoded("b")).alias("b")).where("a <> '' AND b <> ''")
    turned = F.col("lang") == "sl"
    out = x.select("file", "place", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("source"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("target"), F.col("file").alias("origin"), F.lit("en").alias("source_lang"), F.lit("sl").alias("target_lang"))
    return _numbered(out).select("entry_id", "source", "target", "origin", "source_lang", "target_lang")


def _pair(file: str) -> tuple:
    found = lambda k: F.coalesce(nonempty(F.lower(F.regexp_extract(file, r"([A-Za-z]{2})-([A-Za-z]{2})(?=\.\w+$)", k))), F.lit("en" if k == 1 else "sl"))
    return found(1), found(2)


def _lines(files: DataFrame, bare: bool, first: Column | int = 0) -> DataFrame:
    """Lines of two or more columns, both filled, in places from first on; bare: only lines without < and >."""
    x = files.select("file", F.lit(first).alias("first"), F.posexplode(F.split("body", "\n")).alias("place", "line")).withColumn("place", F.col("first") + F.col("place"))
    if bare:
        x = x.where(~F.contains("line", F.lit("<")) & ~F.contains("line", F.lit(">")))
    cells = F.split("line", "\t")
    sl, tl = _pair("file")
    x = x.where(F.size(cells) >= 2).select("file", "place", strip(cells[0]).alias("source_term"), strip(cells[1]).alias("target_term"), sl.alias("source_lang"), tl.alias("target_lang"), F.lit("").alias("note"))
    return x.where("source_term <> '' AND target_term <> ''")


def _csv_rows(files: DataFrame) -> DataFrame:
    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def parse(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import csv
        import io

        def rows(body: str) -> list:
            pick = lambda r, *names: next((r[n] for n in names if r.get(n)), "")
            every = csv.DictReader(io.StringIO(body, newline=""))
            return [[pick(r, "source_term", "source"), pick(r, "target_term", "target"), pick(r, "source_lang", "sl") or "en", pick(r, "target_lang", "tl") or "sl", pick(r, "note")] for r in every]

        for s in parts:
            yield s.map(rows)

    x = files.select("file", F.posexplode(parse("body")).alias("place", "r"))
    names = ("source_term", "target_term", "source_lang", "target_lang", "note")
    return x.select("file", "place", *[F.col("r")[k].alias(n) for k, n in enumerate(names)]).where("source_term <> '' AND target_term <> ''")


#: An entry whose tag has no attributes.
_ENTRY = r"(?s)<termEntry>(.*?)</termEntry>"
_LANG_SET = r"""(?s)<langSet\s[^>]*?lang\s*=\s*["']([^"']+)["'][^>]*>(.*?)</langSet>"""


def _first_text(c: Column | str, tag: str) -> Column:
    """What stands right after the first opening tag of that name, as characters."""
    return strip(html_unescape(F.regexp_extract(c, rf"<{tag}(?:\s[^>]*)?>([^<]*)", 1)))


def _tbx_entries(files: DataFrame) -> DataFrame:
    """Entries with an en and an sl term; one that is no XML, or whose tag has attributes, is passed over. Of several sets of a language the last with a term counts."""
    x = files.select("file", F.posexplode(F.regexp_extract_all("body", F.lit(_ENTRY), F.lit(1))).alias("place", "entry"))
    read = F.from_xml(F.concat(F.lit("<entry>"), "entry", F.lit("</entry>")), "broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    x = x.withColumn("read", read).where("read IS NOT NULL AND read.broken IS NULL").withColumn("note", _first_text("entry", "descrip"))
    sets = F.arrays_zip(F.regexp_extract_all("entry", F.lit(_LANG_SET), F.lit(1)).alias("lang"), F.regexp_extract_all("entry", F.lit(_LANG_SET), F.lit(2)).alias("body"))
    each = x.select("file", "place", "note", F.posexplode(sets).alias("at", "s")).select("file", "place", "note", "at", "s.lang", _first_text("s.body", "term").alias("term")).where("term <> ''")
    last = lambda lang: F.max_by(F.when(F.col("lang") == lang, F.col("term")), F.when(F.col("lang") == lang, F.col("at")))
    both = each.groupBy("file", "place", "note").agg(last("en").alias("source_term"), last("sl").alias("target_term")).where("source_term IS NOT NULL AND target_term IS NOT NULL")
    return both.select("file", "place", "source_term", "target_term", F.lit("en").alias("source_lang"), F.lit("sl").alias("target_lang"), "note")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a folder, in both directions. A file with <termEntry is TBX (with table lines after it), else .csv is CSV, else one with tabs and no < is TSV."""
    from ..operators.glossary import with_reverse

    f = _whole(spark, path, "*")
    tbx, csv_ = F.contains("body", F.lit("<termEntry")), F.endswith("file", F.lit(".csv"))
    first = f.where(tbx)
    lines = _lines(first, bare=True, first=F.size(F.regexp_extract_all("body", F.lit(_ENTRY), F.lit(1))))
    tsv = f.where(~tbx & ~csv_ & F.contains("body", F.lit("\t")) & ~F.contains("body", F.lit("<")))
    every = _tbx_entries(first).unionByName(lines).unionByName(_csv_rows(f.where(~tbx & csv_))).unionByName(_lines(tsv, bare=False)).withColumn("origin", F.col("file"))
    return with_reverse(_numbered(every).select("entry_id", "source_term", "target_term", "source_lang", "target_lang", "note", "origin"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph document; of edges with one pair of ends later values win; a broken file is an empty graph."""
    doc = _whole(spark, path, "*").select(F.from_json("body", f"nodes array<struct<{_struct(NODE_JSON)}>>, edges array<struct<{_struct(EDGE_JSON)}>>", {"mode": "PERMISSIVE"}).alias("d"))
    nodes = doc.select(F.posexplode("d.nodes").alias("pos", "n")).where("n.id IS NOT NULL").groupBy("n.id").agg(F.max_by("n", "pos").alias("n")).select("n.*")
    e = doc.select(F.posexplode("d.edges").alias("pos", "e")).where("e.source IS NOT NULL AND e.target IS NOT NULL")
    values = [c.split()[0] for c in EDGE_JSON.split(", ")][2:]
    e = e.groupBy(F.col("e.source").alias("src"), F.col("e.target").alias("dst")).agg(*[F.max_by(f"e.{c}", F.when(F.col(f"e.{c}").isNotNull(), F.col("pos"))).alias(c) for c in values], F.min("pos").cast("long").alias("pos"))
    return nodes.select([c.split()[0] for c in NODES.split(", ")]), e.select([c.split()[0] for c in EDGES.split(", ")])


def _struct(ddl: str) -> str:
    return ", ".join(":".join(c.split(maxsplit=1)) for c in ddl.split(", "))


def read_projects(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """All readable projects, the last saved first."""
    x = _whole(spark, path, pattern).select(F.from_json("body", PROJECT, {"mode": "PERMISSIVE"}).alias("p")).select("p.*")
    return x.where("id IS NOT NULL AND filename IS NOT NULL AND saved_at IS NOT NULL").orderBy(F.desc("saved_at"), "id")


def project_segments(projects: DataFrame) -> DataFrame:
    return projects.select(F.col("id").alias("project_id"), F.explode("segments").alias("s")).select("project_id", "s.*")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, source): the filled paragraphs of *.docx, numbered from 0."""

    @F.pandas_udf(ArrayType(StringType()))
    def paragraphs(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import io
        import xml.etree.ElementTree as ET
        import zipfile

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

        def read(content: bytes) -> list | None:
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    body = ET.fromstring(z.read("word/document.xml")).find(f"{w}body")
            except (zipfile.BadZipFile, KeyError, ET.ParseError):
                return None
            texts = ("".join(t.text or "" for t in p.iter(f"{w}t")).strip() for p in body.findall(f"{w}p"))
            return [t for t in texts if t]

        for s in parts:
            yield s.map(read)

    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.posexplode(paragraphs("content")).alias("id", "source"))


def read_project(spark: SparkSession, path: str, project_id: str) -> DataFrame:
    """The project of that id, read from its own file or stored folder alone; no row if it is missing or broken."""
    store = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/project={project_id}")
    if store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        return spark.read.schema(PROJECT).parquet(f"{path}/project={project_id}")
    return read_projects(spark, path, f"{project_id}.json").where(F.col("id") == project_id)
