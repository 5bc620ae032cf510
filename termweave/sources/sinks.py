"""Writers: Parquet stores, and documents for interchange."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.text import escape_xml, strip
from ..schemas import EDGE_JSON, NODE_JSON


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): a JSON object a line, {"node": ...} or {"edge": ...}; scales where one document would not."""
    n = nodes.select(F.to_json(F.struct(F.struct(*[c.split()[0] for c in NODE_JSON.split(", ")]).alias("node"))).alias("value"))
    return n.unionByName(edges.select(F.to_json(F.struct(_edge().alias("edge"))).alias("value")))


def _edge():
    names = [c.split()[0] for c in EDGE_JSON.split(", ")]
    return F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), *names[2:])


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): one document {nodes, edges} for other tools; the graph must fit one row, as there it must fit one file."""
    n = nodes.agg(F.array_sort(F.collect_list(F.to_json(F.struct(*[c.split()[0] for c in NODE_JSON.split(", ")])))).alias("n"))
    e = edges.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json(_edge()).alias("j")))), lambda x: x["j"]).alias("e"))
    return n.join(F.broadcast(e), how="cross").select(F.concat(F.lit('{"nodes": ['), F.array_join("n", ", "), F.lit('], "edges": ['), F.array_join("e", ", "), F.lit("]}")).alias("value"))


def tmx_units(tm: DataFrame) -> DataFrame:
    """(entry_id, value): a <tu> for each pair, escaped."""
    side = lambda lang, c: F.concat(F.lit('<tuv xml:lang="'), lang, F.lit('"><seg>'), escape_xml(c), F.lit("</seg></tuv>"))
    return tm.select("entry_id", F.concat(F.lit("<tu>"), side(F.col("source_lang"), F.col("source")), side(F.col("target_lang"), F.col("target")), F.lit("</tu>")).alias("value"))


def glossary_lines(glossary: DataFrame) -> DataFrame:
    """(value): source, target and note between tabs; both terms must be filled."""
    return glossary.where("source_term <> '' AND target_term <> ''").select(F.concat_ws("\t", "source_term", "target_term", F.coalesce("note", F.lit(""))).alias("value"))


def save_projects(documents: DataFrame, path: str) -> None:
    """A folder a project, so that one can be replaced or deleted alone."""
    documents.withColumn("project", F.col("id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path)


def delete_project(spark, path: str, project_id: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/project={project_id}")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def back_up(spark, path: str, stamp: str) -> str:
    """A copy of a stored graph beside it, before it is replaced."""
    jvm, conf, copy = spark._jvm, spark._jsc.hadoopConfiguration(), f"{path.rstrip('/')}.backup-{stamp}"
    a, b = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(copy)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
    return copy


def append_pairs(pairs: DataFrame, path: str) -> None:
    """Rows of the memory, or of the glossary, added to its Parquet store."""
    pairs.write.mode("append").parquet(path)


def write_tmx(tm: DataFrame, path: str, source_lang: str) -> None:
    """The memory as TMX documents in a folder, one a partition; every header has the language given, that of the first pair ever written."""
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<tmx version="1.4">', f'  <header creationtool="termweave" srclang="{source_lang}"/>', "  <body>"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda x: pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["value"])
        yield line(head)
        for batch in batches:
            yield line([f"    {v}" for v in batch.column(0).to_pylist()])
        yield line(["  </body>", "</tmx>"])

    tmx_units(tm).select("value").mapInArrow(whole, "value string").write.mode("overwrite").text(path)


def write_glossary(glossary: DataFrame, path: str, mode: str = "append") -> None:
    """Entries as lines of text files in a folder, added to those that are there."""
    glossary_lines(glossary).write.mode(mode).text(path)


def export_docx(files: DataFrame, segments: DataFrame) -> DataFrame:
    """files(project_id, content) with the paragraphs of each document replaced: (project_id, content).

    A paragraph whose stripped text is the source of a segment gets its target, if that is filled; of several
    segments of one source the last. The rest of the file is kept as it is. A file that is no DOCX is left out.
    """
    last = segments.groupBy("project_id", F.col("source").alias("key")).agg(F.max_by("target", "id").alias("target")).where(strip("target") != "")
    pairs = last.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "target"))).alias("pairs"))

    @F.pandas_udf(BinaryType())
    def replaced(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, maps in parts:
            yield pd.Series([_docx(c, dict(m) if m is not None else {}) for c, m in zip(contents, maps, strict=True)])

    x = files.join(pairs, "project_id", "left").select("project_id", replaced("content", "pairs").alias("content"))
    return x.where("content IS NOT NULL")


def _docx(content: bytes, pairs: dict[str, str]) -> bytes | None:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    out = io.BytesIO()
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
            for member in old.infolist():
                data = old.read(member)
                if member.filename == "word/document.xml":
                    root = ET.fromstring(data)
                    for p in root.find(f"{w}body").findall(f"{w}p"):
                        text = "".join(t.text or "" for t in p.iter(f"{w}t")).strip()
                        if text in pairs:
                            for child in [c for c in p if c.tag != f"{w}pPr"]:
                                p.remove(child)
                            t = ET.SubElement(ET.SubElement(p, f"{w}r"), f"{w}t")
                            t.text = pairs[text]
                            t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                    data = ET.tostring(root, encoding="utf-8", xml_declaration=True)
                new.writestr(member, data)
    except (zipfile.BadZipFile, ET.ParseError, AttributeError):
        return None
    return out.getvalue()


def repair_graph(spark, path: str, stamp: str) -> str | None:
    """Where edges lost their source: a copy of the stored graph is kept, then the sound edges take the place of all; the copy's path. A sound graph is left alone."""
    from ..operators.inspect import integrity, repaired

    nodes, edges = load_graph(spark, path)
    if integrity(edges).first().verdict != "CORRUPTED":
        return None
    copy = back_up(spark, path, stamp)
    _, kept = load_graph(spark, copy)
    repaired(kept).write.mode("overwrite").parquet(f"{path}/edges")
    return copy
