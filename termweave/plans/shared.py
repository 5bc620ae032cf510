"""The folder that driver and executors share, and tables written there once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_STORED: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only in local mode, where one machine is all there is."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="termweave-shared-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/termweave/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def remove(*tables: DataFrame) -> None:
    """Deletes what materialise() wrote for these; only when nothing that is still to run reads them."""
    for df in tables:
        spark, p = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """build() written once for each application and source folder, and read from there on."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path, df = shared_path(spark, name), build()
        df.write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])
