"""Confirmed pairs as a stream: each micro-batch is added to a log once, and promoted when the graph is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import promote_pairs
from ..schemas import EDGES, NODES

PAIRS = "pos long, source string, target string, source_lang string, target_lang string"


class Learner:
    """A graph under a path: one base, and a log of the batches after it.

    A batch costs what it holds, not what the graph holds; one that is repeated replaces itself.
    compact() makes a new base of graph and log by one rename; what it covers is ignored from
    then on and removed.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _fs(self, spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        store, p = self._fs(spark, self.path)
        names = [x.getPath().getName() for x in store.listStatus(p)] if store.exists(p) else []
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(kind))

    def apply(self, pairs: DataFrame, batch_id: int) -> None:
        """pairs(pos, source, target, source_lang, target_lang); pos grows along the stream, over batches too."""
        pairs.write.mode("overwrite").parquet(f"{self.path}/log={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        filled = stream.where((F.trim("source") != "") & (F.trim("target") != ""))
        return filled.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).start()

    def graph(self, spark: SparkSession, batch_id: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges after a batch, the last one if none is named."""
        base = max((n for n in self._numbers(spark, "base=") if batch_id is None or n <= batch_id), default=-1)
        log = [n for n in self._numbers(spark, "log=") if n > base and (batch_id is None or n <= batch_id)]
        if base < 0:
            nodes, edges = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
        else:
            nodes, edges = (spark.read.parquet(f"{self.path}/base={base}/{k}") for k in ("nodes", "edges"))
        if not log:
            return nodes, edges
        return promote_pairs(nodes, edges, spark.read.schema(PAIRS).parquet(*[f"{self.path}/log={n}" for n in log]))

    def compact(self, spark: SparkSession) -> None:
        log = self._numbers(spark, "log=")
        if not log:
            return
        nodes, edges = self.graph(spark)
        fresh, attempt = f"{self.path}/base={log[-1]}", f"{self.path}/_attempt"
        nodes.write.mode("overwrite").parquet(f"{attempt}/nodes")
        edges.write.mode("overwrite").parquet(f"{attempt}/edges")
        store, p = self._fs(spark, attempt)
        if not store.rename(p, self._fs(spark, fresh)[1]):
            raise OSError(f"{fresh} can't be made")
        for kind, last in (("log=", log[-1] + 1), ("base=", log[-1])):
            for n in self._numbers(spark, kind):
                if n < last:
                    store.delete(self._fs(spark, f"{self.path}/{kind}{n}")[1], True)
