"""Connected components by alternating star contractions, in joins and aggregates.

The neighbours of a hub are dealt to SALTS tasks. A hub is a node with more than
HUB and more than one in HUB of all edges, so there are at most 4 * HUB hubs, and
their list is small enough to be broadcast at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove

HUB, SALTS = 200, 64


def _star(edges: DataFrame, rows: int, large: bool) -> DataFrame:
    """large: a node hands its larger neighbours its least neighbour; small: its smaller ones and itself."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > max(HUB, rows // HUB)).select("a", F.lit(True).alias("hub")))
    spread = F.when(F.col("n") > max(HUB, rows // HUB), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = both.join(hubs, "a", "left").select("a", "b", F.when(F.col("hub"), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    joined = dealt.join(least.select("a", "m", F.explode(spread).alias("salt")), ["a", "salt"])
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _told(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether they are stars already: no node has two lower ones, or a lower and a higher one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    n, most = nodes.select(F.sum("down"), F.max(F.when(F.col("down") > 0, F.col("down") + F.col("up")))).first()
    return n or 0, (most or 0) <= 1


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs, in any direction, to (node, component): the least node that each reaches.

    Nodes without an edge to another are left out. Null ends are dropped. Each half
    of a round is written to the shared folder, so a lost executor costs no more, and the
    driver plans one star at a time; what was before it goes. Edges that are stars need
    no further round. The result is written there too.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "edges")
    while not (state := _told(edges))[1]:
        for large in (True, False):
            old, edges = edges, materialise(_star(edges, state[0], large), "edges")
            remove(old)
    found = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    found = materialise(found, "components")
    remove(edges)
    return found
