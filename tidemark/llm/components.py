"""Connected components of an edge list by alternating star contraction.

Every round points all larger neighbours of a node at its smallest neighbour (large star)
and then all smaller neighbours at the smallest of them (small star).  Minima are grouped
aggregates, which combine before the shuffle; no neighbour list is ever gathered, so a hub
with millions of neighbours is only a split join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    up = both.where(F.col("b") > F.col("a")).join(low, "a")
    return up.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of long ids to ``(node, root)``; root is the smallest reachable id.

    Nodes without an edge to another node don't appear.  Repeated edges, either direction
    and self loops are fine; null ends are ignored.
    """
    now = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    mark = _mark(now)
    while mark[0]:
        after = stored(_small_star(_large_star(now)))
        new = _mark(after)
        now = after
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
