"""Connected components by alternating large-star and small-star rounds, for edges that fit no driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearplane.llm._common import stored

MAX_ROUNDS = 60
SMALL = 200_000  # edges up to which the least neighbours of all nodes are broadcast


def _with_least(e: DataFrame, edges: int) -> DataFrame:
    """e (a, b) with m, the least b of each a."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    # as a table of its own the minima meet the edges in a join that Spark can split where a node is a hub
    return e.join(F.broadcast(least) if edges <= SMALL else stored(least, "least"), "a")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Each round hangs neighbours on smaller neighbours, first larger ones, then smaller ones, until
    every edge leads to a root. A round is two joins that bring a node's minimum back to its edges instead of
    gathering neighbour lists: minima of few edges are broadcast, those of many are a table, and Spark's adaptive
    skew join splits a hub's edges. Rounds are logarithmic in practice. Self-loops keep isolated nodes. The
    table of each round is written to the shared folder.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    loops = e.where("a = b").select(F.col("a").alias("node"))
    e = stored(e.where("a <> b"), "edges")
    last, size = None, e.count()
    for _ in range(MAX_ROUNDS):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, size).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
        small = _with_least(large, size).select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("p")).select(F.col("p.x").alias("a"), F.col("p.y").alias("b")).where("a <> b").distinct()
        e = stored(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.countDistinct("a")).first()
        if now == last or now[0] == now[2] and not e.join(e.select(F.col("a").alias("b")), "b", "left_semi").head(1):
            break
        last, size = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    hung = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    known = hung.union(roots)
    return known.union(loops.distinct().join(known, "node", "left_anti").select("node", F.col("node").alias("root")))
