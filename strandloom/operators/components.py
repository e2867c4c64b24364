"""Connected components of an edge table, without bringing edges or nodes to the driver.

Large-star / small-star rewiring (Kiveris et al., "Connected Components in MapReduce and
Beyond", SoCC 2014): each round links every neighbour of a node to the smallest node known
there, so the graph turns into stars whose centres are the component minima.  Rounds grow
with log^2 of the node count, not with the diameter.  Each round ends in a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.runtime import Scratch


def _min_join(rows: DataFrame, best: DataFrame) -> DataFrame:
    """rows(a, b) with the minimum m of a.

    The second join key makes Spark shuffle both sides for the join itself, instead of
    reusing the aggregate's partitioning: then adaptive execution may split a hot node.
    """
    left = rows.withColumn("h", F.xxhash64("a"))
    right = best.withColumn("h", F.xxhash64("a"))
    return left.join(right, ["a", "h"]).select("a", "b", "m")


def _round(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    large = _min_join(both.filter("b > a"), best).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    best = large.groupBy("a").agg(F.min("b").alias("m"))
    small = _min_join(large, best).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(best.select("a", F.col("m").alias("b"))).distinct()


def _state(e: DataFrame):
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, src: str, dst: str, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """Table (node, component): each node of an edge with the smallest node it reaches.

    Edges with a null end and self-loops are left out (a node with only these has no row);
    repeated and reversed edges count once.  No edges give an empty table.
    """
    a, b = F.col(src), F.col(dst)
    e = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    e = scratch.save(e, "edges")
    seen = _state(e)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        nxt = scratch.save(_round(e), "stars")
        state = _state(nxt)
        scratch.drop(e)
        e = nxt
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select("component").distinct().select(F.col("component").alias("node"), "component"))
