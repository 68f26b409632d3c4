"""Connected components of a staged edge table by large-star and small-star rounds.

After Kiveris et al. (2014): every round hooks the neighbours of a node to the
least node around it, first the larger neighbours, then the smaller ones, until
all edges are stars around the least node of their component.  Nodes with many
neighbours, HEAVY at most, are joined by broadcast, so no task holds a star.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stage

HEAVY = 10_000  # nodes of this many that may be broadcast
MANY = 256  # neighbours of such a node at least


def _hooked(rows: DataFrame, least: DataFrame, many: int) -> DataFrame:
    """``rows`` (u, v) with the column m of ``least`` (u, m, n) for their u.

    As the n of all nodes add up to the rows, at most HEAVY nodes have n > ``many``.
    """
    heavy = F.broadcast(least.filter(F.col("n") > many).select("u", "m"))
    light = rows.join(heavy.select("u"), "u", "left_anti").join(least.filter(F.col("n") <= many).select("u", "m"), "u")
    return light.unionByName(rows.join(heavy, "u"))


def components(stage: Stage, edges: DataFrame) -> DataFrame:
    """(node, label) of every node on an edge (a, b); the label is the least node reachable."""
    e = stage.cut(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        many = max(MANY, 2 * (mark[0] if mark else e.count()) // HEAVY)
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _hooked(both, least, many).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage.cut(large, "hooked")
        pairs = _hooked(large, large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), many)
        small = pairs.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(pairs.select("u", F.col("m").alias("v")))
        new = stage.cut(small.filter("u != v").distinct(), "stars")
        now = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        stage.drop(e, large)
        e = new
        if now == mark or not now[0]:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v"), F.col("v")).distinct())
