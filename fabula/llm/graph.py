"""Connected components over an edge table: stars are folded first, then alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm.common import written


def _least(arcs: DataFrame) -> DataFrame:
    """Each arc (u, v) with m, the least of u and all its v. A minimum and a join, so that a hub's arcs may be split."""
    least = arcs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return arcs.join(least, "u")


def _settled(arcs: DataFrame, max_rounds: int) -> DataFrame:
    """(u, v) with v the least of u's component, for each u that isn't. arcs: written, u > v."""
    state = None
    for _ in range(max_rounds):
        both = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large)
        arcs = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        # a digest of the arcs: the same twice running means that nothing moves any more
        now = tuple(arcs.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))), F.countDistinct("u")).first())
        if now == state and now[0] == now[2]:
            return arcs
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that is not the least of its component; root is the least. edges: long columns u, v.

    Null ends and loops are ignored. Most nodes hang on a few hubs: a node that is never the lesser end of an edge is a leaf, and only
    joins its neighbours. Each node's least neighbour stands for it, its other neighbours are tied to that one, and leaves
    leave the graph until its remaining core has settled. Every round writes its arcs, so lost executors cost one round at most."""
    arcs = written(edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    least = written(arcs.groupBy("u").agg(F.min("v").alias("m")))
    ties = arcs.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    inner = least.join(arcs.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u", F.col("m").alias("v"))
    core = written(ties.unionByName(inner).distinct())
    settled = core if core.isEmpty() else _settled(core, max_rounds)
    up = settled.select(F.col("u").alias("m"), F.col("v").alias("root"))
    whole = least.join(up, "m", "left").select(F.col("u").alias("node"), F.coalesce("root", "m").alias("root"))
    return whole.unionByName(settled.select(F.col("u").alias("node"), F.col("v").alias("root"))).distinct()
