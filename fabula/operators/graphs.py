"""Graphs in tables of edges: components, leaders and their clusters, in rounds of joins that never gather a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.sources.shared import written


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, and with overwhelming odds for no others."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of edges (a, b); nodes are numbers or strings. Loops make a node known; nulls are left out.

    Large and small stars in turn: every node points its larger neighbours, then its smaller ones, to the least node it knows. A node with very many
    neighbours is a minimum and a join, no list; minima are written, so that the join reads plain rows and splits such a node."""
    known = edges.filter("a is not null and b is not null")
    nodes = known.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = written(known.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while (now := _state(e)) != state:
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        to = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(to, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(to.select("u", F.col("m").alias("v"))).distinct())
    found = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(found, nodes["node"] == found["u"], "left").select("node", F.coalesce("component", "node").alias("component"))


def leaders(edges: DataFrame) -> DataFrame:
    """node, leader of every node of edges (a, b), as one pass over the nodes in order would have it: a node that no earlier leader has taken leads, and takes its later neighbours that are free.

    A node is settled once all its smaller neighbours are: as a follower if one of them leads, of the least that does, else as a leader. Each round settles the least
    nodes left and all that depend on settled ones only."""
    known = edges.filter("a is not null and b is not null")
    down = written(known.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("smaller")).distinct())
    left = written(known.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    settled = None
    while not left.isEmpty():
        if settled is None:
            free = left.join(down.select("node").distinct(), "node", "left_anti")
            now = free.select("node", F.col("node").alias("leader"))
        else:
            s = settled.select(F.col("node").alias("smaller"), (F.col("leader") == F.col("node")).alias("leads"))
            seen = left.join(down, "node").join(s, "smaller", "left")
            g = seen.groupBy("node").agg(F.count_if(F.col("leads").isNull()).alias("open"), F.min(F.when(F.col("leads"), F.col("smaller"))).alias("first"), F.min(F.when(F.col("leads").isNull(), F.col("smaller"))).alias("first_open"))
            # a leader before all that is open decides, too
            ready = (F.col("open") == 0) | (F.col("first") < F.col("first_open"))
            now = g.filter(ready).select("node", F.coalesce("first", "node").alias("leader"))
        now = written(now)
        settled = now if settled is None else settled.unionByName(now)
        left = written(left.join(now.select("node"), "node", "left_anti"))
    return left.select("node", F.col("node").alias("leader")) if settled is None else settled
