"""Clusters of entities: by likeness of names, and by how they interact."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fabula.functions import text as T
from fabula.operators.graphs import leaders
from fabula.sources.shared import written

# The weights and threshold of likeness, and where a tree is cut. Results depend on them.
BLOCKS_WEIGHT, GRAMS_WEIGHT, LIKE, CUT = 0.6, 0.4, 0.45, 0.7
_HONORIFICS = ("don", "doña", "dona", "señor", "señora", "senor", "senora", "sr", "sra", "dr", "dra", "doctor", "doctora")


def comparable(name):
    """A name without accents, case, marks and honorifics."""
    words = F.split(F.trim(F.regexp_replace(T.normalize_name(name), r"[^\p{L}\p{N} ]", " ")), r"\s+")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*_HONORIFICS) & (w != "")), " ")


def blocks_ratio(a: str, b: str) -> float:
    """Likeness by matching blocks: 1 for equal names; if all words of one are words of the other, .75 and more the less is missing; else twice the matched characters over all."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = set(a.split()), set(b.split())
    short, long = sorted((len(a), len(b)))
    if (x <= y or y <= x) and short >= 3:
        return 0.75 + short / long * 0.2
    return SequenceMatcher(None, a, b).ratio()


def like_names(names: DataFrame) -> DataFrame:
    """a, b, score of the pairs of names (scope, id, name) whose likeness reaches LIKE: a is the smaller id.

    Names are compared that lie in one scope (a story's cast) and share a trigram; a scope's names are few, whatever the number of scopes."""
    plain = T.normalize_name(F.col("name"))
    grams = F.when(F.length(plain) < 3, F.array(plain)).otherwise(T.char_ngrams(plain, 3))
    n = written(names.select("scope", "id", comparable(F.col("name")).alias("form"), grams.alias("grams")).filter("form <> ''"))
    keys = n.select("scope", "id", F.explode("grams").alias("gram"))
    pairs = keys.withColumnRenamed("id", "a").join(keys.withColumnRenamed("id", "b"), ["scope", "gram"]).filter("a < b").select("scope", "a", "b").distinct()
    f, g = n.select("scope", F.col("id").alias("a"), F.col("form").alias("fa"), F.col("grams").alias("ga")), n.select("scope", F.col("id").alias("b"), F.col("form").alias("fb"), F.col("grams").alias("gb"))
    both = pairs.join(f, ["scope", "a"]).join(g, ["scope", "b"]).select("scope", "a", "b", "fa", "fb", T.jaccard(F.col("ga"), F.col("gb")).alias("grams"))

    @F.pandas_udf(DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([blocks_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    scored = both.withColumn("score", BLOCKS_WEIGHT * ratio("fa", "fb") + GRAMS_WEIGHT * F.col("grams"))
    return scored.filter(F.col("score") >= LIKE).select("scope", "a", "b", "score")


def name_clusters(entities: DataFrame) -> DataFrame:
    """scope, id, cluster (its first id) of the entities (scope, id, name) that share a cluster with another.

    Names of the same words in any order are one cluster. Of the others each in turn takes the later ones like it that no earlier one has taken. ids are unique over all scopes."""
    e = entities.select("scope", "id", "name", F.array_join(F.array_sort(F.split(comparable(F.col("name")), " ")), " ").alias("print")).filter("print <> ''")
    same = e.groupBy("scope", "print").agg(F.count("*").alias("n"), F.min("id").alias("cluster"))
    marked = written(e.join(same, ["scope", "print"]))
    alike = like_names(marked.filter("n = 1").select("scope", "id", "name"))
    led = leaders(alike.select("a", "b")).select(F.col("node").alias("id"), F.col("leader").alias("cluster"))
    groups = led.join(led.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster"), "cluster")
    loose = marked.select("scope", "id").join(groups, "id").select("scope", "id", "cluster")
    return marked.filter("n > 1").select("scope", "id", "cluster").unionByName(loose)


def pairs_within(clusters: DataFrame) -> DataFrame:
    """scope, cluster, a, b: the pairs worth a closer look, those inside a cluster. As many as clusters are large: meant for casts, whose names are few of a kind."""
    a, b = clusters.select("scope", "cluster", F.col("id").alias("a")), clusters.select("scope", "cluster", F.col("id").alias("b"))
    return a.join(b, ["scope", "cluster"]).filter("a < b")


def ward(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Ward's tree over a matrix of distances, by chains of nearest neighbours: the merged clusters' first members and the height of each merge, lowest first."""
    n = len(distance)
    d2, size, active = distance.astype(float) ** 2, np.ones(n), np.ones(n, bool)
    np.fill_diagonal(d2, np.inf)
    merges, chain = [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(active)[0])]
        while True:
            i = chain[-1]
            row = np.where(active, d2[i], np.inf)
            row[i] = np.inf
            j = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                j = chain[-2]
                break
            chain.append(j)
        i = chain.pop()
        chain.pop()
        a, b = min(i, j), max(i, j)
        merges.append((a, b, float(np.sqrt(d2[a, b]))))
        k = active.copy()
        k[[a, b]] = False
        d2[a, k] = ((size[a] + size[k]) * d2[a, k] + (size[b] + size[k]) * d2[b, k] - size[k] * d2[a, b]) / (size[a] + size[b] + size[k])
        d2[k, a] = d2[a, k]
        size[a] += size[b]
        active[b] = False
    return sorted(merges, key=lambda m: m[2])


def cut_tree(n: int, merges: list[tuple[int, int, float]], share: float = CUT) -> list[int]:
    """The cluster of each of n members, by its first member: merges up to share of the greatest height hold."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    top = max((h for *_, h in merges), default=0.0)
    for a, b, h in merges:
        if h <= share * top:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(n)]


def relationship_clusters(strengths: DataFrame) -> DataFrame:
    """story, entity_id, cluster (its first entity) from strengths (story, a, b, strength) of pairs; a pair may have several rows, in either order.

    Distance is 1 - strength over the story's greatest one. A story's cast is one small group: stories are dealt over tasks, a cast is never large."""
    pairs = strengths.select("story", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "strength").groupBy("story", "a", "b").agg(F.sum("strength").cast("double").alias("strength"))
    schema = pa.schema([("story", pa.int64()), ("entity_id", pa.int64()), ("cluster", pa.int64())])

    def group(t: pa.Table) -> pa.Table:
        a, b, s = (t[c].to_pylist() for c in ("a", "b", "strength"))
        cast = sorted({*a, *b})
        at = {x: i for i, x in enumerate(cast)}
        m = np.zeros((len(cast), len(cast)))
        for x, y, v in zip(a, b, s, strict=True):
            m[at[x], at[y]] = m[at[y], at[x]] = v
        d = 1 - m / (m.max() if m.max() > 0 else 1.0)
        np.fill_diagonal(d, 0)
        roots = cut_tree(len(cast), ward(d))
        return pa.Table.from_arrays([pa.array([t["story"][0].as_py()] * len(cast), pa.int64()), pa.array(cast, pa.int64()), pa.array([cast[r] for r in roots], pa.int64())], schema=schema)

    return pairs.filter("a <> b").groupBy("story").applyInArrow(group, "story long, entity_id long, cluster long")
