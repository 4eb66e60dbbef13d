"""Approximate nearest neighbours by collision counting (query-aware hashing).

`PROJECTIONS` Gaussian projections of a block of vectors are each kept as one sorted array. A query opens a window
around its own value in every array; virtual rehashing widens the windows step by step with the search radius. A
vector met in at least `threshold` windows is verified by its exact inner product. The search ends once the k-th best
verified vector lies within the radius that the windows stand for; if it never does, the windows end up holding everything,
so that the answer is complete. Largest inner product is made nearest distance by one more dimension.

Data are dealt into blocks by hash; a block's index is built once, in one task, and the queries stream past it, so no vector is copied from block to block and memory is bounded by a
block. The best k of each block are merged. Nothing is collected. Every vector is indexed. Every query meets every block: work grows with vectors times queries.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
with a null vec_id; of repeated vec_ids the least vector counts; vectors are compared with those of equal length only; with
fewer than k candidates all are returned; ties go to the smaller vec_id; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm.common import written

PROJECTIONS = 64
#: Half the window's width, in radii: a vector at the radius is met with odds P(|N(0,1)| < HALF) in each array.
HALF = 1.0
#: How many deviations below its expected meetings a vector at the radius may fall and still be verified.
SLACK = 1.3
FIRST_RADIUS, WIDEN = 0.5, 1.15
DATA_BLOCK = 16_384


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def threshold(m: int = PROJECTIONS) -> int:
    p = math.erf(HALF / math.sqrt(2))
    return max(1, math.floor(m * p - SLACK * math.sqrt(m * p * (1 - p))))


class Index:
    """The sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = PROJECTIONS) -> None:
        self.ids, self.vectors = ids, vectors
        norms = (vectors * vectors).sum(axis=1)
        self.scale = math.sqrt(norms.max())
        unit = np.hstack([vectors / self.scale, np.sqrt(np.maximum(0, 1 - norms / self.scale**2))[:, None]])
        self.directions = np.random.default_rng(unit.shape[1]).standard_normal((unit.shape[1], m))
        values = (unit @ self.directions).T
        order = np.argsort(values, axis=1, kind="stable")
        # the sorted arrays stand behind each other, each lifted above the one before, so that one search serves all
        self.lift = np.arange(m) * (4 * np.abs(values).max(initial=1.0) + 64)
        self.values = (np.take_along_axis(values, order, axis=1) + self.lift[:, None]).ravel()
        self.order = order.ravel()

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and inner products of the k nearest found, nearest first."""
        n, m = len(self.ids), len(self.lift)
        least = threshold(m)
        norm = math.sqrt(float(q @ q))
        at = np.append(q / norm, 0.0) @ self.directions + self.lift
        met = np.zeros(n, dtype=np.int64)
        left = right = np.searchsorted(self.values, at)
        first = np.arange(m) * n
        products = np.full(n, -np.inf)
        others = self.ids != own
        radius, wanted = FIRST_RADIUS, min(k, int(others.sum()))
        while True:
            ends = np.searchsorted(self.values, np.concatenate([at - HALF * radius, at + HALF * radius]))
            lo, hi = np.maximum(ends[:m], first), np.minimum(ends[m:], first + n)
            new = [self.order[a:b] for a, b in zip(lo.tolist(), left.tolist(), strict=True)] + [self.order[a:b] for a, b in zip(right.tolist(), hi.tolist(), strict=True)]
            met += np.bincount(np.concatenate(new), minlength=n)
            left, right = lo, hi
            fresh = np.flatnonzero((met >= least) & (products == -np.inf) & others)
            products[fresh] = (self.vectors @ q)[fresh] if 4 * len(fresh) > n else self.vectors[fresh] @ q
            found = int((products > -np.inf).sum())
            if found >= wanted:
                # distance of the k-th best on the unit sphere of the extra dimension
                kth = np.partition(products, n - wanted)[n - wanted] if wanted else 0.0
                if not wanted or math.sqrt(max(0.0, 2 - 2 * kth / (norm * self.scale))) <= radius or lo[0] == 0 and bool((hi - lo == n).all()):
                    break
            radius *= WIDEN
        if not wanted:
            return self.ids[:0], products[:0]
        close = np.flatnonzero(products >= kth - 1e-9 * (1 + abs(kth)))
        exact = (self.vectors[close] * q).sum(axis=1)  # equal vectors get equal sums, wherever they stand
        best = np.lexsort((self.ids[close], -exact))[:wanted]
        return self.ids[close][best], exact[best]


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of `vectors` (vec_id, embedding) for each row of `queries`."""

    def tidy(df: DataFrame) -> DataFrame:
        return df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))

    data, asked = written(tidy(vectors)), written(tidy(queries))
    blocks = max(1, math.ceil(data.count() / DATA_BLOCK))
    # with fewer blocks than cores, queries are dealt into lots, each with its own copy of the blocks
    lots = max(1, vectors.sparkSession.sparkContext.defaultParallelism // blocks)
    dim = F.size("embedding").alias("dim")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = data.select(dim, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), spread(lots).alias("lot"), F.lit(False).alias("asks"), "vec_id", "embedding").unionByName(
        asked.select(dim, spread(blocks).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(lots)).cast("int").alias("lot"), F.lit(True).alias("asks"), "vec_id", "embedding"))

    def answer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come one after the other, first a block's vectors, then its queries, which stream past its index."""
        now, ids, rows, index = None, [], [], None
        for b in it:
            key = list(zip(*(b.column(c).to_pylist() for c in ("dim", "block", "lot", "asks")), strict=True))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for lo, hi in pairwise(cuts):
                if lo == hi:
                    continue
                part, (*where, asks) = b.slice(lo, hi - lo), key[lo]
                if where != now:
                    now, ids, rows, index = where, [], [], None
                if not asks:
                    ids.append(part.column("vec_id").to_numpy())
                    rows.append(_matrix(part.column("embedding")))
                    continue
                if index is None and ids:
                    index = Index(np.concatenate(ids), np.concatenate(rows))
                    ids, rows = [], []
                if index is None:
                    continue
                found = [(own, *index.search(int(own), q, k)) for own, q in zip(part.column("vec_id").to_numpy(), _matrix(part.column("embedding")), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([np.full(len(got), own) for own, got, _ in found]), pa.int64()), pa.array(np.concatenate([got for _, got, _ in found]), pa.int64()),
                    pa.array(np.concatenate([products for *_, products in found]), pa.float64())], names=["query_id", "vec_id", "score"])

    dealt = sides.repartition("dim", "block", "lot").sortWithinPartitions("dim", "block", "lot", "asks")
    found = dealt.mapInArrow(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, embeddings.filter("vec_id % 20 = 0"))
