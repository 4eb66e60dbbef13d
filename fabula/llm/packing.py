"""Best-fit packing of documents into training sequences under conflicts.

A document is cut into pieces of at most `capacity` tokens (white-space words and one end token); pieces go, longest first, to the
tightest bin that has room and no conflict. Bins are ordered by residual; each carries a bitmap of the sources and
one of the duplicate clusters in it. The search starts at the first residual that fits and goes on to its successors
until a bin shares neither the source nor the cluster; only then is a new bin opened. Pieces of one document never share
a bin either, as they share its cluster.

A source with more pieces than there are mean bins would leave bins half empty, so it is dealt by hash into as many
sub-sources as its share of a mean bin asks for, and a bin takes one piece of each sub-source. All others stand at most once in a
bin. Duplicate clusters are near-duplicate groups where `clusters` gives them (op9_packing passes those of `neardup.groups` on
five-word shingles), else exact copies of a text: the pipeline packs what near-duplicate removal has left, one text of each group.

Pieces are dealt by hash into groups of about `GROUP` and each group is packed on its own in one task: groups don't grow with the
corpus, copies of a text spread over all groups, and at most the last bins of a group stay open. Only counts reach
the driver.

Defined cases: a null or empty text is one piece of the end token; a null source conflicts with nothing; a null
doc_id is packed like others, by its text's cluster; ties in size go by cluster, doc_id and piece, ties in residual to the older bin; a very long text is cut into more pieces; repeated rows are packed each, and as one cluster never share a bin; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm.common import text_key, words, written

CAPACITY = 2048
GROUP = 4096


def best_fit(sizes: list[int], sources: list[int | None], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each piece and where in it the piece starts. Sources and clusters are bit numbers."""
    residuals: list[tuple[int, int]] = []  # (residual, bin), ordered
    of_source: list[int] = []
    of_cluster: list[int] = []
    bins, starts = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        source = 0 if sources[i] is None else 1 << sources[i]
        cluster = 1 << clusters[i]
        at = bisect_left(residuals, (size, -1))
        while at < len(residuals) and (of_source[residuals[at][1]] & source or of_cluster[residuals[at][1]] & cluster):
            at += 1
        if at < len(residuals):
            left, b = residuals.pop(at)
        else:
            left, b = capacity, len(of_source)
            of_source.append(0)
            of_cluster.append(0)
        of_source[b] |= source
        of_cluster[b] |= cluster
        bins[i], starts[i] = b, capacity - left
        if left > size:
            insort(residuals, (left - size, b))
    return bins, starts


def _numbers(values: list) -> list[int | None]:
    """Values as small numbers in order of first sight; null stays null."""
    seen: dict = {}
    return [None if v is None else seen.setdefault(v, len(seen)) for v in values]


def pieces(docs: DataFrame, capacity: int, clusters: DataFrame | None = None) -> DataFrame:
    """doc_id, source, cluster, piece, first_token, n_tokens: the pieces of every document."""
    n = F.size(words(F.col("text"))) + 1
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), text_key(F.col("text")).alias("cluster"), n.alias("n"))
    if clusters is not None:
        named = clusters.filter("n_shingles > 0 and component_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component"))
        rows = rows.join(named, "doc_id", "left").withColumn("cluster", F.coalesce(F.concat(F.lit("g"), F.col("component").cast("string")), "cluster")).drop("component")
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))))
    first = F.col("piece") * capacity
    return cut.select("doc_id", "source", "cluster", "piece", first.alias("first_token"), F.least(F.lit(capacity), F.col("n") - first).alias("n_tokens"))


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, clusters: DataFrame | None = None) -> DataFrame:
    """A row for each piece: bin_id, start (its place in the bin), doc_id, piece, first_token, n_tokens, source, cluster.

    clusters: doc_id, n_shingles, component_id of near-duplicate groups, if they are to count as clusters."""
    cut = written(pieces(docs, capacity, clusters))
    total, tokens = cut.agg(F.count("*"), F.sum("n_tokens")).first()
    groups = max(1, -(-total // group))
    per_bin = capacity * total / max(tokens or 0, 1)
    # more pieces than there are mean bins: of such sources there are at most per_bin, the pieces of a mean bin, whatever the table
    counts = cut.groupBy("source").agg(F.count("*").alias("n")).filter(F.col("source").isNotNull() & (F.col("n") * per_bin > total)).collect() if total else []
    hot = [(r.source, int(np.ceil(r.n / total * per_bin))) for r in counts]
    subs = F.lit(1)
    for source, n in hot:
        subs = F.when(F.col("source") == source, n).otherwise(subs)
    spread = cut.withColumn("sub", F.pmod(F.xxhash64("doc_id", "piece"), subs)).withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "cluster", F.lit(7)), F.lit(groups)))

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("cluster", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sources = [None if s is None else (s, n) for s, n in zip(t.column("source").to_pylist(), t.column("sub").to_pylist(), strict=True)]
        bins, starts = best_fit(t.column("n_tokens").to_pylist(), _numbers(sources), _numbers(t.column("cluster").to_pylist()), capacity)
        ids = np.array(bins, dtype=np.int64) * groups + t.column("group").to_numpy()
        return pa.table({
            "bin_id": ids, "start": pa.array(starts, pa.int32()),
            **{c: t.column(c) for c in ("doc_id", "piece", "first_token", "n_tokens", "source", "cluster")}})

    return spread.groupBy("group").applyInArrow(fill, "bin_id long, start int, doc_id long, piece int, first_token int, n_tokens int, source string, cluster string")
