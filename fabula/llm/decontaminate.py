"""Benchmark decontamination by winnowing.

Documents and benchmark items are reduced to winnowed fingerprints: of every run of `WINDOW` consecutive k-grams the
rightmost k-gram with the least hash is kept. Two texts that share `SPAN` = k + WINDOW - 1 words share such a run, so
they keep the same k-gram of it: no shared span of SPAN words can be missed. Fingerprints are joined, and each hit is
extended left and right over the neighbouring words, which travel with the fingerprint; texts are never shuffled.
Items shorter than SPAN words have no such run; each of their lengths is a class of its own, whose single fingerprint
is the whole item.

The main path is DataFrame functions only. The fingerprints of the benchmark are counted before they are broadcast;
beyond `common.BROADCAST_ROWS` Spark joins by shuffle.

Defined cases: a null or empty text has no words and isn't contaminated; a null item text or one without words is no
item; items with a null item_id mark words but are not counted or named; repeated document rows each get their own,
equal result; repeated items count once; extra columns are ignored; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.llm.common import ALNUM_BREAKS, broadcast_if_small, let, words

SPAN = 13
K = 6
#: Positions and hashes share one long: the hash decides, then the larger position.
POS_BITS = 30
POS_MASK = (1 << POS_BITS) - 1
HASH_MASK = (1 << (63 - POS_BITS)) - 1


def _winnowed(h: Column, span: int, k: int) -> Column:
    """Fingerprints of texts with at least `span` words: array of (cls, pos, fp, left, right).

    left, right: the word hashes beside the k-gram, nearest first, null beyond the text. Elements are read by position:
    slices inside lambdas copy and box, and take several times as long."""
    window, side = span - k + 1, span - k

    def fingerprints(g: Column) -> Column:
        packed = F.transform(g, lambda x, i: F.shiftleft(x.bitwiseAND(F.lit(HASH_MASK)), POS_BITS) + (F.lit(POS_MASK) - i).cast("long"))
        kept = let(packed, lambda p: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(p) - window), lambda i: F.least(*[F.get(p, i + j) for j in range(window)]))))

        def fingerprint(v: Column) -> Column:
            pos = (F.lit(POS_MASK) - v.bitwiseAND(F.lit(POS_MASK))).cast("int")
            return F.struct(
                F.lit(span).alias("cls"), pos.alias("pos"), F.get(g, pos).alias("fp"),
                F.array(*[F.get(h, pos - j) for j in range(1, side + 1)]).alias("left"),
                F.array(*[F.get(h, pos + k + j) for j in range(side)]).alias("right"))

        return F.transform(kept, fingerprint)

    grams = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    return let(grams, fingerprints)


def _whole(h: Column, n: int) -> Column:
    """Every n-gram as a fingerprint, for items of exactly n words."""
    none = F.array().cast("array<bigint>")
    return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.struct(F.lit(n).alias("cls"), i.alias("pos"), F.xxhash64(*[F.get(h, i + j) for j in range(n)]).alias("fp"), none.alias("left"), none.alias("right")))


def _fingerprints(ws: Column, classes: list[int], span: int, k: int, item: bool) -> Column:
    empty = F.array().cast("array<struct<cls:int,pos:int,fp:bigint,left:array<bigint>,right:array<bigint>>>")

    def of(h: Column) -> Column:
        parts = []
        for n in classes:
            fits = F.size(h) == n if item and n < span else F.size(h) >= n
            parts.append(F.when(fits, _winnowed(h, span, k) if n == span else _whole(h, n)).otherwise(empty))
        return F.concat(*parts) if parts else empty

    return let(F.transform(ws, lambda w: F.xxhash64(w)), of)


def _run(a: Column, b: Column) -> Column:
    """How many words agree from the start of both contexts."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return let(same, lambda s: F.when(F.array_position(s, False) > 0, F.array_position(s, False).cast("int") - 1).otherwise(F.size(s)))


def hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """Shared spans: doc_id, text_hash, n_words, item_id, start, end (word positions, end exclusive).

    Every occurrence of `span` consecutive item words (or of a whole shorter item) lies in one of the spans."""
    items = benchmark.select("item_id", words(F.col("text"), ALNUM_BREAKS).alias("ws")).filter(F.size("ws") > 0)
    lengths = [r[0] for r in items.select(F.least(F.size("ws"), F.lit(span)).alias("n")).distinct().collect()]  # at most `span` values
    classes = sorted(lengths)
    item_fps = items.select("item_id", F.explode(_fingerprints(F.col("ws"), classes, span, k, True)).alias("f")).select(
        "item_id", F.col("f.cls").alias("cls"), F.col("f.fp").alias("fp"), F.col("f.left").alias("i_left"), F.col("f.right").alias("i_right"))
    item_fps = broadcast_if_small(item_fps.distinct())
    doc_fps = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text"), ALNUM_BREAKS).alias("ws"))
    doc_fps = doc_fps.select("doc_id", "text_hash", F.size("ws").cast("long").alias("n_words"), F.explode(_fingerprints(F.col("ws"), classes, span, k, False)).alias("f"))
    doc_fps = doc_fps.select("doc_id", "text_hash", "n_words", F.col("f.cls").alias("cls"), F.col("f.fp").alias("fp"), F.col("f.pos").alias("pos"), F.col("f.left").alias("d_left"), F.col("f.right").alias("d_right"))
    size = F.when(F.col("cls") == span, F.lit(k)).otherwise(F.col("cls"))
    return (
        doc_fps.join(item_fps, ["cls", "fp"])
        .select("doc_id", "text_hash", "n_words", "item_id", "cls", "pos", size.alias("size"), _run(F.col("d_left"), F.col("i_left")).alias("l"), _run(F.col("d_right"), F.col("i_right")).alias("r"))
        .filter(F.col("l") + F.col("size") + F.col("r") >= F.col("cls"))
        .select("doc_id", "text_hash", "n_words", "item_id", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("size") + F.col("r")).alias("end"))
    )


def _covered(spans: Column) -> Column:
    """Words in the union of (start, end) spans."""
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("total"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["reach"], s["end"]).alias("reach"),
        (acc["total"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["reach"], s["start"]))).alias("total"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["total"])


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """A row for each document (doc_id, text_hash) with a hit: n_words, n_hit, item_ids, spans, contaminated."""
    found = hits(docs, benchmark, span, k).groupBy("doc_id", "text_hash").agg(
        F.first("n_words").alias("n_words"),
        F.collect_set(F.struct("start", "end")).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    found = found.withColumn("n_hit", _covered(F.col("spans")))
    return found.withColumn("contaminated", F.col("n_hit") * 20 >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, item_ids, contaminated."""
    found = contamination(docs, benchmark, span, k).select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "n_hit", "item_ids", "contaminated")
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"), ALNUM_BREAKS)).cast("long").alias("n_words"))
    return own.join(found, own.doc_id.eqNullSafe(found.f_id) & (own.text_hash == found.f_hash), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    bad = contamination(docs, benchmark, span, k).filter("contaminated").select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad_id")) & (F.xxhash64("text") == F.col("__bad_hash")), "left_anti")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The report with its item ids as one hash."""
    return report(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n)),
hit AS (SELECT dw.rid, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
