"""Sharding by vector bin packing: shards are balanced in bytes, tokens and rows jointly.

Equal texts form a group. Groups are summed before anything is placed; small ones are pooled by hash into `POOLS`
pools, so what is placed is bounded whatever the corpus: at most POOLS pools and, as each large group or part of one
weighs at least a POOLS-th of the corpus in bytes, tokens or rows, at most 3 * POOLS of those. A group above half a shard is dealt
into parts by a hash of its rows, whatever they hold. The bounded list of weights (three numbers each) is placed in numpy, largest first,
each where the dot product with the shard's residual capacity is highest, and moves and exchanges then even out what is left; rows find their shard by a broadcast of the
list. Slots are counted within each pool or lot (a POOLS-th of a large group) and shifted by the counts of those before it in the shard, so no
task holds a whole shard.

Law `bytes`: sizes near equal. Defined cases: a null text has no bytes, no tokens, crc32 null, and is a group of its own,
as is the empty text; repeated rows keep a slot each; null doc_ids are rows like others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm.common import text_key, words, written

POOLS = 4096
#: Pairs of pools whose exchange is weighed in one matrix.
PAIRS_AT_ONCE = 1_000_000
LAW = "bytes"


def _place(weights: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each weight vector: the highest dot product with the residual capacity among shards with room in
    the first dimension (bytes); where none has room, the shard with most of it left. Moves then even out all dimensions jointly."""
    unit = weights / np.maximum(weights.sum(axis=0), 1)  # shares of the whole, so that dimensions compare
    left = np.full((n_shards, weights.shape[1]), 1.0 / n_shards)
    out = np.empty(len(weights), dtype=np.int64)
    for i in np.lexsort((np.arange(len(weights)), -unit[:, 0])):
        room = left[:, 0] >= unit[i, 0]
        score = np.where(room, left @ unit[i], -np.inf) if room.any() else left[:, 0]
        out[i] = j = int(np.argmax(score))
        left[j] -= unit[i]
    return _evened(unit * [2.0, *[1.0] * (weights.shape[1] - 1)], out, n_shards)


def _evened(unit: np.ndarray, out: np.ndarray, n_shards: int) -> np.ndarray:
    """Placements after moves and exchanges, each of which lowers the sum of squared deviations from equal loads; the heaviest shards give first."""
    own = (unit * unit).sum(axis=1)
    load = np.stack([np.bincount(out, weights=unit[:, d], minlength=n_shards) for d in range(unit.shape[1])], axis=1) - unit.sum(axis=0) / n_shards
    for _ in range(2 * len(unit) + 50):
        for s in np.argsort(-(load * load).sum(axis=1), kind="stable"):
            mine = np.flatnonzero(out == s)
            # to move i from s to t changes the sum by 2 u_i (load_t - load_s) + 2 u_i u_i
            gain = 2 * (unit[mine] @ (load - load[s]).T + own[mine, None])
            gain[:, s] = 0
            best, i, t, back = 0.0, -1, -1, -1
            if len(mine) and gain.min() < -1e-15:
                i, t = np.unravel_index(int(gain.argmin()), gain.shape)
                best, i = float(gain[i, t]), int(mine[i])
            o = int(np.argmin(load @ load[s]))  # the shard that deviates most to the other side, to exchange with
            theirs = np.flatnonzero(out == o)
            step = max(1, PAIRS_AT_ONCE // max(1, len(theirs)))
            for at in range(0, len(mine) if o != s and len(theirs) else 0, step):
                some, d = mine[at : at + step], load[o] - load[s]
                swap = 2 * ((unit[some] @ d + own[some])[:, None] + (own[theirs] - unit[theirs] @ d)[None, :] - 2 * unit[some] @ unit[theirs].T)
                if swap.min() < min(best, -1e-15):
                    a, b = np.unravel_index(int(swap.argmin()), swap.shape)
                    best, i, t, back = float(swap[a, b]), int(some[a]), o, int(theirs[b])
            if best < 0:
                break
        else:
            return out
        for item, a, b in ((i, int(s), int(t)), (back, int(t), int(s))):
            if item >= 0:
                load[a] -= unit[item]
                load[b] += unit[item]
                out[item] = b
    return out


def shard(docs: DataFrame, n_shards: int = 24, pools: int = POOLS) -> DataFrame:
    """Each row's place: doc_id, size (bytes plus 8), n_tokens, text_crc32, shard, slot."""
    rows = written(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"),
        F.size(words(F.col("text"))).cast("long").alias("n_tokens"), F.crc32(F.encode("text", "utf-8")).alias("text_crc32"), text_key(F.col("text")).alias("key")))
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n"))
    total = rows.agg(F.sum("size"), F.sum("n_tokens"), F.count("*")).first()
    if not total[2]:
        return rows.select("doc_id", "size", "n_tokens", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = F.greatest(F.col("size") / total[0], F.col("n_tokens") / max(total[1] or 0, 1), F.col("n") / total[2])
    # parts are placed, each at most half a shard's share; lots are numbered, each about a POOLS-th. Both lists are bounded, as each large group has a POOLS-th of some total
    large = groups.withColumn("share", share).filter(F.col("share") * pools > 1).select(
        "key", F.ceil(F.col("share") * (2 * n_shards)).cast("int").alias("parts"), F.ceil(F.col("share") * pools).cast("int").alias("lots"))
    # a row that is itself repeated beyond a POOLS-th (and 1000 times) is dealt by where its copies stand, every other one by its doc_id
    again = rows.join(F.broadcast(large.select("key")), "key").groupBy("key", "doc_id").count().filter(F.col("count") > max(1000, total[2] // pools)).select("key", "doc_id").withColumn("again", F.lit(True))
    lot = F.pmod(F.xxhash64("doc_id", F.when(F.col("again"), F.col("row")).otherwise(0)), F.col("lots"))
    part = F.when(F.col("parts").isNull(), F.format_string("p%d", F.pmod(F.xxhash64("key"), F.lit(pools)))).otherwise(F.concat_ws("-", "key", (lot % F.col("parts")).cast("string")))
    placed = rows.join(F.broadcast(large), "key", "left").join(F.broadcast(again.withColumnRenamed("doc_id", "id").withColumnRenamed("key", "k")), (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id")), "left").withColumn("part", part).withColumn("lot", F.coalesce(lot, F.lit(0)).cast("int")).drop("parts", "lots", "row", "again", "k", "id")
    placed = written(placed)
    lots = placed.groupBy("part", "lot").agg(F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n")).orderBy("part", "lot").collect()
    parts: dict[str, int] = {}
    of_lot = np.array([parts.setdefault(r.part, len(parts)) for r in lots])
    sums = np.array([[r.size, r.n_tokens, r.n] for r in lots], dtype=float)
    weights = np.stack([np.bincount(of_lot, weights=sums[:, d]) for d in range(3)], axis=1)
    shards = _place(weights, n_shards)[of_lot]
    first = np.zeros(n_shards, dtype=np.int64)
    map_rows = []
    for r, s in zip(lots, shards.tolist(), strict=True):
        map_rows.append((r.part, r.lot, s, int(first[s])))
        first[s] += r.n
    where = docs.sparkSession.createDataFrame(map_rows, "part string, lot int, shard int, first long")
    in_lot = F.row_number().over(Window.partitionBy("part", "lot").orderBy("doc_id", "key"))
    return placed.withColumn("at", in_lot).join(F.broadcast(where), ["part", "lot"]).select(
        "doc_id", "size", "n_tokens", "text_crc32", "shard", (F.col("first") + F.col("at") - 1).alias("slot"))


def write(docs: DataFrame, path: str, n_shards: int = 24) -> None:
    """The documents with their places as Parquet folders, one for each shard, in order of slot within each file."""
    places = shard(docs, n_shards).select(F.col("doc_id").alias("__id"), "shard", "slot", F.col("text_crc32").alias("__crc"))
    numbered = docs.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", F.crc32(F.encode("text", "utf-8"))).orderBy(F.lit(0))))
    places = places.withColumn("__m", F.row_number().over(Window.partitionBy("__id", "__crc").orderBy("slot")))
    both = numbered.join(places, F.col("doc_id").eqNullSafe(F.col("__id")) & F.crc32(F.encode("text", "utf-8")).eqNullSafe(F.col("__crc")) & (F.col("__n") == F.col("__m")))
    both.drop("__id", "__crc", "__n", "__m").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot"), F.lit(None).cast("int").alias("grown_shard"))
