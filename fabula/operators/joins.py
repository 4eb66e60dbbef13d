"""Join shapes that Spark has no operator for: bands, nearest rows and as-of. Built of equi-joins on blocks and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What a side may weigh, in rows and in bytes of its text columns, to be broadcast after it was measured.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it was measured to be small, else with one for a merge: Spark splits skewed keys then, and broadcasts neither this side nor the other by the size of its files."""
    strings = [F.octet_length(c) for c, t in df.dtypes if t == "string"]
    size = sum((F.coalesce(n, F.lit(0)) for n in strings), F.lit(0))
    m = df.select(size.alias("b")).limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return F.broadcast(df) if m.n <= BROADCAST_ROWS and (m.b or 0) <= BROADCAST_BYTES else by_merge(df)


def by_merge(df: DataFrame) -> DataFrame:
    """df with the hint that joins to it sort and merge. For written rows: Spark takes the size of their compressed files for the size of the rows and would send millions of rows through the driver."""
    return df.hint("merge")


def parts_for(df: DataFrame, rows: int) -> int:
    """How many parts a shuffle of df's rows needs so that one holds about `rows`: more rows are more tasks, not larger ones. Not fewer than Spark's own, as it would deal the rows again."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, width: int, how: Column | None = None, parts: int | None = None, ahead: bool = False) -> DataFrame:
    """Pairs of rows with equal keys and |left.at - right.other| <= width, by blocks of width + 1.

    left goes to its block and both neighbours, so each pair meets once, in right's block; a key's rows are spread
    over its blocks, which splits hot keys. Column names of the two sides must differ, but for the keys. parts: into how many parts blocks are dealt, else as Spark has it.
    ahead: only pairs with left.at <= right.other, which need no block before."""
    size = width + 1
    near = left.withColumn("__block", F.explode(F.transform(F.array(*map(F.lit, (0, 1) if ahead else (-1, 0, 1))), lambda d: F.floor(F.col(at) / size) + d)))
    far = right.withColumn("__block", F.floor(F.col(other) / size))
    if parts:
        near, far = (side.repartition(parts, *keys, "__block") for side in (near, far))
    within = F.col(other).between(F.col(at), F.col(at) + width) if ahead else F.abs(F.col(at) - F.col(other)) <= width
    return near.join(far, [*keys, "__block"]).filter(within if how is None else within & how).drop("__block")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], row: list[str], at: str, other: str, width: int, tie: str) -> DataFrame:
    """For each row of left the nearest row of right within width; ties go to the least `tie`."""
    pairs = band_join(left, right, keys, at, other, width)
    best = F.min(F.struct(F.abs(F.col(at) - F.col(other)).alias("distance"), F.col(tie).alias("found")))
    return pairs.groupBy(*row).agg(best.alias("best")).select(*row, F.col("best.found").alias(tie), F.col("best.distance").alias("distance"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """left with the value of the last row of right at or before it in order, per key; null if there is none.

    Both sides are stacked and one running window carries the value: a sort instead of a product of pairs."""
    stacked = left.withColumn("__side", F.lit(1)).withColumn(value, F.lit(None).cast(dict(right.dtypes)[value])).unionByName(right.select(*keys, *order, value).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    running = Window.partitionBy(*keys).orderBy(*order, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return stacked.withColumn(value, F.last(value, ignorenulls=True).over(running)).filter("__side = 1").drop("__side")
