"""Voice operators over dialogue rows (conv_id, turn, role, text): profiles, deviations, patterns, mentions, tone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import lexicons as L
from fabula.functions import text as T


def _words(lines: DataFrame, *keys: str) -> DataFrame:
    return lines.select(*keys, F.explode(T.word_list(F.lower("text"))).alias("word"))


def profiles(lines: DataFrame) -> DataFrame:
    """Per speaker: lines, words, mean and sample deviation of line length (0 for one line), distinct words, words used once."""
    n = F.size(T.word_list(F.col("text"))).cast("long")
    sizes = lines.select("role", n.alias("n")).groupBy("role").agg(
        F.count("*").alias("n_lines"), F.sum("n").alias("n_words"), F.round(F.avg("n"), 6).alias("mean_words"), F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 6).alias("std_words"), F.min("n").alias("min_words"), F.max("n").alias("max_words"))
    once = _words(lines, "role").groupBy("role", "word").count().groupBy("role").agg(F.count("*").alias("n_distinct"), F.count_if(F.col("count") == 1).alias("n_once"))
    joined = sizes.join(once, "role", "left").fillna(0, ["n_distinct", "n_once"])
    return joined.withColumn("type_token_ratio", F.when(F.col("n_words") > 0, F.round(F.col("n_distinct") / F.col("n_words"), 6)).otherwise(0.0))


def characteristic_words(lines: DataFrame, top: int = 20) -> DataFrame:
    """Words of a speaker by tf over (overall frequency + 0.001), above 1, used twice at least; the first 20."""
    counts = _words(lines, "role").groupBy("role", "word").agg(F.count("*").alias("n"))
    counts = counts.join(counts.groupBy("role").agg(F.sum("n").alias("of_role")), "role").join(counts.groupBy("word").agg(F.sum("n").alias("of_word")), "word")
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    score = (F.col("n") / F.col("of_role")) * (1 / (F.col("of_word") / F.col("total") + 0.001))
    scored = counts.join(total, F.lit(True)).withColumn("score", F.round(score, 6)).filter((F.col("score") > 1) & (F.col("n") >= 2))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("score"), "word"))).filter(F.col("rank") <= top).select("role", "word", "n", "score", "rank")


def speech_patterns(lines: DataFrame, top: int = 5) -> DataFrame:
    """Each speaker's most common two-word starts and pairs of neighbouring words."""
    ws = T.word_list(F.lower("text"))
    rows = lines.select("role", ws.alias("ws")).filter(F.size("ws") >= 2)
    starts = rows.select("role", F.lit("start").alias("kind"), F.concat_ws(" ", F.get("ws", F.lit(0)), F.get("ws", F.lit(1))).alias("pattern"))
    pairs = rows.select("role", F.lit("pair").alias("kind"), F.explode(F.zip_with(F.slice("ws", F.lit(1), F.size("ws") - 1), F.slice("ws", F.lit(2), F.size("ws") - 1), lambda a, b: F.concat_ws(" ", a, b))).alias("pattern"))
    counts = starts.unionByName(pairs).groupBy("role", "kind", "pattern").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("role", "kind").orderBy(F.desc("n"), "pattern"))).filter(F.col("rank") <= top)


def deviations(lines: DataFrame, flag: float = 2.0) -> DataFrame:
    """Lines whose length lies more than 2 sample deviations from the speaker's mean; above 3 medium, above 4 high."""
    n = F.size(T.word_list(F.col("text"))).cast("long")
    sizes = lines.select("conv_id", "turn", "role", n.alias("n_words"))  # speakers are few, so their figures are aggregated and joined, not windowed
    stats = sizes.join(sizes.groupBy("role").agg(F.avg("n_words").alias("mean"), F.coalesce(F.stddev_samp("n_words"), F.lit(0.0)).alias("std")), "role")
    z = F.abs(F.col("n_words") - F.col("mean")) / F.greatest(F.col("std"), F.lit(1.0))
    severity = F.when(F.col("z") > 4, "high").when(F.col("z") > 3, "medium").otherwise("low")
    return stats.withColumn("z", F.round(z, 6)).filter(F.col("z") > flag).select("conv_id", "turn", "role", "n_words", "z", severity.alias("severity"))


def tone(lines: DataFrame, positive: tuple[str, ...] = L.POSITIVE, negative: tuple[str, ...] = L.NEGATIVE) -> DataFrame:
    """Lexicon tone by substring counts: (positive - negative) / (positive + negative), 0 without hits."""
    low = F.lower(T.empty_as(F.col("text")))
    hits = lambda ws: sum((T.occurrences(low, w) for w in ws), F.lit(0)).cast("long")
    rows = lines.select("conv_id", "turn", "role", hits(positive).alias("n_positive"), hits(negative).alias("n_negative"))
    total = F.col("n_positive") + F.col("n_negative")
    return rows.withColumn("tone", F.when(total == 0, 0.0).otherwise((F.col("n_positive") - F.col("n_negative")) / total))


def tone_shifts(lines: DataFrame, jump: float = 0.5) -> DataFrame:
    """Lines of a speaker whose tone lies more than `jump` from that of the speaker's line before in the conversation."""
    before = F.lag("tone").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return tone(lines).withColumn("before", before).filter(F.abs(F.col("tone") - F.col("before")) > jump).select("conv_id", "turn", "role", F.round("before", 6).alias("before"), F.round("tone", 6).alias("tone"))


def alternation(lines: DataFrame) -> DataFrame:
    """Per conversation: turns, changes of speaker, and whether two speakers alternate strictly."""
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = lines.select("conv_id", "turn", "role").withColumn("before", before)
    g = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("before") != F.col("role")).alias("n_changes"), F.countDistinct("role").alias("n_speakers"))
    return g.withColumn("alternates", (F.col("n_changes") == F.col("n_turns") - 1) & (F.col("n_speakers") == 2))


def speech_windows(lines: DataFrame, size: int = 3, overlap: int = 1, least_words: int = 20) -> DataFrame:
    """Sliding windows of `size` turns that share `overlap`, with their word counts; a last partial one included."""
    step = size - overlap
    rows = lines.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("i"), F.size(T.word_list(F.col("text"))).cast("long").alias("n"))
    at = F.col("i") - 1
    # a turn lies in the windows that start at most size - 1 turns before it
    first = F.greatest(F.lit(0), F.ceil((at - size + 1) / step)).cast("int")
    spread = rows.withColumn("window", F.explode(F.sequence(first, F.floor(at / step).cast("int"))))
    g = spread.groupBy("conv_id", "window").agg(F.count("*").alias("n_turns"), F.sum("n").alias("n_words"))
    return g.filter(F.col("n_words") >= least_words).withColumn("window", F.col("window").cast("long"))


def window_changes(lines: DataFrame, threshold: float = 0.5, z_least: float = 1.96) -> DataFrame:
    """Neighbouring windows whose words per turn differ significantly (z-test with a deviation of a tenth of the mean) and by more than threshold."""
    w = speech_windows(lines).withColumn("value", F.col("n_words") / F.col("n_turns"))
    order = Window.partitionBy("conv_id").orderBy("window")
    w = w.withColumn("before", F.lag("value").over(order)).withColumn("n_before", F.lag("n_turns").over(order)).filter("before is not null")
    std = F.greatest(F.lit(0.1), (F.col("value") + F.col("before")) / 20)
    z = F.abs(F.col("value") - F.col("before")) / (std * F.sqrt(1 / F.col("n_turns") + 1 / F.col("n_before")))
    change = F.abs(F.col("value") - F.col("before")) / F.col("before")
    return w.filter((z > z_least) & (F.col("before") > 0) & (change > threshold)).select("conv_id", "window", F.round(z, 6).alias("z"), F.round(change, 6).alias("change"))


def mentions_in_speech(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Who mentions which name: words of each speaker joined with names (name_lc), counted."""
    return _words(lines, "conv_id", "role").join(names, F.col("word") == F.col("name_lc")).groupBy("role", F.col("name_lc").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_conversations"))
