"""Chat formatting: an event log is folded into final messages, which are rendered by a template with a loss mask.

Events (conv_id, seq, kind, turn, role, text), in order of seq within a conversation:
  message, delta  append text to the turn;
  edit            replaces what the turn held so far;
  regenerate      drops the turn's text so far and every later turn's, then starts the turn anew.
The fold is done by windows: an event falls if a later edit names its turn, or a later regeneration names its turn or
an earlier one. All windows and groups hash by conversation, so the log is shuffled once. A conversation is one
rendered string in the end, so its turns meet in one row by definition; nothing else is gathered.

The template writes <|im_start|>ROLE\\nTEXT<|im_end|>\\n. Inside texts every "<", backslashes, "|" gets one more
backslash, so that no control string can occur there and the escape is undone exactly. In roles, line ends are
written "<n" in the same manner. The loss mask holds the (start, stop) character offsets of assistant texts.

DataFrame functions only. Defined cases: null text and null role are empty strings; a null conv_id is a conversation of its own;
rows of equal turn keep their count and are ordered by role and text, null turns first; an empty log gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm.common import let

START, STOP = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.regexp_replace(escape(role), r"<(\\*)n", r"<\\$1n"), F.lit("\n"), F.lit("<n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(F.replace(role, F.lit("<n"), F.lit("\n")), r"<\\(\\*)n", "<$1n"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of an event log (conv_id, seq, kind, turn, role, text)."""
    rows = events.select("conv_id", "seq", F.lower("kind").alias("kind"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("seq").desc_nulls_last(), F.col("turn").desc_nulls_last(), F.col("kind").desc_nulls_last(), F.col("text").desc()]
    later = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    later_here = Window.partitionBy("conv_id", "turn").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later)
    edited = F.max(F.col("kind") == "edit").over(later_here)
    kept = rows.withColumn("cut", cut).withColumn("edited", edited).filter(~F.coalesce(F.col("cut") <= F.col("turn"), F.lit(False)) & ~F.coalesce("edited", F.lit(False)))
    return kept.groupBy("conv_id", "turn").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "text"))).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))), lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array of start, stop), from (conv_id, turn, role, text)."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    in_order = Window.partitionBy("conv_id").orderBy(*order)
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = rows.select(
        "conv_id", (F.col("role") == LEARNED_ROLE).alias("learned"), F.row_number().over(in_order).alias("i"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit(STOP + "\n")))
    upto = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(upto), F.lit(0)) + F.length("head")
    pieces = pieces.withColumn("start", start).withColumn("stop", F.col("start") + F.length("body"))
    turns = F.array_sort(F.collect_list(F.struct("i", "piece", "learned", "start", "stop")))
    return pieces.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"))).alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """The (role, text) messages of a rendered conversation."""
    cut = len(STOP) + 1

    def message(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(head) + 2, F.length(p) - F.length(head) - 1 - cut)
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return let(F.split(formatted, r"<\|im_start\|>", -1), lambda p: F.transform(F.slice(p, F.lit(2), F.size(p) - 1), message))


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss_mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), (m["stop"] - m["start"]).cast("int")))), "")


def digest(conversations: DataFrame) -> DataFrame:
    """The rendered conversations, read back from the output: counts and hashes."""
    probe = "<|im_end|><|im_start|>assistant ok"
    spark = conversations.sparkSession
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    events = rows.withColumn("seq", seq).select("conv_id", "seq", F.lit("message").alias("kind"), F.col("seq").alias("turn"), "role", "text")
    done = render(fold(events)).select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
    + length(regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '<(\\*)n', '<\\\1n', 'g'))
    + length(role) - length(replace(role, chr(10), ''))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
