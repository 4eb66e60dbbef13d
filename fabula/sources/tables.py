"""Base tables and the tables derived from them: paragraphs, sentences, tokens, chapters, dialogues and the story model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabula.functions import batches as B
from fabula.functions import text as T

CHAPTER_PARAGRAPHS = 5
#: Orders of the star schema that make up one story, and its cast.
STORY, CAST = 100, 8


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, para_idx, start_char, end_char, text: the lines of a text on one character axis, from 0."""
    rows = docs.select("doc_id", F.posexplode(F.split(T.empty_as(F.col("text")), "\n", -1)).alias("para_idx", "text"))
    before = Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return rows.select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), start.cast("long").alias("start_char"), (start + F.length("text")).cast("long").alias("end_char"), "text")


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sent_idx, text. Outer, and null rows left out: before any other explode Spark filters by the size of the array, which splits every text twice."""
    return docs.select("doc_id", F.posexplode_outer(T.sentences(F.col("text"))).alias("sent_idx", "text")).filter("sent_idx is not null").withColumn("sent_idx", F.col("sent_idx").cast("long"))


def tokens(docs: DataFrame, text=None) -> DataFrame:
    """doc_id, word_idx, token, token_lc."""
    words = docs.select("doc_id", B.words(F.col("text") if text is None else text).alias("ws"))
    return words.select("doc_id", F.posexplode_outer("ws").alias("word_idx", "token")).filter("word_idx is not null").select("doc_id", F.col("word_idx").cast("long").alias("word_idx"), "token", F.lower("token").alias("token_lc"))


def chapter_list(text: Column, size: int = CHAPTER_PARAGRAPHS) -> Column:
    """A text's chapters in order: slices of `size` lines, for texts without headings."""
    joined = lambda ls: F.transform(F.sequence(F.lit(1), F.size(ls), F.lit(size)), lambda at: F.array_join(F.slice(ls, at, F.lit(size)), "\n"))
    return T.let(F.split(T.empty_as(text), "\n", -1), joined)


def chapters(docs: DataFrame, size: int = CHAPTER_PARAGRAPHS) -> DataFrame:
    """doc_id, chapter (from 1), text."""
    rows = docs.select("doc_id", F.posexplode_outer(chapter_list(F.col("text"), size)).alias("chapter", "text"))  # a row for each chapter with its own lines, not all lines
    return rows.filter("chapter is not null").select("doc_id", (F.col("chapter") + 1).cast("long").alias("chapter"), "text")


def dialogues(docs: DataFrame) -> DataFrame:
    """doc_id, dlg_idx, text of quoted or dashed speech."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(T.empty_as(F.col("text")), F.lit(T.DIALOGUE), F.lit(0))).alias("dlg_idx", "text")).withColumn("dlg_idx", F.col("dlg_idx").cast("long"))


# The story model. The supplied star schema and event log hold the same shapes: facts with positions, entities, edges.


def alerts(events: DataFrame) -> DataFrame:
    """Findings from the event log, in the alert schema."""
    e = events
    i = F.col("event_id")
    chapter = F.when(i % 37 == 0, None).otherwise(i % 37)
    return e.select(
        i.alias("alert_id"), (F.col("user_id") % 10).alias("project_id"), F.col("event_type").alias("alert_type"),
        F.element_at(F.array(*map(F.lit, ("critical", "warning", "info", "hint", "other"))), (i % 5 + 1).cast("int")).alias("severity"),
        F.element_at(F.array(*map(F.lit, ("new", "open", "dismissed", "resolved", "acknowledged"))), (F.floor(i / 5) % 5 + 1).cast("int")).alias("status"),
        F.concat(F.lit("module_"), (F.col("user_id") % 7).cast("string")).alias("source_module"), chapter.alias("chapter"),
        F.when(i % 3 == 0, None).otherwise(i * 13 % 5000).alias("start_char"), (F.round(F.col("value") * 100).cast("long") % 100 / 100).alias("confidence"),
        F.array(F.col("user_id"), i % 50).alias("entity_ids"), F.concat_ws(" ", "event_type", (i % 11).cast("string")).alias("title"), F.col("ts").alias("created_at"), F.col("user_id").alias("entity_id"))


def mentions(lineitem: DataFrame) -> DataFrame:
    """Entity mentions: entity_id, doc_id, chapter, start_char, end_char, is_active."""
    start = F.col("l_extendedprice").cast("long") % 20000
    return lineitem.select(
        F.col("l_partkey").alias("entity_id"), F.floor(F.col("l_orderkey") / STORY).alias("doc_id"), F.col("l_linenumber").cast("long").alias("chapter"), start.alias("start_char"),
        (start + F.col("l_quantity").cast("long")).alias("end_char"), (F.col("l_returnflag") != "R").alias("is_active"))


def entities(part: DataFrame) -> DataFrame:
    """Every part as an entity: entity_id, name, entity_type, importance."""
    return part.select(
        F.col("p_partkey").alias("entity_id"), F.concat_ws(" ", "p_name", (F.col("p_partkey") % 20).cast("string")).alias("name"), F.lower("p_type").alias("entity_type"),
        F.element_at(F.array(*map(F.lit, ("primary", "secondary", "minor"))), (F.col("p_size") % 3 + 1).cast("int")).alias("importance"))


def interactions(lineitem: DataFrame, *more: Column) -> DataFrame:
    """Interactions between two characters: a, b, chapter, start_char, tone (-1 to 1), kind, and further columns of lineitem."""
    first = F.floor(F.col("l_orderkey") / STORY) * CAST  # each story has its own cast, so that pairs don't grow with the table
    return lineitem.select(
        (first + F.col("l_partkey") % CAST).alias("a"), (first + F.col("l_suppkey") % CAST).alias("b"), F.col("l_linenumber").cast("long").alias("chapter"), F.col("l_orderkey").alias("start_char"),
        ((F.col("l_discount") * 100).cast("long") * 20 - 100).alias("tone_pct"), F.lower("l_linestatus").alias("kind"), *more).filter("a <> b")


def timeline(orders: DataFrame) -> DataFrame:
    """Dated events in reading order: doc_id, event_id, chapter, start_char, story_date, is_dated."""
    return orders.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("event_id"), (F.col("o_orderkey") % 12).alias("chapter"), (F.col("o_orderkey") * 7 % 3000).alias("start_char"),
        F.to_date("o_orderdate").alias("story_date"), (F.col("o_orderpriority") != "5-LOW").alias("is_dated"), (F.floor(F.col("o_totalprice")) % 40).cast("long").alias("number"))


def in_reading_order(*more: str) -> Window:
    return Window.partitionBy("doc_id", *more).orderBy("chapter", "start_char", "event_id")
