"""Narrative structure: sentences that look back or ahead, and the chapter that tells what they speak of."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.functions import batches as B
from fabula.functions import lexicons as L
from fabula.functions import text as T
from fabula.operators.temporal import ORDER_SIGNALS
from fabula.sources import tables
from fabula.sources.shared import written

#: Which way a kind of signal points.
DIRECTIONS = {"past": ORDER_SIGNALS["retrospective"], "future": ORDER_SIGNALS["prospective"]}
KEYWORD_CHARS, LEAST_SHARED, SHARE = 5, 2, 0.4


def references(docs: DataFrame, directions: dict[str, str] = DIRECTIONS) -> DataFrame:
    """doc_id, chapter, sent_idx (within the chapter), direction, text of the sentences that a signal turns to the past or the future; both are two rows."""
    chapters = tables.chapters(docs)
    sentences = chapters.select("doc_id", "chapter", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "text"))
    points = F.array_compact(F.array(*[F.when(F.regexp_like(T.plain(F.col("text")), F.lit(T.whole_words(p))), k) for k, p in directions.items()]))
    return sentences.select("doc_id", "chapter", F.col("sent_idx").cast("long").alias("sent_idx"), F.explode(points).alias("direction"), "text")


def _keywords(words: Column, least_chars: int = KEYWORD_CHARS) -> Column:
    """The distinct words of at least least_chars letters that are no stop words."""
    return F.array_except(F.filter(words, lambda w: F.length(w) >= least_chars), F.array(*map(F.lit, sorted(set(L.STOP_WORDS)))))


def _index(docs: DataFrame) -> DataFrame:
    """doc_id, word, others: the chapters that hold a word, of the words that may be keywords. A word of one chapter meets no other, so it stays in its text's row, unless rows share a doc_id."""
    repeated = not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    rows = docs.select("doc_id", tables.chapter_list(F.lower("text")).alias("chapters")).mapInArrow(_entries(1 if repeated else 2), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, word string, others array<long>")
    return rows.groupBy("doc_id", "word").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others")) if repeated else rows


def _entries(least: int):
    """The entries of the words that at least so many chapters of a row hold."""
    stop = pa.array(sorted(set(L.STOP_WORDS)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = b.column("chapters").value_lengths().to_numpy()
            doc, chapter = np.repeat(np.arange(len(b)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
            lists = B.word_lists(b.column("chapters").flatten())
            words, own = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            may = pc.and_(pc.greater_equal(pc.utf8_length(words), KEYWORD_CHARS), pc.invert(pc.is_in(words, stop)))
            coded = words.filter(may).dictionary_encode()
            own = own[may.to_numpy(zero_copy_only=False)]
            rows = np.stack([doc[own], coded.indices.to_numpy(), chapter[own]])
            rows = rows[:, np.lexsort(rows[::-1])]
            new = np.diff(rows, axis=1, prepend=-1) != 0
            rows, first = rows[:, new.any(axis=0)], new[:2].any(axis=0)[new.any(axis=0)]
            size = np.diff(np.append(np.flatnonzero(first), rows.shape[1]))
            kept, at = np.repeat(size >= least, size), np.flatnonzero(first)[size >= least]
            ends = np.concatenate([[0], np.cumsum(size[size >= least])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows[0, at])), coded.dictionary.take(pa.array(rows[1, at])), pa.ListArray.from_arrays(pa.array(ends), pa.array(rows[2, kept]))], names=["doc_id", "word", "others"])

    return batches


def told_elsewhere(docs: DataFrame, found: DataFrame) -> DataFrame:
    """found (doc_id, chapter, sent_idx, direction, text) with n_keywords, told_in and shared: the first chapter, in reading order, before (past) or after (future) the sentence's own that holds enough of its keywords:
    at least two and two fifths of them. Both are 0 where none does.

    Keywords meet an inverted index of the chapters' words, by text and word; chapters aren't compared with sentences. The index holds only what may be a keyword and meet another chapter, one row for each text and word,
    and what a word of a sentence meets goes on as one row, to where the sentence's other words go."""
    key = ["doc_id", "chapter", "sent_idx", "direction"]
    index = _index(docs)
    keyed = found.select(*key, B.words(F.lower("text")).alias("ws")).select(*key, _keywords(F.col("ws")).alias("words"))
    keyed = written(keyed.select(*key, F.size("words").cast("long").alias("n"), "words"))
    asked = keyed.select(*key, "n", F.explode_outer("words").alias("word")).filter("word is not null")
    points = lambda o: F.when(F.col("direction") == "past", o < F.col("chapter")).otherwise(o > F.col("chapter"))
    met = asked.join(index, ["doc_id", "word"]).select(*key, "n", F.filter("others", points).alias("others")).filter(F.size("others") > 0)
    shared = met.repartition(*key).select(*key, "n", F.explode_outer("others").alias("other")).groupBy(*key, "n", "other").agg(F.count("*").alias("k"))
    enough = shared.filter((F.col("k") >= LEAST_SHARED) & (F.col("k") >= F.col("n") * SHARE))
    first = enough.groupBy(*key).agg(F.min(F.struct("other", "k")).alias("first"))
    return keyed.select(*key, "n").join(first, key, "left").select(*key, F.col("n").alias("n_keywords"), F.coalesce("first.other", F.lit(0)).alias("told_in"), F.coalesce("first.k", F.lit(0)).alias("shared"))
