"""Token counts through a digest cache: counts are stored by what a text's content and the tokenizer's version digest to.

The cache is a folder of Parquet files (content, tokenizer, n_tokens). A run digests all texts, joins the digests to the stored counts of this
tokenizer, encodes one text of each distinct miss, appends the new counts, and joins every row to its count. Content is normalised before it is digested,
only in ways that can't change a count (see `normalised`), so that a text and a copy with other line breaks or capitals share an entry.

An append that was lost or made twice does no harm: what isn't stored is encoded again, and equal entries are folded when the cache is read.
A row whose digest a third of all rows share is one partial row before the shuffle of misses, and its rows meet one stored row.

A null text counts as empty (no bytes, no tokens); a null doc_id stays null; repeated rows give repeated rows; an empty table gives an empty
result and appends nothing; further columns are ignored. Texts are never cut: a text is encoded word by word with the words of its batch counted once.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.llm.common import SPACED_BREAKS, ascii_lower, shared_dir, written

#: Tokens above which a text is over a model's window.
LIMIT = 2048
#: Words whose counts a worker keeps at a time; beyond it, it starts afresh.
KEPT_WORDS = 500_000
CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def version(path: str) -> str:
    """A digest of all that a count depends on besides the text: the tokenizer's file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"\n{tokenizers.__version__}".encode()).hexdigest()


def normalised(text: Column) -> Column:
    """White space at the ends and the kind and length of white space between words don't count for this tokenizer, nor do capitals.

    Capitals stay where a text has combining marks (a mark may compose with a small letter but not with its capital)
    or what might be a special token (these are matched as written)."""
    plain = F.regexp_replace(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACED_BREAKS)), "[ \t\n\x0b\f\r]+", " ")
    return F.when(F.regexp_like(plain, F.lit(r"<\||\p{M}")), plain).otherwise(ascii_lower(plain))


def content(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


class Counter:
    """Counts UTF-8 texts by their words: the tokenizer splits at white space before all else but its special tokens, which hold none."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]
        missing = list({w for words in split for w in words if w not in self.known})
        if len(self.known) + len(missing) > KEPT_WORDS:
            self.known, missing = {}, list({w for words in split for w in words})
        for i in range(0, len(missing), 10_000):
            some = missing[i : i + 10_000]
            tokens = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            self.known.update(zip(some, map(len, tokens), strict=True))
        return [sum(map(self.known.__getitem__, words)) for words in split]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This process's counter: a worker that takes another task keeps the words it knows."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def encoded(misses: DataFrame, path: str) -> DataFrame:
    """content and n_tokens of each row of content, text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in it:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([some.column("content"), pa.array(count(some.column("text").cast(pa.binary()).to_pylist()), pa.int64())], names=["content", "n_tokens"])

    return misses.select("content", "text").mapInArrow(batches, "content string, n_tokens long")


def stored(docs: DataFrame, cache: str, tokenizer: str) -> DataFrame:
    """content, n_tokens of the cache for this tokenizer's version; none where there is no cache yet."""
    spark = docs.sparkSession
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.filter(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def refresh(docs: DataFrame, cache: str, path: str | None = None) -> None:
    """Appends the counts of all contents of docs that the cache doesn't hold for this tokenizer."""
    path = path or default_tokenizer()
    tokenizer = version(path)
    texts = docs.select(content(F.col("text")).alias("content"), F.coalesce("text", F.lit("")).alias("text"))
    distinct = texts.groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(stored(docs, cache, tokenizer).select("content"), "content", "left_anti")
    encoded(misses, path).select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)


def count(docs: DataFrame, cache: str | None = None, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; cache: a folder that outlives the run, or one for this run in the shared folder."""
    cache = cache or f"{shared_dir(docs.sparkSession)}/token-counts-{uuid.uuid4().hex}"
    refresh(docs, cache, path)
    # written, so that the join reads plain rows: a content that many rows share is then split by the skew join
    counts = written(stored(docs, cache, version(path or default_tokenizer())))
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), content(F.col("text")).alias("content"))
    return rows.join(counts, "content", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
