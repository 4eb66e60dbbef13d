"""Counts against the library itself, and what a run leaves in the cache."""

import random

import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fabula.llm import token_counts as K

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t", "Hello  World\r\n\x0b\x0cagain", "<|endoftext|>", "<|ENDOFTEXT|> <|startoftext|>x<|endoftext|>", "a<|endoftext|>b <| c", "H̱ ẖ T̈ ẗ J̌", "can't I'LL 'S's",
       " nbsp em\x1cfs\x85nel", "ΑΣ Σ. İI ǅ ß ſ K", "日本語テキスト 한국어 한", "😀👩‍👩‍👧 éÉ", "x" * 5000, "́ lone", "1234567890 ½ ²"]


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [len(t.encode(x or "", add_special_tokens=False)) for x in texts]


def test_counter_is_the_library_s():
    rng, bits = random.Random(1), [x for x in ODD if x] + [" ", "\n", "\t", "A", "é", "̧", "\x1d", "<|", "|>", "'Ll"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(400)] + [x or "" for x in ODD]
    assert K.Counter(PATH)([x.encode() for x in texts]) == library(texts)


def test_a_full_memory_of_words_starts_afresh(monkeypatch):
    monkeypatch.setattr(K, "KEPT_WORDS", 3)
    c = K.Counter(PATH)
    texts = ["one two", "three four five six", "one seven two", ""]
    assert [c([x.encode()])[0] for x in texts] == library(texts)


def test_equal_normal_forms_have_equal_counts(spark):
    rng, bits = random.Random(2), ["H", "h", "̱", "T", " ", "\n\n", "\x0b", "<|", "endoftext", "ENDOFTEXT", "|>", "É", "é", " "]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 6))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", K.normalised(F.col("text")).alias("n")).collect()
    seen = {}
    for (text, n), tokens in zip(rows, library([r.text for r in rows]), strict=True):
        assert seen.setdefault(n, tokens) == tokens, text
    assert len(seen) < len({r.text for r in rows})


def test_query_equals_the_library(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = pq.read_table(path, columns=["doc_id", "text"]).to_pylist()
    want = {(r["doc_id"], len((r["text"] or "").encode()), n, n > 2048) for r, n in zip(rows, library([r["text"] for r in rows]), strict=True)}
    got = K.count(spark.read.parquet(path))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and {tuple(r) for r in got.collect()} == want and got.count() == len(rows)


def test_only_misses_are_encoded_and_appended(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD, *ODD])] + [(None, "Hello  World", "y")], "doc_id long, text string, content string")
    want = dict(zip([x or "" for x in ODD], library(ODD), strict=True)) | {"Hello  World": 2}
    asked = []
    encoded = K.encoded
    monkeypatch.setattr(K, "encoded", lambda misses, path: asked.append(misses.count()) or encoded(misses, path))

    def run(d):
        texts = {r.doc_id: r.text or "" for r in d.collect()}
        got = K.count(d, cache).collect()
        assert len(got) == d.count() and all(r.n_tokens == want[texts[r.doc_id]] and r.n_bytes == len(texts[r.doc_id].encode()) for r in got)
        return spark.read.parquet(cache).count()

    assert run(docs.limit(5)) == 3  # null, empty and blank texts share an entry
    n = run(docs)
    assert run(docs) == n and asked[-1] == 0 and asked[1] == n - 3
    K.refresh(docs, cache)
    spark.read.parquet(cache).limit(4).write.mode("append").parquet(cache)  # an append made twice
    run(docs)
    other = Tokenizer.from_file(PATH)
    other.save(str(tmp_path / "other.json"))
    K.count(docs, cache, str(tmp_path / "other.json")).collect()
    assert asked[-1] == n  # another version shares nothing


def test_empty_table(spark):
    assert K.count(spark.createDataFrame([], "doc_id long, text string")).count() == 0
