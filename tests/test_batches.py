import random

import pyarrow as pa
from pyspark.sql import functions as F

from fabula.functions import batches as B
from fabula.functions import text as T
from fabula.operators import editorial, energy, structure, texts
from fabula.sources import tables

ODD = [None, "", "a", "é", "É", "áb", "\x01é", "ñandú Ñ", "ÿ à ç x", "日本 año 1 a_b", "à", "ß", "—Hola—dijo", "Ã© C3", "x\n", "́a", "😀abc😀", "ab"]


def _texts(spark):
    draw = random.Random(3)
    rows = ODD + ["".join(draw.choice("aéÉñ. ß日\n_1zA😀") for _ in range(draw.randrange(14))) for _ in range(500)]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), rows


def test_batches_agree_with_columns(spark):
    docs, rows = _texts(spark)
    assert docs.select(T.word_list(F.col("text")).alias("a"), B.words("text").alias("b")).filter("not a <=> b").isEmpty()
    assert B.plain_array(pa.array(rows)).to_pylist() == [r[0] for r in docs.orderBy("doc_id").select(T.plain(F.col("text"))).collect()]
    assert B.word_counts(pa.array(rows)).tolist() == [r[0] for r in docs.orderBy("doc_id").select(F.size(T.word_list(F.col("text")))).collect()]
    assert B.word_lists(pa.array(["x yz", None, "é"]).slice(1)).to_pylist() == [[], ["é"]]
    assert B.word_lists(pa.array([], pa.string())).to_pylist() == []


def test_shared_trigrams_agree_with_sets(spark):
    docs, _ = _texts(spark)
    pairs = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("t")).join(docs.select((F.col("doc_id") + 1).alias("a"), F.col("text").alias("u")), "a")
    for r in pairs.select("t", "u", B.shared_trigrams(F.col("t"), F.col("u")).alias("g")).collect():
        x, y = ({s[i : i + 3] for i in range(len(s) - 2)} for s in (r.t or "", r.u or ""))
        assert (r.g.shared, r.g.either) == (len(x & y), len(x | y))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_split_once_and_not_by_patterns_for_each_sentence(spark):
    docs, _ = _texts(spark)
    # before other explodes Spark filters by the size of the array, and so splits twice
    assert _plan(tables.sentences(docs)).count("split(") == 1 and "split(" not in _plan(tables.tokens(docs)).replace("[split(", "[")
    plan = _plan(energy.sentence_energy(docs))
    assert "MapInArrow" in plan and "REGEXP_COUNT" not in plan.upper() and "cion" not in plan


def test_identity_joins_texts_not_their_trigrams(spark):
    docs, _ = _texts(spark)
    plan = _plan(texts.identity(docs))
    assert "zip_with" not in plan and plan.index("Join") > plan.index("ArrowEvalPython")


def test_capitalised_words_leave_texts_without_a_window_over_all_words(spark):
    docs = spark.createDataFrame([(1, "Ana Ruiz vio. Ana Ruiz fue. Ana Ruiz Ana Ruiz y Marta, Marta, Marta"), (2, None), (3, "")], "doc_id long, text string")
    found = editorial.found_mentions(docs)
    assert "lead(" not in _plan(found)
    assert sorted(found.collect()) == [(1, 0, "Ana Ruiz"), (1, 3, "Ana Ruiz"), (1, 6, "Ana Ruiz"), (1, 8, "Ana Ruiz"), (1, 11, "Marta"), (1, 12, "Marta"), (1, 13, "Marta")]


def test_near_sentences_order_hashes_and_pair_by_words(spark):
    docs = spark.createDataFrame([(1, "Uno dos tres cuatro cinco seis siete ocho nueve diez. Uno dos tres cuatro cinco seis siete ocho nueve diez once. Nada de lo anterior vuelve aqui nunca mas.")], "doc_id long, text string")
    found = texts.near_sentences(docs)
    assert [tuple(r) for r in found.collect()] == [(1, 0, 1, round(10 / 11, 6))]
    assert "Window" not in _plan(found)  # prefixes are written, not formed once for each side of the join


def test_chapters_carry_their_own_lines_only(spark):
    docs = spark.createDataFrame([(1, "\n".join("abcdefgh")), (2, ""), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in tables.chapters(docs, 3).orderBy("doc_id", "chapter").collect()] == [(1, 1, "a\nb\nc"), (1, 2, "d\ne\nf"), (1, 3, "g\nh"), (2, 1, ""), (3, 1, "")]
    assert "Generate explode(sequence" not in _plan(tables.chapters(docs))


def test_told_elsewhere_indexes_keywords_only(spark):
    docs = spark.createDataFrame([(1, "\n".join(["montaña puente y el a"] + ["x"] * 4 + ["Recordaba la montaña y el puente viejo."] + ["x"] * 4))], "doc_id long, text string")
    found = spark.createDataFrame([(1, 2, 0, "past", "Recordaba la montaña y el puente viejo.")], "doc_id long, chapter long, sent_idx long, direction string, text string")
    told = structure.told_elsewhere(docs, found)
    assert [tuple(r) for r in told.collect()] == [(1, 2, 0, "past", 4, 1, 2)]
    index = structure._index(docs)  # words of one chapter stay in their row
    assert [tuple(r) for r in index.orderBy("word").collect()] == [(1, "montaña", [1, 2]), (1, "puente", [1, 2])]
    two = docs.unionByName(spark.createDataFrame([(1, "\n".join(["x"] * 10 + ["viejo y Puente, el puente"]))], docs.schema))
    assert {r.word: sorted(r.others) for r in structure._index(two).collect()} == {"montaña": [1, 2], "puente": [1, 2, 3], "recordaba": [2], "viejo": [2, 3]}
    assert structure._index(docs.filter("doc_id = 2")).isEmpty()
