import pytest
from pyspark.sql import functions as F

from fabula.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("word", "n"), [("aéreo", 4), ("ciudad", 2), ("rey", 1), ("", 0), ("123", 0), ("brr", 1), ("leer", 2), ("Niño", 2), ("poeta", 3)])
def test_syllables(spark, word, n):
    assert one(spark, T.syllables(F.lit(word))) == n


@pytest.mark.parametrize(("a", "b", "x"), [([], [], 1.0), (["a"], [], 0.0), (["a", "b"], ["b", "a"], 1.0), (["a"], ["b"], 0.0), (["a", "b"], ["b", "c"], 1 / 3)])
def test_jaccard(spark, a, b, x):
    array = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    assert one(spark, T.jaccard(array(a), array(b))) == x


def test_names_and_accents(spark):
    assert one(spark, T.normalize_name(F.lit("  Señor   ÁLVAREZ "))) == "senor alvarez"
    assert one(spark, T.strip_accents(F.lit("Ñandú"))) == "Ñandu"
    assert one(spark, T.strip_accents(F.lit("Ñandú"), keep_enye=False)) == "Nandu"


def test_words_sentences_and_grams(spark):
    assert one(spark, T.word_list(F.lit("Niño corrió, ya: 3 veces."))) == ["Niño", "corrió", "ya", "veces"]
    assert one(spark, T.word_list(F.lit(None).cast("string"))) == []
    assert one(spark, T.sentences(F.lit("Uno. ¿Dos?\nTres sin fin"))) == ["Uno.", "¿Dos?", "Tres sin fin"]
    assert one(spark, T.sentences(F.lit("Costó 3.50. «¡Ya!» dijo... corto"))) == ["Costó 3.50.", "«¡Ya!»", "dijo..."]  # a tail under ten characters doesn't count
    assert one(spark, T.sentences(F.lit(" \n... a.b"))) == ["..."] and one(spark, T.sentences(F.lit(None).cast("string"))) == []
    assert one(spark, T.char_ngrams(F.lit("abab"), 2)) == ["ab", "ba"] and one(spark, T.char_ngrams(F.lit("a"), 2)) == []


@pytest.mark.parametrize(("numeral", "n"), [("IV", 4), ("MCMXCIX", 1999), ("x", 10), ("III", 3)])
def test_roman(spark, numeral, n):
    assert one(spark, T.roman_to_int(F.lit(numeral))) == n


def test_dialogue_and_sanitize(spark):
    assert one(spark, T.without_dialogue(F.lit('Dijo «hola» y "adiós".'))) == "Dijo   y  ."
    assert one(spark, T.dialogue_chars(F.lit("a «bc» d"))) == 4
    assert one(spark, T.sanitize(F.lit("a\0b\r\nc\rd"), 5)) == "ab\nc\n"
    assert round(one(spark, T.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))) == 10008
    assert one(spark, T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_long_runs_without_marks_are_read_once(spark):
    import time

    long = spark.createDataFrame([("a" * 400_000 + "." * 200_000 + "b" + "a,b " * 50_000 + "fin",)], "t string")
    began = time.time()
    assert len(long.select(T.sentences(F.col("t")).alias("s")).first().s) == 1
    assert long.select(T.text_syllables(F.col("t")).alias("n")).first().n > 0 and len(long.select(T.char_ngrams(F.col("t"), 3).alias("g")).first().g) < 100
    assert time.time() - began < 20


def test_syllables_of_a_text_are_those_of_its_words(spark):
    texts = ["El aéreo héroe leía. Shh, tras brr y\nEAU!", "", None, "ÁÉ-x 3a ñ çe"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = df.select(F.aggregate(F.transform(T.word_list(F.col("t")), T.syllables), F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).collect()
    assert [r.n for r in df.select(T.text_syllables(F.col("t")).alias("n")).collect()] == [r.n for r in words]
