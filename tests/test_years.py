"""Years in texts of any script."""

from fabula.operators import texts as X


def test_years_stand_between_characters_that_are_no_ascii_word_characters(spark):
    docs = spark.createDataFrame([(1, "añó1999ñ, 1850é y 2020年"), (2, "a1999 1999b 19990 _1999"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.n, r.first_year, r.last_year) for r in X.years(docs).collect()] == [(1, 3, 1850, 2020)]
