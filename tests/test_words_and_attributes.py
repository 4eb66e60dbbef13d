"""Spelling against every edit distance, stems and attributes against fixtures and loops."""

import random

from fabula.operators import attributes as A
from fabula.operators import spelling as O
from fabula.plans import story_text_plans

DOC = "doc_id long, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_suggestions_equal_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abñ", k=rng.randint(2, 12)))
    dictionary = {word(): rng.randint(1, 5) for _ in range(150)}
    base = list(dictionary)
    asked = {w for w in ("".join(c for c in rng.choice(base) if rng.random() > 0.12) + rng.choice(["", "a", "b"]) for _ in range(400)) if len(w) >= 4 and w not in dictionary}
    want = {}
    for w in asked:
        near = [(distance(w, d), -n, d) for d, n in dictionary.items() if distance(w, d) <= (2 if len(w) >= O.LONG else 1)]
        if near:
            k, _, d = min(near)
            want[w] = (d, k)
    got = O.suggestions(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame(list(dictionary.items()), "word string, n long"))
    assert {r.word: (r.suggestion, r.distance) for r in got.collect()} == want and len(want) > 100


def test_misspellings_in_place(spark):
    text = "La ventana abierta. Ventna abierrta, ventxxxa; Ruiz y Ruizz. " + "ventana abierta " * 3
    docs = spark.createDataFrame([(1, text), (2, None), (3, "Ventna ventna")], DOC)
    known = spark.createDataFrame([("Don Abierrta",)], "name string")
    rows = {(r.doc_id, r.word_idx): (r.token, r.suggestion, r.distance, r.confidence) for r in O.misspellings(docs, least=4).collect()}
    assert rows == {(1, 3): ("Ventna", "Ventana", 1, 0.9), (1, 4): ("abierrta", "abierta", 1, 0.9), (3, 0): ("Ventna", "Ventana", 1, 0.9), (3, 1): ("ventna", "ventana", 1, 0.9)}
    assert {r.token for r in O.misspellings(docs, known, least=4).collect()} == {"Ventna", "ventna"}
    s = {r.word: (r.suggestion, r.n, r.n_docs, r.first_doc, r.first_word) for r in O.misspelling_summary(O.misspellings(docs, least=4)).collect()}
    assert s["ventna"] == ("ventana", 3, 2, 1, 3)
    assert O.misspellings(docs.limit(0)).count() == 0


def test_lemmas(spark):
    docs = spark.createDataFrame([(1, "Caminaba despacio. Caminando llegó al camino; caminos. Mira."), (2, "uno dos"), (3, "camino camino")], DOC)
    got = {(r.doc_id, r.stem): (r.n, r.min_distance, r.forms) for r in O.lemma_repetitions(docs).collect()}
    assert got == {(1, "camin"): (4, 1, 4)}


TEXT = "Ana, de ojos azules, entró. Tenía 30 años. Los ojos verdes de Pedro miraban. Ana no era alta. Ana era alta. Pedro tenía el pelo negro." + " y" * 150 + " Ana tenía ojos negros. Cumplió 29 años. Era médica."


def test_attributes_are_bound_and_resolved(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "ojos azules")], DOC)
    places = [(1, 1, i, i + 3) for i in range(len(TEXT)) if TEXT.startswith("Ana", i)] + [(1, 2, i, i + 5) for i in range(len(TEXT)) if TEXT.startswith("Pedro", i)]
    mentions = spark.createDataFrame(places, "doc_id long, entity_id long, start long, stop long")
    rows = A.resolve(A.candidates(docs, mentions))
    got = {(r.entity_id, r.key, r.value, r.negated): (r.n, r.rule) for r in rows.collect()}
    assert got[1, "eyes", "azul", False] == (1, "subject") and got[1, "age", "30", False] == (1, "subject") and got[2, "eyes", "verde", False] == (1, "possessor")
    assert (1, "build", "alta", True) in got and (1, "build", "alta", False) in got and got[2, "hair", "negro", False] == (1, "subject")
    assert not any(r.doc_id == 3 for r in rows.collect())
    kinds = {(r.entity_id, r.key, r.value, r.other, r.kind) for r in A.contradictions(rows).collect()}
    assert (1, "build", "alta", "alta", "negation") in kinds and (1, "eyes", "negro", "azul", "conflict") in kinds and (1, "age", "29", "30", "conflict") in kinds


def test_cascade_and_ties(spark):
    rows = [(1, 10, 20, "eyes", "azul", 5, "subject", False), (1, 10, 20, "eyes", "azul", 4, "following", False), (1, 50, 60, "eyes", "azul", 5, "apposition", False), (1, 80, 90, "hair", "rubio", 7, "subject", False), (1, 80, 90, "hair", "rubio", 6, "subject", False)]
    r = {(x.entity_id, x.key): x for x in A.resolve(spark.createDataFrame(rows, "doc_id long, start long, stop long, key string, value string, entity_id long, rule string, negated boolean")).collect()}
    assert (r[5, "eyes"].n, r[5, "eyes"].rule, r[5, "eyes"].confidence, r[5, "eyes"].first_start) == (2, "apposition", 0.9, 10) and r[6, "hair"].confidence == 0.35 and set(r) == {(5, "eyes"), (6, "hair")}


def test_edited_versions_and_casts_are_derived_from_the_tables(spark):
    docs = spark.createDataFrame([(4, "Uno Dos\nTres.\nCuatro"), (5, None)], DOC)
    assert story_text_plans.edited(docs).count() == 2 and {r.name for r in story_text_plans._cast(docs).collect()} == {"Uno Dos", "Tres", "Cuatro"}


def test_asked_words_are_not_broadcast_where_the_dictionary_is_large(spark, monkeypatch):
    from fabula.operators import joins
    from fabula.sources.shared import written

    asked = written(spark.createDataFrame([("casza",), ("perrro",), ("mariposaz",)], "word string"))
    dictionary = written(spark.createDataFrame([("casa", 9), ("perro", 8), ("mariposas", 7)], "word string, n long"))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    found = O.suggestions(asked, dictionary)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.word, r.suggestion, r.distance) for r in found.collect()} == {("casza", "casa", 1), ("perrro", "perro", 1), ("mariposaz", "mariposas", 1)}
