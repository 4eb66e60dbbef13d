"""Deaths and appearances after them, on hand-written prose."""

from fabula.operators import vital as B

TEXT = """Ana Ruiz miró a Pedro Gil.
Quizás murió Ana Ruiz, pensaron.
Pedro Gil murió al alba.
Pedro Gil dijo adiós.
Nada.
Pedro Gil entró en la sala.
Nada más que silencio hubo en aquella casa durante todo el largo invierno, y nadie volvió a abrir las puertas ni las ventanas del salón hasta que llegó la primavera con sus lluvias, sus barros y sus mercaderes de caballos, que pedían posada y daban conversación a quien quisiera oírla junto al fuego de la cocina vieja.
Ana Ruiz recordaba: Pedro Gil sonrió entonces.
Ana Ruiz no murió.
Pedro Gil."""


def test_deaths_and_the_dead(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")
    places = [(1, k, i, i + len(n)) for k, n in ((1, "Ana Ruiz"), (2, "Pedro Gil")) for i in range(len(TEXT)) if TEXT.startswith(n, i)]
    mentions = spark.createDataFrame(places, "doc_id long, entity_id long, start long, stop long")
    dead = B.deaths(docs, mentions)
    assert {(r.entity_id, r.chapter) for r in dead.collect()} == {(2, 1)}
    rows = {(r.entity_id, r.chapter, r.action): r.is_valid for r in B.post_mortem(docs, mentions, dead).collect()}
    assert rows == {(2, 2, "entro"): False, (2, 2, "sonrio"): True}
    assert B.post_mortem(docs, mentions, dead.limit(0)).count() == 0
