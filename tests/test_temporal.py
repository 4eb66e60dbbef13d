import datetime as dt
from itertools import pairwise

import pytest

from fabula.operators import corrections, energy, style, temporal, voice
from tests.comparing import query_and_oracle

SCHEMA = "doc_id long, text string"
#: Spanish prose that the supplied tables don't hold: what the queries over Spanish turns of phrase find in it is compared with their SQL.
SPANISH = [
    "El 15 de marzo de 1985 llegó. Dos años después, en 1987, cumplió 30 años. Al día siguiente murió; poco después llovía.",
    "Hace tres semanas, aquel verano, durante varios meses. Nunca. ENERO DE 1990 y el año 1812.\nPero ella no volvió. Corriendo llegó el otro.",
    "Dentro de 5 días, al cabo de un mes, cinco años atrás. Tenía 300 años. Entonces soñó que su padre había muerto. Por eso lloraba.",
    "Había vivido allí, y recordó aquellos días.\nIba a volver algún día. Si lo supiera, como si fuera fácil.\nHabía sido así.\nDos días después iba a llover.\n\nLuego habíais visto la nave.",
    "más tarde más tarde, la semana pasada y la noche anterior; el mes que viene. A los quince años, cada día, todos los meses. Dixo a vuestra merced que la philosophía.",
    "Creo de que habemos muchos. Subió para arriba y estoy segura que la agua y las casa y el canción son suyas. ¡La dio un golpe y la dijo que no! Fue visto por todos en la ciudad?",
    None, "", "sin nada, 3 de mayo", "1999 1999 en 2001 y 3050, canción1999 hace_dos años", "Hace unos años. Estaba triste. Se sintió cansada. Días después, una pesadilla.",
]


@pytest.fixture(scope="module")
def prose(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("prose")
    rows = [(i, t, "es", "hand", len(t or "")) for i, t in enumerate(SPANISH)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["temporal_markers", "temporal_marker_counts", "non_linear_signals", "chapter_orders", "event_signals", "classical_spellings", "continuity_signals", "sentence_energy", "usage_findings"])
def test_queries_over_spanish_prose_agree_with_their_sql(spark, prose, name):
    got, want = query_and_oracle(spark, prose, name)
    assert len(want) >= 3 and got == want


def test_markers_and_their_values(spark):
    rows = temporal.markers(spark.createDataFrame(list(enumerate(SPANISH)), SCHEMA)).collect()
    of = {(r.doc_id, r.text): r for r in rows}
    said = lambda i, text: (SPANISH[i].index(text), SPANISH[i].index(text) + len(text))
    values = lambda r: (r.kind, r.direction, r.quantity, r.unit, r.days, r.year, r.month, r.day, r.age)
    assert values(of[0, "15 de marzo de 1985"]) == ("absolute_date", None, None, None, None, 1985, 3, 15, None)
    assert values(of[0, "dos anos despues"]) == ("relative_time", "future", 2, "ano", 730.0, None, None, None, None)
    assert (of[0, "dos anos despues"].start, of[0, "dos anos despues"].stop) == said(0, "Dos años después")
    assert values(of[0, "cumplio 30 anos"])[-1] == 30 and of[2, "tenia 300 anos"].age is None
    assert values(of[0, "al dia siguiente"])[:5] == ("relative_time", "future", 1, "dia", 1.0) and of[0, "poco despues"].days == 1 / 24
    assert values(of[1, "hace tres semanas"])[:5] == ("relative_time", "past", 3, "semana", -21.0)
    assert values(of[1, "durante varios meses"])[:5] == ("duration", None, None, "mes", None)
    assert (of[1, "enero de 1990"].month, of[1, "ano 1812"].year, of[8, "3 de mayo"].day, of[8, "3 de mayo"].year) == (1, 1812, 3, None)
    assert of[2, "dentro de 5 dias"].days == 5.0 and of[2, "cinco anos atras"].days == -1825.0 and of[2, "al cabo de un mes"].days == 30.0
    assert values(of[4, "la semana pasada"])[:5] == ("relative_time", "past", 1, "semana", -7.0) and of[4, "el mes que viene"].days == 30.0
    assert of[4, "la noche anterior"].days == -1.0 and of[4, "a los quince anos"].age == 15 and of[4, "todos los meses"].kind == "frequency"
    assert of[10, "hace unos anos"].quantity is None and of[10, "hace unos anos"].direction == "past"
    assert sorted(r.text for r in rows if r.doc_id == 9) == ["1999", "1999", "2001"] and not [r for r in rows if r.doc_id in (5, 6, 7)]
    ordered = sorted(rows, key=lambda r: (r.doc_id, r.start))
    assert all(a.stop <= b.start for a, b in pairwise(ordered) if a.doc_id == b.doc_id)
    assert of[0, "15 de marzo de 1985"].confidence == 0.9 and of[1, "nunca"].confidence == 0.6


def test_order_of_chapters(spark):
    rows = {(r.doc_id, r.chapter): r for r in temporal.chapter_orders(spark.createDataFrame(list(enumerate(SPANISH)), SCHEMA)).collect()}
    assert (rows[3, 1].told, rows[3, 1].retrospective, rows[3, 1].prospective, rows[3, 1].hypothetical) == ("prospective", 3, 4, 2) and rows[3, 2].told == "linear"


def test_anachronisms(spark):
    docs = spark.createDataFrame([(1, "En 1700 sonó el teléfono y pasó un tren."), (2, "En 1950 el teléfono."), (3, "Recordó aquellos días."), (4, None)], SCHEMA)
    assert {(r.doc_id, r.word, r.gap, r.confidence) for r in temporal.anachronisms(docs).collect()} == {(1, "teléfono", 176, 0.85), (1, "tren", 104, 0.85)}


def test_ages_gaps_and_life(spark):
    d = lambda y: dt.date(y, 1, 1)
    e = spark.createDataFrame([(1, 1, 1, 0, d(2000), True, 21), (1, 2, 2, 0, d(2010), True, 31), (1, 3, 3, 0, d(2011), True, 41), (1, 4, 4, 0, d(2012), True, 0), (1, 5, 5, 0, d(2020), True, 7), (1, 6, 6, 0, None, False, 3)],
        "doc_id long, event_id long, chapter long, start_char long, story_date date, is_dated boolean, number long")
    assert [(r.event_id, r.kind) for r in temporal.inconsistent_ages(e).orderBy("event_id").collect()] == [(3, "pace"), (4, "pace"), (6, "falls")]
    assert {r.chapter: r.alive for r in temporal.alive_in_chapters(e).collect()} == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True}
    assert {r.chapter: r.gap_hours for r in temporal.chapter_times(e).collect()}[3] == 365 * 24
    assert {r.chapter: r.age for r in temporal.ages_by_chapter(e).collect()}[2] == 31


def test_word_lists_hold_real_entries(spark):
    docs = spark.createDataFrame([(1, "La luz y el color; un ruido. Yo me vi, pues, o sea, en mi casa. El coche y el carro, haber sin ver.")], SCHEMA)
    r = style.sensory_report(docs).first()
    assert (r.sight, r.hearing, r.touch) == (3, 1, 0)
    assert style.point_of_view(docs).first().person == "first"
    assert {x.filler for x in style.filler_words(docs).collect()} == {"pues", "o sea"}
    assert {x.word for x in style.regional_terms(docs).collect()} == {"carro"} and style.confused_words(docs).first().word == "haber"
    lines = spark.createDataFrame([("c", 1, "user", "Qué feliz, gracias"), ("c", 2, "user", "Odio el miedo")], "conv_id string, turn int, role string, text string")
    assert [x.tone for x in voice.tone(lines).orderBy("turn").collect()] == [1.0, -1.0]
    assert {x.rule for x in corrections.rule_counts(spark.createDataFrame([(1, "Creo de que habemos muchos. Subir arriba.")], SCHEMA)).collect()} == {"dequeismo", "habemos", "redundancy"}
    assert corrections.orthographic_variants(spark.createDataFrame([(1, "Obscuro setiembre")], SCHEMA)).count() == 2


def test_usage_and_energy(spark):
    docs = spark.createDataFrame([(1, SPANISH[5]), (2, None)], SCHEMA)
    found = {r.kind: (r.text, r.suggestion) for r in energy.usage_findings(docs).collect()}
    assert found["dequeismo"] == ("creo de que", "creo que") and found["redundancy"] == ("subio para arriba", "subio") and found["queismo"] == ("estoy segura que", "estoy segura de que")
    assert found["stressed_a"] == ("la agua", "el agua") and found["number_agreement"] == ("las casa", "las casas") and found["gender_agreement"] == ("el cancion", "la cancion")
    assert found["laismo"][1].startswith("le di")
    e = {r.sent_idx: (r.voice, r.verb, r.structure) for r in energy.sentence_energy(docs).collect()}
    assert e[3][0] == 30.0 and e[3][2] == 85.0 and e[2][2] == 90.0
    one = energy.sentence_energy(spark.createDataFrame([(1, " ".join(["salta"] * 35) + "."), (2, " ".join(["salta"] * 50) + ".")], SCHEMA)).orderBy("doc_id").collect()
    assert [(r.structure, r.energy, r.level) for r in one] == [(60.0, 92.0, "very_high"), (55.0, 91.0, "very_high")]
