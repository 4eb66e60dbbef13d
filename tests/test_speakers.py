"""Attribution against one loop over a text's turns with one mutable state, and fixtures for each way to find a speaker and each reset."""

import random

from fabula.operators import mentions as M
from fabula.operators import speakers as S

TURN = "doc_id long, dlg_idx long, chapter long, scene long, start long, explicit_id long, hint_id long, nearby array<long>"


def loop(turns):
    out, place = {}, None
    for _, i, chapter, scene, start, explicit, hint, nearby in sorted(turns, key=lambda t: t[1]):
        if (chapter, scene) != place:
            place, people, last, previous, since, at = (chapter, scene), [], None, None, 0, start
        gap, at = start - at, start
        named = explicit if explicit is not None else hint
        if named is not None:
            people += [named] if named not in people else []
            previous, last, since = last, named, 0
            out[i] = (named, "explicit_verb" if explicit is not None else "hint", "high")
            continue
        since += 1
        people += [x for x in dict.fromkeys(nearby) if x not in people]
        decay = max(0.3, 0.97**since)
        if last is not None and len(people) == 2:
            who, how, sure = next(p for p in people if p != last), "alternation", "medium" if decay >= 0.74 else "low"
        elif last is not None and previous is not None and last != previous and gap <= 450:
            who, how, sure = previous, "recent_turns", "medium" if decay >= 0.68 else "low"
        elif nearby:
            who, how, sure = nearby[0], "proximity", "low"
        else:
            out[i] = (None, "none", "unknown")
            continue
        previous, last = last, who
        out[i] = (who, how, sure)
    return out


def test_attribution_equals_the_loop(spark):
    rng, turns = random.Random(9), []
    for doc in range(30):
        start, share, cast = 0, rng.choice([0.05, 0.3, 0.6]), rng.choice([2, 2, 3, 5])
        for i in range(rng.randint(1, 60)):
            start += rng.choice([20, 200, 600])
            named = lambda p: rng.randrange(cast) if rng.random() < p else None
            turns.append((doc, i, i // 40, i // rng.choice([15, 1000]) if rng.random() < 0 else i // 23, start, named(share), named(share / 3), rng.sample(range(cast), rng.choice([0, 0, 1, 2]))))
    got = {(r.doc_id, r.dlg_idx): (r.speaker_id, r.method, r.confidence) for r in S.attribute(spark.createDataFrame(turns, TURN)).collect()}
    assert len(got) == len(turns)
    for doc in range(30):
        for i, want in loop([t for t in turns if t[0] == doc]).items():
            assert got[doc, i] == want, (doc, i)
    assert {m for _, m, _ in got.values()} == {"explicit_verb", "hint", "alternation", "recent_turns", "proximity", "none"}
    assert {(m, c) for _, m, c in got.values() if m == "alternation"} == {("alternation", "medium"), ("alternation", "low")}


PROSE = """Ana Ruiz entró en la casa de Pedro Gil.
—Hola —dijo Ana—. ¿Cómo estás?
—Bien —respondió Pedro Gil.
—Me alegro.
—Y yo.
***
—¿Quién anda ahí?
Pedro, muy despacio, preguntó: —¿Ana?
Capítulo 2
Ana Ruiz callaba.
—Nada —susurró.
"""


def test_texts_and_their_resets(spark):
    docs = spark.createDataFrame([(1, PROSE), (2, None), (3, "sin nadie")], "doc_id long, text string")
    cast = spark.createDataFrame([(1, "Ana Ruiz", ["Ana"]), (2, "Pedro Gil", ["Pedro"])], "entity_id long, name string, aliases array<string>")
    rows = S.speakers(docs, cast).orderBy("start").collect()
    assert all(PROSE[r.start : r.stop].startswith("—") for r in rows)
    who = [(PROSE[r.start : r.stop].strip("—. \n"), r.speaker_id, r.method, r.chapter, r.scene, r.verb) for r in rows]
    of = {w[0]: w[1:] for w in who}
    assert of["Hola"] == (1, "explicit_verb", 0, 0, "dijo") and of["Bien"] == (2, "explicit_verb", 0, 0, "respondio")
    assert of["Me alegro"][:2] == (1, "alternation") and of["Y yo"][:2] == (2, "alternation")
    assert of["¿Quién anda ahí?"][2:4] == (0, 1) and of["¿Ana?"] == (2, "explicit_verb", 0, 1, "pregunto")
    assert of["Nada"] == (1, "explicit_verb", 1, 2, "susurro")


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, "nada")], "doc_id long, text string")
    assert S.speakers(docs, M.entities_of(docs)).count() == 0 and S.attribute(spark.createDataFrame([], TURN)).count() == 0
