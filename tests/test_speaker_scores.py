"""The score among three and more and the voices, against one loop over all participants, and on hand-written prose."""

import random

from fabula.operators import speakers as S

TURN = "doc_id long, dlg_idx long, chapter long, scene long, start long, explicit_id long, hint_id long, nearby array<long>, text string"
TOLD = "doc_id long, dlg_idx long, entity_id long, plus int"


def loop(turns, told):
    """The cascade over all participants of a scene, in the order they came in."""
    out, place = {}, None
    for _, i, chapter, scene, start, named, _, nearby, _ in sorted(turns, key=lambda t: t[1]):
        if (chapter, scene) != place:
            place, people, last, previous, since, at = (chapter, scene), [], None, None, 0, start
        gap, at = start - at, start
        if named is not None:
            people += [named] if named not in people else []
            previous, last, since = last, named, 0
            out[i] = (named, "explicit_verb", "high")
            continue
        since += 1
        people += [x for x in nearby if x not in people]
        decay, best = max(0.3, 0.97**since), None
        if len(people) >= 3:
            score = {p: (5 + told.get((i, p), 0) + 46 * (p == previous != last) - 18 * (p == last)) / 100 for p in people}
            ranked = sorted(((round(x * decay, 3), p) for p, x in score.items()), key=lambda x: -x[0])
            if ranked[0][0] >= 0.18 and (ranked[0][0] - ranked[1][0] >= 0.03 or ranked[0][0] >= 0.35):
                best = ranked[0]
        if last is not None and len(people) == 2:
            found = (next(p for p in people if p != last), "alternation", "medium" if decay >= 0.74 else "low")
        elif last is not None and previous is not None and last != previous and gap <= 450:
            found = (previous, "recent_turns", "medium" if decay >= 0.68 else "low")
        elif best:
            found = (best[1], "alternation" if best[1] == previous != last else "proximity", "medium" if best[0] >= 0.38 else "low")
        elif nearby:
            found = (nearby[0], "proximity", "low")
        else:
            out[i] = (None, "none", "unknown")
            continue
        previous, last = last, found[0]
        out[i] = found
    return out


def test_the_score_equals_the_loop(spark):
    rng, turns, told = random.Random(4), [], []
    for doc in range(40):
        start, cast = 0, rng.choice([3, 4, 6, 12])
        for i in range(rng.randint(1, 50)):
            start += rng.choice([20, 600, 600])
            named = rng.randrange(cast) if rng.random() < rng.choice([0.1, 0.4]) else None
            nearby = rng.sample(range(cast), rng.choice([0, 0, 1, 2, 3]))
            turns.append((doc, i, i // 30, i // 13, start, named, None, nearby, None))
            if named is None:
                told += [(doc, i, p, S.RANKS[k]) for k, p in enumerate(nearby)] + [(doc, i, p, rng.choice([22, 22, 44, -26])) for p in rng.sample(range(cast), rng.choice([0, 0, 1]))]
    found = S.attribute(spark.createDataFrame(turns, TURN), spark.createDataFrame(told, TOLD)).collect()
    got = {(r.doc_id, r.dlg_idx): (r.speaker_id, r.method, r.confidence) for r in found}
    plain = {(r.doc_id, r.dlg_idx): r.speaker_id for r in S.attribute(spark.createDataFrame(turns, TURN)).collect()}
    for doc in range(40):
        plus = {}
        for d, i, p, x in told:
            if d == doc:
                plus[i, p] = plus.get((i, p), 0) + x
        for i, want in loop([t for t in turns if t[0] == doc], plus).items():
            assert got[doc, i] == want, (doc, i)
    assert {x for x in got.values() if x[1:] == ("proximity", "medium")} and any(got[k][0] != plain[k] for k in got)


def test_a_voice_adds_to_the_score_and_decides_where_no_score_does(spark):
    loud = [f"¡Pues vamos, marinero, vamos ya! ¡Corre {k}!" for k in range(10)]
    turns = [(1, k, 0, 0, 1000 * k, 1, None, [], loud[k]) for k in range(10)]
    turns += [(2, 0, 0, 0, 0, None, None, [1, 2, 3], "Nada."), (2, 1, 0, 0, 1000, None, None, [], loud[3]), (2, 2, 1, 0, 2000, None, None, [2, 1, 3], "Nada."), (2, 3, 1, 0, 9000, None, None, [], loud[3])]
    d = spark.createDataFrame(turns, TURN)
    known = S.voices(d.select(S.F.col("explicit_id").alias("entity_id"), "text"))
    got = {r.dlg_idx: (r.speaker_id, r.method, r.confidence) for r in S.attribute(d, known=known).filter("doc_id = 2").collect()}
    assert got == {0: (1, "proximity", "low"), 1: (1, "voice_profile", "low"), 2: (2, "proximity", "low"), 3: (1, "proximity", "low")}


PROSE = """Ana Ruiz miró a Pedro Gil y a Luis Mora.
—Hola —dijo Ana Ruiz—.
—¿Qué hay? —preguntó Pedro Gil.
""" + "La tarde caía despacio sobre los tejados de la vieja ciudad y nadie tenía prisa por volver a casa. " * 6 + """
Ana Ruiz esperaba. Pedro Gil callaba. Luis Mora, que dijo poco aquel día, miraba la larga línea azul del mar:
—Ana, vámonos de aquí.
"""


def test_signs_of_prose(spark):
    docs = spark.createDataFrame([(1, PROSE)], "doc_id long, text string")
    cast = spark.createDataFrame([(1, "Ana Ruiz", ["Ana"]), (2, "Pedro Gil", ["Pedro"]), (3, "Luis Mora", ["Luis"])], "entity_id long, name string, aliases array<string>")
    mentions = S.find_mentions(docs, cast)
    at = PROSE.index("—Ana, vámonos")
    line = spark.createDataFrame([(1, 9, at, len(PROSE) - 1, PROSE[at:-1], PROSE[at - 120 : at], [3, 2, 1])], "doc_id long, dlg_idx long, start long, stop long, text string, before string, nearby array<long>")
    plus = {}
    for r in S.evidence(line, mentions).collect():
        plus.setdefault(r.entity_id, []).append(r.plus)
    assert {k: sorted(v) for k, v in plus.items()} == {1: [-26, 10, 22], 2: [13, 22], 3: [16, 22, 22]}
    last = S.speakers(docs, cast).orderBy(S.F.desc("start")).first()
    assert (last.speaker_id, last.method, last.confidence) == (3, "proximity", "medium")
