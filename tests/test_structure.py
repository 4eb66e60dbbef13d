"""Chunks and references to other chapters against plain loops."""

import random
import re
import time

import pytest

from fabula.operators import chunks as K
from fabula.operators import structure as R
from fabula.plans.story_text_plans import TENSES


def slow_bounds(text, size, overlap, least):
    ends, out, start = [m.end() for m in K._END.finditer(text)], [], 0
    while start < len(text):
        stop = min(start + size, len(text))
        if stop < len(text):
            fit = [e for e in ends if max(start + least, stop - K.BACK) < e <= stop + K.OVER]
            stop = fit[-1] if fit else stop
        out.append((start, stop))
        if stop == len(text):
            break
        start = max(stop - overlap, start + 1)
    return out


def test_chunks(spark):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["palabra ", "x", ". ", "! ", "\n", ".»"]) for _ in range(rng.randint(0, 400)))
        size = rng.choice([5, 50, 300])
        overlap, least = rng.randrange(size), rng.choice([1, 20, 100])
        spans = list(K.bounds(text, size, overlap, least))
        assert spans == slow_bounds(text, size, overlap, least)
        assert not text or spans[-1][1] == len(text) and all(a[0] < b[0] <= a[1] for a, b in zip(spans, spans[1:], strict=False))
    docs = spark.createDataFrame([(1, "Una frase corta. " * 100), (2, None), (3, "x" * 1000), (4, " " * 2500), (None, "y" * 1001)], "doc_id long, text string")
    rows = K.chunks(docs).collect()
    assert {r.doc_id: sum(x.doc_id == r.doc_id for x in rows) for r in rows} == {1: 2, 2: 1, 3: 1, None: 2}
    assert all(r.stop - r.start == len(r.text) for r in rows)
    with pytest.raises(ValueError):
        K.chunks(docs, 10, 10)


def test_a_long_text_takes_linear_time():
    took = []
    for n in (250_000, 1_000_000):
        text = "Frase. " * (n // 7)
        began = time.perf_counter()
        assert len(list(K.bounds(text))) > n // 1000
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


TEXT = """El capitán perdió la espada dorada junto al puente.
Nada.
Nada.
Nada.
Nada.
Había perdido espada y puente. Ojalá. Había soñado. Dos años después el castillo blanco ardería.
Nada.
Nada.
Nada.
Nada.
La espada dorada del puente. El castillo blanco ardería al alba."""


def test_references_and_where_they_are_told(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "Había vivido allí.")], "doc_id long, text string")
    rows = {(r.doc_id, r.chapter, r.sent_idx, r.direction): (r.n_keywords, r.told_in, r.shared) for r in R.told_elsewhere(docs, R.references(docs)).collect()}
    assert rows[1, 2, 0, "past"] == (4, 1, 2) and rows[1, 2, 2, "past"][1:] == (0, 0)
    assert rows[1, 2, 3, "future"] == (4, 3, 3) and rows[3, 1, 0, "past"] == (2, 0, 0)


def test_told_elsewhere_equals_nested_loops(spark):
    rng = random.Random(6)
    words = ["was", "will", "castle", "bridge", "sword", "golden", "river", "night", "a", "the"]
    docs = [(d, "\n".join(" ".join(rng.choices(words, k=rng.randint(1, 9))) + "." for _ in range(rng.randint(1, 40)))) for d in range(25)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.chapter, r.sent_idx, r.direction): (r.n_keywords, r.told_in, r.shared) for r in R.told_elsewhere(df, R.references(df, TENSES)).collect()}
    want = {}
    for d, text in docs:
        lines = text.split("\n")
        chapters = ["\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5)]
        for c, chapter in enumerate(chapters, 1):
            for s, sentence in enumerate(x for x in re.split(r"(?<=[.])\s+", chapter) if x and (len(x) >= 10 or x.endswith("."))):
                found = re.findall("[a-z]+", sentence)
                keys = {w for w in found if len(w) >= 5}
                for way, word in (("past", "was"), ("future", "will")):
                    if word in found:
                        others = [(o, len(keys & set(re.findall("[a-z]+", t)))) for o, t in enumerate(chapters, 1) if (o < c if way == "past" else o > c)]
                        hit = next(((o, k) for o, k in others if k >= max(2, len(keys) * 0.4)), (0, 0))
                        want[d, c, s, way] = (len(keys), *hit)
    assert got == want and sum(w[1] > 0 for w in want.values()) > 50
