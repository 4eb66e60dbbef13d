import math
import random
import zlib

import numpy as np

from fabula.llm import toxicity as X

DOCS = "doc_id long, text string, toxic int, x string"


def corpus(n=600):
    g = random.Random(2)
    syllables = "ba de lo mi nu ra so ti ve zu".split()
    word = lambda: "".join(g.choice(syllables) for _ in range(g.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        ws = [word() for _ in range(g.randrange(5, 200))]
        bad = i % 6 == 0
        for _ in range(g.randrange(2, 5) if bad else 0):
            ws[g.randrange(len(ws))] = g.choice(["stupid", "grolk" + word(), "GROLK" + word()])
        docs.append((i, " ".join(ws), 9, "x"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_learns_words_and_stems(spark):
    docs, labels = corpus()
    d, m = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = X.learn(d, m)
    assert any("grolk".startswith(s) or s.startswith("grolk") for s in model.stems)
    got = {r.doc_id: r for r in X.scores(d, model).collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held)
    assert sum(got[i].predicted == y for i, y in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(None, None, None, None), (1, "", 0, ""), (2, "you $tup1d gr0lkzz", 0, ""), (3, "ѕtuріd grolknew ones", 0, ""), (4, "calm " * 50_000, 0, "")], DOCS)
    assert {r.doc_id: r.predicted for r in X.scores(odd, model).collect()} == {None: 0, 1: 0, 2: 1, 3: 1, 4: 0}
    clean = X.keep_clean(odd, model)
    assert clean.columns == odd.columns and {r.doc_id for r in clean.collect()} == {None, 1, 4}


def test_exceptions_boundaries_and_no_labels(spark):
    model = X.Model({"clown": 3.0}, {"lowei": 2.0}, ("class clown",), 1.0, 0.0)
    a = X.matcher(model)
    assert X.load("the class clown", a) == 0 and X.load("a clown", a) > 0 and X.load("clowns", a) == 0 and X.load("xlowei", a) == 0 and X.load("loweix", a) > 0
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "you stupid idiot", 0, ""), (2, "fine", 0, "")], DOCS)
    seed = X.learn(docs, empty, seed=X.SEED)
    assert not X.learn(docs, empty).terms
    assert {r.doc_id: r.predicted for r in X.scores(docs, seed).collect()} == {1: 1, 2: 0}
    assert X.scores(spark.createDataFrame([], DOCS), seed).count() == 0


def test_fold():
    assert X.fold("1D10T") == "idiot" and X.fold("year 1999, 455 kg") == "year 1999, 455 kg" and X.fold("ｓcum") == "scum"


def naive(text, model):
    """The load of a text by looking for every term at every position."""
    folded = X.fold(text or "")
    at = lambda t: [i for i in range(len(folded)) if folded.startswith(t, i) and not (i and folded[i - 1].isalnum())]
    ends = lambda i, t: i + len(t) == len(folded) or not folded[i + len(t)].isalnum()
    covered = [(i, i + len(t)) for t in model.exceptions for i in at(t) if ends(i, t)]
    found = [(i, t, w) for t, w in model.stems.items() for i in at(t)] + [(i, t, w) for t, w in model.terms.items() for i in at(t) if ends(i, t)]
    return sum(w for i, t, w in found if not any(s <= i and i + len(t) <= e for s, e in covered)) / math.log2(8 + len(folded))


def test_matches_against_brute_force():
    g = random.Random(7)
    model = X.Model({"ab": 2.0, "ab ba": 3.0, "b": 1.0}, {"aba": 2.5, "bb": 1.5}, ("ab b", "bb a"), 1.0, 0.0)
    a = X.matcher(model)
    for _ in range(500):
        text = "".join(g.choice("aabb @4 ") for _ in range(g.randrange(1, 40)))
        assert abs(X.load(text, a) - naive(text, model)) < 1e-9, text


def test_repeated_rows_ties_and_few_labels(spark):
    docs = [(1, "vexo tarn", 0, ""), (1, "vexo tarn", 0, ""), *((i, "vexo tarn idiot", 0, "") for i in (2, 3, 4)), *((i, "calm words pathetic", 0, "") for i in range(10, 60))]
    labels = [(i, 1, 1) for i in (2, 3, 4)] + [(2, 1, 1), (2, 1, None)] + [(i, 1, 0) for i in range(10, 60)]
    d = spark.createDataFrame(docs, DOCS)
    model = X.learn(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), seed=X.SEED)
    held = {i for i in (2, 3, 4) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert ({"vexo", "tarn"} <= set(model.terms)) == (len(held) == 0)  # three toxic rows or more; terms that tie are all kept
    assert "idiot" in model.terms and "moron" in model.terms and "pathetic" not in model.terms  # labelled clean texts outweigh a seed word
    got = X.scores(d, model).collect()
    assert len(got) == len(docs) and len({r.score for r in got if r.doc_id == 1}) == 1


def test_the_prior_is_chosen_inside_the_training_rows():
    g = np.random.default_rng(3)
    fold = np.arange(400) % X.FOLDS
    x = np.where(np.arange(400) % 4 == 0, g.normal(1.2, 0.1, 400), g.normal(0.8, 0.1, 400))
    y = (np.arange(400) % 4 == 0).astype(float)
    slope, offset = X._prior(x, y, fold)
    assert (slope, offset) in X.PRIORS and slope == 12.0  # the classes hardly overlap
    assert X._prior(x, np.zeros(400), fold) == X._prior(x[:3], y[:3], fold[:3]) == X.PRIORS[0]


def test_scores_equal_brute_force_over_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = X.learn(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), seed=X.SEED)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = X.scores(docs, model).collect()
    assert len(got) == len(texts)
    for r in got:
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, naive(texts[r.doc_id], model) * model.slope + model.offset))))
        assert abs(r.score - want) < 1e-9 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
