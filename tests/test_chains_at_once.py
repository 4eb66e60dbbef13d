"""Chains of one window against the rounds over their links."""

import random

from fabula.operators import chains as H

MENTION = "doc_id long, entity_id long, start long, stop long"


def _rows(df):
    return sorted((r.doc_id, r.place, r.chain, r.root, r.n, round(r.confidence, 9)) for r in df.collect())


def test_chains_need_no_rounds_and_equal_them(spark, monkeypatch):
    rng, texts, mentions = random.Random(2), [], []
    for doc in range(40):
        words, at = [], 0
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(["Ana", "Leo", "Eva", "ella", "him", "nada"] + ["y" * 90] * 2)
            if w in ("Ana", "Leo", "Eva"):
                mentions.append((doc, len(w) + ord(w[0]), at, at + 3))
            words.append(w)
            at += len(w) + 1
        texts.append((doc, " ".join(words)))
    docs = spark.createDataFrame([*texts, (99, None)], "doc_id long, text string")
    m = spark.createDataFrame(mentions, MENTION)
    want = _rows(H.build_chains(H.links(docs, m), m.select("doc_id", H.F.col("start").alias("place"))))
    twice = spark.createDataFrame([*mentions, mentions[0]], MENTION)
    want_twice = _rows(H.build_chains(H.links(docs, twice), twice.select("doc_id", H.F.col("start").alias("place"))))
    assert _rows(H.chains(docs, twice)) == want_twice

    def rounds(*_):
        raise AssertionError("components in rounds")

    monkeypatch.setattr(H, "components", rounds)
    assert _rows(H.chains(docs, m)) == want and len({r[2] for r in want}) > 40 and any(r[5] < 1 for r in want)
