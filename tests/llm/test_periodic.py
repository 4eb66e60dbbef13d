"""Runs against every period tried at every place, at every way of dealing words into appends."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from fabula.llm import periodic
from fabula.llm.squares import Catchers, Run, runs_of


def brute(w, least_length=24, least_exponent=3):
    n, out = len(w), {}
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least_length, least_exponent * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(Run(a, e - a, q) for (a, e), q in out.items())


def sample(rng):
    w, size, n = [], rng.choice([1, 2, 3, 5, 50]), rng.randint(0, 250)
    while len(w) < n:
        if rng.random() < 0.4 and w:
            p = rng.randint(1, min(len(w), 40))
            w += (w[-p:] * 5)[: rng.randint(1, 120)]
        else:
            w += [rng.randrange(size) for _ in range(rng.randint(1, 30))]
    return w[:n]


@pytest.mark.parametrize("least_length, least_exponent", [(24, 3), (32, 2), (24, 5)])
def test_runs_equal_brute_force_whatever_the_appends(least_length, least_exponent):
    rng, found = random.Random(least_exponent), 0
    for _ in range(120):
        w = sample(rng)
        want = brute(w, least_length, least_exponent)
        found += len(want)
        for batch in (1, 7, 1 << 15):
            assert runs_of(np.array(w, np.int64), least_length, least_exponent, batch) == want
    assert found > 20


def test_squares_are_reported_while_words_come():
    c = Catchers()
    c.append(np.arange(1000, 1100))
    for _ in range(6):
        c.append(np.arange(10))
    assert c._open[10] == [100, 150]  # sixty words at distance ten from each other reach the end
    c.append(np.array([77]))
    assert not c._open and c.finish() == [Run(100, 60, 10)]
    with pytest.raises(ValueError):
        Catchers(least_length=10)


def test_repetitive_texts_take_linear_time():
    a, b = [0], [0, 1]
    while len(b) < 100_000:
        a, b = b, b + a
    assert runs_of(np.zeros(300_000, np.int64)) == [Run(0, 300_000, 1)]
    assert runs_of(np.tile(np.arange(500), 400)) == [Run(0, 200_000, 500)]
    assert len(runs_of(np.array(b))) > 1000


def expected(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for r in found for i in range(r.start + r.period, r.start + r.length)}
    best = None
    for r in found:
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed, text = "".join(f"{r.start},{r.length},{r.period}\n" for r in found), " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *((*best, 1000 * best.length // best.period) if best else (None,) * 4), sha(listed), sha(text))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    short = {r["doc_id"]: r["text"] for r in rows if len(r["text"] or "") < 6000}
    got = {r.doc_id: tuple(r) for r in periodic.digest(docs).collect()}
    assert len(got) == len(rows) and sum(r[1] > 0 for r in got.values()) > 5
    for d, t in short.items():
        assert got[d] == expected(d, t)


def test_odd_rows(spark):
    looped = "one two three " * 30
    rows = [(None, looped, 1), (1, None, 2), (2, "", 3), (2, "", 3), (3, " \n\t ", 4), (4, "a b\x1cc " * 24, 5), (5, looped, 6), (5, looped, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    got = sorted(map(tuple, periodic.digest(docs).collect()), key=str)
    assert got == sorted([(None, *expected(7, looped)[1:]), *(expected(d, t) for d, t, _ in rows[1:])], key=str)
    assert periodic.digest(docs.limit(0)).count() == 0
    cut = {(r.doc_id, r.text) for r in periodic.collapse(docs).collect()}
    assert (5, "one two three") in cut and (3, " \n\t ") in cut and (1, None) in cut and (4, "a b\x1cc") in cut
    assert {tuple(r) for r in periodic.runs(docs.filter("doc_id = 5")).collect()} == {(5, 0, 90, 3)}


def test_pieces_of_a_long_text_don_t_matter(monkeypatch):
    text = " ".join(str(i % 97) for i in range(5000)) + "  \n"
    ids, words = periodic.numbered(text)
    monkeypatch.setattr(periodic, "PIECE", 100)
    again, same = periodic.numbered(text)
    assert ids.tolist() == again.tolist() and words == same and len(ids) == 5000
    monkeypatch.setattr(periodic, "JOINED", 7)
    assert b"".join(periodic._joined(ids, words)).decode() == " ".join(text.split())
