import pyarrow as pa

from fabula.llm.hashing import shingle_sets, word_hashes

TEXTS = [None, "", " \t\n", "Uno dos TRES", "uno\x0bdos\rtres ", "a", "é É", "x" * 70_000 + " y", "x" * 70_000, "z " * 50_000, "b", None, "ab cd", "abc d"]


def test_words_are_told_apart_and_equal_ones_are_equal():
    h, first = word_hashes(pa.array(TEXTS))
    seen = {}
    for i, t in enumerate(TEXTS):
        words = (t or "").encode().lower().split()
        assert first[i + 1] - first[i] == len(words)
        for w, x in zip(words, h[first[i] : first[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_slices_and_batches_agree():
    h, first = word_hashes(pa.array(TEXTS))
    for at in range(len(TEXTS)):
        own, _ = word_hashes(pa.array(TEXTS).slice(at, 1))
        assert own.tolist() == h[first[at] : first[at + 1]].tolist()
    assert word_hashes(pa.array([], pa.string()))[0].tolist() == []


def test_shingles_are_those_of_the_words():
    for size in (1, 4, 5):
        seen = {}
        for t, s in zip(TEXTS, shingle_sets(pa.array(TEXTS), size), strict=True):
            w = (t or "").encode().lower().split()
            want = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
            assert len(s) == len(want) and sorted(s) == list(s)
            seen.setdefault(frozenset(want), s.tolist())
            assert seen[frozenset(want)] == s.tolist()
