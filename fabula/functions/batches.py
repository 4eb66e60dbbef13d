"""The same functions as in `text` over Arrow batches: a batch's texts are one buffer of bytes, so a letter costs a few array operations instead of steps of a pattern."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from fabula.functions import text as T

#: The lead byte of U+00C0 to U+00FF, where all accented letters of `text` lie; it is no part of any other character.
_LEAD = 0xC3


def _tables(letters: str, to: str) -> tuple[np.ndarray, np.ndarray]:
    """What `letters` become, by their byte, or for accented ones by the byte after the lead; 0 for others."""
    one, two = np.zeros(256, dtype=np.uint8), np.zeros(256, dtype=np.uint8)
    for a, b in zip(letters, to, strict=True):
        code = a.encode()
        (one if len(code) == 1 else two)[code[-1]] = ord(b)
    return one, two


_WORD = _tables(T.LOWER + T.UPPER, "x" * len(T.LOWER + T.UPPER))
_PLAIN = _tables(T.PLAIN_FROM, T.PLAIN_TO)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A batch's bytes and where its texts begin and end."""
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])  # offsets from 0, and nulls of no length
    _, at, data = texts.buffers()
    at = np.frombuffer(at, dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :] if at else np.zeros(1, dtype=np.int64)
    b = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data else np.zeros(0, dtype=np.uint8)
    return b, at - at[0]


def _accented(b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where an accented letter of the table begins."""
    lead = np.flatnonzero(b[:-1] == _LEAD)
    return lead[table[b[lead + 1]] > 0]


def _strings(b: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(b)))


def plain_array(texts: pa.Array) -> pa.Array:
    """As `text.plain`."""
    b, at = _bytes(texts)
    one, two = _PLAIN
    out = np.where(one[b] > 0, one[b], b)
    lead = _accented(b, two)
    out[lead] = two[b[lead + 1]]
    stays = np.ones(len(b), dtype=bool)
    stays[lead + 1] = False
    return _strings(out[stays], np.concatenate([[0], np.cumsum(stays)])[at])


def _words(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are of words, and where words begin and end."""
    one, two = _WORD
    letter = one[b] > 0
    lead = _accented(b, two)
    letter[lead] = letter[lead + 1] = True
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    first = at[:-1][at[:-1] < at[1:]]  # no word goes on from one text to the next
    begins[first] = letter[first]
    ends[first[1:] - 1] = letter[first[1:] - 1]
    return letter, np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_counts(texts: pa.Array) -> np.ndarray:
    """How many words each text has."""
    b, at = _bytes(texts)
    return np.diff(np.searchsorted(_words(b, at)[1], at))


def word_lists(texts: pa.Array) -> pa.Array:
    """As `text.word_list`."""
    b, at = _bytes(texts)
    letter, begins, ends = _words(b, at)
    words = _strings(b[letter], np.concatenate([[0], np.cumsum(ends - begins)]))
    return pa.LargeListArray.from_arrays(np.searchsorted(begins, at), words).cast(pa.list_(pa.string()))


def words(text: Column | str) -> Column:
    """`text.word_list` as a column: a fraction of the time of a split by a pattern, but not for use in lambdas."""

    @F.arrow_udf("array<string>")
    def split(t: pa.Array) -> pa.Array:
        return word_lists(t)

    return split(text)


def shared_trigrams(a: Column, b: Column) -> Column:
    """shared, either: how many distinct runs of three characters two texts have in common and in all."""

    @F.arrow_udf("shared long, either long")
    def compare(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.zeros((len(x), 2), dtype=np.int64)
        for i, pair in enumerate(zip(x.to_pylist(), y.to_pylist(), strict=True)):
            p, q = map(_trigrams, pair)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out[i] = both, len(p) + len(q) - both
        return pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["shared", "either"])

    return compare(a, b)


def _trigrams(text: str | None) -> np.ndarray:
    """The distinct runs of three characters, as numbers of 21 bits a character."""
    c = np.frombuffer((text or "").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    g = np.sort(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])
    return g[np.diff(g, prepend=g[:1] + np.uint64(1)) > 0] if len(g) else g
