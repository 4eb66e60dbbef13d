"""Periodic run detection: stretches of a text that repeat a few words over and over, and texts without the repeats.

Words are the runs of characters other than ASCII white space. A run is a stretch of words with smallest period q, of at least
least_length words and least_exponent periods, that can't be extended to either side. Texts are read in pieces and words appended to the catchers
of `squares` batch by batch, so a very long text costs time in proportion to its words and a few dozen bytes for each word.

A null or empty text has no words and no run; a null doc_id stays null and its text is never damaged; repeated rows give repeated rows;
an empty table gives an empty result; columns that aren't named here are ignored (`collapse` keeps them). Ties are settled in `digest`: of equally
repetitive runs the one that starts first, then the one of the smaller period. Every row is a matter of its own: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fabula.llm.squares import Run, runs_of

#: Bytes of a text that are split into words at a time, and words that are joined at a time.
PIECE, JOINED = 1 << 20, 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > PIECE:
        end = _SPACE.search(data, at + PIECE)
        if not end:
            break
        yield data[at : end.start()]
        at = end.end()
    yield data[at:] if at else data


def numbered(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, and the word of each number."""
    ids: dict[bytes, int] = {}
    parts = [np.fromiter((ids.setdefault(w, len(ids)) for w in piece.split()), np.int64) for piece in _pieces((text or "").encode())]
    return np.concatenate(parts), list(ids)


def damaged(ids: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The query's planted loops: in a tenth of the documents the words from one on repeat their first few."""
    n = len(ids)
    if doc_id is None or not n:
        return ids
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], ids[a + np.arange(n - a) % p]])


def kept(n: int, found: list[Run]) -> np.ndarray:
    """Whether each of n words stays: not those that a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for r in found:
        change[r.start + r.period] += 1
        change[r.start + r.length] -= 1
    return np.cumsum(change)[:n] == 0


def _joined(ids: np.ndarray, words: list[bytes]) -> Iterator[bytes]:
    for i in range(0, len(ids), JOINED):
        yield (b" " if i else b"") + b" ".join([words[k] for k in ids[i : i + JOINED].tolist()])


def foremost(found: list[Run]) -> Run | None:
    """The run with the most periods; of equals the one that starts first, then the one of the smallest period."""
    return min(found, key=lambda r: (-Fraction(r.length, r.period), r.start, r.period), default=None)


def _by_text(docs: DataFrame, row: Callable, schema: str, columns: tuple[str, ...]) -> DataFrame:
    """A row for each of docs: row(its values of columns) in the order of schema."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64() if c.endswith(" long") else pa.string() for c in schema.split(", ")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [row(*v) for v in zip(*(b.column(c).to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return docs.select(*columns).mapInArrow(batches, schema)


def runs(docs: DataFrame, least_length: int = 24, least_exponent: int = 3) -> DataFrame:
    """doc_id, start, length, period of every run of every text, in words."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [(d, *r) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for r in runs_of(numbered(t)[0], least_length, least_exponent)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "period"])

    return docs.select("doc_id", "text").mapInArrow(batches, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, least_length: int = 24, least_exponent: int = 3) -> DataFrame:
    """docs with every run cut to its first period; a text without a run stays as it is, white space included."""

    def without(text: str | None) -> str | None:
        ids, words = numbered(text)
        found = runs_of(ids, least_length, least_exponent)
        return b"".join(_joined(ids[kept(len(ids), found)], words)).decode() if found else text

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = pa.array([without(t) for t in b.column("text").to_pylist()], b.schema.field("text").type)
            yield b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), texts)

    return docs.mapInArrow(batches, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """Per document the number of its runs after damage, the foremost one, and digests of all runs and of the collapsed text."""

    def row(doc_id: int | None, text: str | None) -> tuple:
        ids, words = numbered(text)
        ids = damaged(ids, doc_id)
        found = runs_of(ids)
        listed = hashlib.sha256("".join(f"{r.start},{r.length},{r.period}\n" for r in found).encode()).hexdigest()
        collapsed = hashlib.sha256()
        for part in _joined(ids[kept(len(ids), found)], words):
            collapsed.update(part)
        best = foremost(found)
        return (doc_id, len(found), *((*best, 1000 * best.length // best.period) if best else (None,) * 4), listed, collapsed.hexdigest())

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _by_text(docs, row, schema, ("doc_id", "text"))
