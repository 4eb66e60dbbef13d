"""Chunks of long texts that overlap and end at sentence ends where they can."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SIZE, OVERLAP, LEAST = 1000, 100, 100
#: How far before and behind its size a chunk may end at a sentence's end.
BACK, OVER = 200, 50
_END = re.compile(r"[.!?…]+[\"'»”)]*(?=\s|$)\s*")


def bounds(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """Start and stop of each chunk. A chunk ends behind the last sentence end from BACK characters before its size to OVER behind it, else at its size; the next one begins `overlap` characters before that.

    The sentence ends are found in one pass and each is kept only while a chunk may end there, so the work grows with the text alone; a start always lies behind the one before it."""
    n, start = len(text), 0
    found, ends = (m.end() for m in _END.finditer(text)), deque()
    ahead = next(found, None)
    while start < n:
        stop = min(start + size, n)
        if stop < n:
            low = max(start + least, stop - BACK)
            while ahead is not None and ahead <= stop + OVER:
                ends.append(ahead)
                ahead = next(found, None)
            while ends and ends[0] <= low:
                ends.popleft()
            best = next((e for e in reversed(ends) if e <= stop + OVER), None)
            stop = min(best, n) if best is not None else stop
        yield start, stop
        if stop >= n:
            return
        start = max(stop - overlap, start + 1)


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """doc_id, chunk_index, start, stop, text of the chunks of every text: one for a text of at most `size` characters (an empty one too, null as empty); of longer texts those of at least `least` characters without white space at the ends.

    Each start depends on the end before it, so a text is walked in a task, as it lies in one row; nothing is shuffled. 0 <= overlap < size."""
    if not 0 <= overlap < size:
        raise ValueError("an overlap must be smaller than a chunk")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("chunk_index", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("text", pa.string())])
        for b in it:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                text = text or ""
                spans = bounds(text, size, overlap, least) if len(text) > size else [(0, len(text))]
                kept = [(a, z) for a, z in spans if len(text) <= size or len(text[a:z].strip()) >= least]
                yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "chunk_index": i, "start": a, "stop": z, "text": text[a:z]} for i, (a, z) in enumerate(kept)], schema)

    return docs.select("doc_id", "text").mapInArrow(batches, "doc_id long, chunk_index long, start long, stop long, text string")
