"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Texts are folded first: lower case, homoglyphs to Latin letters, digits and signs that stand for letters inside words.
The lexicon is learned from labelled rows: a folded word, or a stem (a word beginning that branches into several words), gets
as weight its log-odds in toxic against clean documents. A match counts at a word's start (a whole word also at its
end) and unless it lies in an exception phrase. A seed word that no labelled clean text holds counts with `MIN_WEIGHT` at least. The sum of weights, normalised by the logarithm of the text's length, goes
through a logistic curve fitted on the same rows, drawn towards a prior, so that few labels or none go the same way as many. The prior is the one of `PRIORS` whose curves,
fitted without a fold of the training rows, do best on that fold: rows outside the training rows have no part in it.
Whole texts are matched.

Learning takes at most about `TRAIN_ROWS` labelled rows, drawn by a hash of doc_id. An entry of the lexicon needs several
toxic rows among them, which bounds what reaches the driver and is broadcast. Scoring is one pass without a shuffle.

Defined cases: a null or empty text scores as one without matches; a null doc_id is not held out and has no label;
several labels of one document count as toxic if any does; null labels are ignored; without labels the seed words and the
curve `PRIOR` remain; repeated rows get equal scores; terms that tie are all kept; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.llm.common import broadcast_if_small

TRAIN_ROWS = 30_000
MIN_WEIGHT = 2.5
STEM_CHARS = range(3, 9)
STEM_BRANCHES = 3
#: Slopes and offsets of the curve before any label. The first one stands where labels are too few for folds: two matches of the least weight in a text of a thousand characters, a load of a half, are a toss-up.
PRIORS = tuple((slope, -slope * even) for slope in (3.0, 1.5, 6.0, 12.0) for even in (0.5, 0.25, 1.0))
FOLDS = 5

# Letters of other scripts that look like Latin ones, and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "ɑ": "a", "α": "a", "е": "e", "ҽ": "e", "ε": "e", "о": "o", "ο": "o", "օ": "o", "р": "p", "ρ": "p", "с": "c", "ϲ": "c", "у": "y", "γ": "y",
    "х": "x", "χ": "x", "і": "i", "ι": "i", "ı": "i", "ӏ": "l", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "κ": "k", "к": "k", "м": "m", "т": "t",
    "τ": "t", "в": "b", "н": "h", "ν": "v", "ѵ": "v", "ԝ": "w", "ω": "w", "υ": "u", "ս": "u", "п": "n", "η": "n", "ո": "n", "г": "r", "ʀ": "r", "ӡ": "z",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
SEED = ("idiot", "moron", "stupid", "scum", "pathetic", "worthless", "loser", "disgusting", "imbécil", "estúpido", "basura", "imbécile", "abruti", "dummkopf", "abschaum", "trottel")
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "scum line", "pond scum", "sore loser clause")

_FOLD = str.maketrans(HOMOGLYPHS | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)})
_SIGNS = str.maketrans(SUBSTITUTES)
_MIXED = re.compile(r"(?<=[^\W\d_])[0-9@$!|]+(?=[^\W\d_])|(?<![\w@$!|])[0134578@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578@$]+(?![\w@$])")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    low = text.lower().translate(_FOLD)
    return _MIXED.sub(lambda m: m[0].translate(_SIGNS), low)


class Model(NamedTuple):
    terms: dict[str, float]  # whole words
    stems: dict[str, float]  # beginnings of words
    exceptions: tuple[str, ...]
    slope: float
    offset: float


def matcher(model: Model) -> ahocorasick.Automaton | None:
    a = ahocorasick.Automaton()
    for stem, w in model.stems.items():
        a.add_word(stem, (len(stem), w, 0))
    for term, w in model.terms.items():
        a.add_word(term, (len(term), w, 1))
    for phrase in model.exceptions:
        a.add_word(phrase, (len(phrase), 0.0, 2))
    if not len(a):
        return None
    a.make_automaton()
    return a


def load(text: str | None, a: ahocorasick.Automaton | None) -> float:
    """The weight of a text's matches over the logarithm of its length in characters."""
    if not text or a is None:
        return 0.0
    folded, found, covered = fold(text), [], []
    n = len(folded)
    for end, (size, w, kind) in a.iter(folded):
        start = end - size + 1
        if start and folded[start - 1].isalnum() or kind and end + 1 < n and folded[end + 1].isalnum():
            continue
        (covered if kind == 2 else found).append((start, end, w))
    if covered:
        found = [x for x in found if not any(s <= x[0] and x[1] <= e for s, e, _ in covered)]
    return sum(w for _, _, w in found) / math.log2(8 + n)


def score(x: float, model: Model) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * x + model.offset))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def _features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and stems in a task's labelled rows, a row for each document they occur in."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for b in it:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            seen = set(_WORD.findall(fold(text or "")))
            counts[toxic].update(seen)
            # a stem with the letter after it, so that its branches can be counted
            counts[toxic].update({w[:i] + "*" + w[i] for w in seen for i in STEM_CHARS if i < len(w)})
    names = list(counts[0].keys() | counts[1].keys())
    for i in range(0, len(names), 50_000):
        part = names[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([counts[t][x] for x in part], pa.int64()) for t in (1, 0))], names=["feature", "bad", "good"])


def _prior(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[float, float]:
    """The prior whose curves lose least on the fold they were fitted without; the first one unless each fold has rows of both kinds."""
    if any(len(np.unique(y[fold == f])) < 2 for f in range(FOLDS)):
        return PRIORS[0]

    def loss(prior: tuple[float, float]) -> float:
        total = 0.0
        for f in range(FOLDS):
            slope, offset = _curve(x[fold != f], y[fold != f], prior)
            z = np.where(y[fold == f] > 0, -1.0, 1.0) * np.clip(slope * x[fold == f] + offset, -30, 30)
            total += float(np.log1p(np.exp(z)).sum())
        return total

    return min(PRIORS, key=loss)


def _curve(x: np.ndarray, y: np.ndarray, towards: tuple[float, float]) -> tuple[float, float]:
    """A logistic curve through one value, by Newton steps with a small ridge around the prior curve."""
    scale = max(float(np.abs(x).max(initial=0)), 1e-9)
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    prior, ridge = np.array([towards[0] * scale, towards[1]]), np.array([1e-2, 1e-3])
    b = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + np.diag(ridge)
        b += np.clip(np.linalg.solve(h, a.T @ (y - p) - ridge * (b - prior)), -5, 5)
    return float(b[0] / scale), float(b[1])


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, seed: tuple[str, ...] = ()) -> Model:
    """The lexicon and curve from labelled rows outside the held-out fold. seed: words that count before any label, such as SEED; labels suffice without."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic")).filter(~held_out(F.col("__id")))
    n = marks.count()
    if n > train_rows:
        marks = marks.filter(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(1e6 * train_rows / n))
    rows = docs.select("doc_id", "text").join(broadcast_if_small(marks, min(n, train_rows)), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic")
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = totals.get(1, 0), totals.get(0, 0)
    counts = rows.select("text", "toxic").mapInArrow(_features, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    weight = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    words = counts.filter(~F.contains(F.col("feature"), F.lit("*"))).withColumn("weight", weight)
    stem = F.substring_index("feature", "*", 1)
    stems = counts.filter(F.contains(F.col("feature"), F.lit("*"))).groupBy(stem.alias("feature")).agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count_if(F.col("bad") > 0).alias("branches")).filter(f"bad >= 5 and branches >= {STEM_BRANCHES}").withColumn("weight", weight)
    enough = F.col("weight") >= MIN_WEIGHT
    chosen: dict[str, float] = {}
    for r in sorted(stems.filter(enough).select("feature", "weight").collect(), key=lambda r: (len(r.feature), r.feature)):  # the most general stem stands for those it begins
        if not any(r.feature[:i] in chosen for i in STEM_CHARS):
            chosen[r.feature] = r.weight
    found = words.filter((F.col("bad") >= 3) & enough | F.col("feature").isin(*seed)).select("feature", "weight", "good").collect()
    weights = dict.fromkeys(seed, MIN_WEIGHT) | {r.feature: r.weight if r.good else max(r.weight, MIN_WEIGHT) for r in found}
    terms = {f: w for f, w in weights.items() if w >= MIN_WEIGHT and not any(f[:i] in chosen for i in STEM_CHARS)}
    model = Model(terms, chosen, EXCEPTIONS, 1.0, 0.0)
    fold = F.floor(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) / 5) % FOLDS  # the remainder by 5 is the held-out fold's
    seen = _loads(rows.select("doc_id", "text", "toxic"), model).select("toxic", "x", fold.alias("fold")).toPandas()
    x, y = seen["x"].to_numpy(float), seen["toxic"].to_numpy(float)
    slope, offset = _curve(x, y, _prior(x, y, seen["fold"].to_numpy(int)))
    return model._replace(slope=slope, offset=offset)


def _loads(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs but text, and x: the load of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != "text"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = matcher(shared.value)
        for b in it:
            xs = [load(t, a) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(xs, pa.float64())], names=[*others, "x"])

    schema = docs.drop("text").schema.add("x", "double")
    return docs.mapInArrow(batches, schema)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    curve = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("x") * model.slope + model.offset))))
    return _loads(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), curve.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the model doesn't call toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, m = matcher(shared.value), shared.value
        for b in it:
            yield b.filter(pa.array([score(load(t, a), m) < 0.5 for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
