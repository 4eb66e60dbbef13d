"""Two versions of a manuscript: ordered differences between their texts, and which entities go on, under what name."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.operators.joins import by_merge
from fabula.sources import tables
from fabula.sources.shared import written


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (i, j), given by i, whose j increase too: patience sorting, n log n."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _lcs_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lengths of the longest common subsequences of a with every prefix of b."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return row


def _common(a: np.ndarray, b: np.ndarray, i: int, j: int, out: list[tuple[int, int]]) -> None:
    """A longest common subsequence, by divide and conquer over a: memory grows with len(b) only."""
    stack = [(a, b, i, j)]
    while stack:
        a, b, i, j = stack.pop()
        if not len(a) or not len(b):
            continue
        if len(a) == 1:
            hit = np.flatnonzero(b == a[0])
            if len(hit):
                out.append((i, j + int(hit[0])))
            continue
        half = len(a) // 2
        cut = int(np.argmax(_lcs_row(a[:half], b) + _lcs_row(a[half:][::-1], b[::-1])[::-1]))
        stack += [(a[:half], b[:cut], i, j), (a[half:], b[cut:], i + half, j + cut)]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of equal elements in increasing order of both: common ends, then the elements that both hold once as anchors, then the
    stretches between anchors in the same way; where nothing is unique, a longest common subsequence."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i1, i2, j1, j2 = stack.pop()
        while i1 < i2 and j1 < j2 and a[i1] == b[j1]:
            out.append((i1, j1))
            i1, j1 = i1 + 1, j1 + 1
        while i1 < i2 and j1 < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i1 == i2 or j1 == j2:
            continue
        once: dict[int, list[int]] = {}
        for side, xs, lo, hi in ((0, a, i1, i2), (1, b, j1, j2)):
            for k in range(lo, hi):
                seen = once.setdefault(xs[k], [0, 0, -1, -1])
                seen[side], seen[side + 2] = seen[side] + 1, k
        anchors = increasing(sorted((i, j) for m, n, i, j in once.values() if m == n == 1))
        if anchors:
            for (p, q), (r, s) in zip([(i1 - 1, j1 - 1), *anchors], [*anchors, (i2, j2)], strict=True):
                stack.append((p + 1, r, q + 1, s))
            out += anchors
        elif any(m and n for m, n, _, _ in once.values()):
            _common(np.array(a[i1:i2]), np.array(b[j1:j2]), i1, j1, out)
    return sorted(out)


def _lines(docs: DataFrame, i: str) -> DataFrame:
    p = tables.paragraphs(docs)
    return p.select("doc_id", F.col("para_idx").alias(i), F.col("start_char").alias(f"start_{i}"), F.col("end_char").alias(f"end_{i}"), F.md5("text").alias("hash"))


def matched_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, i, j of the lines of two versions (_lines) that stay in place.

    Lines that occur once in each version are joined; of these the longest run in both orders are anchors. Lines between two anchors are aligned piece by
    piece, so a task holds the line numbers of one text's anchors, or the lines of one piece."""
    once = lambda side, i: side.groupBy("doc_id", "hash").agg(F.count("*").alias("n"), F.min(i).alias(i)).filter("n = 1").drop("n")
    pairs = by_merge(once(old, "i")).join(once(new, "j"), ["doc_id", "hash"]).select("doc_id", "i", "j")
    schema = pa.schema([("doc_id", pa.int64()), ("i", pa.int64()), ("j", pa.int64())])

    def table(doc_id: int | None, found: list[tuple[int, int]]) -> pa.Table:
        return pa.Table.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array([i for i, _ in found], pa.int64()), pa.array([j for _, j in found], pa.int64())], schema=schema)

    def run(t: pa.Table) -> pa.Table:
        return table(t["doc_id"][0].as_py(), increasing(sorted(zip(t["i"].to_pylist(), t["j"].to_pylist(), strict=True))))

    anchors = written(pairs.groupBy("doc_id").applyInArrow(run, "doc_id long, i long, j long"))

    def pieces(side: DataFrame, i: str) -> DataFrame:
        """The lines that are no anchors, with the number of anchors before them."""
        marked = side.join(by_merge(anchors.select("doc_id", i, F.lit(1).alias("anchor"))), ["doc_id", i], "left")
        piece = F.coalesce(F.sum("anchor").over(Window.partitionBy("doc_id").orderBy(i).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
        return marked.withColumn("piece", piece).filter("anchor is null").select("doc_id", "piece", F.col(i).alias("at"), "hash", F.lit(i).alias("side"))

    def within(t: pa.Table) -> pa.Table:
        sides: dict[str, list[tuple[int, str]]] = {"i": [], "j": []}
        for at, line, side in zip(t["at"].to_pylist(), t["hash"].to_pylist(), t["side"].to_pylist(), strict=True):
            sides[side].append((at, line))
        a, b = sorted(sides["i"]), sorted(sides["j"])
        ids: dict[str, int] = {}
        number = lambda rows: [ids.setdefault(line, len(ids)) for _, line in rows]
        return table(t["doc_id"][0].as_py(), [(a[i][0], b[j][0]) for i, j in align(number(a), number(b))])

    both = pieces(old, "i").unionByName(pieces(new, "j"))
    return anchors.unionByName(both.groupBy("doc_id", "piece").applyInArrow(within, "doc_id long, i long, j long"))


def opcodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The edits that turn the old text of a doc_id into the new one, line by line and in order: doc_id, tag (equal, replace, delete, insert), i1, i2, j1, j2 (lines, half open), and
    the same in characters: old_start, old_stop, new_start, new_stop.

    Texts are of one row each, in old and new (doc_id, text); a text that one side lacks isn't compared, a null text is empty."""
    a, b = written(_lines(old, "i")), written(_lines(new, "j"))
    m = matched_lines(a, b).join(by_merge(a.drop("hash")), ["doc_id", "i"]).join(by_merge(b.drop("hash")), ["doc_id", "j"])
    order = Window.partitionBy("doc_id").orderBy("i")
    starts = F.when((F.col("i") - F.lag("i").over(order) == 1) & (F.col("j") - F.lag("j").over(order) == 1), 0).otherwise(1)
    runs = m.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edge = lambda side, i: side.groupBy("doc_id").agg((F.max(i) + 1).alias(i), (F.max(f"end_{i}") + 1).alias(f"start_{i}"))
    ends = by_merge(edge(a, "i")).join(edge(b, "j"), "doc_id")
    blocks = runs.groupBy("doc_id", "run").agg(
        F.min("i").alias("i1"), (F.max("i") + 1).alias("i2"), F.min("j").alias("j1"), (F.max("j") + 1).alias("j2"),
        F.min("start_i").alias("old_start"), F.max("end_i").alias("old_stop"), F.min("start_j").alias("new_start"), F.max("end_j").alias("new_stop")).drop("run")
    last = ends.select("doc_id", F.col("i").alias("i1"), F.col("i").alias("i2"), F.col("j").alias("j1"), F.col("j").alias("j2"), F.col("start_i").alias("old_start"), F.col("start_i").alias("old_stop"), F.col("start_j").alias("new_start"), F.col("start_j").alias("new_stop"))
    by_place = Window.partitionBy("doc_id").orderBy("i1", "j1", "i2", "j2")
    before = {f"b_{c}": F.coalesce(F.lag(c).over(by_place), F.lit(none)) for c, none in (("i2", 0), ("j2", 0), ("old_stop", -1), ("new_stop", -1))}
    placed = blocks.unionByName(last).withColumns(before)
    old_at, new_at = F.col("b_old_stop") + 1, F.col("b_new_stop") + 1
    gap = F.struct(
        F.col("b_i2").alias("i1"), F.col("i1").alias("i2"), F.col("b_j2").alias("j1"), F.col("j1").alias("j2"), old_at.alias("old_start"), F.greatest(old_at, F.col("old_start") - 1).alias("old_stop"),
        new_at.alias("new_start"), F.greatest(new_at, F.col("new_start") - 1).alias("new_stop"))
    here = F.struct("i1", "i2", "j1", "j2", "old_start", "old_stop", "new_start", "new_stop")
    rows = placed.select("doc_id", F.explode(F.array(F.struct(F.lit(True).alias("gap"), gap.alias("o")), F.struct(F.lit(False).alias("gap"), here.alias("o")))).alias("x")).select("doc_id", "x.gap", "x.o.*")
    tag = F.when(~F.col("gap"), "equal").when((F.col("i1") < F.col("i2")) & (F.col("j1") < F.col("j2")), "replace").when(F.col("i1") < F.col("i2"), "delete").otherwise("insert")
    return rows.filter("i1 < i2 or j1 < j2").select("doc_id", tag.alias("tag"), "i1", "i2", "j1", "j2", "old_start", "old_stop", "new_start", "new_stop")


def diff_summary(ops: DataFrame) -> DataFrame:
    """doc_id, status, similarity (twice the lines kept over all lines) and lines added, removed, modified and unchanged, from opcodes.

    Of a replaced stretch the longer side counts as modified."""
    n_old, n_new = F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1")
    total = lambda tag, n: F.coalesce(F.sum(F.when(F.col("tag") == tag, n)), F.lit(0)).alias({"insert": "added", "delete": "removed", "replace": "modified", "equal": "unchanged"}[tag])
    g = ops.groupBy("doc_id").agg(total("insert", n_new), total("delete", n_old), total("replace", F.greatest(n_old, n_new)), total("equal", n_old), F.sum(n_old + n_new).alias("n"))
    return g.select("doc_id", F.when(F.col("unchanged") * 2 == F.col("n"), "unchanged").otherwise("modified").alias("status"), (2 * F.col("unchanged") / F.col("n")).alias("similarity"), "added", "removed", "modified", "unchanged")


# What makes two entities of different versions one. Results depend on them.
RENAME_LEAST = 0.78
SCORES = {"exact_canonical": (0.90, 0.08), "old_in_new_aliases": (0.86, 0.10), "new_in_old_aliases": (0.83, 0.10), "token_overlap": (0.78, 0.08)}
SAME_IMPORTANCE, TOKENS_LEAST, TOKENS_SLOPE = 0.05, 0.8, 0.35


def _norm(name: Column) -> Column:
    return F.trim(F.regexp_replace(T.normalize_name(F.trim(name)), r"[^\p{L}\p{N}_\s]", ""))


def _signature(entities: DataFrame, side: str) -> DataFrame:
    """The columns an entity is compared by, with the side's name in front, and `keys`: what it must share with its counterpart.

    Names and aliases are keys, and of the sorted distinct words of a name the first len - ceil(0.8 len) + 1: names with a word Jaccard of 0.8 share one of these."""
    norm, words = _norm(F.col("name")), F.array_sort(F.array_distinct(F.filter(F.split(T.normalize_name(F.col("name")), r"\s+"), lambda w: w != "")))
    e = entities.select(
        "story", F.col("entity_id").alias("id"), F.coalesce("entity_type", F.lit("")).alias("type"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce(F.col("mention_count").cast("long"), F.lit(0)).alias("n"),
        F.coalesce("importance", F.lit("")).alias("importance"), F.coalesce(norm, F.lit("")).alias("norm"), F.coalesce(words, F.array().cast("array<string>")).alias("words"),
        F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), _norm), lambda a: a.isNotNull() & (a != "")).alias("aliases"))
    whole = F.transform(F.array_distinct(F.concat(F.filter(F.array("norm"), lambda x: x != ""), F.col("aliases"))), lambda x: F.concat(F.lit("name "), x))
    prefix = F.slice("words", F.lit(1), F.size("words") - F.ceil(F.size("words") * TOKENS_LEAST - 1e-9).cast("int") + 1)
    keyed = e.withColumn("keys", F.concat(whole, F.transform(prefix, lambda x: F.concat(F.lit("word "), x))))
    return keyed.select("story", *[F.col(c).alias(f"{side}_{c}") for c in keyed.columns if c != "story"])


def candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs of entities of the two versions of a story that may be one: story, old_id, new_id, score, reason, same. Only pairs with a common key meet."""
    a, b = _signature(old, "old"), _signature(new, "new")
    meet = a.select("story", "old_id", F.explode("old_keys").alias("key")).join(b.select("story", "new_id", F.explode("new_keys").alias("key")), ["story", "key"]).select("story", "old_id", "new_id").distinct()
    p = meet.join(a.drop("old_keys"), ["story", "old_id"]).join(b.drop("new_keys"), ["story", "new_id"])
    both = (F.col("old_n") > 0) & (F.col("new_n") > 0)
    ratio = F.when(both, F.least("old_n", "new_n") / F.greatest("old_n", "new_n")).otherwise(0.5)
    bonus = F.when((F.col("old_importance") == F.col("new_importance")) & (F.col("old_importance") != ""), SAME_IMPORTANCE).otherwise(0.0)
    words = T.jaccard(F.col("old_words"), F.col("new_words"))
    contains = lambda names, name: (F.col(name) != "") & F.array_contains(names, F.col(name))
    reason = F.when((F.col("old_norm") != "") & (F.col("old_norm") == F.col("new_norm")), "exact_canonical").when(contains("new_aliases", "old_norm"), "old_in_new_aliases").when(
        contains("old_aliases", "new_norm"), "new_in_old_aliases").when((words >= TOKENS_LEAST) & (F.size("old_words") > 0), "token_overlap")
    base = lambda k: F.lit(SCORES[k][0]) + (F.greatest(words - TOKENS_LEAST, F.lit(0.0)) * TOKENS_SLOPE if k == "token_overlap" else 0) + ratio * SCORES[k][1] + bonus
    score = F.least(F.lit(1.0), F.coalesce(*[F.when(reason == k, base(k)) for k in SCORES]))
    fits = (F.col("old_type") == F.col("new_type")) | (F.col("old_type") == "") | (F.col("new_type") == "")
    scored = p.filter(fits).select("story", "old_id", "new_id", score.alias("score"), reason.alias("reason"), (F.col("old_norm") == F.col("new_norm")).alias("same"))
    return scored.filter(F.col("score") >= RENAME_LEAST)


def one_to_one(edges: DataFrame) -> DataFrame:
    """The edges (story, old_id, new_id, score, ...) that a pass over old_id in order takes, where each old entity takes the best new one still free (ties: the smallest new_id).

    In rounds: an edge is taken when it is the best one left of its old entity and no earlier old entity is left that could take its new one. In every story
    the first old entity left takes its edge, so rounds end; texts of one cast take a few, whatever the number of stories."""
    left, taken = written(edges), None
    while not left.isEmpty():
        best = Window.partitionBy("story", "old_id").orderBy(F.desc("score"), "new_id")
        first = Window.partitionBy("story", "new_id")
        ranked = left.withColumns({"__best": F.row_number().over(best), "__first": F.min("old_id").over(first)})
        now = written(ranked.filter("__best = 1 and __first = old_id").drop("__best", "__first"))
        taken = now if taken is None else taken.unionByName(now)
        left = written(left.join(now.select("story", "old_id"), ["story", "old_id"], "left_anti").join(now.select("story", "new_id"), ["story", "new_id"], "left_anti"))
    return left if taken is None else taken


def entity_continuity(old: DataFrame, new: DataFrame) -> DataFrame:
    """What becomes of the entities of a story (story, entity_id, entity_type, name, aliases, mention_count, importance) from one version to the next: story, old_id, new_id, old_name, new_name, link (same, renamed, removed, new), confidence, reason."""
    links = one_to_one(candidates(old, new))
    a, b = old.select("story", F.col("entity_id").alias("old_id"), F.col("name").alias("old_name")), new.select("story", F.col("entity_id").alias("new_id"), F.col("name").alias("new_name"))
    found = a.join(links, ["story", "old_id"], "full_outer").join(b, ["story", "new_id"], "full_outer")
    link = F.when(F.col("new_id").isNull(), "removed").when(F.col("old_id").isNull(), "new").when(F.col("same"), "same").otherwise("renamed")
    none = F.when(F.col("new_id").isNull(), "not_matched").otherwise("new_entity")
    return found.select("story", "old_id", "new_id", "old_name", "new_name", link.alias("link"), F.coalesce("score", F.lit(0.0)).alias("confidence"), F.coalesce("reason", none).alias("reason"))
