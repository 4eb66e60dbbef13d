"""Diffs by what they rebuild and what a plain subsequence finds; continuity against a pass over old entities in order."""

import random

from fabula.operators import versions as V

DOC = "doc_id long, text string"
ENTITY = "story long, entity_id long, entity_type string, name string, aliases array<string>, mention_count long, importance string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_in_order_and_as_long_as_can_be_without_anchors():
    rng = random.Random(3)
    for _ in range(200):
        size = rng.choice([2, 5, 40])
        a, b = [rng.randrange(size) for _ in range(rng.randint(0, 30))], [rng.randrange(size) for _ in range(rng.randint(0, 30))]
        pairs = V.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        out = []
        V._common(V.np.array(a), V.np.array(b), 0, 0, out)
        assert len(out) == lcs(a, b) >= len(pairs)
        k = V.increasing([(i, x) for i, x in enumerate(a)])
        assert len(k) == lcs(a, sorted(set(a)))


def rebuilt(old, new, ops):
    """The new text from the old one and what is new; checks that ranges follow each other without holes."""
    at, parts = [0, 0, 0, 0], []
    for r in ops:
        assert [r.i1, r.j1] == at[:2] and (r.old_start, r.new_start) == (at[2], at[3])
        a, b = old[r.old_start : r.old_stop], new[r.new_start : r.new_stop]
        assert a.count("\n") == max(0, r.i2 - r.i1 - 1) and b.count("\n") == max(0, r.j2 - r.j1 - 1)
        assert {"equal": a == b, "replace": r.i1 < r.i2 and r.j1 < r.j2, "delete": r.j1 == r.j2 and b == "", "insert": r.i1 == r.i2 and a == ""}[r.tag]
        if r.j1 < r.j2:
            parts.append(a if r.tag == "equal" else b)
        at = [r.i2, r.j2, at[2] if r.i1 == r.i2 else r.old_stop + 1, at[3] if r.j1 == r.j2 else r.new_stop + 1]
    assert at == [old.count("\n") + 1, new.count("\n") + 1, len(old) + 1, len(new) + 1]
    return "\n".join(parts)


def test_opcodes_rebuild_the_new_text(spark):
    rng, pairs = random.Random(8), [("", ""), ("a", ""), ("", "b"), ("a\nb\nc", "a\nb\nc"), ("a\n\nb", "b\n\na\n"), (None, "x\n")]
    for _ in range(60):
        size = rng.choice([2, 6, 300])
        lines = [f"línea {rng.randrange(size)}" for _ in range(rng.randint(0, 40))]
        other = [x for x in lines for _ in range(rng.choice([0, 1, 1, 1, 1, 2]))]
        if rng.random() < 0.5:
            rng.shuffle(other)
        pairs.append(("\n".join(lines), "\n".join(other)))
    old, new = ([(d, p[k]) for d, p in enumerate(pairs)] for k in (0, 1))
    df = V.opcodes(spark.createDataFrame([*old, (999, "only old")], DOC), spark.createDataFrame([*new, (998, "only new")], DOC))
    ops = {}
    for r in df.orderBy("doc_id", "i1", "j1", "i2").collect():
        ops.setdefault(r.doc_id, []).append(r)
    assert set(ops) == set(range(len(pairs)))
    for d, (a, b) in enumerate(pairs):
        assert rebuilt(a or "", b or "", ops[d]) == (b or ""), d
    s = {r.doc_id: r for r in V.diff_summary(df).collect()}
    assert (s[3].status, s[3].similarity, s[3].unchanged) == ("unchanged", 1.0, 3)
    for d, (a, b) in enumerate(pairs):
        kept = sum(r.i2 - r.i1 for r in ops[d] if r.tag == "equal")
        assert s[d].similarity == 2 * kept / ((a or "").count("\n") + (b or "").count("\n") + 2)


def greedy(edges):
    out, free = [], {}
    for old in sorted({e[0] for e in edges}):
        best = max((e for e in edges if e[0] == old and e[1] not in free), key=lambda e: (e[2], -e[1]), default=None)
        if best:
            free[best[1]] = True
            out.append(best)
    return set(out)


def test_rounds_take_what_the_pass_in_order_takes(spark):
    rng, rows = random.Random(6), []
    for story in range(25):
        n = rng.randint(1, 9)
        rows += [(story, a, b, rng.choice([0.8, 0.85, 0.9]), "r", True) for a in range(n) for b in range(n) if rng.random() < 0.5]
    got = V.one_to_one(spark.createDataFrame(rows, "story long, old_id long, new_id long, score double, reason string, same boolean")).collect()
    for story in range(25):
        assert {(r.old_id, r.new_id, r.score) for r in got if r.story == story} == greedy([r[1:4] for r in rows if r[0] == story])


def test_continuity_cases(spark):
    old = [(1, 1, "character", "María Pérez", ["Mari"], 10, "primary"), (1, 2, "character", "Juan", None, 4, "minor"), (1, 3, "place", "Madrid", None, 2, ""), (1, 4, "character", "Don Luis de la Vega Real", None, 0, None),
        (1, 5, "character", "Ana", None, 1, "minor"), (1, 6, "character", "", None, 1, None)]
    new = [(1, 11, "character", "maria perez", [], 5, "primary"), (1, 12, "character", "Juanito", ["juan"], 4, "minor"), (1, 13, "character", "Madrid", None, 2, ""), (1, 14, "character", "Luis de la Vega Real", None, 3, None),
        (1, 15, "character", "Pedro", None, 2, None), (1, 16, "", "Ána!", None, 1, "minor"), (2, 17, "", "Ana", None, 1, None)]
    got = {(r.old_id, r.new_id): (r.link, round(r.confidence, 6), r.reason) for r in V.entity_continuity(spark.createDataFrame(old, ENTITY), spark.createDataFrame(new, ENTITY)).collect()}
    assert got == {
        (1, 11): ("same", 0.99, "exact_canonical"), (2, 12): ("renamed", 1.0, "old_in_new_aliases"), (3, None): ("removed", 0.0, "not_matched"), (None, 13): ("new", 0.0, "new_entity"),
        (4, 14): ("renamed", round(0.78 + (5 / 6 - 0.8) * 0.35 + 0.04, 6), "token_overlap"), (5, 16): ("same", 1.0, "exact_canonical"), (6, None): ("removed", 0.0, "not_matched"),
        (None, 15): ("new", 0.0, "new_entity"), (None, 17): ("new", 0.0, "new_entity")}


def _broadcasts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastExchange")


def test_written_lines_are_never_broadcast(spark):
    lines = "\n".join(f"line {i % 7} of {i}" for i in range(40))
    docs = spark.createDataFrame([(k, lines) for k in range(5)], DOC)
    ops = V.opcodes(docs, docs)
    assert _broadcasts(ops) == 0 and {(r.doc_id, r.tag, r.i2) for r in ops.collect()} == {(k, "equal", 40) for k in range(5)}
    assert _broadcasts(V.diff_summary(ops)) == 0
