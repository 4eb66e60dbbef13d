"""The second version of texts, line by line, and that its moved lines reach the diffs."""

from zlib import crc32

from fabula.operators import versions as V
from fabula.plans.story_text_plans import edited


def version(doc_id, text):
    kind = lambda i: crc32(f"{doc_id}:{i}".encode()) % 20
    lines, out = (text or "").split("\n"), []
    for i, s in enumerate(lines):
        moves = kind(i) == 3 and i + 1 < len(lines) and kind(i + 1) != 3
        out += {0: [], 1: [s.upper()], 2: [s, s]}.get(kind(i), [] if moves else [s])
        if i and kind(i - 1) == 3 and kind(i) != 3:
            out.append(lines[i - 1])
    return "\n".join(out)


def test_lines_are_dropped_changed_said_twice_and_moved(spark):
    docs = [(k, "\n".join(f"line {i} of {k}" for i in range(k % 40))) for k in range(300)] + [(300, None), (301, "one")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in edited(df).collect()}
    assert got == {k: version(k, t) for k, t in docs}
    moved = {k for k, t in docs if t and sorted(got[k].split("\n")) == sorted(t.split("\n")) and got[k] != t}
    assert moved  # nothing but their order tells these from the first version
    ops = V.opcodes(df, edited(df))
    found = {r.doc_id: r for r in V.diff_summary(ops).collect()}
    assert all(found[k].status == "modified" and found[k].removed + found[k].added + found[k].modified > 0 for k in moved)
