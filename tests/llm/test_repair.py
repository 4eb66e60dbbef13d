"""Repairs against a sweep over all labels of all states, and reports against a fold of each conversation's rows."""

import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest

from fabula.llm import repair as R


def least(rows, entry=R.START, goals=R.ACCEPTED):
    """The least (cost, audit) of every state after every row."""

    def inserted(labels):
        for _ in range(4):
            for q in list(labels):
                edit, _, to, c = R._MOVES[None, q][0]
                labels[to] = min(labels.get(to, (1 << 40, "")), (labels[q][0] + c, labels[q][1] + edit))
        return labels

    labels = inserted({entry: (0, "")})
    for r in rows:
        after = {}
        for q, (cost, audit) in labels.items():
            for edit, read, to, c in R._MOVES[r, q]:
                if read:
                    after[to] = min(after.get(to, (1 << 40, "")), (cost + c, audit + edit))
        labels = inserted(after)
    return min((labels[g] for g in goals if g in labels), default=None)


def some_rows(rng, n):
    return "".join(rng.choices(rng.choice(["ua", "uaUAx", "suaoSUAOx", "sx", "uuuaax"]), k=n))


def test_branch_and_bound_proves_the_optimum():
    rng = random.Random(4)
    for _ in range(300):
        rows = some_rows(rng, rng.randint(0, 25))
        assert R.solve(rows) == least(rows)
        a, b = rng.randrange(4), rng.randrange(4)
        assert R.solve(rows, a, (b,)) == least(rows, a, (b,))
        bounds = R.suffix_bounds(rows)
        assert all(bounds[i] <= min(s[0] for q in range(4) if (s := least(rows[i:], q, (0, 1, 2, 3)))) for i in range(len(rows) + 1))
    long = some_rows(rng, 400)
    assert R.solve(long) == least(long)


def test_fragments_join_to_the_same_solution():
    rng = random.Random(5)
    for _ in range(100):
        rows = some_rows(rng, rng.randint(0, 30))
        cuts = sorted(rng.randint(0, len(rows)) for _ in range(3))
        pieces = [rows[i:j] for i, j in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        best, picks = R.joined([{(a, b): s for a in range(4) for b in range(4) if (s := R.solve(p, a, (b,)))} for p in pieces])
        assert best == least(rows) and "".join(p for _, p in picks) == best.audit


def expected(rows, damage):
    """Report of one conversation's (conv_id, turn, role, text) rows."""
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, letters, counts = set(), "", [0, 0, 0]
    for _, role, text in out:
        said = text.rstrip(" \t\n\x0b\x0c\r")
        again, initial = (role, text) in seen, role[:1] if role[:1] in ("s", "u", "a") else "o"
        seen.add((role, text))
        fault = 0 if not said else 1 if again else 2 if said[-1] not in ".!?" else None
        if fault is not None:
            counts[fault] += 1
        letters += "x" if fault in (0, 1) else initial.upper() if fault == 2 else initial
    turns = {t for t, _, _ in out if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:], strict=False))
    cost, audit = least(letters)
    lines, rest, state = [], iter(out), 0
    for edit in audit:
        row = next(rest) if edit != "I" else None
        if edit != "D":
            wanted = "assistant" if state == "u" else "user"
            lines.append((row[1] if edit == "K" else wanted, row[2] if row else ""))
            state = lines[-1][0][:1]
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def agrees(df, rows, damage=True):
    got = {r.conv_id: tuple(r)[1:] for r in df.collect()}
    want = {c: expected(rs, damage) for c, rs in by_conversation(rows).items()}
    assert got == want
    return want


def test_query_equals_a_fold(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    rows = [tuple(r.values()) for r in pq.read_table(path, columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    want = agrees(R.digest(spark.read.parquet(path)), rows)
    assert all(any(w[i] for w in want.values()) for i in range(1, 6))


@pytest.mark.parametrize("fragment", [3, 256])
def test_one_conversation_in_many_fragments(spark, monkeypatch, fragment):
    monkeypatch.setattr(R, "FRAGMENT", fragment)
    rng = random.Random(fragment)
    rows = [(1 + (rng.random() < 0.3), rng.choice([None, *range(400)]), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice([None, "", "Yes.", "No", " ", f"{rng.random()}."])) for _ in range(900)]
    rows += [(1, 7, "user", "Again.")] * 40
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    agrees(R.digest(conversations), rows)
    texts = {}
    for r in sorted(R.repair(conversations).collect(), key=lambda r: (r.conv_id, r.place, r.position)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in texts.items()} == {c: expected(rs, False)[-1] for c, rs in by_conversation(rows).items()}


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (3, 2, "user", "Hi."), (3, 2, "user", "Hi."), (4, 1, "", ""), (5, 1, "user", "x" * 300_000 + "."), (5, 2, "assistant", "y." * 200_000)]
    rows += [(c, 0, "user", "Hi.") for c in range(100, 160)]  # some are dropped whole
    extra = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, place string, n long")
    want = agrees(R.digest(extra), rows)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want.values()
    assert R.digest(extra.limit(0)).count() == 0
