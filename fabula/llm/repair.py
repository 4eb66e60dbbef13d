"""Conversation structure repair: the cheapest edits that turn a conversation into an alternation of user and assistant turns.

Rows may be kept, given another role, deleted, and empty turns inserted, so that the initials of the roles read `(s?(ua)+)?`: an optional system turn, then
pairs. Blank rows and rows said before must go; a truncated row that stays costs extra. The least cost is found, and of the edit strings
(audits) of that cost the least in ASCII order, by depth-first branch and bound: an explicit stack, lower bounds on what a suffix costs at
least, an incumbent, and for each node (rows read, state of the pattern) a dominance table.

A conversation may be of any length. Rows are range-partitioned by conversation and turn, so one that holds a third of the table is spread over tasks, and
cut into fragments of at most FRAGMENT rows. A conversation in a single fragment is repaired there. The others' fragments are solved for each pair of
states they may begin and end in, the few solutions of a conversation are joined, and its fragments then written out in parallel;
only the digest of the repaired text, which is sequential by nature, reads them in order, a fragment at a time.

Nulls in role, text and the damage key are one space; a null turn comes first and takes no part in gaps; a null conv_id is a conversation. Rows of
one turn are taken by role, then text; repeated rows are duplicates of the first. A role's initial is its first character; roles with other initials than s, u and a
can't be kept. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from fabula.llm.common import SPACED_BREAKS, written

#: Rows and bytes of text in a fragment.
FRAGMENT, FRAGMENT_BYTES = 256, 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What the pattern has read: nothing, a system turn, a user turn that waits for its answer, whole pairs.
START, SYSTEM, ASKED, ANSWERED = range(4)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
ACCEPTED = (START, ANSWERED)
_LEGAL = {"su", "ua", "au"}


class Solution(NamedTuple):
    cost: int
    audit: str


def _moves(row: str | None, state: int) -> list[tuple[str, int, int, int]]:
    """Edits in ASCII order, as edit, rows read, next state, cost. A row is its initial, in upper case if truncated, or x for one that must go."""
    out = []
    if row is not None:
        out.append(("D", 1, state, DELETE))
    turn = {START: "u", SYSTEM: "u", ASKED: "a", ANSWERED: "u"}[state]
    out.append(("I", 0, _NEXT[state, turn], INSERT))
    if row is not None and row != "x":
        extra = TRUNCATED if row.isupper() else 0
        if (state, row.lower()) in _NEXT:
            out.append(("K", 1, _NEXT[state, row.lower()], KEEP + extra))
        out.append(("R", 1, _NEXT[state, turn], REROLE + extra))
    return out


_MOVES = {(r, q): _moves(r, q) for r in (None, "x", *"suaoSUAO") for q in range(4)}


def suffix_bounds(rows: str) -> list[int]:
    """For each i what rows[i:] cost at least, from any state to any state.

    Every row has its own least cost: 4 if it must go, 3 if it is truncated, or its role can't stand (4 if both). And of two neighbours of one role among the
    rows that need not go, one must be deleted or given another role or a turn inserted between: 3 more, or 1 more if one was truncated and
    is deleted instead. Pairs are taken from the end, each row in one pair only, so that nothing is counted twice."""
    own = {"x": DELETE, "s": 0, "u": 0, "a": 0, "o": REROLE, "S": TRUNCATED, "U": TRUNCATED, "A": TRUNCATED, "O": DELETE}
    bounds, paired, free = [0] * (len(rows) + 1), 0, None  # free: the nearest row to the right that is in no pair yet
    total = 0
    for i in range(len(rows) - 1, -1, -1):
        r = rows[i]
        total += own[r]
        if r in "suaSUA":
            if free is not None and free.lower() == r.lower():
                paired += 1 if r.isupper() or free.isupper() else min(INSERT, REROLE)
                free = None
            else:
                free = r
        elif r != "x":
            free = None
        bounds[i] = total + paired
    return bounds


def _first_incumbent(rows: str, entry: int, goal: int) -> Solution | None:
    """A repair found without search: rows that fit are kept; one that doesn't is given the other role if the row after it has its own, else the turn before it is inserted."""
    state, cost, edits = entry, 0, []
    live = [i for i, r in enumerate(rows) if r != "x"]
    after = dict(zip(live, [rows[i].lower() for i in live[1:]], strict=False))
    for i, r in enumerate(rows):
        moves = {m[0]: m for m in _MOVES[r, state]}
        if goal in (START, SYSTEM) or r == "x":
            chosen = ["K" if r.lower() == "s" and state < goal == SYSTEM and "K" in moves else "D"]
        elif "K" in moves:
            chosen = ["K"]
        elif r.lower() in "ua" and after.get(i) != r.lower():
            chosen = ["I", "K"]
        else:
            chosen = ["R"]
        for edit in chosen:
            _, _, to, c = next(m for m in _MOVES[r, state] if m[0] == edit)
            state, cost = to, cost + c
            edits.append(edit)
    while state != goal:
        if goal in (START, SYSTEM):
            return None
        state, cost = _MOVES[None, state][0][2], cost + INSERT
        edits.append("I")
    return Solution(cost, "".join(edits))


def solve(rows: str, entry: int = START, goals: tuple[int, ...] = ACCEPTED) -> Solution | None:
    """The least (cost, audit) that reads all rows and leads from state entry to one of goals; None where none can.

    The stack yields prefixes in ASCII order of their audits. So of two prefixes of equal cost that reach a node the earlier one is the less, and a
    node's table needs its least cost only: a prefix that doesn't lower it is dominated. No edits of cost 0 lead from a node to itself, so neither is
    a prefix of the other and the order holds for all they may be completed to."""
    bounds, n, worst = suffix_bounds(rows), len(rows), Solution(1 << 60, "")
    best = min((s for g in goals if (s := _first_incumbent(rows, entry, g))), default=worst)
    furthest = max(goals)
    tables: list[list[int]] = [[worst.cost] * 4 for _ in range(n + 1)]
    path: list[str] = []
    stack = [(0, entry, 0, 0, "")]  # rows read, state, cost, edits before, edit
    while stack:
        i, state, cost, depth, edit = stack.pop()
        if cost + bounds[i] > best.cost or cost >= tables[i][state]:
            continue
        tables[i][state] = cost
        if edit:
            del path[depth:]
            path.append(edit)
            depth += 1
        if i == n and state in goals:
            best = min(best, Solution(cost, "".join(path)))
        for e, read, to, c in reversed(_MOVES[rows[i] if i < n else None, state]):
            if cost + c + bounds[i + read] <= best.cost and (to <= furthest or furthest >= ASKED):
                stack.append((i + read, to, cost + c, depth, e))
    return best if best is not worst else None


def joined(parts: list[dict[tuple[int, int], Solution]]) -> tuple[Solution, list[tuple[int, str]]]:
    """The least solution of a conversation from those of its fragments, and for each fragment the state it begins in and its audit."""
    reached, trails = {START: Solution(0, "")}, []
    for solutions in parts:
        after: dict[int, Solution] = {}
        trail: dict[int, tuple[int, str]] = {}
        for (a, b), s in solutions.items():
            if a in reached:
                label = Solution(reached[a].cost + s.cost, reached[a].audit + s.audit)
                if b not in after or label < after[b]:
                    after[b], trail[b] = label, (a, s.audit)
        reached = after
        trails.append(trail)
    best, state = min((reached[b], b) for b in ACCEPTED if b in reached)
    picks = []
    for trail in reversed(trails):
        state, audit = trail[state]
        picks.append((state, audit))
    return best, picks[::-1]


def rendered(rows: str, roles: list[str], texts: list[str], audit: str, entry: int = START) -> Iterator[tuple[str, str]]:
    """Role and text of each repaired row. roles and texts are of the rows that need not go."""
    state, i, live = entry, 0, iter(zip(roles, texts, strict=True))
    for edit in audit:
        row = None if edit == "I" else rows[i]
        role, text = next(live) if row not in (None, "x") else ("", "")
        if edit != "D":
            yield role if edit == "K" else "assistant" if state == ASKED else "user", text
        _, read, to, _ = next(m for m in _MOVES[row, state] if m[0] == edit)
        i, state = i + read, to


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: the rows after damage, equal ones counted; a conversation's dropped rows are one row with n = 0."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    dropped = F.col("kind") == 0
    return rows.select(
        "conv_id", F.when(~dropped, F.col("turn")).alias("turn"),
        F.when(dropped, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(dropped, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("n"))


def as_they_are(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n = 1 of the rows as given: what a user repairs."""
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("n"))


def _marked(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number n, and `seen`: whether an earlier turn has the same role and text."""
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    said = F.md5(F.concat_ws("\0", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), "role", "text"))
    turn = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    keyed = same.withColumn("__said", said)
    again = rows.filter("n > 0").select(said.alias("__said"), turn.alias("at")).groupBy("__said").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first <> last")
    out = keyed.join(again.select("__said", "first"), "__said", "left")
    return out.select("conv_id", "turn", "role", "text", "n", F.coalesce(turn > F.col("first"), F.lit(False)).alias("seen"))


def _letter(role: str, text: str) -> str:
    """x for a blank text, else the role's initial (o for others), in upper case if the text is truncated."""
    said = text.rstrip(SPACED_BREAKS)
    if not said:
        return "x"
    r = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return r if said[-1] in ".!?" else r.upper()


class _Fragment:
    """The rows of a conversation that are gathered until a fragment is full."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.roles, self.texts, self.size = conv_id, [], [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, n: int, seen: bool) -> None:
        letter, initial = _letter(role, text), role[:1]
        for k in range(n):
            again = letter != "x" and (seen or k > 0)
            self.rows.append("x" if again else letter)
            self.blank += letter == "x"
            self.duplicate += again
            if self.rows[-1] != "x":
                self.truncated += letter.isupper()
                self.roles.append(role)
                self.texts.append(text)
                self.size += len(text)
            self.illegal += self.last is not None and self.last + initial not in _LEGAL
            self.first, self.last = initial if self.first is None else self.first, initial
        if n and turn is not None and turn != self.high:
            self.n_turns, self.low, self.high = self.n_turns + 1, turn if self.low is None else self.low, turn

    @property
    def full(self) -> bool:
        return len(self.rows) >= FRAGMENT or self.size >= FRAGMENT_BYTES

    def finished(self, place: int, whole: bool) -> dict:
        rows = "".join(self.rows)
        out = {k: getattr(self, k) for k in ("conv_id", "roles", "texts", "blank", "duplicate", "truncated", "illegal", "n_turns", "low", "high", "first", "last")}
        out |= {"place": place, "rows": rows}
        if whole:
            return out | solve(rows)._asdict()
        solutions = [{"entry": a, "goal": b} | s._asdict() for a in range(4) for b in range(4) if (s := solve(rows, a, (b,)))]
        return out | {"solutions": solutions}


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_SOLUTION = pa.struct([("entry", pa.int64()), ("goal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
_FRAGMENT_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("place", pa.int64()), ("rows", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), *((c, pa.int64()) for c in _COUNTS),
    ("n_turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("solutions", pa.list_(_SOLUTION))])


def _fragments(rows: DataFrame) -> DataFrame:
    """Conversations cut into fragments, in the order of place. One that is known to be whole has its cost and audit, others the solutions between all states.

    Written to the shared folder, as the cuts follow from sampled ranges: a second computation might cut elsewhere."""
    order = ["conv_id", "turn", "role", "text"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, now, begins, done = TaskContext.get().partitionId() << 32, None, False, []

        def close(whole: bool) -> None:
            nonlocal place
            done.append(now.finished(place, whole))
            place += 1

        for b in it:
            for conv_id, turn, role, text, n, seen in zip(*(b.column(c).to_pylist() for c in (*order, "n", "seen")), strict=True):
                if now is None:  # a partition's first and last conversations may go on in its neighbours
                    now = _Fragment(conv_id)
                elif conv_id != now.conv_id:
                    close(begins)
                    now, begins = _Fragment(conv_id), True
                while now.full or n > FRAGMENT:
                    if not now.full:
                        now.add(turn, role, text, FRAGMENT, seen)
                        n, seen = n - FRAGMENT, True
                    close(False)
                    now, begins = _Fragment(conv_id), False
                now.add(turn, role, text, n, seen)
                if len(done) >= 64:
                    yield pa.RecordBatch.from_pylist(done, _FRAGMENT_SCHEMA)
                    done = []
        if now is not None:
            close(False)
        yield pa.RecordBatch.from_pylist(done, _FRAGMENT_SCHEMA)

    ranges = ["conv_id", "turn", "role", F.left("text", F.lit(64))]  # bounds of ranges are kept short
    spread = rows.repartitionByRange(*ranges).sortWithinPartitions(*order).select(*order, "n", "seen")
    return written(spread.mapInArrow(batches, to_ddl(_FRAGMENT_SCHEMA)))


def to_ddl(schema: pa.Schema) -> str:
    return from_arrow_schema(schema).toDDL()


def _chosen(parts: DataFrame) -> DataFrame:
    """For each fragment of the conversations in several the state it begins in and its audit, and on the first of them the conversation's results."""
    counts = ["gaps", *_COUNTS, "cost"]
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("entry", pa.int64()), ("piece", pa.string()), *((c, pa.int64()) for c in counts), ("audit", pa.string())])

    def choose(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["place"])
        best, picks = joined([{(s["entry"], s["goal"]): Solution(s["cost"], s["audit"]) for s in r["solutions"]} for r in rows])
        totals = {c: sum(r[c] for r in rows) for c in _COUNTS}
        totals["illegal"] += sum(a["last"] + b["first"] not in _LEGAL for a, b in pairwise(r for r in rows if r["first"] is not None))
        turns = [r for r in rows if r["low"] is not None]
        n_turns = sum(r["n_turns"] for r in turns) - sum(a["high"] == b["low"] for a, b in pairwise(turns))
        totals |= {"gaps": turns[-1]["high"] - turns[0]["low"] + 1 - n_turns if turns else 0} | best._asdict()
        out = [{"conv_id": r["conv_id"], "place": r["place"], "entry": entry, "piece": piece} for r, (entry, piece) in zip(rows, picks, strict=True)]
        out[0] |= totals
        return pa.Table.from_pylist(out, schema)

    return parts.drop("rows", "roles", "texts", "cost", "audit").groupBy("conv_id").applyInArrow(choose, to_ddl(schema))


def _rendered(fragments: DataFrame, schema: str, batch: Callable[[list[dict]], pa.RecordBatch]) -> DataFrame:
    """batch(rows) of fragments with their entry, piece (audit) and `repaired`, the rows as role and text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(0, b.num_rows, 64):
                rows = b.slice(i, 64).to_pylist()
                yield batch([r | {"repaired": rendered(r["rows"], r["roles"], r["texts"], r["piece"], r["entry"])} for r in rows])

    return fragments.mapInArrow(batches, schema)


def _sha256(lines: Iterator[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in lines).encode()).hexdigest()


def _digests(parts: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the conversations in several fragments: their pieces are rendered in parallel and digested in order, one at a time."""
    text = lambda rows: ["".join(f"{a}:{b}\n" for a, b in r["repaired"]) for r in rows]
    piece_names = ["conv_id", "place", "repaired"]
    pieces = _rendered(parts, "conv_id long, place long, repaired string", lambda rows: pa.RecordBatch.from_arrays(
        [pa.array([r["conv_id"] for r in rows], pa.int64()), pa.array([r["place"] for r in rows], pa.int64()), pa.array(text(rows), pa.string())], names=piece_names))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, started = [], None, False
        for b in it:
            for conv_id, piece in zip(b.column("conv_id").to_pylist(), b.column("repaired").to_pylist(), strict=True):
                if digest is None or conv_id != out[-1][0]:
                    out.append([conv_id, None])
                    digest, started = hashlib.sha256(), False
                if piece:
                    digest.update((("\n" if started else "") + piece[:-1]).encode())
                    started = True
                out[-1][1] = digest.hexdigest()
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], names=["conv_id", "repaired_sha256"])

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(batches, "conv_id long, repaired_sha256 string")


def _solved(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole conversations and the fragments of the others, each with entry and piece, and the others' results."""
    fragments = _fragments(_marked(rows))
    parts = fragments.filter("solutions is not null")
    chosen = written(_chosen(parts))
    whole = fragments.filter("solutions is null").withColumns({"entry": F.lit(START).cast("long"), "piece": F.col("audit")})
    return whole, parts.drop("cost", "audit").join(chosen.select("place", "entry", "piece"), "place"), chosen.filter("cost is not null")


def report(rows: DataFrame) -> DataFrame:
    """A row for each conversation of rows (conv_id, turn, role, text, n): its faults, the cost and audit of its repair, and the digest of the repaired rows."""
    whole, parts, results = _solved(rows)
    names = ["conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256"]
    gaps = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("n_turns")).cast("long")
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    types = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]
    small = _rendered(whole.withColumn("gaps", gaps), schema, lambda rows: pa.RecordBatch.from_arrays(
        [pa.array([_sha256(r["repaired"]) if n == "repaired_sha256" else r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names))
    digests = _digests(parts).withColumnRenamed("conv_id", "__conv")
    return small.unionByName(results.join(digests, F.col("conv_id").eqNullSafe(F.col("__conv"))).select(*names))


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, place, position, role, text: the repaired rows; a conversation's are in the order of place, then position."""
    whole, parts, _ = _solved(as_they_are(conversations))
    names = ["conv_id", "place", "turns"]
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    columns = ["conv_id", "place", "rows", "roles", "texts", "entry", "piece"]
    pieces = _rendered(whole.select(*columns).unionByName(parts.select(*columns)), "conv_id long, place long, turns array<struct<role: string, text: string>>", lambda rows: pa.RecordBatch.from_arrays(
        [pa.array([r["conv_id"] for r in rows], pa.int64()), pa.array([r["place"] for r in rows], pa.int64()), pa.array([[{"role": a, "text": b} for a, b in r["repaired"]] for r in rows], turn)], names=names))
    return pieces.select("conv_id", "place", F.posexplode("turns").alias("position", "turn")).select("conv_id", "place", "position", "turn.role", "turn.text")


def digest(conversations: DataFrame) -> DataFrame:
    """The report of conversations after the query's damage."""
    return report(damaged(conversations))
