"""Who speaks: dialogue spans of texts attributed by speech verbs, hints, alternation, turns just before, a score among three and more, voices, and who is near."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from fabula.functions import lexicons as L
from fabula.functions import text as T
from fabula.operators import voice as C
from fabula.operators.character import FAMILIAR, FORMAL
from fabula.operators.joins import as_of, band_join, broadcast_if_small
from fabula.operators.mentions import find_mentions
from fabula.sources.shared import written

#: Verbs of speech by their stems in plain text; the forms are those of the past and the present that narrators use.
_STEMS = ("dij", "pregunt", "respond", "contest", "grit", "exclam", "susurr", "murmur", "replic", "anad", "afirm", "insist", "explic", "orden", "suplic", "protest", "repit", "interrump", "balbuce", "coment", "asegur", "confes")
VERBS = "(?:(?:" + "|".join(_STEMS) + ")(?:o|io|e|eron|aron|ieron|a|aba|ia|an)|dice|decia|said|asked|replied|answered|cried|whispered|shouted|dit|demanda|repondit|sagte|fragte|antwortete|rief)"
#: A name in text without accents, whose capitals were kept.
NAME = "(?:(?:don|dona|el|la|senor|senora) )?([A-Z][a-z]+(?: [A-Z][a-z]+){0,2})"
#: What opens a turn: a dash that begins a line or follows a mark and a space, or quotes. A dash within a line sets off narration.
SPEECH = "(?:(?<![^\n])|(?<=[:.!?] ))—[^—\n]+|«[^»\n]+»|“[^”\n]+”|\"[^\"\n]+\""
# Reaches in characters, and how confidence falls with turns since the last explicit one. Results depend on them.
AFTER, BEFORE, SUBJECT, NEARBY, RECENT = 220, 150, 260, 500, 450
DECAY, FLOOR, MEDIUM_ALTERNATION, MEDIUM_RECENT = 0.97, 0.30, 0.74, 0.68
# The score among three and more, in hundredths: for who spoke before the last one, who spoke last, who takes part, the last one mentioned, the ranks by nearness, a name with a verb of speech behind it, and who is addressed.
CROWD, PREVIOUS, AGAIN, TAKES_PART, MENTIONED, RANKS, SUBJECT_VERB, ADDRESSED = 3, 46, -18, 5, 22, (16, 13, 10, 7, 4, 4, 4, 4), 22, -26
# How near the last one mentioned stands, how far behind a name its verb, the least score, the lead over the second that a low one needs, and from where it is no low one; what a voice adds, and from where it decides alone.
MENTIONED_WITHIN, VERB_WITHIN, LEAST, LEAD, SURE, MEDIUM_SCORE, VOICE_SHARE, VOICE_MOST, VOICE_LEAST = 240, 90, 0.18, 0.03, 0.35, 0.38, 0.5, 0.16, 0.25
#: Lines from which a voice is known for sure, words that mark it, and fillers.
VOICE_LINES, VOICE_WORDS, VOICE_FILLERS = 10, 15, 5


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, dlg_idx, start, stop, text, before, after of the dialogue spans: before and after are the narration around them, cut at the next span, to BEFORE and AFTER characters."""
    text = T.empty_as(F.col("text"))
    # of the narration only its length and ends leave the row
    ends = F.transform(F.split(text, SPEECH, -1), lambda x: F.struct(F.length(x).alias("n"), F.left(x, F.lit(AFTER)).alias("head"), F.right(x, F.lit(BEFORE)).alias("tail")))
    z = F.arrays_zip(ends.alias("part"), F.regexp_extract_all(text, F.lit(SPEECH), F.lit(0)).alias("hit"))
    rows = docs.select("doc_id", F.posexplode(z).alias("i", "z")).select("doc_id", F.col("i").cast("long").alias("dlg_idx"), "z.part.*", F.col("z.hit").alias("text"))
    order = Window.partitionBy("doc_id").orderBy("dlg_idx")
    stop = F.sum(F.col("n") + F.coalesce(F.length("text"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumns({"stop": stop, "after": F.lead("head").over(order)}).filter("text is not null")
    return placed.select("doc_id", "dlg_idx", (F.col("stop") - F.length("text")).alias("start"), "stop", "text", F.col("tail").alias("before"), "after")


def named_by_verb(dialogues: DataFrame, entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """dialogues with explicit_id and verb, where a verb of speech says who speaks, else null: `verb name` after the span, `name ... verb` right before it, `name ... verb` after it,
    or a verb after it alone, whose subject is the last one mentioned, at most SUBJECT characters before."""
    plain = lambda c: F.translate(c, T.ACCENTED + "ñÑ", T.PLAIN + "nN")  # noqa: E731  # capitals stay: they mark names
    of = lambda c, p, i: F.nullif(F.regexp_extract(plain(c), p, i), F.lit(""))
    verb_name, name_verb = rf"(?<![A-Za-z])({VERBS}) {NAME}", rf"{NAME},?(?: [^.!?;:\n]{{0,60}})? ({VERBS})(?![A-Za-z])"
    ending = name_verb + r"[^.!?\n]{0,40}$"
    tried = [("after", verb_name, 2, 1), ("before", ending, 1, 2), ("after", name_verb, 1, 2)]
    found = dialogues.withColumn("__tries", F.array(*[F.struct(of(c, p, n).alias("name"), of(c, p, v).alias("verb")) for c, p, n, v in tried]))
    # a name is looked up as a whole, then without its last words; the first form that some entity bears decides
    words = lambda x: F.split(T.normalize_name(x["name"]), " ")
    forms = F.flatten(F.transform(F.filter("__tries", lambda x: x["name"].isNotNull()), lambda x: F.transform(
        F.filter(F.array(F.lit(3), F.lit(2), F.lit(1)), lambda n: n <= F.size(words(x))), lambda n: F.struct(F.array_join(F.slice(words(x), F.lit(1), n), " ").alias("form"), x["verb"].alias("verb")))))
    keyed = found.select("doc_id", "dlg_idx", F.posexplode(forms).alias("k", "f")).select("doc_id", "dlg_idx", "k", "f.form", "f.verb")
    borne = entities.select("entity_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form")).groupBy(T.normalize_name(F.col("form")).alias("form")).agg(F.min("entity_id").alias("entity_id"))
    named = keyed.join(borne, "form").groupBy("doc_id", "dlg_idx").agg(F.min_by(F.struct("entity_id", "verb"), "k").alias("named"))
    last = as_of(dialogues.select("doc_id", "dlg_idx", F.col("start").alias("at")), mentions.select("doc_id", F.col("stop").alias("at"), F.struct("entity_id", "stop").alias("subject")), ["doc_id"], ["at"], "subject")
    alone = F.nullif(F.regexp_extract(T.plain(F.col("after")), T.whole_words(VERBS), 0), F.lit(""))
    both = found.drop("__tries").join(named, ["doc_id", "dlg_idx"], "left").join(last.drop("at"), ["doc_id", "dlg_idx"], "left")
    implied = alone.isNotNull() & (F.col("start") - F.col("subject.stop") <= SUBJECT)
    out = F.coalesce("named", F.when(implied, F.struct(F.col("subject.entity_id").alias("entity_id"), alone.alias("verb"))))
    return both.withColumn("__by", out).withColumns({"explicit_id": F.col("__by.entity_id"), "verb": F.col("__by.verb")}).drop("named", "subject", "__by")


def with_nearby(dialogues: DataFrame, mentions: DataFrame) -> DataFrame:
    """dialogues with `nearby`: the entities mentioned within NEARBY characters of a span's start, nearest first."""
    m = mentions.select("doc_id", "entity_id", "start", "stop").withColumn("edge", F.explode(F.array("start", "stop")))
    pairs = band_join(dialogues.select("doc_id", "dlg_idx", F.col("start").alias("at")), m.select("doc_id", "entity_id", "edge"), ["doc_id"], "at", "edge", NEARBY)
    close = pairs.groupBy("doc_id", "dlg_idx", "entity_id").agg(F.min(F.abs(F.col("at") - F.col("edge"))).alias("d")).groupBy("doc_id", "dlg_idx").agg(F.array_sort(F.collect_list(F.struct("d", "entity_id"))).alias("near"))
    return dialogues.join(close, ["doc_id", "dlg_idx"], "left").withColumn("nearby", F.coalesce(F.transform("near", lambda x: x["entity_id"]), F.array().cast("array<bigint>"))).drop("near")


class Sign(NamedTuple):
    """What tells for a participant of a scene at a turn: hundredths of the score, likeness of the voice, and when it came into the scene."""

    plus: int
    voice: float
    enters: tuple[int, int]


class Turn(NamedTuple):
    """What a turn brings: its place, the speaker named (or none), the pair of a scene with just two participants, the nearest entity; where three and more take part, what tells for whom."""

    start: int
    named: int | None
    pair: tuple[int, int] | None
    nearest: int | None
    signs: dict[int, Sign] = {}
    crowd: bool = False


class Memory(NamedTuple):
    last: int | None = None
    previous: int | None = None
    since: int = 0  # turns since a speaker was named
    at: int | None = None


def scored(memory: Memory, turn: Turn, decay: float, entered: dict[int, tuple[int, int]]) -> tuple[int, float] | None:
    """The best participant of a scene of three and more with its score, or none if it is too low or leads by too little. Ties go to who came into the scene first.

    Of the participants only those that something tells for, and the last two speakers, are looked at: the others have TAKES_PART, which neither wins nor comes near what wins."""
    found = []
    for who in {*turn.signs, memory.last, memory.previous} - {None}:
        sign = turn.signs.get(who)
        score = (TAKES_PART + (sign.plus if sign else 0) + (PREVIOUS if who == memory.previous != memory.last else 0) + (AGAIN if who == memory.last else 0)) / 100
        score += min(VOICE_MOST, sign.voice * VOICE_SHARE) if sign else 0
        found.append((-round(score * decay, 3), entered[who], who))
    found.sort()
    if not found or -found[0][0] < LEAST or len(found) > 1 and found[1][0] - found[0][0] < LEAD and -found[0][0] < SURE:
        return None
    return found[0][2], -found[0][0]


def step(memory: Memory, turn: Turn, entered: dict[int, tuple[int, int]]) -> tuple[Memory, int | None, str, str]:
    """The memory after a turn, its speaker, and how and how surely it was found. entered: when those who are known so far came into the scene."""
    if turn.named is not None:
        return Memory(turn.named, memory.last, 0, turn.start), turn.named, "named", "high"
    since = memory.since + 1
    decay = max(FLOOR, DECAY**since)
    spoken = lambda who, how, sure: (Memory(who, memory.last, since, turn.start), who, how, sure)
    if memory.last is not None and turn.pair:
        return spoken(turn.pair[1] if turn.pair[0] == memory.last else turn.pair[0], "alternation", "medium" if decay >= MEDIUM_ALTERNATION else "low")
    recent = memory.at is not None and turn.start - memory.at <= RECENT
    if memory.last is not None and memory.previous is not None and memory.last != memory.previous and recent:
        return spoken(memory.previous, "recent_turns", "medium" if decay >= MEDIUM_RECENT else "low")
    best = scored(memory, turn, decay, entered) if turn.crowd else None
    if best:
        returns = best[0] == memory.previous != memory.last
        return spoken(best[0], "alternation" if returns else "proximity", "medium" if best[1] >= MEDIUM_SCORE else "low")
    voice = max(turn.signs, key=lambda x: (turn.signs[x].voice, [-k for k in turn.signs[x].enters]), default=None)
    if voice is not None and turn.signs[voice].voice >= VOICE_LEAST:
        return spoken(voice, "voice_profile", "low")
    if turn.nearest is not None:
        return spoken(turn.nearest, "proximity", "low")
    return memory._replace(since=since, at=turn.start), None, "none", "unknown"


_SIGNS = "array<struct<entity_id: bigint, plus: bigint, voice: double, enters: struct<dlg_idx: bigint, k: int>>>"
_OUT = pa.schema([("doc_id", pa.int64()), ("dlg_idx", pa.int64()), ("speaker_id", pa.int64()), ("method", pa.string()), ("confidence", pa.string())])


def _spoken(text: Column) -> Column:
    """A line without the marks that open and close it."""
    return F.btrim(F.translate(T.empty_as(text), "«»“”\"", ""), F.lit("— \n"))


def voices(lines: DataFrame) -> DataFrame:
    """What the lines (entity_id, text) of each known speaker have in common: entity_id, profile (sure, formal, mean, std, exclaims, asks, trails, fillers, words)."""
    said = lines.filter("entity_id is not null").select(F.col("entity_id").alias("role"), _spoken(F.col("text")).alias("text"))
    said = written(said)
    low, plain = F.lower("text"), T.plain(F.col("text"))
    count = lambda words: F.sum(F.regexp_count(plain, F.lit(T.whole_words(words))))
    uses = F.array(*[F.struct((-F.sum(T.occurrences(low, f))).alias("n"), F.lit(f).alias("filler")) for f in L.FILLERS])
    fillers = F.transform(F.slice(F.array_sort(F.filter(uses, lambda x: x["n"] < 0)), 1, VOICE_FILLERS), lambda x: x["filler"])
    g = said.groupBy("role").agg(
        count(FORMAL).alias("f"), count(FAMILIAR).alias("u"), F.avg(T.occurrences(F.col("text"), "!")).alias("exclaims"), F.avg(T.occurrences(F.col("text"), "?")).alias("asks"),
        F.avg(T.occurrences(F.col("text"), "...")).alias("trails"), fillers.alias("fillers"))
    words = C.characteristic_words(said, VOICE_WORDS).groupBy("role").agg(F.collect_list("word").alias("words"))
    p = g.join(C.profiles(said).select("role", "n_lines", "mean_words", "std_words"), "role").join(words, "role", "left")
    formal = F.when(F.col("f") + F.col("u") > 0, F.col("f") / (F.col("f") + F.col("u"))).otherwise(0.5)
    return p.select(F.col("role").alias("entity_id"), F.struct(
        F.least(F.lit(1.0), F.col("n_lines") / VOICE_LINES).alias("sure"), formal.alias("formal"), F.col("mean_words").alias("mean"), F.col("std_words").alias("std"), "exclaims", "asks", "trails", "fillers",
        F.coalesce("words", F.array().cast("array<string>")).alias("words")).alias("profile"))


def _likeness(text: Column, p: Column) -> Column:
    """How much a line sounds like a voice, from 0 to 1: address, length, marks, fillers and words count."""
    low = F.lower(text)
    polite, familiar = F.contains(low, F.lit("usted")), F.regexp_like(low, F.lit("tú|tu | tu|tuyo|tuya"))
    address = F.when((polite & (p["formal"] > 0.6)) | (familiar & (p["formal"] < 0.4)), 0.2).when(~polite & ~familiar, 0.1).otherwise(0.0)
    off = F.abs(F.size(F.array_remove(F.split(text, r"\s+"), "")) - p["mean"])
    length = F.when(p["mean"] <= 0, 0.0).when(p["std"] > 0, F.when(off < p["std"], 0.2).when(off < 2 * p["std"], 0.1).otherwise(0.0)).when(off < p["mean"] * 0.5, 0.15).otherwise(0.0)
    mark = lambda has, share, often, seldom: F.when(has & (share > often), 0.33).when(~has & (share < seldom), 0.2).otherwise(0.0)
    has = lambda chars: F.regexp_like(text, F.lit(chars))
    marks = mark(has("[!¡]"), p["exclaims"], 0.15, 0.1) + mark(has("[?¿]"), p["asks"], 0.15, 0.1) + mark(has(r"\.\.\."), p["trails"], 0.05, 0.05)
    filler = F.when(F.exists(p["fillers"], lambda f: F.contains(low, f)), 0.2).otherwise(0.0)
    common = F.size(F.array_intersect(F.split(low, r"[\s,;:.!?¡¿]+"), p["words"]))
    return F.round((address + length + marks * 0.15 + filler + F.least(common * 0.08, F.lit(0.25))) * (0.5 + 0.5 * p["sure"]), 3)


def evidence(dialogues: DataFrame, mentions: DataFrame) -> DataFrame:
    """doc_id, dlg_idx, entity_id, plus: what tells for an entity, or against it, at a turn that no one is named for: nearness, the last mention before it, a verb of speech behind the name, and that the line calls it by its name.

    dialogues: doc_id, dlg_idx, start, stop, text, before, nearby. Each mention is led to the line it stands in or before by running windows."""
    near = dialogues.select("doc_id", "dlg_idx", F.posexplode(F.slice("nearby", 1, len(RANKS))).alias("k", "entity_id"))
    rank = near.select("doc_id", "dlg_idx", "entity_id", F.element_at(F.array(*map(F.lit, RANKS)), F.col("k") + 1).alias("plus"))
    m = mentions.select("doc_id", "entity_id", F.col("start").alias("from"), F.col("stop").alias("to"))
    places = m.select("doc_id", F.col("to").alias("at"), F.struct("entity_id", "to").alias("subject"))
    last = as_of(dialogues.select("doc_id", "dlg_idx", F.col("start").alias("at")), places, ["doc_id"], ["at"], "subject").filter(F.col("at") - F.col("subject.to") <= MENTIONED_WITHIN)
    mentioned = last.select("doc_id", "dlg_idx", "subject.entity_id", F.lit(MENTIONED).alias("plus"))
    # a name in the narration right before the line: its last mention there
    lines = dialogues.select("doc_id", "dlg_idx", F.col("start").alias("at"), "before")
    inside = band_join(lines, m, ["doc_id"], "at", "to", BEFORE).filter((F.col("to") <= F.col("at")) & (F.col("from") >= F.col("at") - F.length("before")) & (F.col("to") - F.col("from") >= 4))
    names = inside.groupBy("doc_id", "dlg_idx", "entity_id").agg(F.max(F.struct("to", "at", "before")).alias("x"))
    tail = F.substring("x.before", F.length("x.before") - (F.col("x.at") - F.col("x.to")).cast("int") + 1, VERB_WITHIN)
    subject = names.filter(F.regexp_like(T.plain(tail), F.lit(T.whole_words(VERBS)))).select("doc_id", "dlg_idx", "entity_id", F.lit(SUBJECT_VERB).alias("plus"))
    held = as_of(m.select("doc_id", "entity_id", "to", F.col("from").alias("at")), dialogues.select("doc_id", F.col("start").alias("at"), F.struct("dlg_idx", "start", "stop", "text").alias("line")), ["doc_id"], ["at"], "line")
    i, n = (F.col("at") - F.col("line.start")).cast("int"), (F.col("to") - F.col("at")).cast("int")
    called = F.regexp_like(F.substring("line.text", i + n + 1, 20), F.lit(r"^\s*,")) & ((i == 0) | F.regexp_like(F.substring("line.text", i, F.lit(1)), F.lit(r"[\s¿¡—«“\"]"))) & (n >= 3)
    addressed = held.filter((F.col("to") <= F.col("line.stop")) & called).select("doc_id", "line.dlg_idx", "entity_id", F.lit(ADDRESSED).alias("plus")).distinct()
    return rank.unionByName(mentioned).unionByName(subject).unionByName(addressed)


def _signs(d: DataFrame, enters: DataFrame, told: DataFrame | None, known: DataFrame | None) -> DataFrame:
    """doc_id, dlg_idx, signs (entity_id, plus, voice, enters): what tells for those who take part in a scene by a turn, and when the one who is named or nearest came in."""
    at = ["doc_id", "chapter", "scene", "dlg_idx"]
    e = d.filter("size(who) > 0").select(*at, F.col("who")[0].alias("entity_id"), F.lit(0).alias("plus"), F.lit(0.0).alias("voice"))
    open_ = d.filter("named is null")
    if told is not None:
        e = e.unionByName(open_.select(*at).join(told, ["doc_id", "dlg_idx"]).select(*at, "entity_id", "plus", F.lit(0.0).alias("voice")))
    if known is not None:
        heard = enters.join(broadcast_if_small(known), "entity_id").withColumnRenamed("enters", "came")
        pairs = open_.select(*at, _spoken(F.col("text")).alias("text")).join(heard, ["doc_id", "chapter", "scene"]).filter(F.col("came.dlg_idx") <= F.col("dlg_idx"))
        e = e.unionByName(pairs.select(*at, "entity_id", F.lit(0).alias("plus"), _likeness(F.col("text"), F.col("profile")).alias("voice")).filter("voice > 0"))
    g = e.groupBy(*at, "entity_id").agg(F.sum("plus").alias("plus"), F.max("voice").alias("voice"))
    part = g.join(enters, ["doc_id", "chapter", "scene", "entity_id"]).filter(F.col("enters.dlg_idx") <= F.col("dlg_idx"))
    return part.groupBy("doc_id", "dlg_idx").agg(F.array_sort(F.collect_list(F.struct("entity_id", "plus", "voice", "enters"))).alias("signs"))


def attribute(dialogues: DataFrame, told: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """doc_id, dlg_idx, speaker_id, method, confidence of dialogues (doc_id, dlg_idx, chapter, scene, start, explicit_id, hint_id, nearby; text, if voices are known).

    In order: who is named; the other one of two; who spoke before the last one, if that is near; among three and more the best by score; the voice most alike; the nearest one. told: what tells for whom (`evidence`);
    known: their voices (`voices`). With neither, there is no score and no voice to go by.

    Memory begins anew at each chapter and scene. Who takes part in a scene so far, and whether it is just two, comes from running windows, and what tells for whom from joins; only the memory of
    the last two speakers is a fold. Two named turns in a row settle it whatever came before, so a scene is cut there, and a task folds the turns between two such cuts."""
    named = F.coalesce("explicit_id", "hint_id")
    scene = ["doc_id", "chapter", "scene"]
    signed = told is not None or known is not None
    d = dialogues.select(
        *scene, "dlg_idx", "start", named.alias("named"), F.when(named.isNull(), F.col("nearby")).otherwise(F.array(named)).alias("who"), F.when(F.col("explicit_id").isNotNull(), "explicit_verb").when(F.col("hint_id").isNotNull(), "hint").alias("how"),
        *(["text"] if known is not None else []))
    # when each of a scene's first three participants comes in
    enters = d.select(*scene, "dlg_idx", F.posexplode("who").alias("k", "entity_id")).groupBy(*scene, "entity_id").agg(F.min(F.struct("dlg_idx", "k")).alias("enters"))
    if signed:
        d, enters = written(d), written(enters)
    nth = F.row_number().over(Window.partitionBy(*scene).orderBy("enters"))
    three = enters.withColumn("nth", nth).filter("nth <= 3").groupBy(*scene).agg(F.array_sort(F.collect_list(F.struct("enters", "entity_id"))).alias("three"))
    here = F.filter("three", lambda x: x["enters"]["dlg_idx"] <= F.col("dlg_idx"))
    null_safe = [d[c].eqNullSafe(F.col(f"__{c}")) for c in scene]
    joined = d.join(three.withColumnsRenamed({c: f"__{c}" for c in scene}), null_safe, "left").drop(*[f"__{c}" for c in scene], "text")
    paired = joined.withColumn("here", here).withColumn("pair", F.when(F.size("here") == 2, F.col("here")))
    paired = paired.join(_signs(d, enters, told, known), ["doc_id", "dlg_idx"], "left") if signed else paired.withColumn("signs", F.lit(None).cast(_SIGNS))
    order = Window.partitionBy(*scene).orderBy("dlg_idx")
    settled = F.col("named").isNotNull() & F.lag("named").over(order).isNotNull()
    cut = paired.withColumn("settled", F.coalesce(settled, F.lit(False))).withColumn("part", F.sum(F.col("settled").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # a part begins with its settled turn; the memory needs the named speaker before it, and when that one came in
    rows = cut.withColumns({"prior": F.when(F.col("settled"), F.lag("named").over(order)), "prior_signs": F.when(F.col("settled"), F.lag("signs").over(order))}).select(
        *scene, "part", "dlg_idx", "start", "named", "how", "prior", "prior_signs", "pair", "signs", (F.lit(signed) & (F.size("here") >= CROWD)).alias("crowd"), F.get(F.col("who"), F.lit(0)).alias("nearest"))

    def fold(t: pa.Table) -> pa.Table:
        turns = sorted(t.to_pylist(), key=lambda r: r["dlg_idx"])
        memory, out = Memory(last=turns[0]["prior"]), []
        entered: dict[int, tuple[int, int]] = {}
        for r in turns:
            for x in (*(r["prior_signs"] or ()), *(r["pair"] or ()), *(r["signs"] or ())):
                entered[x["entity_id"]] = tuple(x["enters"].values())
            signs = {x["entity_id"]: Sign(x["plus"], x["voice"], entered[x["entity_id"]]) for x in r["signs"] or ()}
            pair = tuple(x["entity_id"] for x in r["pair"]) if r["pair"] else None
            memory, who, method, sure = step(memory, Turn(r["start"], r["named"], pair, None if r["named"] is not None else r["nearest"], signs, r["crowd"]), entered)
            out.append({"doc_id": r["doc_id"], "dlg_idx": r["dlg_idx"], "speaker_id": who, "method": r["how"] or method, "confidence": sure})
        return pa.Table.from_pylist(out, _OUT)

    return rows.groupBy(*scene, "part").applyInArrow(fold, from_arrow_schema(_OUT))


def speakers(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Every dialogue span of texts with its speaker among entities (entity_id, name, aliases): doc_id, dlg_idx, start, stop, chapter, scene, verb, speaker_id, method, confidence."""
    docs = written(docs.select("doc_id", "text").filter(F.regexp_like("text", F.lit(SPEECH))))  # other texts have no rows
    mentions = written(find_mentions(docs, entities))
    d = written(with_scenes(docs, named_by_verb(spans(docs), entities, mentions)))
    ready = written(with_nearby(d, mentions).withColumn("hint_id", F.lit(None).cast("long")))
    told = evidence(ready.filter("explicit_id is null"), mentions)
    known = written(voices(d.select(F.col("explicit_id").alias("entity_id"), "text")))
    return d.select("doc_id", "dlg_idx", "start", "stop", "chapter", "scene", "verb").join(attribute(ready, told, known), ["doc_id", "dlg_idx"])


def with_scenes(docs: DataFrame, dialogues: DataFrame) -> DataFrame:
    """dialogues with chapter and scene, both counted from 0 by the headings and scene breaks (lines of stars, dashes or hashes) that begin before them."""
    text = T.plain(F.col("text"))
    mark = r"(?m)^[ \t]*(?:(?:capitulo|chapter|chapitre|kapitel)[^\n]{0,60}|(?:[*#~_-][ \t]*){3,})$"
    z = F.arrays_zip(F.transform(F.split(text, mark, -1), lambda x: F.length(x)).alias("gap"), F.regexp_extract_all(text, F.lit(mark), F.lit(0)).alias("mark"))
    each = docs.select("doc_id", F.posexplode(z).alias("i", "z")).filter("z.mark is not null")
    order = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    chapter = F.regexp_like("z.mark", F.lit("[a-z]")).cast("long")
    marks = each.select("doc_id", (F.sum(F.col("z.gap") + F.length("z.mark")).over(order) - F.length("z.mark")).alias("start"), F.struct(F.sum(chapter).over(order).alias("chapter"), F.count("*").over(order).alias("scene")).alias("place"))
    placed = as_of(dialogues, marks, ["doc_id"], ["start"], "place")
    return placed.withColumns({"chapter": F.coalesce("place.chapter", F.lit(0)), "scene": F.coalesce("place.scene", F.lit(0))}).drop("place")
