"""Time in texts and timelines: markers with their offsets and parsed values, anachronisms, ages, gaps and who is alive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import lexicons as L
from fabula.functions import text as T
from fabula.operators.texts import MONTHS, years
from fabula.sources import tables
from fabula.sources.tables import in_reading_order


def _either(*forms: str) -> str:
    return "(?:" + "|".join(sorted(forms, key=len, reverse=True)) + ")"


# The grammar of Spanish time expressions in plain text: parts first, then the shapes of each kind.
MONTH = _either(*MONTHS)
NUMBER = _either("[0-9]{1,3}", *L.NUMBER_WORDS, *L.VAGUE_NUMBERS)
UNIT = _either(*L.UNIT_DAYS, *(u + "s" for u in L.UNIT_DAYS if u != "mes"), "meses")
AMOUNT = f"{NUMBER} +{UNIT}"
#: What follows or precedes an amount, or a named day, and turns it to the future or the past.
AHEAD = {"after": ("despues", "mas tarde", "mas adelante"), "before": ("dentro de", "al cabo de", "en menos de", "tras"), "next": ("siguiente", "proximo", "proxima", "que viene")}
BEHIND = {"after": ("antes", "atras"), "before": ("hace", "desde hace", "hara"), "next": ("anterior", "previo", "previa", "pasado", "pasada")}
#: Set phrases and the days they move the story by.
PHRASES = {"anteayer": -2.0, "ayer": -1.0, "anoche": -1.0, "hoy": 0.0, "esa misma noche": 0.0, "poco despues": 1 / 24, "al rato": 1 / 24, "mas tarde": 4 / 24, "pasado manana": 2.0, "poco antes": -1 / 24}
_YEAR = "(?:1[0-9]{3}|20[0-2][0-9])"
KINDS = {
    "absolute_date": f"[0-9]{{1,2}} +de +{MONTH}(?: +del? +(?:ano +)?{_YEAR})?|{MONTH} +del? +(?:ano +)?{_YEAR}|ano +(?:de +)?{_YEAR}|(?:19[0-9]{{2}}|20[0-2][0-9])",
    "character_age": f"(?:a +los|con|cumpl(?:ir|io|ia|e|en)|ten(?:ia|dria|er)|tuvo|tiene|edad +de) +{_either('[0-9]{1,3}', *L.NUMBER_WORDS)} +anos",
    "relative_time": f"{_either(*AHEAD['before'], *BEHIND['before'])} +{AMOUNT}|{AMOUNT} +{_either(*AHEAD['after'], *BEHIND['after'])}"
                     f"|(?:el|la|al|a +la) +(?:manana|tarde|noche|{UNIT}) +{_either(*AHEAD['next'], *BEHIND['next'])}|{_either(*PHRASES)}",
    "duration": f"(?:durante|a +lo +largo +de|por +espacio +de) +{AMOUNT}|{AMOUNT} +(?:enter|seguid|complet)[oa]s?",
    "season_epoch": "(?:aquel(?:la)?|es[ea]|est[ea]|el|la|en) +(?:(?:pasado|proximo) +)?(?:verano|otono|invierno|primavera|posguerra|infancia|juventud)",
    "frequency": f"siempre|nunca|jamas|a +(?:veces|menudo|diario)|de +(?:vez|cuando) +en +(?:cuando|vez)|(?:rara|cada) +vez|cada +{UNIT}|tod[oa]s +l[oa]s +{UNIT}|a +menudo"}


def located(docs: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """doc_id, start, stop, kind, text (plain) of all whole-word hits of the kinds' patterns in the texts' plain form, from left to right without overlap.

    The kinds are one alternation, so a text is read twice whatever their number, and of it only the lengths between hits travel on.
    Of two kinds that begin at one place the first one named takes it."""
    pattern = T.whole_words("|".join(f"(?:{p})" for p in kinds.values()))
    plain = T.plain(F.col("text"))
    gaps, hits = F.transform(F.split(plain, pattern, -1), lambda x: F.length(x)), F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))
    rows = docs.select("doc_id", gaps.alias("gaps"), hits.alias("hits")).filter(F.size("hits") > 0).select("doc_id", F.posexplode(F.arrays_zip("gaps", "hits")).alias("i", "z")).filter("z.hits is not null")
    so_far = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("z.gaps") + F.length("z.hits")).over(so_far)
    found = rows.select("doc_id", (stop - F.length("z.hits")).alias("start"), stop.alias("stop"), F.col("z.hits").alias("text"))
    kind = F.coalesce(*[F.when(F.regexp_like("text", F.lit(f"^(?:{p})$")), k) for k, p in kinds.items()])
    return found.select("doc_id", "start", "stop", kind.alias("kind"), "text")


def located_sql(kinds: dict[str, str], table: str = "documents") -> str:
    """The same in SQL, as the body of a query."""
    pattern = "\\b(?:" + "|".join(f"(?:{p})" for p in kinds.values()) + ")\\b"
    cases = " ".join(f"WHEN regexp_full_match(text, '{p}') THEN '{k}'" for k, p in kinds.items())
    return f"""SELECT doc_id, stop - length(text) AS start, stop, CASE {cases} END AS kind, text FROM (
  SELECT doc_id, hit AS text, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM (
    SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM (SELECT doc_id, translate(coalesce(text, ''), '{T.PLAIN_FROM}', '{T.PLAIN_TO}') AS t FROM {table}))))"""


def marker_counts(docs: DataFrame) -> DataFrame:
    """How many markers of each kind a text holds."""
    return located(docs, KINDS).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def _number(word: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in L.NUMBER_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(words, word), word.try_cast("int"))


def markers(docs: DataFrame) -> DataFrame:
    """Time markers of texts with their values: doc_id, start, stop, kind, text, direction, quantity, unit, days, year, month, day, age, confidence.

    Null where a marker doesn't say; a vague amount ("varios") has a unit but no quantity. Years are those from 1000 to 2029, ages go up to 130.
    The more of its values a marker states, the surer it is: 0.6, and 0.1 for each of them up to 0.9."""
    text = F.regexp_replace("text", " +", " ")
    is_kind = lambda *ks: F.col("kind").isin(*ks)
    part = lambda p, i: F.nullif(F.regexp_extract("plain", p, i), F.lit(""))
    says = lambda words: F.regexp_like("plain", F.lit(rf"\b{_either(*words)}\b"))
    amount = f"\\b({NUMBER}) ({UNIT})\\b"
    phrases = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    moved = F.when(is_kind("relative_time"), F.try_element_at(phrases, F.col("plain")))
    turn = F.when(says([w for ws in AHEAD.values() for w in ws]), "future").when(says([w for ws in BEHIND.values() for w in ws]), "past")
    direction = F.when(is_kind("relative_time"), F.when(moved.isNotNull(), F.when(moved > 0, "future").when(moved < 0, "past")).otherwise(turn))
    named = part(f"^(?:el|la|al|a la) ({UNIT}|manana|tarde|noche) ", 1)
    unit = F.when(is_kind("relative_time", "duration"), F.coalesce(part(amount, 2), F.when(moved.isNull(), named)))
    unit = F.when(unit.isin("manana", "tarde", "noche"), "dia").when(unit.isin("mes", "meses"), "mes").otherwise(F.regexp_replace(unit, "s$", ""))
    counted = part(amount, 1)
    quantity = F.when(is_kind("relative_time", "duration"), F.when(counted.isNotNull(), _number(counted)).when(moved.isNull() & named.isNotNull(), 1))
    dated = is_kind("absolute_date")
    year = F.when(dated, part("([0-9]{4})", 1).cast("int"))
    month = F.when(dated, F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), part(f"({MONTH})", 1)), F.lit(0)).cast("int"))
    day = F.when(dated, part("^([0-9]{1,2}) de ", 1).cast("int"))
    age = F.when(is_kind("character_age"), _number(part("([a-z0-9]+) anos$", 1)))
    out = located(docs, KINDS).withColumn("plain", text).withColumns(
        {"direction": direction, "quantity": quantity, "unit": unit, "moved": moved, "year": year, "month": month, "day": day, "age": F.when(age <= 130, age)})
    units = F.create_map(*[F.lit(x) for pair in L.UNIT_DAYS.items() for x in pair])
    days = F.when(is_kind("relative_time"), F.coalesce("moved", F.col("quantity") * F.try_element_at(units, F.col("unit")) * F.when(F.col("direction") == "past", -1).otherwise(1)))
    stated = sum((F.col(c).isNotNull().cast("int") for c in ("direction", "quantity", "unit", "year", "month", "day", "age")), F.lit(0))
    return out.select(
        "doc_id", "start", "stop", "kind", F.col("plain").alias("text"), "direction", "quantity", "unit", days.alias("days"), "year", "month", "day", "age", F.least(F.lit(9), stated + 6).cast("double").alias("tenths")
    ).withColumn("confidence", F.col("tenths") / 10).drop("tenths")


def markers_sql(table: str = "documents") -> str:
    """The same in SQL, for engines without look-around."""
    values = lambda pairs: "MAP {" + ", ".join(f"'{k}': {v}" for k, v in pairs) + "}"
    numbers = values(L.NUMBER_WORDS.items())
    number = lambda w: f"coalesce(element_at({numbers}, {w})[1], try_cast({w} AS INTEGER))"
    part = lambda p, i: f"nullif(regexp_extract(text, '{p}', {i}), '')"
    says = lambda d: f"regexp_matches(text, '\\b{_either(*(w for ws in d.values() for w in ws))}\\b')"
    amount = f"\\b({NUMBER}) ({UNIT})\\b"
    return f"""WITH h AS (SELECT doc_id, start, stop, kind, regexp_replace(text, ' +', ' ', 'g') AS text FROM ({located_sql(KINDS, table)})),
m AS (SELECT *, kind = 'relative_time' AS rel, kind IN ('relative_time', 'duration') AS timed, CASE WHEN kind = 'relative_time' THEN element_at({values(PHRASES.items())}, text)[1] END AS moved,
  {part(amount, 1)} AS counted, {part(amount, 2)} AS unit1, {part(f"^(?:el|la|al|a la) ({UNIT}|manana|tarde|noche) ", 1)} AS named FROM h),
v AS (SELECT *, CASE WHEN rel THEN CASE WHEN moved > 0 THEN 'future' WHEN moved < 0 THEN 'past' WHEN moved IS NOT NULL THEN NULL WHEN {says(AHEAD)} THEN 'future' WHEN {says(BEHIND)} THEN 'past' END END AS direction,
  CASE WHEN timed THEN coalesce(unit1, CASE WHEN moved IS NULL THEN named END) END AS u,
  CASE WHEN timed THEN CASE WHEN counted IS NOT NULL THEN {number("counted")} WHEN moved IS NULL AND named IS NOT NULL THEN 1 END END AS quantity,
  CASE WHEN kind = 'absolute_date' THEN CAST({part("([0-9]{4})", 1)} AS INTEGER) END AS year, CASE WHEN kind = 'absolute_date' THEN CAST(list_position({list(MONTHS)!r}, {part(f"({MONTH})", 1)}) AS INTEGER) END AS month,
  CASE WHEN kind = 'absolute_date' THEN CAST({part("^([0-9]{1,2}) de ", 1)} AS INTEGER) END AS day, CASE WHEN kind = 'character_age' THEN {number(part("([a-z0-9]+) anos$", 1))} END AS age0 FROM m),
w AS (SELECT *, CASE WHEN u IN ('manana', 'tarde', 'noche') THEN 'dia' WHEN u IN ('mes', 'meses') THEN 'mes' ELSE regexp_replace(u, 's$', '') END AS unit, CASE WHEN age0 <= 130 THEN age0 END AS age FROM v)
SELECT doc_id, start, stop, kind, text, direction, quantity, unit, CASE WHEN rel THEN CAST(coalesce(moved, quantity * element_at({values(L.UNIT_DAYS.items())}, unit)[1] * CASE WHEN direction = 'past' THEN -1 ELSE 1 END) AS DOUBLE) END AS days, year, month, day, age,
  least(9, 6 + {" + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in ("direction", "quantity", "unit", "year", "month", "day", "age"))}) / 10.0::DOUBLE AS confidence FROM w"""


_PARTICIPLE = "(?:[a-z]+(?:ado|ido)|dicho|hecho|visto|puesto|vuelto|muerto|escrito|abierto|roto)"
#: Signs that a text leaves the order of telling, by the verb forms that carry them: the pluperfect and verbs of memory look back, the conditional and
#: periphrases of the future look ahead, the imperfect subjunctive after its particles leaves what happens.
ORDER_SIGNALS = {
    "retrospective": f"hab(?:ia|ias|iamos|iais|ian) +(?:sido +)?{_PARTICIPLE}|(?:record|evoc|rememor|anor)(?:o|aba|aban|ando|aron)|{AMOUNT} +{_either(*BEHIND['after'])}|en +(?:aquel|aquella|aquellos|aquellas) +(?:dias|epoca|tiempos?|anos)",
    "prospective": f"ib(?:a|an|amos) +a +[a-z]+[aei]r|habri(?:a|an) +de +[a-z]+[aei]r|{AMOUNT} +{_either(*AHEAD['after'])}|algun +dia|(?:todavia|aun) +no +sab(?:ia|ian)",
    "hypothetical": "(?:como +si|si|ojala|quien) +(?:no +)?(?:se +|lo +|la +|le +)?(?:fuera|fuese|[a-z]+(?:iera|iese|ara|ase))[sn]?"}


def chapter_orders(docs: DataFrame, least: int = 2) -> DataFrame:
    """doc_id, chapter, a count for each kind of signal, and the order a chapter is told in.

    retrospective or prospective where that signal comes at least `least` times and more often than the other one; mixed on a tie; else linear."""
    chapters = tables.chapters(docs).select(F.struct("doc_id", "chapter").alias("doc_id"), "text")
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    counts = located(chapters, ORDER_SIGNALS).groupBy("doc_id").agg(*map(n, ORDER_SIGNALS))
    back, ahead = F.col("retrospective"), F.col("prospective")
    order = F.when(F.greatest(back, ahead) < least, "linear").when(back > ahead, "retrospective").when(ahead > back, "prospective").otherwise("mixed")
    return counts.select("doc_id.doc_id", "doc_id.chapter", *ORDER_SIGNALS, order.alias("told"))


def chapter_orders_sql(table: str = "documents", least: int = 2) -> str:
    lines = f"(SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {table})"
    chapters = f"(SELECT {{'doc_id': doc_id, 'chapter': c}} AS doc_id, array_to_string(ls[(c - 1) * {tables.CHAPTER_PARAGRAPHS} + 1 : c * {tables.CHAPTER_PARAGRAPHS}], chr(10)) AS text FROM (SELECT *, unnest(range(1, CAST(ceil(len(ls) / {tables.CHAPTER_PARAGRAPHS}.0) AS BIGINT) + 1)) AS c FROM {lines}))"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ORDER_SIGNALS)
    return f"""SELECT doc_id.doc_id AS doc_id, doc_id.chapter AS chapter, {", ".join(ORDER_SIGNALS)}, CASE WHEN greatest(retrospective, prospective) < {least} THEN 'linear' WHEN retrospective > prospective THEN 'retrospective' WHEN prospective > retrospective THEN 'prospective' ELSE 'mixed' END AS told
FROM (SELECT doc_id, {counts} FROM ({located_sql(ORDER_SIGNALS, chapters)}) GROUP BY 1)"""


def anachronisms(docs: DataFrame, earliest: dict[str, int] = L.EARLIEST_YEAR) -> DataFrame:
    """Things named in a text whose earliest year lies after the last year the text itself names; surer the wider the gap."""
    period = years(docs).select("doc_id", "last_year")
    things = F.broadcast(docs.sparkSession.createDataFrame(sorted(earliest.items()), "token_lc string, earliest long"))  # a fixed word list
    used = tables.tokens(docs).join(things, "token_lc").groupBy("doc_id", F.col("token_lc").alias("word"), "earliest").agg(F.count("*").alias("n"))
    gap = F.col("earliest") - F.col("last_year")
    return used.join(period, "doc_id").filter(gap > 0).select("doc_id", "word", "n", gap.alias("gap"), F.when(gap > 200, 0.95).when(gap > 50, 0.85).otherwise(0.7).alias("confidence"))


def inconsistent_ages(events: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Neighbouring events whose ages (number) don't differ as their dates do; without both dates, ages that fall."""
    w = in_reading_order()
    e = events.select("doc_id", "event_id", F.col("number").alias("age"), F.lag("number").over(w).alias("age0"), F.when(F.col("is_dated"), F.col("story_date")).alias("d"), F.lag(F.when(F.col("is_dated"), F.col("story_date"))).over(w).alias("d0"))
    off = F.abs((F.col("age") - F.col("age0")) - F.datediff("d", "d0") / 365.25)
    kind = F.when(off > tolerance, "pace").when(off.isNull() & (F.col("age") < F.col("age0")), "falls")
    return e.filter("age0 is not null").withColumn("kind", kind).filter("kind is not null").select("doc_id", "event_id", "age", "age0", "kind")


def chapter_times(events: DataFrame) -> DataFrame:
    """The story time of each chapter, the first date told in it, and the hours since the chapter before that has one (0 for the first)."""
    c = events.filter("is_dated").groupBy("doc_id", "chapter").agg(F.min("story_date").alias("at"))
    before = Window.partitionBy("doc_id").orderBy("chapter")
    return c.select("doc_id", "chapter", F.col("at").cast("string").alias("date"), F.coalesce(F.datediff("at", F.lag("at").over(before)) * 24, F.lit(0)).cast("long").alias("gap_hours"))


def alive_in_chapters(events: DataFrame) -> DataFrame:
    """Whether a document's character, who dies at its first dated event with number 0, lives in each chapter: unless the chapter's time lies after the death. Unknown times count as alive."""
    death = events.filter("number = 0 and is_dated").groupBy("doc_id").agg(F.min("story_date").alias("death"))
    times = events.groupBy("doc_id", "chapter").agg(F.min(F.when(F.col("is_dated"), F.col("story_date"))).alias("at"))
    return times.join(death, "doc_id", "left").select("doc_id", "chapter", F.coalesce(F.col("death") >= F.col("at"), F.lit(True)).alias("alive"))


def ages_by_chapter(events: DataFrame) -> DataFrame:
    """A character's age in each chapter with a date: the age stated by the nearest dated reference (odd numbers; ties to the earlier date), moved on by the time between, never below 0."""
    times = events.filter("is_dated").groupBy("doc_id", "chapter").agg(F.min("story_date").alias("at"))
    refs = events.filter("is_dated and number % 2 = 1").groupBy("doc_id", F.col("story_date").alias("ref")).agg(F.max("number").alias("age"))
    nearest = F.min_by(F.struct("ref", "age"), F.struct(F.abs(F.datediff("at", "ref")), F.col("ref"))).alias("r")
    g = times.join(refs, "doc_id").groupBy("doc_id", "chapter", "at").agg(nearest)  # a document has a few references
    return g.select("doc_id", "chapter", F.greatest(F.lit(0), F.floor(F.col("r.age") + F.datediff("at", "r.ref") / 365.25)).cast("long").alias("age"))
