"""Editorial operators over texts, entities, interactions and findings: coordinates, diffs, mentions, votes, imports, dictionaries, scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import batches as B
from fabula.functions import text as T
from fabula.operators.corrections import scene_breaks
from fabula.operators.story import ancestors
from fabula.sources import tables
from fabula.sources.shared import written


def paragraph_to_text(places: DataFrame, docs: DataFrame) -> DataFrame:
    """Places in paragraphs (doc_id, para_idx, local) as offsets in the text; a place beyond its paragraph is left out."""
    p = tables.paragraphs(docs)
    return places.join(p, ["doc_id", "para_idx"]).filter(F.col("local") <= F.col("end_char") - F.col("start_char")).select("doc_id", "para_idx", "local", (F.col("start_char") + F.col("local")).alias("offset"))


def paragraph_duplicates(docs: DataFrame, least_chars: int = 50) -> DataFrame:
    """Paragraphs of at least least_chars, equal up to case and white space, that occur in several places: one row for each with its places counted."""
    norm = F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))
    p = tables.paragraphs(docs).select("doc_id", "para_idx", norm.alias("norm")).filter(F.length("norm") >= least_chars)
    g = p.groupBy(F.md5("norm").alias("paragraph")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.min(F.struct("doc_id", "para_idx")).alias("first"))
    return g.filter("n > 1").select("paragraph", "n", "n_docs", F.col("first.doc_id").alias("first_doc"), F.col("first.para_idx").alias("first_para"))


def paragraph_diffs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paragraphs kept, removed and added between two versions (doc_id, text), as bags, and 2 * kept over all: the k-th copy of a paragraph meets the k-th copy."""
    def numbered(docs: DataFrame, side: str) -> DataFrame:
        p = tables.paragraphs(docs).filter(F.trim("text") != "").select("doc_id", F.md5(F.trim("text")).alias("h"), "para_idx")
        return p.select("doc_id", "h", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("para_idx")).alias("k"), F.lit(True).alias(side))

    both = numbered(old, "o").join(numbered(new, "n"), ["doc_id", "h", "k"], "full_outer")
    g = both.groupBy("doc_id").agg(F.count_if(F.col("o") & F.col("n")).alias("kept"), F.count_if(F.col("n").isNull()).alias("removed"), F.count_if(F.col("o").isNull()).alias("added"))
    return g.withColumn("ratio", F.round(2 * F.col("kept") / (2 * F.col("kept") + F.col("removed") + F.col("added")), 6))


def in_modified_area(places: DataFrame, changes: DataFrame, length: int = 50, margin: int = 200) -> DataFrame:
    """Places (doc_id, chapter, entity_id, start_char, end_char) that a changed span (doc_id, chapter, at .. at + length) overlaps within the margin. Spans are at most 50 long, so starts that count lie in a band."""
    p = places.select("doc_id", "chapter", "entity_id", "start_char", "end_char")
    c = changes.select("doc_id", "chapter", "at")
    overlap = (F.col("at") - margin < F.col("end_char")) & (F.col("at") + length + margin > F.col("start_char"))
    # changes are fewer, so they go to three blocks each; a place stays in its own and is counted there, where it is joined
    block = F.floor(F.col("start_char") / (length + margin + 51))
    p = p.withColumn("__block", block)
    c = c.withColumn("__block", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("at") / (length + margin + 51)) + d)))
    met = p.join(c, ["doc_id", "chapter", "__block"]).filter(overlap)
    return met.groupBy("doc_id", "chapter", "__block", "entity_id", "start_char", "end_char").agg(F.count("*").alias("n_changes")).drop("__block")


def entity_list(entities: DataFrame, mentions: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Entities of some types with their active mentions, most mentioned first, then by name."""
    n = mentions.filter("is_active").groupBy("entity_id").agg(F.count("*").alias("mention_count"))
    e = entities.filter(F.col("entity_type").isin(*kinds)).join(n, "entity_id", "left").select("entity_id", "name", "entity_type", F.coalesce("mention_count", F.lit(0)).alias("mention_count"))
    return e.orderBy(F.desc("mention_count"), "name", "entity_id")


def speech_kinds(docs: DataFrame, other_than: str) -> DataFrame:
    """Dialogue spans whose kind (by their opening mark) is not the given one."""
    kind = F.when(F.col("text").startswith("—"), "dash").when(F.col("text").startswith("«"), "angular").when(F.col("text").startswith("“"), "curly").otherwise("straight")
    return tables.dialogues(docs).select("doc_id", "dlg_idx", kind.alias("kind"), F.length("text").cast("long").alias("n_chars")).filter(F.col("kind") != other_than)


def scenes_with(mentions: DataFrame, entities: DataFrame, importance: str, least: int = 3) -> DataFrame:
    """Scenes (a document's chapters) with at least `least` mentions and a participant of the given importance: mentions, participants, and those of that importance."""
    own = entities.filter(F.col("importance") == importance).select("entity_id", F.lit(True).alias("wanted"))
    g = mentions.join(own, "entity_id", "left").groupBy("doc_id", "chapter").agg(
        F.count("*").alias("n"), F.countDistinct("entity_id").alias("n_participants"), F.countDistinct(F.when(F.col("wanted"), F.col("entity_id"))).alias("n_wanted"))
    return g.filter((F.col("n") >= least) & (F.col("n_wanted") > 0))


def scene_stats(docs: DataFrame) -> DataFrame:
    """Scenes of each text, whether it is divided at all, and the longest."""
    g = scene_breaks(docs).groupBy("doc_id").agg(F.count("*").alias("n_scenes"), F.max(F.col("end_char") - F.col("start_char")).alias("longest"), F.sum("n_lines").alias("n_lines"))
    return g.withColumn("has_scenes", F.col("n_scenes") > 1)


def entity_links(links: DataFrame, entities: DataFrame, books: DataFrame) -> DataFrame:
    """Links (a, b) with both entities' names and their books' (book_id, title); ends that don't exist stay, with empty names."""
    side = lambda s: entities.select(F.col("entity_id").alias(s), F.col("name").alias(f"name_{s}"), F.col("book_id").alias(f"book_{s}"))
    title = lambda s: books.select(F.col("book_id").alias(f"book_{s}"), F.col("title").alias(f"title_{s}"))
    out = links.join(side("a"), "a", "left").join(side("b"), "b", "left").join(title("a"), "book_a", "left").join(title("b"), "book_b", "left")
    return out.select("a", "b", *[F.coalesce(c, F.lit("")).alias(c) for c in ("name_a", "name_b", "title_a", "title_b")])


def interactions_by_chapter(x: DataFrame, entities: DataFrame) -> DataFrame:
    """Interactions of each chapter between a known entity and another, known or not: counted, with mean tone."""
    named = x.join(entities.select(F.col("entity_id").alias("a"), F.col("name").alias("name_a")), "a").join(entities.select(F.col("entity_id").alias("b"), F.col("name").alias("name_b")), "b", "left")
    return named.groupBy("chapter", "name_a", F.coalesce("name_b", F.lit("")).alias("name_b")).agg(F.count("*").alias("n"), F.round(F.avg("tone_pct"), 6).alias("mean_tone"))


def healed_differently(events: DataFrame) -> DataFrame:
    """(entity, book, kind, part): injuries of one book and healings of a later one that name different parts of the body."""
    pick = lambda kind, s: events.filter((F.col("kind") == kind) & (F.col("part") != "")).select("entity", F.col("book").alias(f"book_{s}"), F.col("part").alias(f"part_{s}")).distinct()
    return pick("injury", "a").join(pick("healing", "b"), "entity").filter("book_a < book_b and part_a <> part_b")


def supporting_characters(mentions: DataFrame, x: DataFrame, least: int = 3, most: int = 60, chapters: int = 2) -> DataFrame:
    """Entities with few mentions in some chapters that also act or speak: mentions, chapters, span, partners."""
    g = mentions.groupBy("entity_id").agg(F.count("*").alias("n"), F.countDistinct("chapter").alias("n_chapters"), F.min("chapter").alias("first"), F.max("chapter").alias("last"))
    g = g.filter(F.col("n").between(least, most) & (F.col("n_chapters") >= chapters))
    ends = x.select(F.col("a").alias("entity_id"), F.col("b").alias("o")).unionByName(x.select(F.col("b").alias("entity_id"), F.col("a").alias("o")))
    return g.join(ends.groupBy("entity_id").agg(F.countDistinct("o").alias("n_partners")), "entity_id")


def rejection_stats(decisions: DataFrame) -> DataFrame:
    """Conditional counts of decisions (scope, keep, decided_by): null counts as neither."""
    return decisions.groupBy("scope").agg(F.count("*").alias("n"), F.count_if(F.col("keep")).alias("kept"), F.count_if(~F.col("keep")).alias("dropped"), F.count_if(F.col("decided_by") == "user").alias("by_user"))


def history_stats(log: DataFrame) -> DataFrame:
    """Actions by type, and all."""
    g = log.groupingSets([["event_type"], []], "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    return g.select(F.coalesce("event_type", F.lit("all")).alias("action"), "n", "last")


def relationship_vote(votes: DataFrame, bonus: float = 1.15, least: float = 0.3) -> DataFrame:
    """(a, b, kind, method, score, weight): the weighted mean of each relation, times a bonus if two methods agree, 1 at most; those below `least` go. The best vote's method is its evidence."""
    g = votes.groupBy("a", "b", "kind").agg(F.sum(F.col("score") * F.col("weight")).alias("s"), F.sum("weight").alias("w"), F.countDistinct("method").alias("n_methods"), F.max_by("method", F.struct("score", "method")).alias("best"))
    mean = F.col("s") / F.col("w")
    score = F.round(F.when(F.col("n_methods") >= 2, F.least(F.lit(1.0), mean * bonus)).otherwise(mean) + 1e-9, 6)
    return g.filter("w > 0").select("a", "b", "kind", "n_methods", "best", score.alias("confidence")).filter(F.col("confidence") >= least)


def consolidated_attributes(values: DataFrame) -> DataFrame:
    """(entity, key, value, confidence): one row for each value up to case and spaces."""
    return values.groupBy("entity", "key", F.lower(F.trim("value")).alias("value")).agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


def inconsistent_attributes(values: DataFrame, synonyms: dict[str, str], least: float = 0.05) -> DataFrame:
    """Keys of an entity with more than one value once synonyms are put together: the values, and the highest confidence of a pair (the lesser of its two)."""
    words = F.create_map(*[F.lit(x) for pair in sorted(synonyms.items()) for x in pair])
    c = consolidated_attributes(values).withColumn("value", F.coalesce(F.try_element_at(words, F.col("value")), F.col("value"))).groupBy("entity", "key", "value").agg(F.max("confidence").alias("confidence"))
    g = c.groupBy("entity", "key").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("values"), F.count("*").alias("n"), F.get(F.sort_array(F.collect_list("confidence"), asc=False), F.lit(1)).alias("confidence"))
    return g.filter((F.col("n") > 1) & (F.col("confidence") >= least))


def emotional_evolution(states: DataFrame) -> DataFrame:
    """Characters whose prevailing tone turns to its opposite from one chapter to the very next."""
    c = states.groupBy("doc_id", "entity_id", "chapter").agg(F.signum(F.sum("tone")).cast("int").alias("tone"))
    w = Window.partitionBy("doc_id", "entity_id").orderBy("chapter")
    c = c.withColumn("before", F.lag("tone").over(w)).withColumn("chapter0", F.lag("chapter").over(w))
    return c.filter("chapter = chapter0 + 1 and tone * before = -1").select("doc_id", "entity_id", "chapter", "before", "tone")


def attributions(docs: DataFrame) -> DataFrame:
    """Lines of speech that open with a dash or quote, and how many of them go on after it closes (an attribution may follow)."""
    t = F.trim("text")
    opens = t.rlike('^[—«“"]')
    closed = t.rlike('^—[^—]+—|^«[^»]+».*[a-z]|^“[^”]+”.*[a-z]|^"[^"]+".*[a-z]')
    g = tables.chapters(docs).select("doc_id", "chapter", F.explode(F.split("text", "\n")).alias("text")).filter(opens)
    return g.groupBy("doc_id", "chapter").agg(F.count("*").alias("n_lines"), F.count_if(closed).alias("n_attributed"))


def gender_of_names(docs: DataFrame, ambiguous: tuple[str, ...], female: tuple[str, ...], male: tuple[str, ...]) -> DataFrame:
    """Capitalised words as first names: unknown if ambiguous, by list, else by their ending in a or o."""
    w = F.lower("token")
    kind = F.when(w.isin(*ambiguous), "unknown").when(w.isin(*female), "female").when(w.isin(*male), "male").when(w.endswith("a"), "female").when(w.endswith("o"), "male").otherwise("unknown")
    return tables.tokens(docs).filter(F.col("token").rlike("^[A-ZÁÉÍÓÚÑ][a-záéíóúüñ]{2,}$")).groupBy(w.alias("name"), kind.alias("gender")).agg(F.count("*").alias("n"))


def interaction_asymmetry(x: DataFrame, alert: float = 0.5) -> DataFrame:
    """Pairs by what goes each way: counts, (there - back) over all, mean tone each way, and whether that calls for an alert."""
    d = x.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("tone_pct").alias("tone"))
    there, back = d.filter("a < b"), d.filter("a > b").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"), F.col("tone").alias("other"))
    j = there.join(back, ["a", "b"], "full_outer").fillna(0, ["n", "m"])
    score = (F.col("n") - F.col("m")) / (F.col("n") + F.col("m"))
    opposite = F.coalesce(F.col("tone") * F.col("other") < 0, F.lit(False))
    return j.select("a", "b", F.col("n").alias("there"), F.col("m").alias("back"), F.round(score, 6).alias("score"), ((F.abs(score) > alert) | opposite).alias("alert"))


def register_scores(docs: DataFrame, lexicons: dict[str, tuple[str, ...]], least: int = 2) -> DataFrame:
    """Registers of a text: distinct words of each list (none below `least`), over a hundredth of its distinct words, 1 at most; neutral is 1 less twice the highest, .1 at least; all normalised to 1."""
    ws = F.array_distinct(T.word_list(F.lower("text")))
    rows = docs.select("doc_id", ws.alias("ws")).filter(F.size("ws") > 0)
    for k, v in lexicons.items():
        hits = F.size(F.array_intersect("ws", F.array(*map(F.lit, v))))
        rows = rows.withColumn(k, F.least(F.lit(1.0), F.when(hits >= least, hits).otherwise(0) / F.greatest(F.size("ws") / 100, F.lit(1.0))))
    rows = rows.withColumn("neutral", F.greatest(F.lit(0.1), 1 - 2 * F.greatest(*lexicons)))
    total = sum((F.col(k) for k in lexicons), F.col("neutral"))
    return rows.select("doc_id", *[F.round(F.col(k) / total, 6).alias(k) for k in (*lexicons, "neutral")])


def snapshot(entities: DataFrame, mentions: DataFrame, aliases: int = 10) -> DataFrame:
    """Entities with their mention counts and at most `aliases` of the chapters that mention them, as a snapshot keeps them; a project without any gives none."""
    m = mentions.groupBy("entity_id").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("chapter")), 1, aliases), ",").alias("chapters"))
    return entities.join(m, "entity_id", "left").select("entity_id", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("chapters", F.lit("")).alias("chapters"), F.substring(F.sha2(F.concat_ws("|", "name", "entity_type"), 256), 1, 16).alias("digest"))


def imported_decisions(local: DataFrame, imported: DataFrame) -> DataFrame:
    """A dry run of an import (key, value, at): new, same, taken over or kept. The imported row wins on ties and where the local one has no time; the local one wins if the imported one has none."""
    l, i = local.select("key", F.col("value").alias("was"), F.col("at").alias("at_l")), imported.select("key", F.col("value").alias("now"), F.col("at").alias("at_i"))
    wins = F.col("at_i").isNotNull() & (F.col("at_l").isNull() | (F.col("at_i") >= F.col("at_l")))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "only_local").when(F.col("was") == F.col("now"), "same").when(wins, "taken_over").otherwise("kept")
    both = l.join(i, "key", "full_outer").withColumn("status", status)
    return both.select("key", "status", F.when(F.col("status").isin("new", "taken_over"), F.col("now")).otherwise(F.col("was")).alias("value"))


def dictionary(docs: DataFrame, custom: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Entries of three sources by word: how often texts use it, its custom note, its synonyms; any of them may lack."""
    used = tables.tokens(docs).groupBy(F.col("token_lc").alias("word")).agg(F.count("*").alias("n_uses"))
    j = used.join(custom.select("word", "note"), "word", "full_outer").join(synonyms.groupBy("word").agg(F.array_join(F.array_sort(F.collect_set("synonym")), ",").alias("synonyms")), "word", "full_outer")
    sources = (F.when(F.col("note").isNotNull(), 1).otherwise(0) + F.when(F.col("synonyms").isNotNull(), 1).otherwise(0) + F.when(F.col("n_uses").isNotNull(), 1).otherwise(0)).cast("int")
    return j.select("word", F.coalesce("n_uses", F.lit(0)).alias("n_uses"), F.coalesce("note", F.lit("")).alias("note"), F.coalesce("synonyms", F.lit("")).alias("synonyms"), sources.alias("n_sources"))


def prefix_search(docs: DataFrame, length: int = 3, top: int = 10) -> DataFrame:
    """For every prefix of `length` letters, accents left out, the first `top` words that begin with it: shortest first, then by letter."""
    words = tables.tokens(docs).select(F.col("token_lc").alias("word")).distinct().withColumn("prefix", F.substring(T.strip_accents(F.col("word"), keep_enye=True), 1, length)).filter(F.length("prefix") == length)
    return words.withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy(F.length("word"), "word"))).filter(F.col("rank") <= top)


def mention_signatures(mentions: DataFrame) -> DataFrame:
    """A digest of each document's active mention counts, in order of entity: it changes when, and only when, they do."""
    c = mentions.filter("is_active").groupBy("doc_id", "entity_id").agg(F.count("*").alias("n"))
    return c.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "n"))), lambda x: F.concat_ws(":", x["entity_id"].cast("string"), x["n"].cast("string"))), "|"), 256).alias("signature"), F.count("*").alias("n_entities"))


def descendants(nodes: DataFrame) -> DataFrame:
    """For each place the number of places below it, and how deep they lie."""
    return ancestors(nodes).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


def found_mentions(docs: DataFrame, least: int = 3) -> DataFrame:
    """Mentions of names in texts. Names are pairs of neighbouring capitalised words, and single ones of four letters or more, that occur `least` times in all.

    The longer name takes its words: pairs first, from left to right without overlap, then single words that no pair covers."""
    w = Window.partitionBy("doc_id").orderBy("word_idx")
    cap = lambda word: F.col(word).rlike("^[A-ZÁÉÍÓÚÑ][a-záéíóúüñ]+$")
    # each word beside the next one in the text's own row, so that only capitalised ones leave it, once
    two = docs.select("doc_id", B.words("text").alias("ws")).select("doc_id", F.posexplode_outer(F.arrays_zip("ws", F.slice("ws", F.lit(2), F.size("ws")).alias("next"))).alias("word_idx", "z"))
    t = two.filter("word_idx is not null").select("doc_id", F.col("word_idx").cast("long").alias("word_idx"), F.col("z.ws").alias("token"), F.col("z.next").alias("next")).filter(cap("token"))
    t = written(t.withColumn("next", F.when(cap("next"), F.col("next"))))
    two = t.filter("next is not null").withColumn("name", F.concat_ws(" ", "token", "next"))
    two = two.join(two.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= least), "name").select("doc_id", "word_idx", "name")
    # of pairs that begin at neighbouring words, every other one stays
    run = F.col("word_idx") - F.row_number().over(w)
    two = two.withColumn("run", run).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("word_idx"))).filter("k % 2 = 1").select("doc_id", "word_idx", "name")
    covered = two.select("doc_id", F.explode(F.array(F.col("word_idx"), F.col("word_idx") + 1)).alias("word_idx"))
    one = t.filter(F.length("token") >= 4).select("doc_id", "word_idx", F.col("token").alias("name"))
    one = one.join(one.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("name"), "name").join(covered, ["doc_id", "word_idx"], "left_anti")
    return two.unionByName(one.select("doc_id", "word_idx", "name"))


def word_difficulty(docs: DataFrame) -> DataFrame:
    """For readers' ages: the share of words of at most two syllables and of four or more, and distinct words over all. Syllables are counted once for each distinct word of a text."""
    w = tables.tokens(docs).groupBy("doc_id", F.col("token_lc").alias("word")).agg(F.count("*").alias("n")).withColumn("syllables", T.syllables(F.col("word")))
    total = F.sum("n")
    share = lambda cond: F.round(F.sum(F.when(cond, F.col("n")).otherwise(0)) / total, 6)
    return w.groupBy("doc_id").agg(total.alias("n_words"), share(F.col("syllables") <= 2).alias("simple"), share(F.col("syllables") >= 4).alias("complex"), F.round(F.count("*") / total, 6).alias("diversity"))


def after_undo(log: DataFrame, undo: str) -> DataFrame:
    """The state of each key (user_id) of an append-only log once undone actions are left out: each undo takes back the last action still in force, as brackets close; with none in force it does nothing.

    Actions raise a height and undos lower it, never below 0: an action stands if the height never falls below its own again. Running sums and minima, no stack."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    so_far, later = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    is_undo = F.col("event_type").eqNullSafe(undo)
    rows = log.select("user_id", "event_id", "event_type", "value", "ts", is_undo.alias("is_undo")).withColumn("sum", F.sum(F.when(F.col("is_undo"), -1).otherwise(1)).over(so_far))
    height = rows.withColumn("height", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far))).withColumn("lowest", F.min("height").over(later))
    standing = height.filter("not is_undo and lowest >= height")
    return standing.groupBy("user_id").agg(F.count("*").alias("n_actions"), F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("s")).select("user_id", "n_actions", "s.event_id", "s.event_type", "s.value")


def equal_spellings(docs: DataFrame) -> DataFrame:
    """Capitalised words of a text that are one once accents and case are left out: how many forms, and the commonest one (the first in order on ties)."""
    t = tables.tokens(docs).filter(F.col("token").rlike("^[A-ZÁÉÍÓÚÑ]") & (F.length("token") >= 3)).groupBy("doc_id", T.normalize_name(F.col("token")).alias("norm"), "token").agg(F.count("*").alias("n"))
    g = t.groupBy("doc_id", "norm").agg(F.count("*").alias("forms"), F.sum("n").alias("n"), F.min_by("token", F.struct(-F.col("n"), F.col("token"))).alias("canonical"))
    return g.filter("forms > 1")


#: How a sentence takes up the one before it, by its first words in plain text, and how surely its subject goes on.
CONTINUITY = {
    "subject_pronoun": (0.8, ("el", "ella", "ellos", "ellas", "este", "esta", "aquel", "aquella")), "sequence": (0.7, ("luego", "entonces", "despues", "enseguida", "al rato", "mas tarde", "por fin")),
    "consequence": (0.6, ("por eso", "asi que", "por tanto", "de ahi que", "pues")), "contrast": (0.5, ("pero", "aunque", "en cambio", "con todo", "sin embargo", "aun asi")),
    "possessive": (0.5, ("su", "sus", "he", "she", "his", "her", "they", "il", "elle", "son", "sa", "er", "sie", "sein", "seine", "ihr"))}
_GERUND = "[a-z]{2,}(?:ando|iendo|yendo)"


def _continuity_pattern(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(w.replace(" ", " +") for w in words) + ")"


def continuity_signals(docs: DataFrame) -> DataFrame:
    """doc_id, sent_idx, kind, score of the sentences after a text's first that begin by taking up the one before: the surest kind of each."""
    low = T.plain(F.col("text"))
    starts = lambda p: F.regexp_like(low, F.lit(f"^[^a-z0-9]*{p}(?![{T.WORD_CHARS}])"))
    kinds = [(k, score, _continuity_pattern(words)) for k, (score, words) in CONTINUITY.items()] + [("gerund", 0.4, _GERUND)]
    kind = F.coalesce(*[F.when(starts(p), F.struct(F.lit(k).alias("kind"), F.lit(score).alias("score"))) for k, score, p in kinds])
    return tables.sentences(docs).filter("sent_idx > 0").select("doc_id", "sent_idx", kind.alias("k")).filter("k is not null").select("doc_id", "sent_idx", "k.kind", "k.score")


def continuity_sql(sentences: str) -> str:
    kinds = [(k, score, _continuity_pattern(words)) for k, (score, words) in CONTINUITY.items()] + [("gerund", 0.4, _GERUND)]
    case = lambda i: "CASE " + " ".join(f"WHEN regexp_matches(t, '^[^a-z0-9]*{k[2]}\\b') THEN {repr(k[i]) if i == 0 else f'CAST({k[i]} AS DOUBLE)'}" for k in kinds) + " END"
    return f"""WITH {sentences}, p AS (SELECT doc_id, sent_idx, translate(text, '{T.PLAIN_FROM}', '{T.PLAIN_TO}') AS t FROM sent WHERE sent_idx > 0), k AS (SELECT doc_id, sent_idx, {case(0)} AS kind, {case(1)} AS score FROM p)
SELECT * FROM k WHERE kind IS NOT NULL"""
