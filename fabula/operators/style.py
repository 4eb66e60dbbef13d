"""Style operators over texts: repetition, readability, stickiness, fillers, point of view, pacing, typography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import lexicons as L
from fabula.functions import text as T
from fabula.operators.joins import by_merge
from fabula.sources import tables
from fabula.sources.shared import written


def lexical_repetition(docs: DataFrame, stop_words: list[str] = L.STOP_WORDS, max_distance: int = 50) -> DataFrame:
    """Words of three letters or more that come back within max_distance words, speech left out."""
    toks = tables.tokens(docs.withColumn("text", T.without_dialogue(F.col("text"))))
    toks = toks.filter((F.length("token_lc") >= 3) & ~F.col("token_lc").isin(stop_words))
    gap = F.col("word_idx") - F.lag("word_idx").over(Window.partitionBy("doc_id", "token_lc").orderBy("word_idx"))
    found = toks.withColumn("gap", gap).groupBy("doc_id", F.col("token_lc").alias("word")).agg(
        F.count("*").alias("n"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.avg("gap").alias("avg_gap"))
    severity = F.when(F.col("min_gap") < 10, "high").when(F.col("min_gap") < 30, "medium").otherwise("low")
    return found.filter(F.col("min_gap") <= max_distance).withColumn("severity", severity).withColumn("confidence", F.when(F.col("min_gap") < 20, 0.9).otherwise(0.7))


def repeated_sentence_starts(docs: DataFrame) -> DataFrame:
    """Neighbouring sentences that begin with the same two words."""
    sents = tables.sentences(docs).withColumn("ws", T.word_list(F.lower("text"))).filter(F.size("ws") >= 2)
    start = F.concat_ws(" ", F.element_at("ws", 1), F.element_at("ws", 2))
    w = Window.partitionBy("doc_id").orderBy("sent_idx")
    return sents.select("doc_id", "sent_idx", start.alias("start")).withColumn("before", F.lag("start").over(w)).filter("start = before").select("doc_id", "sent_idx", "start")


def readability(docs: DataFrame) -> DataFrame:
    """Words, sentences, syllables and the two Spanish readability scores, clamped to 0..100."""
    words = T.word_list(F.col("text"))
    base = docs.select(
        "doc_id", F.size(words).cast("long").alias("n_words"), F.greatest(F.lit(1), F.size(T.sentences(F.col("text")))).cast("long").alias("n_sentences"),
        T.text_syllables(F.col("text")).alias("n_syllables")).filter("n_words > 0")
    per_word, per_sentence = F.col("n_syllables") / F.col("n_words"), F.col("n_words") / F.col("n_sentences")
    clamp = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), c)), 6)
    return base.select(
        "doc_id", "n_words", "n_sentences", "n_syllables", clamp(206.84 - 62.3 * per_word - 1.02 * per_sentence).alias("szigriszt"),
        clamp(206.84 - 0.60 * (100 * per_word) - 1.02 * per_sentence).alias("fernandez_huerta"))


def sentence_length_buckets(docs: DataFrame) -> DataFrame:
    """Sentences of under 10, up to 20, up to 35 and more words."""
    n = F.size(T.word_list(F.col("text")))
    bucket = F.when(n < 10, "short").when(n <= 20, "medium").when(n <= 35, "long").otherwise("very_long")
    return tables.sentences(docs).groupBy("doc_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def sticky_sentences(docs: DataFrame, glue: list[str] = L.GLUE_WORDS, threshold: float = 0.40, least: int = 5) -> DataFrame:
    """Sentences of at least `least` words whose share of glue words reaches the threshold."""
    words = T.word_list(F.lower("text"))
    sents = tables.sentences(docs).withColumn("ws", words).filter(F.size("ws") >= least)
    n_glue = F.size(F.filter("ws", lambda w: w.isin(glue))).cast("long")
    return sents.select("doc_id", "sent_idx", F.size("ws").cast("long").alias("n_words"), n_glue.alias("n_glue")).filter(F.col("n_glue") >= threshold * F.col("n_words"))


def filler_words(docs: DataFrame, fillers: tuple[str, ...] = L.FILLERS) -> DataFrame:
    """Fillers by how often they occur in each 1000 words, longest first so that overlaps count once."""
    pattern = "(?<![" + T.LETTERS + "])(?:" + "|".join(sorted(fillers, key=lambda f: (-len(f), f))) + ")(?![" + T.LETTERS + "])"
    rows = docs.select("doc_id", F.size(T.word_list(F.col("text"))).cast("long").alias("n_words"), F.explode(F.regexp_extract_all(F.lower(T.empty_as(F.col("text"))), F.lit(pattern), F.lit(0))).alias("filler"))
    return rows.groupBy("doc_id", "filler", "n_words").agg(F.count("*").alias("n")).withColumn("per_1000", F.round(F.col("n") * 1000 / F.col("n_words"), 6))


def dialogue_density(docs: DataFrame) -> DataFrame:
    chars = F.length(T.empty_as(F.col("text"))).cast("long")
    return docs.select("doc_id", T.dialogue_chars(F.col("text")).alias("dialogue_chars"), chars.alias("chars")).withColumn("density", F.when(F.col("chars") == 0, 0.0).otherwise(F.col("dialogue_chars") / F.col("chars")))


def sensory_report(docs: DataFrame, senses: dict[str, tuple[str, ...]] = L.SENSES) -> DataFrame:
    """Words of each sense: a keyword and up to three letters more. Balance is 1 - cv / 2 over the senses (population)."""
    low = F.lower(T.empty_as(F.col("text")))
    each = {sense: _count_in(low, tuple(f"{k}[{T.LETTERS}]{{0,3}}" for k in keys)).alias(sense) for sense, keys in senses.items()}
    counts = docs.select("doc_id", F.regexp_count(low, F.lit(f"[{T.LETTERS}]+")).alias("n_words"), *each.values()).filter("n_words > 0")
    total = sum((F.col(s) for s in senses), F.lit(0)).cast("long")
    mean = total / len(senses)
    spread = F.sqrt(sum((F.pow(F.col(s) - mean, 2) for s in senses), F.lit(0.0)) / len(senses))
    balance = F.when(total == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - spread / mean / 2))
    return counts.select("doc_id", *senses, F.round(total * 1000 / F.col("n_words"), 6).alias("per_1000"), F.round(balance, 6).alias("balance"))


def _count_in(low: Column, lexicon: tuple[str, ...]) -> Column:
    """How many words of a text in lower case are in the lexicon: whole runs of letters, counted in one pass, without an array of all words."""
    return F.regexp_count(low, F.lit(f"(?<![{T.LETTERS}])(?:{'|'.join(lexicon)})(?![{T.LETTERS}])")).cast("long")


def point_of_view(docs: DataFrame) -> DataFrame:
    """Each narrative paragraph's dominant person, where it has two markers or more, and whether it shifts."""
    paras = tables.paragraphs(docs).filter(~F.col("text").rlike('^\\s*[—«“"-]'))
    low = F.lower("text")
    c = paras.select("doc_id", "para_idx", _count_in(low, L.FIRST_PERSON).alias("first"), _count_in(low, L.SECOND_PERSON).alias("second"), _count_in(low, L.THIRD_PERSON).alias("third"))
    top = F.greatest("first", "second", "third")
    person = F.when(F.col("first") == top, "first").when(F.col("second") == top, "second").otherwise("third")
    c = c.filter(top >= 2).withColumn("person", person)
    before = F.lag("person").over(Window.partitionBy("doc_id").orderBy("para_idx"))
    return c.withColumn("shift", F.coalesce(before != F.col("person"), F.lit(False)))


def chapter_metrics(docs: DataFrame) -> DataFrame:
    """Word, sentence, paragraph and mark counts of chapters."""
    text = F.col("text")
    return tables.chapters(docs).select(
        "doc_id", "chapter", F.size(T.word_list(text)).cast("long").alias("n_words"), F.greatest(F.lit(1), F.size(T.sentences(text))).cast("long").alias("n_sentences"),
        F.size(F.filter(F.split(text, "\n"), lambda s: F.length(F.trim(s)) > 0)).cast("long").alias("n_paragraphs"), T.dialogue_chars(text).alias("dialogue_chars"), F.length(text).cast("long").alias("chars"),
        F.regexp_count(text, F.lit("[!¡]")).cast("long").alias("exclamations"), F.regexp_count(text, F.lit("[?¿]")).cast("long").alias("questions"),
        F.size(F.filter(T.word_list(F.lower(text)), lambda w: w.rlike("(" + "|".join(L.ACTION) + ")$"))).cast("long").alias("n_action"))


def min_max(value: Column, *keys: str) -> Column:
    """A value's place between the least and the largest of its group; 0.5 if they are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, 0.5).otherwise((value - low) / (high - low))


def tension_curve(docs: DataFrame) -> DataFrame:
    """Tension of each chapter: six signals, each min-max normalised in its document, weighted."""
    m = chapter_metrics(docs).filter("n_words > 0")
    signals = {
        "action": F.col("n_action") / F.col("n_words"), "sentence": F.col("n_words") / F.col("n_sentences"), "dialogue": F.col("dialogue_chars") / F.col("chars"),
        "exclaim": F.col("exclamations") * 100 / F.col("n_words"), "ask": F.col("questions") * 100 / F.col("n_words"), "paragraph": F.col("n_words") / F.greatest(F.col("n_paragraphs"), F.lit(1))}
    for name, value in signals.items():
        m = m.withColumn(name, value)
    n = {name: min_max(F.col(name), "doc_id") for name in signals}
    tension = 0.25 * n["action"] + 0.20 * (1 - n["sentence"]) + 0.10 * n["dialogue"] + 0.15 * n["exclaim"] + 0.15 * n["ask"] + 0.15 * (1 - n["paragraph"])
    upto = Window.partitionBy("doc_id").orderBy("chapter").rowsBetween(Window.unboundedPreceding, 0)
    return m.withColumn("tension", F.round(tension, 6)).withColumn("position", F.sum("n_words").over(upto)).select("doc_id", "chapter", "n_words", "position", "tension")


def tension_arc(curve: DataFrame) -> DataFrame:
    """The shape of each document's curve: flat, wave, rising, falling, mountain or valley."""
    w = Window.partitionBy("doc_id").orderBy("chapter")
    t = F.col("tension")
    c = curve.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).withColumn("before", F.lag(t).over(w)).withColumn("after", F.lead(t).over(w))
    turn = ((t > F.col("before")) & (t > F.col("after"))) | ((t < F.col("before")) & (t < F.col("after")))
    third = F.floor(F.col("n") / 3)
    part = lambda cond: F.avg(F.when(cond, t))
    g = c.groupBy("doc_id").agg(
        F.first("n").alias("n"), (F.max(t) - F.min(t)).alias("range"), F.count_if(turn).alias("turns"), part(F.col("i") <= third).alias("a"),
        part((F.col("i") > third) & (F.col("i") <= 2 * third)).alias("b"), part(F.col("i") > 2 * third).alias("c"))
    arc = (
        F.when(F.col("n") < 3, "flat").when(F.col("range") < 0.15, "flat").when((F.col("n") >= 6) & (F.col("turns") >= F.floor(F.col("n") / 3)), "wave")
        .when((F.col("b") > F.col("a") + 0.08) & (F.col("b") > F.col("c") + 0.08), "mountain").when((F.col("b") < F.col("a") - 0.08) & (F.col("b") < F.col("c") - 0.08), "valley")
        .when(F.col("c") > F.col("a"), "rising").otherwise("falling"))
    return g.select("doc_id", F.col("n").alias("n_chapters"), F.col("turns").alias("n_turns"), arc.alias("arc"))


def chapter_balance(docs: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Chapters longer than threshold times the mean of their document, or shorter than its inverse."""
    m = chapter_metrics(docs).select("doc_id", "chapter", "n_words")
    w = Window.partitionBy("doc_id")
    m = m.withColumn("total", F.sum("n_words").over(w)).withColumn("n", F.count("*").over(w)).filter("n > 1 and total > 0")
    ratio = F.col("n_words") * F.col("n") / F.col("total")
    return m.withColumn("ratio", F.round(ratio, 6)).withColumn("issue", F.when(ratio > threshold, "too_long").when(ratio < 1 / threshold, "too_short")).filter("issue is not null").select("doc_id", "chapter", "n_words", "ratio", "issue")


def dense_blocks(docs: DataFrame, least_words: int = 150) -> DataFrame:
    """Runs of paragraphs without speech that hold more than least_words words: gaps and islands."""
    p = tables.paragraphs(docs).filter(F.length(F.trim("text")) > 0)
    w = Window.partitionBy("doc_id").orderBy("para_idx")
    p = p.withColumn("speech", F.col("text").rlike(T.DIALOGUE)).withColumn("island", F.sum(F.col("speech").cast("int")).over(w)).filter("not speech")
    g = p.groupBy("doc_id", "island").agg(F.min("para_idx").alias("first_para"), F.count("*").alias("n_paragraphs"), F.sum(F.size(T.word_list(F.col("text")))).alias("n_words"))
    return g.filter(F.col("n_words") > least_words).drop("island")


def crutch_words(docs: DataFrame, expected: float = 5.0, z: float = 2.0, least_words: int = 100, stop_words: list[str] = L.STOP_WORDS) -> DataFrame:
    """Words that a text uses more often than expected in each 10 000 words, in deviations of half the expectation."""
    toks = tables.tokens(docs)
    n = toks.groupBy("doc_id").agg(F.count("*").alias("n_words")).filter(F.col("n_words") >= least_words)
    counts = toks.filter(~F.col("token_lc").isin(stop_words)).groupBy("doc_id", F.col("token_lc").alias("word")).agg(F.count("*").alias("n")).join(n, "doc_id")
    score = (F.col("n") * 10_000 / F.col("n_words") - expected) / max(0.5 * expected, 1.0)
    return counts.filter("n >= 3").withColumn("z", F.round(score, 6)).filter(score >= z).select("doc_id", "word", "n", "z")


def typography(docs: DataFrame) -> DataFrame:
    """Counts of typographic faults of a text."""
    t = T.empty_as(F.col("text"))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    return docs.select(
        "doc_id", count(r"\.{4,}").alias("long_ellipsis"), count(r"[^.]\.\.(?:[^.]|$)").alias("short_ellipsis"), count("  +").alias("multiple_spaces"), count(r" [,.;:!?]").alias("space_before_mark"),
        count(r"[,;:][A-Za-z]").alias("no_space_after_mark"), count(r"[!?]{3,}|,,+").alias("sequences"),
        (T.occurrences(t, '"') % 2 == 1).alias("odd_quotes"), (T.occurrences(t, "(") != T.occurrences(t, ")")).alias("unclosed_brackets"))


def clarity(docs: DataFrame, max_words: int = 40) -> DataFrame:
    """Sentences longer than max_words words, with their commas and subordinating words."""
    s = tables.sentences(docs)
    ws = T.word_list(F.lower("text"))
    sub = F.size(F.filter(ws, lambda w: w.isin(["que", "porque", "cuando", "aunque", "that", "which", "dass", "wenn"]))).cast("long")
    return s.select("doc_id", "sent_idx", F.size(ws).cast("long").alias("n_words"), T.occurrences(F.col("text"), ",").alias("n_commas"), sub.alias("n_subordinate")).filter(F.col("n_words") > max_words)


def acronyms(docs: DataFrame) -> DataFrame:
    """Runs of two to six capitals with their uses, and whether some use is defined in brackets."""
    t = T.empty_as(F.col("text"))
    rows = docs.select("doc_id", t.alias("t"), F.explode(F.regexp_extract_all(t, F.lit("[A-ZÁÉÍÓÚÑÄÖÜ]{2,6}"), F.lit(0))).alias("acronym"))
    return rows.groupBy("doc_id", "acronym").agg(F.count("*").alias("n"), F.max(F.contains("t", F.concat(F.lit("("), F.col("acronym"), F.lit(")")))).alias("defined"))


def regional_terms(docs: DataFrame, lexicon: dict[str, str] = L.REGIONAL) -> DataFrame:
    """Regional words where a text mixes regions: those outside its dominant region."""
    spark = docs.sparkSession
    words = F.broadcast(spark.createDataFrame(sorted(lexicon.items()), "token_lc string, region string"))  # a fixed word list
    hits = tables.tokens(docs).join(words, "token_lc").groupBy("doc_id", "region", "token_lc").agg(F.count("*").alias("n"))
    per_region = hits.withColumn("in_region", F.sum("n").over(Window.partitionBy("doc_id", "region")))
    w = Window.partitionBy("doc_id").orderBy(F.desc("in_region"), "region")
    return per_region.withColumn("dominant", F.first("region").over(w)).filter("region <> dominant").select("doc_id", "region", F.col("token_lc").alias("word"), "n", "dominant")


def neighbour_paragraph_overlap(docs: DataFrame, threshold: float = 0.6, stop_words: list[str] = L.STOP_WORDS) -> DataFrame:
    """Neighbouring paragraphs whose word sets (three letters and more, no stop words) overlap by the threshold."""
    ws = F.array_distinct(F.filter(T.word_list(F.lower("text")), lambda w: (F.length(w) >= 3) & ~w.isin(stop_words)))
    p = tables.paragraphs(docs).filter(F.length(F.trim("text")) > 0).select("doc_id", "para_idx", ws.alias("ws"))
    p = p.withColumn("before", F.lag("ws").over(Window.partitionBy("doc_id").orderBy("para_idx"))).filter("before is not null")
    return p.withColumn("similarity", F.round(T.jaccard(F.col("ws"), F.col("before"), 0.0), 6)).filter(F.col("similarity") >= threshold).select("doc_id", "para_idx", "similarity")


def glossary_candidates(docs: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """Capitalised words inside sentences, used `least` to `most` times in a text."""
    hits = F.regexp_extract_all(T.empty_as(F.col("text")), F.lit("[a-záéíóúüñ,;] ([A-ZÁÉÍÓÚÑ][a-záéíóúüñ]{2,})"), F.lit(1))
    return docs.select("doc_id", F.explode(hits).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n")).filter(F.col("n").between(least, most))


def register_changes(docs: DataFrame) -> DataFrame:
    """Paragraphs without speech whose register (share of words of nine letters or more) differs from the one before."""
    ws = T.word_list(F.col("text"))
    p = tables.paragraphs(docs).filter(~F.col("text").rlike(T.DIALOGUE)).select("doc_id", "para_idx", F.size(ws).alias("n"), F.size(F.filter(ws, lambda w: F.length(w) >= 9)).alias("long")).filter("n >= 5")
    p = p.withColumn("register", F.when(F.col("long") * 10 >= F.col("n") * 3, "formal").when(F.col("long") * 10 >= F.col("n"), "neutral").otherwise("colloquial"))
    return p.withColumn("before", F.lag("register").over(Window.partitionBy("doc_id").orderBy("para_idx"))).filter("before <> register").select("doc_id", "para_idx", "before", "register")


def confused_words(docs: DataFrame, pairs: tuple[tuple[str, str], ...] = L.CONFUSED, span: int = 15) -> DataFrame:
    """Words of confusion pairs with the other one within `span` words: an equi-join on document, pair and blocks of positions.

    Texts are read once, whatever the number of pairs; only words of pairs leave them."""
    block = F.floor(F.col("word_idx") / (span + 1))
    mine = lambda side: F.array_compact(F.array(*[F.when(F.col("token_lc") == p[side], F.struct(F.lit(p[0]).alias("word"), F.lit(p[1]).alias("other"))) for p in pairs]))
    toks = written(tables.tokens(docs).filter(F.col("token_lc").isin(sorted({w for p in pairs for w in p}))).select("doc_id", "word_idx", "token_lc"))
    left = toks.select("doc_id", "word_idx", F.explode(mine(0)).alias("p")).select("doc_id", "word_idx", "p.*", F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    right = toks.select("doc_id", "word_idx", F.explode(mine(1)).alias("p")).select("doc_id", F.col("word_idx").alias("o_idx"), "p.*", block.alias("block"))
    near = by_merge(left).join(right, ["doc_id", "word", "other", "block"]).filter(F.abs(F.col("word_idx") - F.col("o_idx")) <= span)
    return near.groupBy("doc_id", "word_idx", "word", "other").agg(F.count("*").alias("n_near")).select("doc_id", "word_idx", "n_near", "word", "other")


def classify_documents(docs: DataFrame, lexicons: dict[str, tuple[str, ...]]) -> DataFrame:
    """The type whose lexicon a text hits most; unknown if its share is under .25 or it has under 3 hits."""
    low = F.lower(T.empty_as(F.col("text")))
    rows = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("type"), _count_in(low, v).alias("score")) for k, v in lexicons.items()])).alias("s")).select("doc_id", "s.type", "s.score")
    g = rows.groupBy("doc_id").agg(F.sum("score").alias("total"), F.max(F.struct("score", F.col("type"))).alias("best"))
    share = F.when(F.col("total") > 0, F.col("best.score") / F.col("total")).otherwise(0.0)
    known = (share >= 0.25) & (F.col("best.score") >= 3)
    return g.select("doc_id", F.when(known, F.col("best.type")).otherwise("unknown").alias("type"), F.round(share, 6).alias("confidence"))


def quote_style(docs: DataFrame) -> DataFrame:
    """Each text's dominant quotation mark; ties go to the first in order of name."""
    t = T.empty_as(F.col("text"))
    marks = {"angular": "«", "curly": "“", "dash": "—", "straight": '"'}
    rows = docs.select("doc_id", F.explode(F.array(*[F.struct(T.occurrences(t, m).alias("n"), F.lit(k).alias("mark")) for k, m in marks.items()])).alias("m")).select("doc_id", "m.n", "m.mark").filter("n > 0")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "mark"))).filter("rank = 1").select("doc_id", "mark", "n")
