"""Text identity and structure: duplicates, fingerprints, coordinates, structure, temporal markers, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import batches as B
from fabula.functions import lexicons as L
from fabula.functions import text as T
from fabula.operators.joins import broadcast_if_small
from fabula.sources import tables
from fabula.sources.shared import written

MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


def sentence_duplicates(docs: DataFrame, least_chars: int = 30) -> DataFrame:
    """Sentences of at least least_chars that occur in several places: one row per text with its places counted.

    Groups are aggregated, never expanded to pairs, so a sentence in a third of all documents costs one row."""
    s = tables.sentences(docs).withColumn("norm", F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))).filter(F.length("norm") >= least_chars)
    g = s.groupBy("norm").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.min(F.struct("doc_id", "sent_idx")).alias("first"))
    return g.filter("n > 1").select(F.md5("norm").alias("sentence"), "n", "n_docs", F.col("first.doc_id").alias("first_doc"), F.col("first.sent_idx").alias("first_sentence"))


def near_sentences(docs: DataFrame, threshold: float = 0.9, least_chars: int = 30) -> DataFrame:
    """Different sentences of one document with word-set Jaccard of the threshold or more.

    Blocked by prefix filtering: sets that reach the threshold share one of their first |s| - ceil(t |s|) + 1 words in the order of
    (rarity, hash), so only sentences with a common rare word meet. A text's words travel once, as hashes; words themselves are read again for the sentences that met."""
    s = tables.sentences(docs).filter(F.length("text") >= least_chars).select("doc_id", "sent_idx", B.words(F.lower("text")).alias("ws"))
    s = s.select("doc_id", "sent_idx", F.array_distinct("ws").alias("ws"))
    w = s.select("doc_id", "sent_idx", F.size("ws").alias("size"), F.explode_outer("ws").alias("word")).filter("word is not null").select("doc_id", "sent_idx", "size", F.xxhash64("word").alias("word"))
    w = w.repartition("doc_id").withColumn("df", F.count("*").over(Window.partitionBy("doc_id", "word")))  # both windows stay where a text's words are
    rank = F.row_number().over(Window.partitionBy("doc_id", "sent_idx").orderBy("df", "word"))
    prefix = written(w.withColumn("rank", rank).filter(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).select("doc_id", "sent_idx", "size", "word"))
    a, b = prefix.select("doc_id", F.col("sent_idx").alias("a"), F.col("size").alias("na"), "word"), prefix.select("doc_id", F.col("sent_idx").alias("b"), F.col("size").alias("nb"), "word")
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    pairs = written(a.hint("merge").join(b, ["doc_id", "word"]).filter(fits).select("doc_id", "a", "b").distinct())
    ends = pairs.select("doc_id", F.explode(F.array("a", "b")).alias("sent_idx")).distinct()
    met = written(s.join(broadcast_if_small(written(ends)), ["doc_id", "sent_idx"], "left_semi"))
    left, right = met.select("doc_id", F.col("sent_idx").alias("a"), F.col("ws").alias("wa")), met.select("doc_id", F.col("sent_idx").alias("b"), F.col("ws").alias("wb"))
    return pairs.join(left, ["doc_id", "a"]).join(right, ["doc_id", "b"]).select("doc_id", "a", "b", F.round(T.jaccard(F.col("wa"), F.col("wb")), 6).alias("similarity")).filter(F.col("similarity") >= threshold)


def fingerprints(docs: DataFrame) -> DataFrame:
    """SHA-256 of the text and of its first 1000 characters, word and character counts."""
    t = T.empty_as(F.col("text"))
    return docs.select("doc_id", F.sha2(t, 256).alias("full_hash"), F.sha2(F.substring(t, 1, 1000), 256).alias("start_hash"), F.size(T.word_list(t)).cast("long").alias("n_words"), F.length(t).cast("long").alias("n_chars"))


def fingerprint_matches(docs: DataFrame) -> DataFrame:
    """Documents with the same text as an earlier one, or else the same start: each with the first such document."""
    f = fingerprints(docs)
    for key, name in (("full_hash", "same"), ("start_hash", "like")):  # a minimum and a join: a text that a third of all rows share is no one task's
        f = f.join(f.groupBy(key).agg(F.min("doc_id").alias(name)), key)
    how = F.when(F.col("same") < F.col("doc_id"), "exact").when(F.col("like") < F.col("doc_id"), "start")
    return f.withColumn("how", how).filter("how is not null").select("doc_id", F.when(F.col("how") == "exact", F.col("same")).otherwise(F.col("like")).alias("match_id"), "how")


def identity(docs: DataFrame) -> DataFrame:
    """Neighbouring versions (ids 2k and 2k + 1) compared: .3 word Jaccard + .5 trigram Jaccard + .2 length ratio. The texts travel, and their words and trigrams are formed where two meet."""
    d = docs.select(F.floor(F.col("doc_id") / 2).alias("pair"), (F.col("doc_id") % 2).alias("side"), F.lower(T.empty_as(F.col("text"))).alias("t"))
    j = d.filter("side = 0").join(d.filter("side = 1").select("pair", F.col("t").alias("t1")), "pair")
    j = j.select("pair", F.length("t").alias("n"), F.length("t1").alias("n1"), B.words("t").alias("ws"), B.words("t1").alias("ws1"), B.shared_trigrams(F.col("t"), F.col("t1")).alias("grams"))
    grams = F.when(F.col("grams.either") == 0, 0.0).otherwise(F.col("grams.shared") / F.col("grams.either"))
    score = 0.3 * T.jaccard(F.col("ws"), F.col("ws1"), 0.0) + 0.5 * grams + 0.2 * (F.least("n", "n1") / F.greatest("n", "n1", F.lit(1)))
    j = j.select("pair", score.alias("score"))
    score = F.col("score")
    kind = F.when(score >= 0.78, "same").when(score <= 0.40, "different").otherwise("uncertain")
    return j.select("pair", F.round(score, 6).alias("score"), kind.alias("kind"))


def page_and_line(docs: DataFrame, offset: int = 1000, words_per_page: int = 300) -> DataFrame:
    """Line and page of an offset: line ends before it plus 1, words before it over 300 plus 1; (1, 1) beyond the text."""
    before = F.substring("text", 1, offset)
    inside = F.length(T.empty_as(F.col("text"))) > offset
    line = F.when(inside, T.occurrences(before, "\n") + 1).otherwise(1).cast("long")
    n = F.size(F.filter(F.split(before, r"[ \n\t\r]+"), lambda w: w != ""))
    return docs.select("doc_id", line.alias("line"), F.when(inside, F.floor(n / words_per_page) + 1).otherwise(1).cast("long").alias("page"))


def offsets_to_paragraphs(docs: DataFrame, every: int = 700) -> DataFrame:
    """Offsets on a text's axis located in its paragraphs: a range join by blocks, separators belong to the paragraph before."""
    p = tables.paragraphs(docs).withColumn("next", F.col("end_char") + 1)
    size = 2048
    blocks = F.sequence(F.floor(F.col("start_char") / size), F.floor((F.col("next") - 1) / size))
    p = p.withColumn("block", F.explode(blocks))
    n = F.length(T.empty_as(F.col("text")))
    o = docs.filter(n > 0).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1, F.lit(every).cast("long"))).alias("offset")).withColumn("block", F.floor(F.col("offset") / size))
    inside = (F.col("offset") >= F.col("start_char")) & (F.col("offset") < F.col("next"))
    return o.join(p, ["doc_id", "block"]).filter(inside).select("doc_id", "offset", "para_idx", (F.col("offset") - F.col("start_char")).alias("local"))


def headings(docs: DataFrame) -> DataFrame:
    """Short lines without a final mark that begin with a capital, each with the end of its section: the next heading."""
    p = tables.paragraphs(docs)
    h = p.filter((F.length(F.trim("text")).between(1, 60)) & F.col("text").rlike("^[A-ZÁÉÍÓÚÑÄÖÜ]") & ~F.col("text").rlike("[.!?;:,]$"))
    following = F.lead("start_char").over(Window.partitionBy("doc_id").orderBy("para_idx"))
    return h.select("doc_id", "para_idx", "start_char", F.coalesce(following, F.lit(-1)).alias("section_end"))


def years(docs: DataFrame, low: int = 1000, high: int = 2029) -> DataFrame:
    """Numbers of four digits that can be years, counted in each text, with the narrowest epoch they all fit in."""
    found = F.regexp_extract_all(T.empty_as(F.col("text")), F.lit(T.whole_words(r"\d{4}")), F.lit(0))
    y = docs.select("doc_id", F.explode(found).alias("y")).select("doc_id", F.col("y").cast("long").alias("y")).filter(F.col("y").between(low, high))
    g = y.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("y").alias("first_year"), F.max("y").alias("last_year"))
    epoch = F.lit("unknown")
    for name, start, end in sorted(L.PERIODS, key=lambda p: p[1] - p[2]):  # widest first, so that the narrowest comes last
        epoch = F.when((F.col("first_year") >= start) & (F.col("last_year") <= end), name).otherwise(epoch)
    return g.withColumn("epoch", epoch)


def absolute_dates(text_rows: DataFrame) -> DataFrame:
    """Day-month-year dates written in Spanish (row_id, text) as dates; impossible ones are left out."""
    p = r"(\d{1,2}) de (" + "|".join(MONTHS) + r") de (\d{4})"
    rows = text_rows.select("row_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0))).alias("d"))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract("d", p, 2)).cast("int")
    made = F.try_make_timestamp(F.regexp_extract("d", p, 3).cast("int"), month, F.regexp_extract("d", p, 1).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    return rows.select("row_id", F.to_date(made).alias("date")).filter("date is not null")


def html_paragraphs(pages: DataFrame) -> DataFrame:
    """Paragraph texts of pages in order, tags taken out; scripts and styles are skipped."""
    body = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<(script|style)[^>]*>.*?</\1>", "")
    paras = F.filter(F.transform(F.slice(F.split(body, r"<p[ >]"), F.lit(2), F.lit(100_000)), lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(p, r"(?s)^(.*?)(?:</p>|$)", 1), "<[^>]*>", " "), r"\s+", " "))), lambda p: p != "")
    return pages.select("page_id", F.posexplode(paras).alias("i", "text")).select("page_id", F.col("i").cast("long").alias("para_idx"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def neighbour_coherence(vectors: DataFrame, size: int = 50) -> DataFrame:
    """Cosines of neighbouring vectors within runs of `size`; breaks below .3, below .15 high, below .21 medium."""
    v = vectors.withColumn("run", F.floor(F.col("vec_id") / size))
    v = v.withColumn("before", F.lag("embedding").over(Window.partitionBy("run").orderBy("vec_id"))).filter("before is not null")
    v = v.select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("before")), 6).alias("similarity")).filter("similarity < 0.3")
    return v.withColumn("severity", F.when(F.col("similarity") < 0.15, "high").when(F.col("similarity") < 0.21, "medium").otherwise("low"))


def semantic_redundancy(vectors: DataFrame, width: int = 100, threshold: float = 0.4) -> DataFrame:
    """Vectors within `width` places of each other with a cosine of the threshold: a band join, as far pairs don't count."""
    from fabula.operators.joins import band_join

    a = vectors.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea"), F.lit(0).alias("k"))
    b = vectors.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"), F.lit(0).alias("k"))
    pairs = band_join(a, b, ["k"], "a", "b", width, F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(T.cosine(F.col("ea"), F.col("eb")), 6).alias("similarity")).filter(F.col("similarity") >= threshold)


def label_centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector of each label, one row for each component."""
    return vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.count("*").alias("n"))


def token_statistics(docs: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent words of each language, with the number of documents that hold them."""
    t = tables.tokens(docs.select("doc_id", "lang", "text").withColumn("doc_id", F.struct("doc_id", "lang")))
    g = t.groupBy(F.col("doc_id.lang").alias("lang"), F.col("token_lc").alias("word")).agg(F.count("*").alias("n"), F.countDistinct("doc_id.doc_id").alias("n_docs"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= top)


def label_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Precision and recall of a simple length rule against reviewed labels: the evaluation operator's shape."""
    j = docs.select("doc_id", (F.col("n_chars") < 500).alias("flag")).join(labels, "doc_id").select("flag", (F.col("quality") == 0).alias("truth"))
    g = j.agg(F.count_if(F.col("flag") & F.col("truth")).alias("tp"), F.count_if(F.col("flag") & ~F.col("truth")).alias("fp"), F.count_if(~F.col("flag") & F.col("truth")).alias("fn"))
    share = lambda a, b: F.when(a + b == 0, 0.0).otherwise(F.round(a / (a + b), 6))
    return g.select("tp", "fp", "fn", share(F.col("tp"), F.col("fp")).alias("precision"), share(F.col("tp"), F.col("fn")).alias("recall"))
