"""Correction detectors that are tables of patterns, and lexicon detectors over tokens. All return one row per finding or count."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.sources import tables

_B, _E = "(?:^|[^a-záéíóúüñ])", "(?:[^a-záéíóúüñ]|$)"  # word borders written out, as engines differ on letters with accents
# Rules of Spanish usage as patterns without look-around, so that any engine can check them.
RULES = {
    "dequeismo": _B + "(?:creo|pienso|opino|dijo|dice|afirma) de que" + _E,
    "queismo": _B + "(?:me acuerdo|estoy segur[oa]|a pesar|darse cuenta) que" + _E,
    "laismo": _B + "la (?:dije|di|dio|pegó|regaló)" + _E,
    "loismo": _B + "lo (?:dije|di|dio|pegó|regaló) (?:un|una|el|la)" + _E,
    "habemos": _B + "habemos" + _E,
    "redundancy": _B + "(?:subir arriba|bajar abajo|entrar adentro|salir afuera|volver a repetir)" + _E,
    "gerund_of_sequence": "[a-zñ](?:ó|aron|ieron), [a-zñ]+(?:ando|iendo)" + _E,
    "feminine_stressed_a": _B + "la (?:agua|alma|arma|hacha|águila)" + _E,
    "number_agreement": _B + "(?:los|las|unos|unas) [a-zñ]{2,}[aeo]" + _E,
    "anglicism": _B + "(?:feedback|marketing|online|email|link|software)" + _E,
    "double_mark": "[,;:] ?[,;:]",
    "quote_after_stop": "[.]\"",
}
VARIANTS = {"setiembre": "septiembre", "obscuro": "oscuro", "substancia": "sustancia", "sicología": "psicología", "harmonía": "armonía", "trasparente": "transparente"}


def rule_counts(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Findings of each rule in each text: all rules in one pass over the text."""
    low = F.lower(T.empty_as(F.col("text")))
    hits = F.array(*[F.struct(F.lit(k).alias("rule"), F.regexp_count(low, F.lit(p)).cast("long").alias("n")) for k, p in rules.items()])
    return docs.select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.rule", "h.n").filter("n > 0")


def orthographic_variants(docs: DataFrame, variants: dict[str, str] = VARIANTS) -> DataFrame:
    """Variant words with the preferred form; a capital is kept."""
    words = F.broadcast(docs.sparkSession.createDataFrame(sorted(variants.items()), "token_lc string, preferred string"))  # a fixed list
    hits = tables.tokens(docs).join(words, "token_lc")
    suggestion = F.when(F.col("token").rlike("^[A-Z]"), F.initcap("preferred")).otherwise(F.col("preferred"))
    return hits.groupBy("doc_id", "token", suggestion.alias("suggestion")).agg(F.count("*").alias("n"), F.min("word_idx").alias("first_idx"))


def scene_breaks(docs: DataFrame) -> DataFrame:
    """Scenes of a text: runs of lines between separators (***, ---, #, or a blank line)."""
    p = tables.paragraphs(docs).withColumn("sep", F.col("text").rlike(r"^\s*(?:\*{3,}|-{3,}|#|)\s*$"))
    island = F.sum(F.col("sep").cast("int")).over(Window.partitionBy("doc_id").orderBy("para_idx"))
    g = p.withColumn("island", island).filter("not sep").groupBy("doc_id", "island").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.count("*").alias("n_lines"))
    return g.drop("island")


def non_narrative_lines(docs: DataFrame) -> DataFrame:
    """Lines that are empty, short and in capitals, or look like headings or metadata."""
    t = F.trim("text")
    kind = F.when(t == "", "empty").when((F.length(t) < 40) & (t == F.upper(t)) & (t != F.lower(t)), "capitals").when(t.rlike(r"^(?i:cap[ií]tulo|chapter|copyright|isbn|licensed)\b"), "metadata")
    return tables.paragraphs(docs).withColumn("kind", kind).filter("kind is not null").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def titles(docs: DataFrame) -> DataFrame:
    """Lines scored as titles: short, a capital first, no final stop, a colon or dash; above .5 they are."""
    t = F.trim("text")
    s = F.when(F.length(t) <= 60, 0.3).otherwise(0.0) + F.when(t.rlike("^[A-ZÁÉÍÓÚÑ]"), 0.2).otherwise(0.0) + F.when(~t.rlike("[.!?]$"), 0.2).otherwise(0.0) + F.when(t.rlike("[:—-]"), 0.1).otherwise(0.0)
    return tables.paragraphs(docs).filter(F.length(t) > 0).select("doc_id", "para_idx", F.round(s, 2).alias("score")).filter("score > 0.5")


def references(docs: DataFrame) -> DataFrame:
    """Numbered citations [n] against the highest entry "n." that starts a line: cited without an entry, or the reverse."""
    t = T.empty_as(F.col("text"))
    cited = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\[(\d{1,3})\]"), F.lit(1)))).alias("n")).withColumn("cited", F.lit(True))
    listed = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?m)^(\d{1,3})\. "), F.lit(1)))).alias("n")).withColumn("listed", F.lit(True))
    both = cited.join(listed, ["doc_id", "n"], "full_outer")
    return both.select("doc_id", F.col("n").cast("long").alias("n"), F.when(F.col("listed").isNull(), "orphan").when(F.col("cited").isNull(), "unused").otherwise("ok").alias("kind"))


def without_overlaps(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, start, stop) from left to right: of two that overlap, the longer one stays and takes the last one's place.

    An ordered fold, as chains of overlaps can't be decided pair by pair. A document is cut where a span starts at or after all earlier
    stops, as the fold starts anew there; a task holds an island, or short ones together."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, int]] = []
        for start, stop in sorted(zip(pdf["start"].tolist(), pdf["stop"].tolist(), strict=True)):
            if not kept or start >= kept[-1][1]:
                kept.append((start, stop))
            elif stop - start > kept[-1][1] - kept[-1][0]:
                kept[-1] = (start, stop)
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]] * len(kept), "start": [s for s, _ in kept], "stop": [e for _, e in kept]})

    rows = spans.select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).filter("start is not null and stop is not null")
    w = Window.partitionBy("doc_id").orderBy("start", "stop")
    first = F.coalesce(F.col("start") >= F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    # islands by the number of their first span, some 10 000 spans of short ones together
    begun = rows.withColumn("begin", F.when(first, F.row_number().over(w)))
    islands = begun.withColumn("island", F.floor(F.max("begin").over(w.rowsBetween(Window.unboundedPreceding, 0)) / 10_000))
    return islands.groupBy("doc_id", "island").applyInPandas(fold, "doc_id long, start long, stop long")
