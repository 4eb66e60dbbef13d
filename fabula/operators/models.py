"""Configuration cascades, cross-book checks, scores and communities over the story model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.operators.joins import band_join, parts_for
from fabula.operators.story import alike_names
from fabula.sources.shared import written


#: Arcs of a network that one task takes.
ARCS = 1_000_000
#: Patterns that one expression may combine.
MOST_PATTERNS = 10_000


def any_of(rules: DataFrame, column: str) -> str:
    """One pattern for all of a list of rules, so that a row is matched once instead of joined with every rule; more than MOST_PATTERNS are refused."""
    patterns = [r[0] for r in rules.select(column).filter(F.col(column).isNotNull()).distinct().limit(MOST_PATTERNS + 1).collect()]
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns: a list of rules was expected, not a table")
    return "|".join(f"(?:{p})" for p in sorted(patterns)) or "(?!)"


def entity_filter(entities: DataFrame, system: DataFrame, rejected: DataFrame, overrides: DataFrame) -> DataFrame:
    """Keep or drop each entity: project override, then user rejection, then system pattern, else keep. A rule for the entity's type beats one for all types.

    rejected, overrides: (name, entity_type or null, keep); system: (pattern). The rules are joined on the name, the type decided by rank."""
    def best(rules: DataFrame, flag: str) -> DataFrame:
        j = entities.alias("e").join(rules.alias("r"), (F.col("e.name") == F.col("r.name")) & (F.col("r.entity_type").isNull() | (F.col("r.entity_type") == F.col("e.entity_type"))))
        j = j.select("e.entity_id", F.col("r.keep").alias(flag), F.row_number().over(Window.partitionBy("e.entity_id").orderBy(F.col("r.entity_type").isNull(), F.col("r.keep"))).alias("rank"))
        return j.filter("rank = 1").drop("rank")

    hit = entities.filter(F.col("name").rlike(any_of(system, "pattern"))).select("entity_id", F.lit(True).alias("hit"))
    out = entities.join(best(overrides, "o"), "entity_id", "left").join(best(rejected, "u"), "entity_id", "left").join(hit, "entity_id", "left")
    by = F.when(F.col("o").isNotNull(), "override").when(F.col("u").isNotNull(), "user").when(F.col("hit").isNotNull(), "system").otherwise("default")
    return out.select("entity_id", F.coalesce("o", "u", ~F.col("hit"), F.lit(True)).alias("keep"), by.alias("decided_by"))


def resolved_config(rows: DataFrame) -> DataFrame:
    """Settings (scope, path, value, level) by the highest level of each path; where the value comes from is kept."""
    return rows.groupBy("scope", "path").agg(F.max_by(F.struct("value", "level"), F.struct("level", "value")).alias("v")).select("scope", "path", "v.value", "v.level")


def link_suggestions(entities: DataFrame, linked: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Entities of one type in different books (book, entity_id, name, entity_type) with equal names or trigram Jaccard of the threshold, links that exist left out.

    A name that a book has several times counts once, for its first entity: names are compared, n_a and n_b say how many entities bear them."""
    c = entities.groupBy("book", "entity_type", T.normalize_name(F.col("name")).alias("norm")).agg(F.min("entity_id").alias("id"), F.count("*").alias("n"))
    side = lambda s: c.select(F.col("entity_type").alias("type"), "norm", F.col("book").alias(f"book_{s}"), F.col("id").alias(s), F.col("n").alias(f"n_{s}"))
    names = c.groupBy("entity_type", "norm").agg(F.min("id").alias("row_id"))
    near = alike_names(names.select("row_id", F.col("entity_type").alias("block"), "norm"), threshold)
    name = lambda s: names.select(F.col("row_id").alias(s), F.col("norm").alias(f"norm_{s}"), F.col("entity_type").alias("type"))
    both = near.join(name("a"), "a").join(name("b").drop("type"), "b").select("type", "norm_a", "norm_b", "similarity")
    both = both.unionByName(both.select("type", F.col("norm_b").alias("norm_a"), F.col("norm_a").alias("norm_b"), "similarity"))
    both = both.unionByName(names.select(F.col("entity_type").alias("type"), F.col("norm").alias("norm_a"), F.col("norm").alias("norm_b"), F.lit(1.0).alias("similarity")))
    pairs = both.join(side("a").withColumnRenamed("norm", "norm_a"), ["type", "norm_a"]).join(side("b").withColumnRenamed("norm", "norm_b"), ["type", "norm_b"]).filter("book_a < book_b")
    return pairs.select("a", "b", F.col("similarity").alias("score"), "n_a", "n_b").join(linked, ["a", "b"], "left_anti")


def attribute_conflicts(values: DataFrame) -> DataFrame:
    """(entity, key, book, value, confidence): keys whose value sets differ between two books, with each side's most confident value."""
    v = values.withColumn("value", F.lower(F.trim("value")))
    g = v.groupBy("entity", "key", "book").agg(F.array_sort(F.collect_set("value")).alias("values"), F.max_by("value", F.struct("confidence", "value")).alias("best"))
    a, b = g.withColumnsRenamed({"book": "book_a", "values": "va", "best": "best_a"}), g.withColumnsRenamed({"book": "book_b", "values": "vb", "best": "best_b"})
    return a.join(b, ["entity", "key"]).filter("book_a < book_b and va <> vb").select("entity", "key", "book_a", "book_b", "best_a", "best_b")


def lost_without_having(events: DataFrame) -> DataFrame:
    """(entity, book, item, kind): items acquired and not lost in book 0, lost in book 1 and not acquired again there: two anti-joins."""
    pick = lambda book, kind: events.filter((F.col("book") == book) & (F.col("kind") == kind)).select("entity", "item").distinct()
    kept = pick(0, "acquire").join(pick(0, "lose"), ["entity", "item"], "left_anti")
    return kept.join(pick(1, "lose"), ["entity", "item"]).join(pick(1, "acquire"), ["entity", "item"], "left_anti")


def emotional_inconsistencies(declared: DataFrame, spoken: DataFrame, width: int = 500) -> DataFrame:
    """Declared against spoken tone of a character within 500 characters of the same chapter, of opposite sign."""
    a = declared.select("doc_id", "chapter", "entity_id", F.col("row_id").alias("a"), F.col("at"), F.col("tone").alias("said"))
    b = spoken.select("doc_id", "chapter", "entity_id", F.col("row_id").alias("b"), F.col("at").alias("other"), F.col("tone").alias("shown"))
    return band_join(a, b, ["doc_id", "chapter", "entity_id"], "at", "other", width, F.col("said") * F.col("shown") < 0).select("doc_id", "chapter", "entity_id", "a", "b")


def antecedent_candidates(mentions: DataFrame, sentences: int = 3) -> DataFrame:
    """For each mention the earlier ones of other entities at most `sentences` before it: count, and the nearest."""
    m = mentions.select("doc_id", "chapter", "entity_id", F.floor(F.col("start_char") / 100).alias("s"), "start_char")
    a = m.select("doc_id", "chapter", F.col("entity_id").alias("a"), F.col("s").alias("sa"), F.col("start_char").alias("at"))
    b = m.select("doc_id", "chapter", F.col("entity_id").alias("b"), F.col("s").alias("sb"), F.col("start_char").alias("other"))
    pairs = band_join(a, b, ["doc_id", "chapter"], "sa", "sb", sentences, (F.col("other") < F.col("at")) & (F.col("a") != F.col("b")))
    return pairs.groupBy("doc_id", "chapter", "a", "at").agg(F.count("*").alias("n"), F.max_by("b", F.struct("other", "b")).alias("nearest"))


def archetypes(scores: DataFrame) -> DataFrame:
    """(entity_id, archetype, score): the best is 100, the first two of each entity stay."""
    w = Window.partitionBy("entity_id")
    s = scores.withColumn("scaled", F.round(F.col("score") * 100 / F.max("score").over(w), 4)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "archetype")))
    return s.filter("rank <= 2").select("entity_id", "archetype", "scaled", "rank")


def percentile_ranks(values: DataFrame) -> DataFrame:
    """10 + 80 * the place between least and largest of the group, clamped to 0..100; half-even rounding."""
    w = Window.partitionBy("grp")
    low, high = F.min("value").over(w), F.max("value").over(w)
    return values.select("grp", "id", F.when(high == low, 50.0).otherwise(F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 10 + 80 * (F.col("value") - low) / (high - low))), 3)).alias("rank"))


def chi_squared(counts: DataFrame) -> DataFrame:
    """(id, a, b, c, d): the 2 x 2 statistic with Yates' correction, and whether it passes 3.841."""
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    gap = F.greatest(F.lit(0.0), F.abs(F.col("a") * F.col("d") - F.col("b") * F.col("c")) - n / 2)
    below = (F.col("a") + F.col("b")).cast("double") * (F.col("c") + F.col("d")) * (F.col("a") + F.col("c")) * (F.col("b") + F.col("d"))
    x = F.when(below == 0, 0.0).otherwise(n * gap * gap / below)
    return counts.select("id", F.round(x, 4).alias("chi2"), (x > 3.841).alias("significant"))


def importance(mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Roles of entities: mentions, chapters and partners, each over the largest, weighted .5, .2 and .3; cut at .7, .45, .2."""
    m = mentions.groupBy("entity_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id", "chapter").alias("c"))
    p = pairs.select(F.col("a").alias("entity_id"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("entity_id"), F.col("a").alias("o"))).groupBy("entity_id").agg(F.countDistinct("o").alias("p"))
    j = m.join(p, "entity_id", "left").fillna(0, ["p"])
    top = F.broadcast(j.agg(F.max("n").alias("mn"), F.max("c").alias("mc"), F.greatest(F.max("p"), F.lit(1)).alias("mp")))  # one row
    score = 0.5 * F.col("n") / F.col("mn") + 0.2 * F.col("c") / F.col("mc") + 0.3 * F.col("p") / F.col("mp")
    role = F.when(score >= 0.7, "protagonist").when(score >= 0.45, "main").when(score >= 0.2, "secondary").otherwise("minor")
    return j.join(top, F.lit(True)).select("entity_id", F.round(score, 6).alias("score"), role.alias("role"))


def communities(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Label propagation for a fixed number of rounds: each node takes the label with the most weight among its neighbours, the least label on ties.

    Weights are summed per (node, label) by a partial aggregate; a hub costs one row for each label around it. In the first round every label is a neighbour itself, so nothing is joined or summed.
    Arcs are dealt into parts of about ARCS rows, so that what a task holds doesn't grow with the network."""
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")) if not rounds else None
    one = written(edges.groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    arcs = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    parts = parts_for(arcs, ARCS)
    for _ in range(rounds):
        if labels is None:
            around = arcs.select(F.col("a").alias("node"), F.col("b").alias("label"), "weight")
        else:
            around = arcs.repartition(parts, "b").join(labels.repartition(parts, "node"), F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label", "weight")
        # both aggregates stay in the part of a node
        w = around.repartition(parts, "node").groupBy("node", "label").agg(F.sum("weight").alias("w"))
        labels = written(w.groupBy("node").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label")))
    return labels
