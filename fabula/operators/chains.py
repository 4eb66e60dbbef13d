"""Coreference chains and aliases: links between mentions become chains with an elected root, and aliases are resolved by rules in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.operators.graphs import components
from fabula.operators.joins import as_of, nearest
from fabula.operators.temporal import located

#: Pronouns by language, in plain text: what links back to a name.
PRONOUNS = {"pronoun": "el|ella|ellos|ellas|le|les|he|she|him|her|they|them|il|elle|lui|ils|elles|er|sie|ihm|ihr|ihn"}
#: Words that make the capitalised word behind them a description of somebody named elsewhere.
TITLES = "(?:don|doña|señor|señora|doctor|doctora|the|el|la|le|les|der|die|das|of)"
REACH = 300


def _node(place: Column) -> Column:
    """The name of a place of a text among the nodes of all texts."""
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.lpad(place.cast("string"), 12, "0"))


def _by_pronoun(docs: DataFrame, mentions: DataFrame, reach: int) -> DataFrame:
    """doc_id, anaphor, name (start, entity_id), score of the pronouns that link back to a name."""
    pronouns = located(docs, PRONOUNS).select("doc_id", F.col("start").alias("at"))
    names = mentions.select("doc_id", F.col("start").alias("at"), F.struct("start", "entity_id").alias("name"))
    back = as_of(pronouns.withColumn("anaphor", F.col("at")), names, ["doc_id"], ["at"], "name")
    distance = F.col("anaphor") - F.col("name.start")
    return back.filter(distance.between(1, reach)).select("doc_id", "anaphor", "name", (1 - distance / (2 * reach)).alias("score"))


def links(docs: DataFrame, mentions: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, anaphor, antecedent (places of mentions), score: a pronoun links to the last name at most `reach` characters before it, the surer the nearer; a name to the last mention of its entity in the text."""
    by_pronoun = _by_pronoun(docs, mentions, reach).select("doc_id", "anaphor", F.col("name.start").alias("antecedent"), "score")
    w = Window.partitionBy("doc_id", "entity_id").orderBy("start")
    by_name = mentions.select("doc_id", F.col("start").alias("anaphor"), F.lag("start").over(w).alias("antecedent"), F.lit(1.0).alias("score")).filter("antecedent is not null")
    return by_pronoun.unionByName(by_name)


def build_chains(pairs: DataFrame, proper: DataFrame) -> DataFrame:
    """Chains of pairs (doc_id, anaphor, antecedent, score): doc_id, place, chain, root, confidence for each mention. proper: doc_id, place of proper nouns.

    A chain is a component; its root is its first proper noun, or where it has none its first mention; confidence is the mean score of its pairs."""
    p = pairs.filter("anaphor is not null and antecedent is not null").select("doc_id", "anaphor", "antecedent", "score", _node(F.col("anaphor")).alias("a"), _node(F.col("antecedent")).alias("b"))
    found = components(p.select("a", "b"))
    place = F.substring_index("node", ":", -1).cast("long")
    members = found.select(F.substring_index("node", ":", 1).cast("long").alias("doc_id"), place.alias("place"), F.col("component").alias("chain"))
    known = proper.select("doc_id", F.col("place").cast("long").alias("place")).distinct().withColumn("is_proper", F.lit(True))
    marked = members.join(known, ["doc_id", "place"], "left")
    roots = marked.groupBy("chain").agg(F.min_by("place", F.struct(F.coalesce(~F.col("is_proper"), F.lit(True)), F.col("place"))).alias("root"), F.count("*").alias("n"))
    means = p.join(found.withColumnsRenamed({"node": "a", "component": "chain"}), "a").groupBy("chain").agg(F.avg("score").alias("confidence"))
    return marked.join(roots, "chain").join(means, "chain").select("doc_id", "place", "chain", "root", "n", "confidence")


def chains(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """The coreference chains of texts from mentions (doc_id, entity_id, start, stop) and the pronouns between them: as `build_chains` has them from `links`.

    Where no two mentions begin at one place, a chain is what belongs to one entity of a text: its mentions, each linked to the one before, and the pronouns linked to them. So its root is the entity's first mention,
    and one window over a text's entities takes the place of the rounds that search for components."""
    places = mentions.select("doc_id", "entity_id", F.col("start").cast("long").alias("place"))
    if not places.groupBy("doc_id", "place").count().filter("count > 1").isEmpty():
        return build_chains(links(docs, mentions), places.select("doc_id", "place"))
    chain = Window.partitionBy("doc_id", "entity_id")
    said = places.withColumn("score", F.lit(None).cast("double")).unionByName(_by_pronoun(docs, mentions, REACH).select("doc_id", "name.entity_id", F.col("anaphor").cast("long").alias("place"), "score"))
    root, n = F.min("place").over(chain), F.count("*").over(chain)
    # each mention but the first is a link of score 1
    linked = F.sum(F.when(F.col("score").isNull(), 1).otherwise(0)).over(chain) - 1
    sure = (linked + F.coalesce(F.sum("score").over(chain), F.lit(0.0))) / (n - 1)
    c = said.filter("doc_id is not null and entity_id is not null").select("doc_id", "place", root.alias("root"), n.alias("n"), F.when(n > 1, sure).alias("confidence")).filter("n > 1")
    return c.select("doc_id", "place", _node(F.col("root")).alias("chain"), "root", "n", "confidence")


def found_aliases(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, start, stop, alias, anchor: capitalised words behind a title that no entity bears. anchor: the name in front of it, where only a comma parts them ("Ana Ruiz, la Reina")."""
    word = "[A-ZÁÉÍÓÚÑÄÖÜÉ][a-záéíóúüñäößàâçèêëîïôùû]+"
    pattern = rf"(?<!\p{{L}})(?:{word}(?: {word}){{0,2}}, )?{TITLES} {word}(?!\p{{L}})"
    text = T.empty_as(F.col("text"))
    z = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    rows = docs.select("doc_id", F.posexplode(z).alias("i", "z")).filter("z.hit is not null")
    stop = F.sum(F.col("z.gap") + F.length("z.hit")).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    hit = F.col("z.hit")
    anchor = F.when(F.contains(hit, F.lit(", ")), F.substring_index(hit, ", ", 1))
    found = rows.select("doc_id", (stop - F.length(F.substring_index(hit, ", ", -1))).alias("start"), stop.alias("stop"), F.substring_index(hit, ", ", -1).alias("alias"), anchor.alias("anchor"))
    borne = entities.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form")).select(T.normalize_name(F.col("form")).alias("form")).distinct()
    return found.withColumn("form", T.normalize_name(F.substring_index("alias", " ", -1))).join(borne, "form", "left_anti").drop("form")


def resolve_aliases(aliases: DataFrame, entities: DataFrame, mentions: DataFrame, chain_members: DataFrame, reach: int = 200) -> DataFrame:
    """aliases (doc_id, start, stop, alias, anchor) with entity_id and source, by the first rule that tells: pattern (the anchor names an entity), context (the nearest mention within
    `reach` characters), coreference (an entity in the chain of the nearest link: chain_members with doc_id, place, root); else both are null."""
    a = aliases.withColumn("alias_id", F.xxhash64("doc_id", "start"))
    borne = entities.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"), "entity_id").groupBy(T.normalize_name(F.col("form")).alias("form")).agg(F.min("entity_id").alias("by_pattern"))
    with_pattern = a.withColumn("form", T.normalize_name(F.col("anchor"))).join(borne, "form", "left").drop("form")
    m = mentions.select("doc_id", F.col("entity_id").alias("by_context"), F.col("start").alias("place"))
    near = nearest(a.select("doc_id", "alias_id", F.col("start").alias("at")), m, ["doc_id"], ["doc_id", "alias_id"], "at", "place", reach, "by_context").drop("distance")
    roots = chain_members.join(mentions.select("doc_id", F.col("start").alias("root"), F.col("entity_id").alias("by_chain")), ["doc_id", "root"]).select("doc_id", F.col("place").alias("at"), "by_chain")
    linked = as_of(a.select("doc_id", "alias_id", F.col("start").alias("at")), roots, ["doc_id"], ["at"], "by_chain").drop("at")
    j = with_pattern.join(near, ["doc_id", "alias_id"], "left").join(linked, ["doc_id", "alias_id"], "left")
    source = F.when(F.col("by_pattern").isNotNull(), "pattern").when(F.col("by_context").isNotNull(), "context").when(F.col("by_chain").isNotNull(), "coreference")
    return j.select("doc_id", "start", "stop", "alias", F.coalesce("by_pattern", "by_context", "by_chain").alias("entity_id"), source.alias("source"))


def alias_clusters(resolved: DataFrame) -> DataFrame:
    """doc_id, entity_id, alias, n, source of resolved aliases: how often an alias stands for an entity in a text, and by the surest rule."""
    sure = F.min(F.when(F.col("source") == "pattern", 0).when(F.col("source") == "context", 1).otherwise(2))
    g = resolved.filter("entity_id is not null").groupBy("doc_id", "entity_id", "alias").agg(F.count("*").alias("n"), sure.alias("k"))
    return g.select("doc_id", "entity_id", "alias", "n", F.element_at(F.array(F.lit("pattern"), F.lit("context"), F.lit("coreference")), F.col("k") + 1).alias("source"))
