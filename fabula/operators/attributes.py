"""Attributes of entities read from texts: spans bound to whom they tell of, resolved by rules in order, and their contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.operators.joins import as_of
from fabula.operators.temporal import located
from fabula.sources.shared import written

_COLOUR = "(?:azul|verde|negr[oa]|castan[oa]|marron|gris|rubi[oa]|pelirroj[oa]|moren[oa]|blanc[oa]|canos[oa]|roj[oa])(?:e?s)?"
#: Kinds of attribute and how prose states them, in plain text; `value` takes what is stated out of the hit.
PATTERNS = {
    "eyes": f"ojos +(?:muy +|mas +)?{_COLOUR}|(?:blue|green|brown|grey|black|hazel) +eyes",
    "hair": f"(?:pelo|cabellos?|melena|barba|bigote) +(?:muy +|mas +)?{_COLOUR}|(?:blond|black|brown|red|grey|white) +hair",
    "age": "(?:tenia|tiene|cumplio|de|con|aged) +[0-9]{1,3}(?: +anos)?|[0-9]{1,3} +(?:anos|years +old)",
    "profession": "(?:era|es|fue|trabajaba +como|trabaja +como|was +an?|is +an?) +(?:un +|una +|el +|la +|la +mejor +)?(?:medic[oa]|abogad[oa]|maestr[oa]|profesora?|herrer[oa]|soldado|carpinter[oa]|marinero|cura|juez|jueza|doctor|teacher|lawyer|soldier|smith)",
    "build": "(?:era|es|muy|was|is) +(?:alt[oa]|baj[oa]|gord[oa]|delgad[oa]|fuerte|debil|tall|short|stout|thin|strong)"}
VALUES = {"eyes": f"({_COLOUR}|blue|green|brown|grey|black|hazel)", "hair": f"({_COLOUR}|blond|black|brown|red|grey|white)", "age": "([0-9]{1,3})", "profession": " ([a-z]+)$", "build": " ([a-z]+)$"}
#: Kinds that can change in the course of a story: another value later is a change, no contradiction.
CHANGING = ("age", "profession", "hair")
#: What denies a statement, at most two words before it.
NEGATION = "(?:no|nunca|jamas|tampoco|not|never)"
# Reaches of the rules, in characters.
BEFORE, AFTER = 200, 80
RULES = ("apposition", "possessor", "subject", "following")


def candidates(docs: DataFrame, mentions: DataFrame, patterns: dict[str, str] = PATTERNS, values: dict[str, str] = VALUES) -> DataFrame:
    """doc_id, start, stop, key, value, negated, entity_id, rule of the attribute spans of texts and whom they may tell of: a row for every rule that binds.

    The nearest mention before a span and the nearest one behind it come from two as-of passes, whatever the number of mentions. apposition: the mention
    ends right in front of the span; possessor: the next one begins two to four characters behind the span, which is room for "de" or "of"; subject: the last mention at most BEFORE characters before it; following: the next one within AFTER characters."""
    spans = located(docs, {k: f"(?:{NEGATION} +(?:[a-z]+ +){{0,2}})?(?:{p})" for k, p in patterns.items()}).withColumn("negated", F.regexp_like("text", F.lit(f"^{NEGATION} ")))
    value = F.coalesce(*[F.when(F.col("kind") == k, F.nullif(F.regexp_extract("text", p, 1), F.lit(""))) for k, p in values.items()])
    s = spans.select("doc_id", "start", "stop", F.col("kind").alias("key"), F.regexp_replace(value, "(?<=azul|marron|gris)es$|(?<=[a-z]{3}[aeo])s$", "").alias("value"), "negated").filter("value is not null")
    m = mentions.select("doc_id", "entity_id", F.col("start").alias("m_start"), F.col("stop").alias("m_stop"))
    back = as_of(s.withColumn("at", F.col("start")), m.select("doc_id", F.col("m_stop").alias("at"), F.struct("entity_id", "m_stop").alias("prior")), ["doc_id"], ["at"], "prior").drop("at")
    # looking ahead is looking back on the reversed axis
    fore = as_of(back.withColumn("at", -F.col("stop")), m.select("doc_id", (-F.col("m_start")).alias("at"), F.struct("entity_id", "m_start").alias("next")), ["doc_id"], ["at"], "next").drop("at")
    behind, ahead = F.col("start") - F.col("prior.m_stop"), F.col("next.m_start") - F.col("stop")
    rule = lambda name, cond, side: F.when(cond, F.struct(F.lit(name).alias("rule"), F.col(f"{side}.entity_id").alias("entity_id")))
    bound = F.array_compact(F.array(rule("apposition", behind.between(0, 2), "prior"), rule("possessor", ahead.between(2, 4), "next"), rule("subject", behind.between(3, BEFORE), "prior"), rule("following", ahead.between(0, AFTER), "next")))
    return fore.withColumn("b", F.explode(bound)).select("doc_id", "start", "stop", "key", "value", "negated", "b.entity_id", "b.rule")


def resolve(found: DataFrame) -> DataFrame:
    """The candidates (doc_id, start, stop, key, value, entity_id, rule, negated) that the first rule of RULES binds, one for each span, with confidence; equal statements of one entity in a text are one row with n and its first place.

    A span on which equally good rules name two entities is ambiguous: the smaller entity_id stands and confidence is halved."""
    rank = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule"))
    r = written(found.withColumn("rank", rank))
    best = r.groupBy("doc_id", "start", "stop", "key", "value", "negated").agg(F.min(F.struct("rank", "entity_id")).alias("b"))
    ties = r.groupBy("doc_id", "start", "stop", "key", "rank").agg(F.countDistinct("entity_id").alias("n_entities"))
    one = best.select("doc_id", "start", "stop", "key", "value", "negated", "b.rank", "b.entity_id").join(ties, ["doc_id", "start", "stop", "key", "rank"])
    sure = F.element_at(F.array(F.lit(0.9), F.lit(0.8), F.lit(0.7), F.lit(0.5)), F.col("rank").cast("int")) / F.when(F.col("n_entities") > 1, 2).otherwise(1)
    g = one.withColumn("sure", sure).groupBy("doc_id", "entity_id", "key", "value", "negated").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.max("sure").alias("confidence"), F.min("rank").alias("rank"))
    return g.select("doc_id", "entity_id", "key", "value", "negated", "n", "first_start", "confidence", F.element_at(F.array(*map(F.lit, RULES)), F.col("rank").cast("int")).alias("rule"))


def contradictions(attributes: DataFrame) -> DataFrame:
    """doc_id, entity_id, key, value, other, first_start, other_start, kind of the pairs of neighbouring statements (by first place) of one entity's attribute that don't agree.

    kind: negation where the same value is said and denied; change where the attribute may change (an age only upwards); else conflict. Of two different values one denied, nothing follows. Statements
    are compared with the one before only, so an entity of many values yields as many rows, not their square."""
    a = attributes.select("doc_id", "entity_id", "key", "value", "negated", "first_start")
    by_place = Window.partitionBy("doc_id", "entity_id", "key", "negated").orderBy("first_start", "value")
    prior = a.withColumns({"other": F.lag("value").over(by_place), "other_start": F.lag("first_start").over(by_place)}).filter("not negated and other is not null")
    falls = (F.col("key") == "age") & (F.col("value").try_cast("int") < F.col("other").try_cast("int"))
    kind = F.when(F.col("key").isin(*CHANGING) & ~falls, "change").otherwise("conflict")
    differ = prior.select("doc_id", "entity_id", "key", "value", "other", "first_start", "other_start", kind.alias("kind"))
    denied = a.filter("negated").select("doc_id", "entity_id", "key", "value", F.col("first_start").alias("other_start"))
    both = a.filter("not negated").join(denied, ["doc_id", "entity_id", "key", "value"]).select("doc_id", "entity_id", "key", "value", F.col("value").alias("other"), "first_start", "other_start", F.lit("negation").alias("kind"))
    return differ.unionByName(both)
