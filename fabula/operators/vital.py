"""Who dies where, and who acts after that: death events read from texts and appearances of the dead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.operators.attributes import candidates, resolve
from fabula.operators.joins import as_of
from fabula.operators.temporal import located
from fabula.sources import tables

#: How prose tells a death, in plain text; what it only supposes is found with it and left out.
DEATH = "(?:se +)?(?:murio|murieron|fallecio|perecio|died|mourut|starb)|perdio +la +vida|exhalo +su +ultimo|(?:fue|fueron|was) +(?:asesinad[oa]s?|ejecutad[oa]s?|enterrad[oa]s?|murdered|killed|buried)|(?:lo|la|le) +mataron|hallaron +muert[oa]"
SUPPOSED = "(?:si|quiza|quizas|tal +vez|como +si|casi|podria +haber|creyo +que|penso +que|if|perhaps|almost)"
#: What only the living do, and what makes an appearance of the dead no error.
ACTIONS = "(?:dijo|pregunto|respondio|grito|camino|corrio|entro|salio|miro|sonrio|abrio|cogio|tomo|llego|said|asked|walked|ran|entered|smiled|looked|opened|took)"
RECALLED = "(?:record(?:o|aba|ando|aban)|recuerdos?|memorias?|fantasmas?|espectros?|espiritus?|sono|sonaba|suenos?|anos +atras|antano|de +nino|de +nina|cuando +viv(?:ia|ian)|retratos?|fotografias?|tumbas?|remembered|ghosts?|dreams?|memory|memories)"
CONTEXT, REACH = 250, 30


def _with_chapter(docs: DataFrame, places: DataFrame, at: str) -> DataFrame:
    """places with the chapter that the offset `at` lies in."""
    lines = tables.paragraphs(docs).select("doc_id", F.col("start_char").alias("__at"), (F.floor(F.col("para_idx") / tables.CHAPTER_PARAGRAPHS) + 1).alias("chapter"))
    return as_of(places.withColumn("__at", F.col(at)), lines, ["doc_id"], ["__at"], "chapter").drop("__at")


def deaths(docs: DataFrame, mentions: DataFrame, telling: str = DEATH) -> DataFrame:
    """doc_id, entity_id, start, chapter, confidence: the first death told of each entity of a text. Deaths that are supposed ("si muriera", "tal vez murió") or denied don't count.

    A death is bound to an entity as attributes are: right behind its mention, the last one mentioned before, or the next one after."""
    patterns = {"death": f"(?:{SUPPOSED} +(?:[a-z]+ +){{0,2}})?(?:{telling})"}
    found = candidates(docs, mentions, patterns, {"death": f"^(?:(?!{SUPPOSED} ).)*?((?:{telling}))"}).filter("not negated")
    first = resolve(found).filter("entity_id is not null").groupBy("doc_id", "entity_id").agg(F.min("first_start").alias("start"), F.max("confidence").alias("confidence"))
    return _with_chapter(docs, first, "start").select("doc_id", "entity_id", "start", "chapter", "confidence")


def post_mortem(docs: DataFrame, mentions: DataFrame, dead: DataFrame, actions: str = ACTIONS) -> DataFrame:
    """doc_id, entity_id, death_chapter, chapter, start, action, is_valid: what the dead do in chapters after that of their death.

    An action belongs to the mention that ends at most REACH characters before it. is_valid: memory, dream or ghost is spoken of within CONTEXT characters; such rows are kept, and marked."""
    acts = located(docs, {"act": actions}).select("doc_id", F.col("start").alias("act_start"), F.col("text").alias("action"))
    back = as_of(acts.withColumn("at", F.col("act_start")), mentions.select("doc_id", F.col("stop").alias("at"), F.struct("entity_id", "start", "stop").alias("who")), ["doc_id"], ["at"], "who").drop("at")
    acting = back.filter(F.col("act_start") - F.col("who.stop") <= REACH).select("doc_id", F.col("who.entity_id").alias("entity_id"), F.col("who.start").alias("start"), "act_start", "action")
    later = _with_chapter(docs, acting.join(dead.select("doc_id", "entity_id", F.col("chapter").alias("death_chapter")), ["doc_id", "entity_id"]), "start").filter("chapter > death_chapter")
    recalled = located(docs, {"recalled": RECALLED}).select("doc_id", "start")
    before = as_of(later.withColumn("at", F.col("start")), recalled.select("doc_id", F.col("start").alias("at"), F.col("start").alias("told")), ["doc_id"], ["at"], "told").drop("at")
    after = as_of(before.withColumn("at", -F.col("start")), recalled.select("doc_id", (-F.col("start")).alias("at"), F.col("start").alias("tells")), ["doc_id"], ["at"], "tells").drop("at")
    valid = F.coalesce(F.col("start") - F.col("told") <= CONTEXT, F.lit(False)) | F.coalesce(F.col("tells") - F.col("start") <= CONTEXT, F.lit(False))
    return after.select("doc_id", "entity_id", "death_chapter", "chapter", "start", "action", valid.alias("is_valid"))
