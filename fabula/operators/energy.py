"""The energy of sentences: voice, strength of verbs and structure as one score, and findings of usage with a correction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.functions import batches as B
from fabula.functions import text as T
from fabula.operators.temporal import located, located_sql
from fabula.sources import tables

# Weights and steps of the score. Results depend on them.
VOICE, VERB, STRUCTURE = 0.4, 0.4, 0.2
LEAST_WORDS, NOMINAL, MOST_NOMINAL = 4, 5.0, 15.0
LEVELS = ((80, "very_high"), (60, "high"), (40, "medium"), (20, "low"))

#: Verb forms that carry little action, of the four languages, in plain text.
WEAK = (
    "es|son|era|eran|fue|fueron|ser|esta|estan|estaba|estaban|estar|hay|habia|habian|hubo|haber|ha|han|tiene|tienen|tenia|tenian|tener|hace|hacen|hacia|hizo|hacer|va|van|iba|iban|ir|pone|puso|da|dio|dar"
    "|is|are|was|were|be|been|has|have|had|do|does|did|get|got|make|made|est|sont|etait|ont|avait|fait|ist|sind|war|waren|hat|haben|hatte|wird|werden")
_PARTICIPLE = "[a-z]+(?:ad|id|t|s|ch)[oa]s?|[a-z]{3,}ed"
#: Where such a form is no weak verb: an auxiliary before a participle, going somewhere, and set phrases of force.
STRONG = f"(?:ha|han|habia|habian|hubo|haber|has|have|had) +(?:[a-z]+ +)?(?:{_PARTICIPLE})|(?:va|van|iba|iban|ir) +(?:hacia|hasta|tras|al|contra)|(?:hace|hacen|hizo|hacer) +(?:anicos|trizas|pedazos|frente|saltar)"
PASSIVE = f"(?:es|son|era|eran|fue|fueron|sera|seran|ser|sido|siendo|is|are|was|were|been|being) +(?:[a-z]+mente +|[a-z]+ly +)?(?:{_PARTICIPLE})"
REFLEXIVE = "se +[a-z]+(?:a|e|o|an|en|aron|ieron)"
NOMINALS = "[a-z]+(?:cion|sion|ciones|siones|miento|mientos|ncia|ncias|anza|idad|idades|tion|tions|ment|ness|heit|keit|ung)"


def sentence_energy(docs: DataFrame) -> DataFrame:
    """doc_id, sent_idx, n_words, voice, verb, structure, energy, level of the sentences of at least LEAST_WORDS words.

    voice: 30 in the passive, 45 in the reflexive passive, else 100. verb: 100, 70, 45 or 20 with none, one, two or more weak verbs. structure: 90 exclaimed, 85 asked, 60 left open, else 70,
    less 1.5 a word beyond 40 (30 at most, and not below 10), or 10 from 31 to 40 words (not below 30). energy is their weighted mean, less 5 for each nominalisation up to 15, not below 0."""
    t = F.trim("text")
    kind = F.when(F.endswith(t, F.lit("!")) | F.startswith(t, F.lit("¡")), 90.0).when(F.endswith(t, F.lit("?")) | F.startswith(t, F.lit("¿")), 85.0).when(F.endswith(t, F.lit("...")) | F.endswith(t, F.lit("…")), 60.0).otherwise(70.0)
    s = tables.sentences(docs).select("doc_id", "sent_idx", kind.alias("kind"), "text")
    s = s.mapInArrow(_traits, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sent_idx long, kind double, n_words long, voice double, weak long, nominals long")
    verb = F.when(F.col("weak") == 0, 100.0).when(F.col("weak") == 1, 70.0).when(F.col("weak") == 2, 45.0).otherwise(20.0)
    scored = s.select("doc_id", "sent_idx", "n_words", "voice", verb.alias("verb"), _shortened(F.col("kind"), F.col("n_words")).alias("structure"), F.least(F.col("nominals") * NOMINAL, F.lit(MOST_NOMINAL)).alias("nominal"))
    energy = F.round(F.greatest(F.lit(0.0), F.col("voice") * VOICE + F.col("verb") * VERB + F.col("structure") * STRUCTURE - F.col("nominal")), 4)
    level = F.coalesce(*[F.when(F.col("energy") >= at, name) for at, name in LEVELS], F.lit("very_low"))
    return scored.withColumn("energy", energy).withColumn("level", level).drop("nominal")


def _traits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sentences of at least LEAST_WORDS words with their words, voice, weak verbs and nominalisations. Each pattern reads a batch once, in time linear in it."""
    word = lambda pattern: rf"\b(?:{pattern})\b"
    for b in it:
        n = B.word_counts(b.column("text"))
        b = b.filter(pa.array(n >= LEAST_WORDS))
        p = B.plain_array(b.column("text"))
        count = lambda pattern: pc.count_substring_regex(p, word(pattern)).to_numpy(zero_copy_only=False).astype(np.int64)
        has = lambda pattern: pc.match_substring_regex(p, word(pattern)).to_numpy(zero_copy_only=False)
        voice = np.where(has(PASSIVE), 30.0, np.where(has(REFLEXIVE), 45.0, 100.0))
        weak = np.maximum(0, count(WEAK) - count(STRONG))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("sent_idx"), b.column("kind"), *map(pa.array, (n[n >= LEAST_WORDS], voice, weak, count(NOMINALS)))],
            names=["doc_id", "sent_idx", "kind", "n_words", "voice", "weak", "nominals"])


def _shortened(kind: Column, n: Column) -> Column:
    return F.when(n > 40, F.greatest(F.lit(10.0), kind - F.least((n - 40) * 1.5, F.lit(30.0)))).when(n > 30, F.greatest(F.lit(30.0), kind - 10.0)).otherwise(kind)


def energy_sql(sentences: str, word: str) -> str:
    """The same in SQL; sentences: a common table expression `sent` (doc_id, sent_idx, text), word: the pattern of a word."""
    count = lambda p: f"len(regexp_extract_all(p, '\\b(?:{p})\\b'))"
    has = lambda p: f"regexp_matches(p, '\\b(?:{p})\\b')"
    levels = " ".join(f"WHEN energy >= {at} THEN '{name}'" for at, name in LEVELS)
    return f"""WITH {sentences}, s AS (SELECT doc_id, sent_idx, trim(text) AS t, translate(text, '{T.PLAIN_FROM}', '{T.PLAIN_TO}') AS p, CAST(len(regexp_extract_all(text, '{word}')) AS BIGINT) AS n_words FROM sent),
k AS (SELECT doc_id, sent_idx, n_words, CASE WHEN {has(PASSIVE)} THEN 30.0 WHEN {has(REFLEXIVE)} THEN 45.0 ELSE 100.0 END::DOUBLE AS voice, greatest(0, {count(WEAK)} - {count(STRONG)}) AS weak, least({count(NOMINALS)} * {NOMINAL}, {MOST_NOMINAL})::DOUBLE AS nominal,
  CASE WHEN t LIKE '%!' OR t LIKE '¡%' THEN 90.0 WHEN t LIKE '%?' OR t LIKE '¿%' THEN 85.0 WHEN t LIKE '%...' OR t LIKE '%…' THEN 60.0 ELSE 70.0 END::DOUBLE AS kind FROM s WHERE n_words >= {LEAST_WORDS}),
v AS (SELECT *, CASE weak WHEN 0 THEN 100.0 WHEN 1 THEN 70.0 WHEN 2 THEN 45.0 ELSE 20.0 END::DOUBLE AS verb,
  CASE WHEN n_words > 40 THEN greatest(10.0::DOUBLE, kind - least((n_words - 40) * 1.5::DOUBLE, 30.0::DOUBLE)) WHEN n_words > 30 THEN greatest(30.0::DOUBLE, kind - 10.0::DOUBLE) ELSE kind END AS structure FROM k),
e AS (SELECT doc_id, sent_idx, n_words, voice, verb, structure, round(greatest(0.0::DOUBLE, voice * {VOICE}::DOUBLE + verb * {VERB}::DOUBLE + structure * {STRUCTURE}::DOUBLE - nominal), 4) AS energy FROM v)
SELECT *, CASE {levels} ELSE 'very_low' END AS level FROM e"""


#: Findings of Spanish usage, in plain text: the pattern, what to put in place of what in the hit, and how sure it is.
USAGE = {
    "dequeismo": ("(?:creo|pienso|opino|supongo|dijo|dice|afirma|parece) +de +que", "de +que", "que", 0.9),
    "queismo": ("(?:me +(?:acuerdo|alegro)|estoy +segur[oa]|a +pesar|a +condicion|darse +cuenta) +que", "que$", "de que", 0.85),
    "laismo": ("las? +(?:dije|dijo|di|dio|pego|regalo|conto|pregunto) +(?:que|un|una|el|la|los|las)", "^la", "le", 0.7),
    "loismo": ("los? +(?:dije|dijo|di|dio|pego|regalo|conto) +(?:que|un|una)", "^lo", "le", 0.7),
    "habemos": ("habemos +[a-z]+", "^habemos", "somos", 0.95),
    "redundancy": ("(?:subir|subio|sube) +(?:para +)?arriba|(?:bajar|bajo|baja) +(?:para +)?abajo|(?:entrar|entro|entra) +(?:para +)?adentro|(?:salir|salio|sale) +(?:para +)?afuera|volver +a +repetir", " +(?:para +)?(?:arriba|abajo|adentro|afuera)$", "", 0.8),
    "stressed_a": ("(?:la|una) +(?:agua|alma|arma|hacha|aguila|aula|hambre|hada|ancla|ave)", "a +", " ", 0.9),
    "number_agreement": ("(?:los|las|unos|unas) +[a-z]+[bcdfghjklmnpqrstvwxyz](?:a|e|o)", "$", "s", 0.6),
    "gender_agreement": ("(?:el|un) +[a-z]{3,}(?:cion|sion|dad|tad|umbre)|(?:la|una) +[a-z]{3,}(?:aje|ambre|ismo)", "^(el|un|la|una) ", "", 0.6)}


def usage_findings(docs: DataFrame) -> DataFrame:
    """doc_id, start, stop, kind, text, suggestion, confidence of findings of usage, at their places; text and suggestion are plain."""
    swap = {"el": "la", "un": "una", "la": "el", "una": "un"}
    other = F.create_map(*[F.lit(x) for pair in swap.items() for x in pair])
    found = located(docs, {k: p for k, (p, *_) in USAGE.items()})
    fixed = lambda k: F.regexp_replace("text", USAGE[k][1], USAGE[k][2])
    gendered = F.concat_ws(" ", F.try_element_at(other, F.regexp_extract("text", "^([a-z]+)", 1)), F.regexp_replace("text", "^[a-z]+ +", ""))
    stressed = F.concat_ws(" ", F.when(F.startswith("text", F.lit("la ")), "el").otherwise("un"), F.regexp_replace("text", "^[a-z]+ +", ""))
    suggestion = F.coalesce(*[F.when(F.col("kind") == k, gendered if k == "gender_agreement" else stressed if k == "stressed_a" else fixed(k)) for k in USAGE])
    sure = F.coalesce(*[F.when(F.col("kind") == k, F.lit(c)) for k, (*_, c) in USAGE.items()])
    return found.select("*", suggestion.alias("suggestion"), sure.alias("confidence"))


def usage_sql(table: str = "documents") -> str:
    gendered = "concat_ws(' ', CASE regexp_extract(text, '^([a-z]+)', 1) WHEN 'el' THEN 'la' WHEN 'un' THEN 'una' WHEN 'la' THEN 'el' ELSE 'un' END, regexp_replace(text, '^[a-z]+ +', ''))"
    stressed = "concat_ws(' ', CASE WHEN text LIKE 'la %' THEN 'el' ELSE 'un' END, regexp_replace(text, '^[a-z]+ +', ''))"
    fixes = " ".join(f"WHEN '{k}' THEN " + (gendered if k == "gender_agreement" else stressed if k == "stressed_a" else f"regexp_replace(text, '{a}', '{b}')") for k, (_, a, b, _) in USAGE.items())
    sure = " ".join(f"WHEN '{k}' THEN CAST({c} AS DOUBLE)" for k, (*_, c) in USAGE.items())
    return f"SELECT *, CASE kind {fixes} END AS suggestion, CASE kind {sure} END AS confidence FROM ({located_sql({k: p for k, (p, *_) in USAGE.items()}, table)})"
