"""Queries that read stories out of texts: mentions of given names, versions, dialogue, chains, attributes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.functions import lexicons as L
from fabula.functions import text as T
from fabula.operators import attributes as A
from fabula.operators import chains as H
from fabula.operators import character as Q
from fabula.operators import chunks as K
from fabula.operators import clusters as G
from fabula.operators import energy as Y
from fabula.operators import mentions as M
from fabula.operators import speakers as S
from fabula.operators import spelling as O
from fabula.operators import structure as R
from fabula.operators import versions as V
from fabula.operators import vital as B
from fabula.operators.joins import broadcast_if_small
from fabula.plans.catalog import query
from fabula.plans.story_plans import INTERACTIONS, _interactions
from fabula.plans.style_plans import CHAP, QUOTED, SENT, TOK, WORD, sentences_sql
from fabula.sources import tables
from fabula.sources.shared import written
from fabula.sources.tables import CAST, load
from fabula.streaming import events as E


def _docs(spark, d):
    return load(spark, d, "documents")


@query()
def mentions_of_names(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return M.find_mentions(docs, written(M.entities_of(docs)))


def edited(docs):
    """A second version of each text: by a checksum of its place some lines are dropped, written in capitals, said twice, or moved behind the next one. Of neighbouring lines that all would move only the last does; a text's last line stays."""
    kind = lambda i: F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), i.cast("string"))) % 20
    moves = lambda i, n: (kind(i) == 3) & (kind(i + 1) != 3) & (i + 1 < n)
    here = lambda s, i, n: F.when((kind(i) == 0) | moves(i, n), F.array().cast("array<string>")).when(kind(i) == 1, F.array(F.upper(s))).when(kind(i) == 2, F.array(s, s)).otherwise(F.array(s))
    behind = lambda ls, i: F.when((i > 0) & moves(i - 1, F.size(ls)), F.array(F.get(ls, i - 1))).otherwise(F.array().cast("array<string>"))
    each = T.let(F.split(T.empty_as(F.col("text")), "\n", -1), lambda ls: F.transform(ls, lambda s, i: F.concat(here(s, i, F.size(ls)), behind(ls, i))))
    return docs.withColumn("text", F.array_join(F.flatten(each), "\n"))


@query()
def ordered_diffs(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return V.opcodes(docs, edited(docs))


@query()
def diff_summaries(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return V.diff_summary(V.opcodes(docs, edited(docs)))


def _cast(docs):
    """The capitalised names of each text as entities: story (a pair of neighbouring texts), entity_id, entity_type, name, aliases (the last word of several), mention_count, importance."""
    capital = "[A-ZÁÉÍÓÚÑÄÖÜÉÈÊÇ][a-záéíóúüñäößàâçèêëîïôùû]+"
    names = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"(?<!\p{{L}}){capital}(?: {capital}){{0,2}}(?!\p{{L}})"), F.lit(0))).alias("name"))
    n = names.groupBy("doc_id", "name").agg(F.count("*").alias("mention_count"))
    e = n.withColumn("entity_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("name")).cast("long"))
    importance = F.when(F.col("mention_count") >= 5, "primary").when(F.col("mention_count") >= 2, "secondary").otherwise("minor")
    alias = F.when(F.contains("name", F.lit(" ")), F.array(F.substring_index("name", " ", -1))).otherwise(F.array().cast("array<string>"))
    return e.select(F.floor(F.col("doc_id") / 2).alias("story"), (F.col("doc_id") % 2).alias("version"), "entity_id", F.lit("character").alias("entity_type"), "name", alias.alias("aliases"), "mention_count", importance.alias("importance"))


@query()
def entity_continuity(spark, sf_dir):
    cast = written(_cast(_docs(spark, sf_dir)))
    return V.entity_continuity(cast.filter("version = 0").drop("version"), cast.filter("version = 1").drop("version"))


@query()
def speaker_attribution(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return S.speakers(docs, written(M.entities_of(docs)))


@query()
def attributed_turns(spark, sf_dir):
    """Conversations as dialogue: a third of the turns, by a checksum, say who speaks, and the other speakers are found. Speakers are roles, by number."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    role = F.crc32(F.coalesce("role", F.lit("")))
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.row_number().over(order) - 1).cast("long").alias("dlg_idx"), F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), "text")
    said = F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("dlg_idx").cast("string"))) % 3 == 0
    none = F.lit(None).cast("long")
    d = c.select(
        F.col("conv_id").alias("doc_id"), "dlg_idx", F.floor(F.col("dlg_idx") / 20).alias("chapter"), F.lit(0).cast("long").alias("scene"), F.coalesce("before", F.lit(0)).alias("start"), none.alias("explicit_id"),
        F.when(said, role).alias("hint_id"), F.array().cast("array<bigint>").alias("nearby"), "text")
    found = S.attribute(d, known=written(S.voices(d.select(F.col("hint_id").alias("entity_id"), "text")))).withColumnRenamed("doc_id", "conv_id")
    return c.select("conv_id", "dlg_idx", "turn", "role").join(found, ["conv_id", "dlg_idx"]).withColumn("right", F.col("speaker_id") == role)


def _named(spark, sf_dir):
    """Texts, the entities they name, and where."""
    docs = _docs(spark, sf_dir)
    entities = written(M.entities_of(docs))
    return docs, entities, written(M.find_mentions(docs, entities))


@query()
def coreference_chains(spark, sf_dir):
    docs, _, mentions = _named(spark, sf_dir)
    return H.chains(docs, mentions)


@query()
def resolved_aliases(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    entities = written(M.entities_of(docs))
    found = written(H.found_aliases(docs, entities))
    told = written(docs.join(broadcast_if_small(found.select("doc_id").distinct()), "doc_id", "left_semi"))  # an alias is resolved within its text
    mentions = written(M.find_mentions(told, entities))
    return H.alias_clusters(H.resolve_aliases(found, entities, mentions, H.chains(told, mentions)))


#: Words of the supplied tables' four languages that turn a sentence to the past or the future, in plain text.
TENSES = {"past": "was|were|had|fue|era|habia|etait|avait|war|hatte|wurde", "future": "will|shall|sera|seront|wird|werden|va|iba"}


@query(f"""WITH {CHAP}, s AS (SELECT doc_id, chapter, unnest(ss) AS text, unnest(range(len(ss))) AS sent_idx FROM (SELECT doc_id, chapter, {sentences_sql("text")} AS ss FROM chap)),
p AS (SELECT *, translate(text, '{T.PLAIN_FROM}', '{T.PLAIN_TO}') AS t FROM s), r AS ({" UNION ALL ".join(f"SELECT doc_id, chapter, sent_idx, '{k}' AS direction, text FROM p WHERE regexp_matches(t, '{chr(92)}b(?:{w}){chr(92)}b')" for k, w in TENSES.items())}),
k AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(text), '{WORD}')), lambda w: length(w) >= {R.KEYWORD_CHARS} AND w NOT IN ({QUOTED(L.STOP_WORDS)})) AS ws FROM r),
i AS (SELECT DISTINCT doc_id, chapter AS other, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM chap), a AS (SELECT doc_id, chapter, sent_idx, direction, len(ws) AS n, unnest(ws) AS word FROM k),
h AS (SELECT doc_id, chapter, sent_idx, direction, other, n, count(*) AS k FROM a JOIN i USING (doc_id, word) WHERE CASE WHEN direction = 'past' THEN other < chapter ELSE other > chapter END GROUP BY ALL HAVING count(*) >= {R.LEAST_SHARED} AND count(*) >= n * {R.SHARE}::DOUBLE),
f AS (SELECT doc_id, chapter, sent_idx, direction, min(other) AS told_in, arg_min(k, other) AS shared FROM h GROUP BY ALL)
SELECT doc_id, chapter, sent_idx, direction, len(ws) AS n_keywords, coalesce(told_in, 0) AS told_in, coalesce(shared, 0) AS shared FROM k LEFT JOIN f USING (doc_id, chapter, sent_idx, direction)""")
def told_elsewhere(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return R.told_elsewhere(docs, written(R.references(docs, TENSES)))


@query()
def prolepses_and_analepses(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return R.told_elsewhere(docs, written(R.references(docs)))


@query()
def name_clusters(spark, sf_dir):
    """Names of several words in two neighbouring texts, clustered by likeness."""
    cast = _cast(_docs(spark, sf_dir)).filter("name like '% %'")
    return G.name_clusters(cast.select(F.col("story").alias("scope"), (F.col("story") * 1_000_000 + F.col("version") * 500_000 + F.col("entity_id")).alias("id"), "name"))


@query()
def pairs_within_name_clusters(spark, sf_dir):
    return G.pairs_within(written(name_clusters(spark, sf_dir)))


@query()
def relationship_clusters(spark, sf_dir):
    i = _interactions(spark, sf_dir)
    return G.relationship_clusters(i.select(F.floor(F.least("a", "b") / CAST).alias("story"), "a", "b", F.lit(1).alias("strength")))


@query()
def text_chunks(spark, sf_dir):
    c = K.chunks(_docs(spark, sf_dir))
    return c.select("doc_id", "chunk_index", "start", "stop", F.md5("text").alias("text"))


@query()
def misspellings(spark, sf_dir):
    """Words near a common word of the corpus but not in its dictionary; the names that texts hold are known."""
    docs = _docs(spark, sf_dir)
    return O.misspelling_summary(written(O.misspellings(docs, M.entities_of(docs))))


@query(f"""WITH {TOK}, t AS (SELECT doc_id, word_idx, translate(token, '{T.PLAIN_FROM}', '{T.PLAIN_TO}') AS word FROM tok WHERE length(token) >= 4),
s AS (SELECT *, CASE WHEN regexp_matches(word, '^[a-z]{{4}}') THEN regexp_replace(word, '^([a-z]{{4,20}}?)(?:{"|".join(O.ENDINGS)})$', '\\1') ELSE word END AS stem FROM t), g AS (SELECT *, word_idx - lag(word_idx) OVER (PARTITION BY doc_id, stem ORDER BY word_idx) AS gap FROM s)
SELECT doc_id, stem, count(*) AS n, min(gap) AS min_distance, count(DISTINCT word) AS forms FROM g GROUP BY 1, 2 HAVING min(gap) <= 50 AND count(DISTINCT word) > 1""")
def lemma_repetitions(spark, sf_dir):
    return O.lemma_repetitions(_docs(spark, sf_dir))


#: What the supplied tables' prose says of somebody, in plain text: any word behind a form of "to be".
SAID = {"being": "(?:was|is|era|es|fue|est|etait|ist|war) +[a-z]{4,}"}


@query()
def entity_attributes(spark, sf_dir):
    docs, _, mentions = _named(spark, sf_dir)
    return A.resolve(A.candidates(docs, mentions, A.PATTERNS | SAID, A.VALUES | {"being": " ([a-z]+)$"}))


@query()
def attribute_contradictions(spark, sf_dir):
    return A.contradictions(written(entity_attributes(spark, sf_dir)))


#: Words of the supplied tables' prose that stand for telling a death and for acting, as it tells neither: function words, in plain text.
GONE, DOES = "was +[a-z]+|fue +[a-z]+|war +[a-z]+", "(?:is|has|to|es|se|ist|zu|est|a) +[a-z]+"


@query()
def deaths(spark, sf_dir):
    docs, _, mentions = _named(spark, sf_dir)
    return B.deaths(docs, mentions, f"{B.DEATH}|{GONE}")


@query()
def post_mortem_appearances(spark, sf_dir):
    docs, _, mentions = _named(spark, sf_dir)
    return B.post_mortem(docs, mentions, written(B.deaths(docs, mentions, f"{B.DEATH}|{GONE}")), f"{B.ACTIONS}|{DOES}")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def replayed_event_windows(spark, sf_dir):
    """The event log replayed as a stream into tumbling windows; the last update of each window."""
    return E.replayed_windows(spark, f"{sf_dir}/events.parquet")


@query(Y.energy_sql(SENT, WORD))
def sentence_energy(spark, sf_dir):
    return Y.sentence_energy(_docs(spark, sf_dir))


@query(Y.usage_sql())
def usage_findings(spark, sf_dir):
    return Y.usage_findings(_docs(spark, sf_dir))


_TURNS = "lines AS (SELECT conv_id AS story, role AS speaker, turn // 4 AS chapter, text FROM conversations)"


@query(Q.out_of_character_sql(_TURNS))
def out_of_character(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return Q.out_of_character(c.select(F.col("conv_id").alias("story"), F.col("role").alias("speaker"), F.floor(F.col("turn") / 4).alias("chapter"), "text"))


_FULL = lambda x: f"CASE WHEN ({x}) IS NOT NULL THEN round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, {x})), 4) END"
_MEANS = " + ".join(f"coalesce({d} * {w}, 0)" for d, w in Q.WEIGHTS.items() if d not in ("goal", "stakes"))
_SHARES = " + ".join(f"CASE WHEN {d} IS NOT NULL THEN {w} ELSE 0 END" for d, w in Q.WEIGHTS.items() if d not in ("goal", "stakes"))
_KNOWN = " + ".join(f"CAST({d} IS NOT NULL AS BIGINT)" for d in Q.WEIGHTS if d not in ("goal", "stakes"))


@query(f"""WITH {INTERACTIONS}, i AS (SELECT a // {CAST} AS story, chapter, a, b, tone / 100.0::DOUBLE AS tone FROM p), m AS (SELECT story, chapter, a AS e FROM i UNION ALL SELECT story, chapter, b FROM i),
g AS (SELECT story, e, count(*) AS n, min(chapter) AS f, max(chapter) AS l FROM m GROUP BY 1, 2),
c AS (SELECT story, max(n) AS top, avg(n) AS mean, CAST(sum(n) AS DOUBLE) AS total, count(*) AS k, CAST(sum(n * n) AS DOUBLE) AS sq, count(*) FILTER (f <= 3) AS early, count(*) FILTER (f <= 3 AND l > 3) AS again FROM g GROUP BY 1),
h AS (SELECT story, count(*) AS n_chapters, avg(n) AS pm, stddev_pop(n) AS ps FROM (SELECT story, chapter, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1), pl AS (SELECT DISTINCT story, chapter, e FROM m),
s AS (SELECT x.story, count(*) AS shared FROM pl x JOIN pl y ON x.story = y.story AND x.e = y.e AND x.chapter = y.chapter + 1 GROUP BY 1), la AS (SELECT story, count(*) AS later FROM (SELECT *, min(chapter) OVER (PARTITION BY story) AS fc FROM pl) WHERE chapter > fc GROUP BY 1),
t AS (SELECT story, chapter, avg(tone) AS tone, count(*) AS m, count(*) FILTER (tone < 0) AS hostile FROM i GROUP BY 1, 2),
r AS (SELECT story, sum(hostile) AS hostile, sum(m) AS m, max(tone) AS hi, min(tone) AS lo, arg_min(chapter, row(tone, chapter)) AS low_at, max(chapter) AS fin, arg_max(tone, chapter) AS ft, min(chapter) AS beg FROM t GROUP BY 1),
d AS (SELECT story, n_chapters, {_FULL("50.0 * top / mean / 2")} AS protagonist, {_FULL("CASE WHEN k > 1 THEN 100.0 * (1 - sq / (total * total)) / (1 - 1.0::DOUBLE / k) END")} AS cast_balance, {_FULL("100.0 * (1 - ps / pm)")} AS pacing,
  CASE WHEN later > 0 THEN {_FULL("100.0 * coalesce(shared, 0) / later")} END AS coherence, CASE WHEN early > 0 THEN {_FULL("100.0::DOUBLE * again / early")} END AS chekhov, {_FULL(f"100.0::DOUBLE * n_chapters / {Q.FULL_STRUCTURE}")} AS structure, {_FULL("200.0::DOUBLE * hostile / m")} AS conflict,
  CASE WHEN fin > beg THEN {_FULL("100.0::DOUBLE * (low_at - beg) / (fin - beg)")} END AS climax, {_FULL("100.0 * (ft - lo)")} AS resolution, {_FULL("100.0 * (hi - lo)")} AS emotional_arc FROM c JOIN h USING (story) LEFT JOIN s USING (story) LEFT JOIN la USING (story) LEFT JOIN r USING (story)),
z AS (SELECT story, n_chapters, {_KNOWN} AS n_dimensions, CASE WHEN n_chapters < 2 THEN 0.0 ELSE round(CAST(({_MEANS}) / ({_SHARES}) AS DOUBLE), 3) END AS score FROM d)
SELECT *, CASE WHEN score >= {Q.WELL} THEN 'well' WHEN score >= {Q.DOUBTFUL} THEN 'doubtful' ELSE 'critical' END AS status FROM z""")
def narrative_health(spark, sf_dir):
    at = F.struct("_metadata.file_name", "_metadata.row_index").alias("at")  # a row's place in the table
    i = written(tables.interactions(load(spark, sf_dir, "lineitem"), at).select(F.floor(F.col("a") / CAST).alias("story"), "chapter", "a", "b", (F.col("tone_pct") / 100).alias("tone"), "at"))
    mentions = i.select("story", "chapter", F.explode(F.array("a", "b")).alias("entity_id"))
    return Q.health(Q.dimensions(mentions, i))
