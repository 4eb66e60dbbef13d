"""Editorial queries: coordinates, diffs, mentions, votes, imports, dictionaries and scenes."""

from pyspark.sql import functions as F

from fabula.operators import editorial as D
from fabula.operators import temporal as P
from fabula.operators import texts as X
from fabula.plans.alert_plans import ALERTS, _alerts
from fabula.plans.catalog import query
from fabula.plans.model_plans import STATES
from fabula.plans.story_plans import ENTITIES, INTERACTIONS, MARKERS, MENTIONS, _entities, _events, _interactions, _markers, _mentions
from fabula.plans.style_plans import CHAP, QUOTED, SENT, SPEECH, TOK, WORD
from fabula.plans.text_plans import PARAS
from fabula.sources.tables import load


def _docs(spark, d):
    return load(spark, d, "documents")


@query(f"""WITH {PARAS}, o AS (SELECT doc_id, unnest(range(0, length(text), 700)) AS o FROM documents WHERE length(text) > 0)
SELECT o.doc_id, p.para_idx, o.o - p.start_char AS "local", o.o AS "offset" FROM o ASOF JOIN paras p ON o.doc_id = p.doc_id AND o.o >= p.start_char""")
def paragraph_offsets_to_text(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return D.paragraph_to_text(X.offsets_to_paragraphs(docs).drop("offset"), docs)


@query(f"""WITH {PARAS}, n AS (SELECT doc_id, para_idx, lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS norm FROM paras)
SELECT md5(norm) AS paragraph, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc, arg_min(para_idx, row(doc_id, para_idx)) AS first_para FROM n WHERE length(norm) >= 50 GROUP BY norm HAVING count(*) > 1""")
def paragraph_duplicates(spark, sf_dir):
    return D.paragraph_duplicates(_docs(spark, sf_dir))


@query(f"""WITH {PARAS}, p AS (SELECT doc_id // 2 AS d, doc_id % 2 AS side, md5(trim(text)) AS h, row_number() OVER (PARTITION BY doc_id, md5(trim(text)) ORDER BY para_idx) AS k FROM paras WHERE trim(text) <> ''),
b AS (SELECT d AS doc_id, o.k AS o, n.k AS n FROM (SELECT * FROM p WHERE side = 0) o FULL JOIN (SELECT * FROM p WHERE side = 1) n USING (d, h, k))
SELECT doc_id, count(*) FILTER (o IS NOT NULL AND n IS NOT NULL) AS kept, count(*) FILTER (n IS NULL) AS removed, count(*) FILTER (o IS NULL) AS added, round(2 * count(*) FILTER (o IS NOT NULL AND n IS NOT NULL) / (2 * count(*) FILTER (o IS NOT NULL AND n IS NOT NULL) + count(*) FILTER (n IS NULL) + count(*) FILTER (o IS NULL)), 6) AS ratio FROM b GROUP BY 1""")
def paragraph_diffs(spark, sf_dir):
    half = lambda r: _docs(spark, sf_dir).filter(F.col("doc_id") % 2 == r).select(F.floor(F.col("doc_id") / 2).alias("doc_id"), "text")
    return D.paragraph_diffs(half(0), half(1))


@query(f"""WITH {MENTIONS}, {MARKERS}, p AS (SELECT doc_id, chapter, entity_id, start_char, end_char FROM mentions)
SELECT p.*, count(*) AS n_changes FROM p JOIN markers m ON m.doc_id = p.doc_id AND m.chapter = p.chapter AND m.at - 200 < p.end_char AND m.at + 250 > p.start_char GROUP BY ALL""")
def in_modified_areas(spark, sf_dir):
    return D.in_modified_area(_mentions(spark, sf_dir), _markers(spark, sf_dir))


@query(f"WITH {MENTIONS}, {ENTITIES} SELECT entity_id, name, entity_type, count(doc_id) AS mention_count FROM entities LEFT JOIN (SELECT * FROM mentions WHERE is_active) USING (entity_id) WHERE entity_type IN ('economy', 'promo', 'large') GROUP BY 1, 2, 3")
def entity_list(spark, sf_dir):
    return D.entity_list(_entities(spark, sf_dir), _mentions(spark, sf_dir), ("economy", "promo", "large"))


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPEECH}') AS ds FROM documents), u AS (SELECT doc_id, unnest(range(len(ds))) AS dlg_idx, unnest(ds) AS text FROM d),
k AS (SELECT doc_id, dlg_idx, CASE text[1] WHEN '—' THEN 'dash' WHEN '«' THEN 'angular' WHEN '“' THEN 'curly' ELSE 'straight' END AS kind, CAST(length(text) AS BIGINT) AS n_chars FROM u) SELECT * FROM k WHERE kind <> 'dash'""")
def speech_without_dashes(spark, sf_dir):
    return D.speech_kinds(_docs(spark, sf_dir), "dash")


@query(f"""WITH {MENTIONS}, {ENTITIES}, g AS (SELECT doc_id, chapter, count(*) AS n, count(DISTINCT m.entity_id) AS n_participants, count(DISTINCT e.entity_id) AS n_wanted FROM mentions m LEFT JOIN (SELECT * FROM entities WHERE importance = 'primary') e ON e.entity_id = m.entity_id GROUP BY 1, 2)
SELECT * FROM g WHERE n >= 3 AND n_wanted > 0""")
def scenes_with_primary_characters(spark, sf_dir):
    return D.scenes_with(_mentions(spark, sf_dir), _entities(spark, sf_dir), "primary")


@query(f"""WITH {PARAS}, s AS (SELECT *, regexp_matches(text, '^\\s*(?:\\*{{3,}}|-{{3,}}|#|)\\s*$') AS sep FROM paras), i AS (SELECT *, sum(CAST(sep AS INT)) OVER (PARTITION BY doc_id ORDER BY para_idx) AS island FROM s),
c AS (SELECT doc_id, max(start_char + length(text)) - min(start_char) AS size, count(*) AS n FROM i WHERE NOT sep GROUP BY doc_id, island)
SELECT doc_id, count(*) AS n_scenes, max(size) AS longest, CAST(sum(n) AS BIGINT) AS n_lines, count(*) > 1 AS has_scenes FROM c GROUP BY 1""")
def scene_stats(spark, sf_dir):
    return D.scene_stats(_docs(spark, sf_dir))


@query("""WITH l AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), e AS (SELECT p_partkey AS id, p_name AS name, p_size AS book FROM part), b AS (SELECT n_nationkey AS id, n_name AS title FROM nation)
SELECT a, l.b, coalesce(x.name, '') AS name_a, coalesce(y.name, '') AS name_b, coalesce(p.title, '') AS title_a, coalesce(q.title, '') AS title_b FROM l LEFT JOIN e x ON x.id = a LEFT JOIN e y ON y.id = l.b LEFT JOIN b p ON p.id = x.book LEFT JOIN b q ON q.id = y.book""")
def entity_links(spark, sf_dir):
    e = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_size").alias("book_id"))
    books = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("book_id"), F.col("n_name").alias("title"))
    return D.entity_links(load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct(), e, books)


@query(f"""WITH {INTERACTIONS}, {ENTITIES} SELECT x.chapter, e.name AS name_a, coalesce(f.name, '') AS name_b, count(*) AS n, round(avg(tone_pct), 6) AS mean_tone FROM x JOIN entities e ON e.entity_id = x.a LEFT JOIN entities f ON f.entity_id = x.b GROUP BY 1, 2, 3""")
def interactions_by_chapter(spark, sf_dir):
    return D.interactions_by_chapter(_interactions(spark, sf_dir), _entities(spark, sf_dir))


@query("SELECT DISTINCT o_custkey AS doc_id, o_orderkey % 12 AS chapter, CAST(floor(o_totalprice) AS BIGINT) % 40 % 4 AS place FROM orders")
def locations_by_chapter(spark, sf_dir):
    return _events(spark, sf_dir).select("doc_id", "chapter", (F.col("number") % 4).alias("place")).distinct()


@query("""WITH e AS (SELECT DISTINCT l_partkey AS entity, l_suppkey % 3 AS book, CASE l_returnflag WHEN 'A' THEN 'injury' WHEN 'R' THEN 'healing' ELSE '' END AS kind, ['', 'arm', 'leg', 'head'][l_linenumber % 4 + 1] AS part FROM lineitem)
SELECT DISTINCT a.entity, a.book AS book_a, a.part AS part_a, b.book AS book_b, b.part AS part_b FROM e a JOIN e b ON a.entity = b.entity AND a.kind = 'injury' AND b.kind = 'healing' AND a.part <> '' AND b.part <> '' AND a.book < b.book AND a.part <> b.part""")
def healed_differently(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "injury").when(F.col("l_returnflag") == "R", "healing").otherwise("")
    part = F.element_at(F.array(*map(F.lit, ("", "arm", "leg", "head"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return D.healed_differently(li.select(F.col("l_partkey").alias("entity"), (F.col("l_suppkey") % 3).alias("book"), kind.alias("kind"), part.alias("part")))


@query(f"""WITH {MENTIONS}, {INTERACTIONS}, g AS (SELECT entity_id, count(*) AS n, count(DISTINCT chapter) AS n_chapters, min(chapter) AS first, max(chapter) AS last FROM mentions GROUP BY 1 HAVING count(*) BETWEEN 3 AND 60 AND count(DISTINCT chapter) >= 2),
q AS (SELECT entity_id, count(DISTINCT o) AS n_partners FROM (SELECT a AS entity_id, b AS o FROM x UNION ALL SELECT b, a FROM x) GROUP BY 1) SELECT * FROM g JOIN q USING (entity_id)""")
def supporting_characters(spark, sf_dir):
    return D.supporting_characters(_mentions(spark, sf_dir), _interactions(spark, sf_dir))


@query("""SELECT user_id AS scope, count(*) AS n, count(*) FILTER (value > 50) AS kept, count(*) FILTER (NOT value > 50) AS dropped, count(*) FILTER (event_type = 'click') AS by_user FROM events GROUP BY 1""")
def rejection_stats(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return D.rejection_stats(e.select(F.col("user_id").alias("scope"), (F.col("value") > 50).alias("keep"), F.when(F.col("event_type") == "click", "user").otherwise("system").alias("decided_by")))


@query("SELECT event_type AS action, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1 UNION ALL SELECT 'all', count(*), max(event_id) FROM events")
def history_stats(spark, sf_dir):
    return D.history_stats(load(spark, sf_dir, "events"))


@query(f"""WITH {INTERACTIONS}, v AS (SELECT a, b, kind, CAST(chapter % 3 AS INT) AS method, (tone + 100) / 200 AS score, (chapter % 3 + 1) / 4 AS weight FROM p),
g AS (SELECT a, b, kind, sum(score * weight) / sum(weight) AS mean, count(DISTINCT method) AS n_methods, arg_max(method, row(score, method)) AS best FROM v GROUP BY 1, 2, 3),
s AS (SELECT a, b, kind, n_methods, best, round(CASE WHEN n_methods >= 2 THEN least(1.0, mean * 1.15::DOUBLE) ELSE mean END + 1e-9::DOUBLE, 6) AS confidence FROM g) SELECT * FROM s WHERE confidence >= 0.3::DOUBLE""")
def relationship_vote(spark, sf_dir):
    x = _interactions(spark, sf_dir)
    v = x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind", (F.col("chapter") % 3).cast("int").alias("method"), ((F.col("tone_pct") + 100) / 200).alias("score"), ((F.col("chapter") % 3 + 1) / 4).alias("weight"))
    return D.relationship_vote(v)


VALUES = "v AS (SELECT l_partkey AS entity, l_linestatus AS key, ' ' || l_returnflag || CAST(l_linenumber % 3 AS VARCHAR) AS value, l_discount AS confidence FROM lineitem)"


def _values(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("entity"), F.col("l_linestatus").alias("key"), F.concat(F.lit(" "), "l_returnflag", (F.col("l_linenumber") % 3).cast("string")).alias("value"), F.col("l_discount").alias("confidence"))


@query(f"WITH {VALUES} SELECT entity, key, lower(trim(value)) AS value, count(*) AS n, max(confidence) AS confidence FROM v GROUP BY 1, 2, 3")
def consolidated_attributes(spark, sf_dir):
    return D.consolidated_attributes(_values(spark, sf_dir))


@query(f"""WITH {VALUES}, c AS (SELECT entity, key, CASE lower(trim(value)) WHEN 'a1' THEN 'a0' WHEN 'n2' THEN 'n0' ELSE lower(trim(value)) END AS value, max(confidence) AS confidence FROM v GROUP BY 1, 2, 3),
g AS (SELECT entity, key, array_to_string(list_sort(list(value)), ',') AS "values", count(*) AS n, list_reverse_sort(list(confidence))[2] AS confidence FROM c GROUP BY 1, 2) SELECT * FROM g WHERE n > 1 AND confidence >= 0.05::DOUBLE""")
def inconsistent_attributes(spark, sf_dir):
    return D.inconsistent_attributes(_values(spark, sf_dir), {"a1": "a0", "n2": "n0"})


@query(f"""WITH {STATES}, c AS (SELECT doc_id, entity_id, CAST(chapter AS BIGINT) AS chapter, CAST(sign(sum(tone)) AS INT) AS tone FROM st GROUP BY 1, 2, 3), l AS (SELECT *, lag(tone) OVER w AS before, lag(chapter) OVER w AS c0 FROM c WINDOW w AS (PARTITION BY doc_id, entity_id ORDER BY chapter))
SELECT doc_id, entity_id, chapter, before, tone FROM l WHERE chapter = c0 + 1 AND tone * before = -1""")
def emotional_evolution(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return D.emotional_evolution(li.select(F.floor(F.col("l_orderkey") / 100).alias("doc_id"), (F.col("l_partkey") % 20).alias("entity_id"), F.col("l_linenumber").cast("long").alias("chapter"), F.when(F.col("l_discount") > 0.05, 1).otherwise(-1).alias("tone")))


@query(f"""WITH {CHAP}, l AS (SELECT doc_id, chapter, trim(unnest(string_split(text, chr(10)))) AS t FROM chap)
SELECT doc_id, chapter, count(*) AS n_lines, count(*) FILTER (regexp_matches(t, '^—[^—]+—|^«[^»]+».*[a-z]|^“[^”]+”.*[a-z]|^"[^"]+".*[a-z]')) AS n_attributed FROM l WHERE regexp_matches(t, '^[—«“"]') GROUP BY 1, 2""")
def dialogue_attributions(spark, sf_dir):
    return D.attributions(_docs(spark, sf_dir))


AMBIGUOUS, FEMALE, MALE = ("trinidad", "guadalupe", "cruz", "andrea"), ("carmen", "isabel", "pilar", "dolores"), ("luca", "borja", "josé", "miguel")


@query(f"""WITH {TOK} SELECT token_lc AS name, CASE WHEN token_lc IN ({QUOTED(AMBIGUOUS)}) THEN 'unknown' WHEN token_lc IN ({QUOTED(FEMALE)}) THEN 'female' WHEN token_lc IN ({QUOTED(MALE)}) THEN 'male' WHEN token_lc LIKE '%a' THEN 'female' WHEN token_lc LIKE '%o' THEN 'male' ELSE 'unknown' END AS gender, count(*) AS n
FROM tok WHERE regexp_matches(token, '^[A-ZÁÉÍÓÚÑ][a-záéíóúüñ]{{2,}}$') GROUP BY 1, 2""")
def gender_of_names(spark, sf_dir):
    return D.gender_of_names(_docs(spark, sf_dir), AMBIGUOUS, FEMALE, MALE)


@query(f"""WITH {INTERACTIONS}, d AS (SELECT a, b, count(*) AS n, avg(tone_pct) AS tone FROM x GROUP BY 1, 2), j AS (SELECT coalesce(t.a, k.b) AS a, coalesce(t.b, k.a) AS b, coalesce(t.n, 0) AS there, coalesce(k.n, 0) AS back, t.tone AS u, k.tone AS v FROM (SELECT * FROM d WHERE a < b) t FULL JOIN (SELECT * FROM d WHERE a > b) k ON t.a = k.b AND t.b = k.a)
SELECT a, b, there, back, round((there - back) / (there + back), 6) AS score, abs((there - back) / (there + back)) > 0.5 OR coalesce(u * v < 0, false) AS alert FROM j""")
def interaction_asymmetry(spark, sf_dir):
    return D.interaction_asymmetry(_interactions(spark, sf_dir))


# Words that mark registers.
REGISTERS = {
    "formal": ("asimismo", "empero", "mediante", "respecto", "conforme", "therefore", "hereby", "moreover", "regarding"), "colloquial": ("vale", "tío", "mola", "guay", "venga", "okay", "yeah", "gonna", "stuff"),
    "technical": ("sistema", "proceso", "método", "análisis", "datos", "system", "process", "method", "data"), "poetic": ("alma", "sueño", "luna", "mar", "silencio", "soul", "dream", "moon", "sea")}
_HITS = lambda v: f"len(list_intersect(ws, [{QUOTED(v)}]))"


@query(f"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{WORD}')) AS ws FROM documents), h AS (SELECT doc_id, len(ws) AS n, {", ".join(f"{_HITS(v)} AS {k}" for k, v in REGISTERS.items())} FROM w WHERE len(ws) > 0),
s AS (SELECT doc_id, {", ".join(f"least(1.0::DOUBLE, CASE WHEN {k} >= 2 THEN {k} ELSE 0 END / greatest(n / 100, 1.0::DOUBLE)) AS {k}" for k in REGISTERS)} FROM h), t AS (SELECT *, greatest(0.1::DOUBLE, 1 - 2 * greatest({", ".join(REGISTERS)})) AS neutral FROM s)
SELECT doc_id, {", ".join(f"round({k} / ({' + '.join(REGISTERS)} + neutral), 6) AS {k}" for k in (*REGISTERS, "neutral"))} FROM t""")
def register_scores(spark, sf_dir):
    return D.register_scores(_docs(spark, sf_dir), REGISTERS)


@query(f"""WITH {MENTIONS}, {ENTITIES}, m AS (SELECT entity_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(chapter)))[1:10], ',') AS chapters FROM mentions GROUP BY 1)
SELECT entity_id, name, coalesce(n, 0) AS n, coalesce(chapters, '') AS chapters, substr(sha256(name || '|' || entity_type), 1, 16) AS digest FROM entities LEFT JOIN m USING (entity_id)""")
def snapshot_of_entities(spark, sf_dir):
    return D.snapshot(_entities(spark, sf_dir), _mentions(spark, sf_dir))


@query("""WITH e AS (SELECT user_id || '/' || event_type AS key, CAST(round(value) AS BIGINT) % 3 AS value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE epoch_us(ts) END AS t, event_id % 3 = 0 AS imp, event_id FROM events),
k AS (SELECT key, imp, arg_max(row(value, t), event_id) AS r FROM e GROUP BY 1, 2), l AS (SELECT key, struct_extract(r, 1) AS was, struct_extract(r, 2) AS tl FROM k WHERE NOT imp), i AS (SELECT key, struct_extract(r, 1) AS now, struct_extract(r, 2) AS ti FROM k WHERE imp),
s AS (SELECT key, was, now, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'only_local' WHEN was = now THEN 'same' WHEN ti IS NOT NULL AND (tl IS NULL OR ti >= tl) THEN 'taken_over' ELSE 'kept' END AS status FROM l FULL JOIN i USING (key))
SELECT key, status, CASE WHEN status IN ('new', 'taken_over') THEN now ELSE was END AS value FROM s""")
def imported_decisions(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    at = F.when(F.col("event_id") % 7 != 0, F.unix_micros(F.col("ts").cast("timestamp")))
    rows = e.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), (F.round("value").cast("long") % 3).alias("value"), at.alias("at"), "event_id")
    last = lambda df: df.groupBy("key").agg(F.max_by(F.struct("value", "at"), "event_id").alias("r")).select("key", "r.value", "r.at")
    return D.imported_decisions(last(rows.filter("event_id % 3 <> 0")), last(rows.filter("event_id % 3 = 0")))


@query(f"""WITH {TOK}, u AS (SELECT token_lc AS word, count(*) AS n_uses FROM tok GROUP BY 1), c AS (SELECT lower(r_name) AS word, 'region ' || r_regionkey AS note FROM region), p AS (SELECT string_split(p_name, ' ')[2] AS word, array_to_string(list_sort(list_distinct(list(string_split(p_name, ' ')[1]))), ',') AS synonyms FROM part GROUP BY 1)
SELECT word, coalesce(n_uses, 0) AS n_uses, coalesce(note, '') AS note, coalesce(synonyms, '') AS synonyms, CAST((note IS NOT NULL)::INT + (synonyms IS NOT NULL)::INT + (n_uses IS NOT NULL)::INT AS INT) AS n_sources FROM u FULL JOIN c USING (word) FULL JOIN p USING (word)""")
def dictionary_lookup(spark, sf_dir):
    custom = load(spark, sf_dir, "region").select(F.lower("r_name").alias("word"), F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("note"))
    pair = F.split("p_name", " ")
    return D.dictionary(_docs(spark, sf_dir), custom, load(spark, sf_dir, "part").select(pair[1].alias("word"), pair[0].alias("synonym")))


@query(f"""WITH {TOK}, w AS (SELECT DISTINCT token_lc AS word, substr(translate(token_lc, 'áéíóúü', 'aeiouu'), 1, 3) AS prefix FROM tok WHERE length(token_lc) >= 3)
SELECT word, prefix, CAST(row_number() OVER (PARTITION BY prefix ORDER BY length(word), word) AS INT) AS rank FROM w QUALIFY rank <= 10""")
def dictionary_prefixes(spark, sf_dir):
    return D.prefix_search(_docs(spark, sf_dir))


@query(f"""WITH {MENTIONS}, c AS (SELECT doc_id, entity_id, count(*) AS n FROM mentions WHERE is_active GROUP BY 1, 2) SELECT doc_id, sha256(string_agg(entity_id || ':' || n, '|' ORDER BY entity_id)) AS signature, count(*) AS n_entities FROM c GROUP BY 1""")
def mention_signatures(spark, sf_dir):
    return D.mention_signatures(_mentions(spark, sf_dir))


@query("""WITH RECURSIVE n AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
r AS (SELECT node, parent AS ancestor, CAST(1 AS BIGINT) AS depth FROM n UNION ALL SELECT r.node, n.parent, depth + 1 FROM r JOIN n ON r.ancestor = n.node WHERE depth < 5) SELECT ancestor AS node, count(*) AS n, max(depth) AS depth FROM r GROUP BY 1""")
def location_descendants(spark, sf_dir):
    link = lambda t, a, k, b, p: load(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(k).cast("string")).alias("node"), F.concat(F.lit(b), F.col(p).cast("string")).alias("parent"))
    return D.descendants(link("customer", "c", "c_custkey", "n", "c_nationkey").unionByName(link("nation", "n", "n_nationkey", "r", "n_regionkey")))


@query(f"""WITH {TOK}, c AS (SELECT doc_id, word_idx, token, regexp_matches(token, '^[A-ZÁÉÍÓÚÑ][a-záéíóúüñ]+$') AS cap FROM tok), t AS (SELECT *, lead(token) OVER w AS nx, lead(cap) OVER w AS nc FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx)),
p AS (SELECT doc_id, word_idx, token || ' ' || nx AS name FROM t WHERE cap AND nc), q AS (SELECT * FROM p WHERE name IN (SELECT name FROM p GROUP BY 1 HAVING count(*) >= 3)),
r AS (SELECT *, word_idx - row_number() OVER (PARTITION BY doc_id ORDER BY word_idx) AS run FROM q), two AS (SELECT doc_id, word_idx, name FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, run ORDER BY word_idx) % 2 = 1),
o AS (SELECT doc_id, word_idx, token AS name FROM t WHERE cap AND length(token) >= 4)
SELECT * FROM two UNION ALL SELECT doc_id, word_idx, name FROM o WHERE name IN (SELECT name FROM o GROUP BY 1 HAVING count(*) >= 3) AND NOT EXISTS (SELECT 1 FROM two WHERE two.doc_id = o.doc_id AND (two.word_idx = o.word_idx OR two.word_idx + 1 = o.word_idx))""")
def found_mentions(spark, sf_dir):
    return D.found_mentions(_docs(spark, sf_dir))


# Spellings of the classical language, in plain text.
CLASSICAL = {"ph_for_f": "[a-z]*ph[aeiou][a-z]*", "ss_for_s": "[a-z]+ss[aeiou][a-z]*", "old_verb": "dixo|fazer|fizo|ansi|desto|della|dello|vuestra +merced", "que_for_cua": "qu[ao][a-z]+"}


@query(P.located_sql(CLASSICAL))
def classical_spellings(spark, sf_dir):
    return P.located(_docs(spark, sf_dir), CLASSICAL)


@query(D.continuity_sql(SENT))
def continuity_signals(spark, sf_dir):
    return D.continuity_signals(_docs(spark, sf_dir))


@query(f"""WITH {ALERTS}, t AS (SELECT alert_id, title, alert_type FROM alerts), k AS (SELECT DISTINCT alert_type AS term FROM t), v AS (SELECT term, [term, upper(term), term || 's'] AS vs FROM k)
SELECT alert_id, min(term) AS term FROM t JOIN v ON list_contains(vs, string_split(title, ' ')[1]) GROUP BY 1""")
def glossary_lookups(spark, sf_dir):
    """The glossary entry whose term or variant a finding's first word is: variants are exploded, so the lookup is an equi-join."""
    a = _alerts(spark, sf_dir)
    terms = a.select(F.col("alert_type").alias("term")).distinct()
    spelled = terms.select("term", F.explode(F.array("term", F.upper("term"), F.concat("term", F.lit("s")))).alias("word"))
    return a.select("alert_id", F.split("title", " ")[0].alias("word")).join(spelled, "word").groupBy("alert_id").agg(F.min("term").alias("term"))


@query(f"""WITH {TOK}, w AS (SELECT doc_id, token_lc AS w, count(*) AS n FROM tok GROUP BY 1, 2), s AS (SELECT doc_id, n, greatest(1, len(regexp_extract_all(w, '[aeiouáéíóúü]+')) + coalesce(list_sum(list_transform(regexp_extract_all(w, '[aeoáéó]{{2,}}'), lambda g: length(g) - 1)), 0)) AS s FROM w)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_words, round(coalesce(sum(n) FILTER (s <= 2), 0) / sum(n), 6) AS simple, round(coalesce(sum(n) FILTER (s >= 4), 0) / sum(n), 6) AS complex, round(count(*) / sum(n), 6) AS diversity FROM s GROUP BY 1""")
def word_difficulty(spark, sf_dir):
    return D.word_difficulty(_docs(spark, sf_dir))


@query("""WITH s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, s - least(0, min(s) OVER w) AS h FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT *, min(h) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM m),
r AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n_actions FROM k WHERE event_type <> 'error' AND low >= h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, n_actions, event_id, event_type, value FROM r""")
def state_after_undo(spark, sf_dir):
    return D.after_undo(load(spark, sf_dir, "events"), "error")


@query(f"""WITH {TOK}, t AS (SELECT doc_id, trim(translate(lower(token), 'áéíóúüñ', 'aeiouun')) AS norm, token, count(*) AS n FROM tok WHERE regexp_matches(token, '^[A-ZÁÉÍÓÚÑ]') AND length(token) >= 3 GROUP BY 1, 2, 3)
SELECT doc_id, norm, count(*) AS forms, CAST(sum(n) AS BIGINT) AS n, arg_min(token, row(-n, token)) AS canonical FROM t GROUP BY 1, 2 HAVING count(*) > 1""")
def spelling_variants(spark, sf_dir):
    return D.equal_spellings(_docs(spark, sf_dir))
