"""Style queries over `documents`."""

from fabula.functions import lexicons as L
from fabula.operators import style
from fabula.plans.catalog import query
from fabula.sources.tables import load

WORD = "[a-záéíóúüñA-ZÁÉÍÓÚÜÑ]+"
SPEECH = '—[^—\\n]+|«[^»\\n]+»|“[^”\\n]+”|"[^"\\n]+"'
QUOTED = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)

TOK = f"""tok AS (SELECT doc_id, unnest(ws) AS token, lower(unnest(ws)) AS token_lc, unnest(range(len(ws))) AS word_idx
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents))"""
def sentences_sql(text):
    """The sentences of an expression as a list: ends are marked with chr(1), then the text is split there."""
    marked = f"regexp_replace(replace({text}, chr(1), ' '), '([.!?]+(?:\\s|$|[\"'')»]))', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s, i: s <> '' AND (length(s) >= 10 OR i <= length({marked}) - length(replace({marked}, chr(1), ''))))"


SENT = f"sent AS (SELECT doc_id, unnest(ss) AS text, unnest(range(len(ss))) AS sent_idx FROM (SELECT doc_id, {sentences_sql("coalesce(text, '')")} AS ss FROM documents))"
PARA = """para AS (SELECT doc_id, unnest(ls) AS text, unnest(range(len(ls))) AS para_idx
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"""
CHAP = """chap AS (SELECT doc_id, c AS chapter, array_to_string(ls[(c - 1) * 5 + 1:c * 5], chr(10)) AS text
  FROM (SELECT doc_id, ls, unnest(range(1, CAST(ceil(len(ls) / 5.0) AS BIGINT) + 1)) AS c FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))"""
WS = f"regexp_extract_all(lower(text), '{WORD}')"


def _n(words, ws="ws"):
    return f"CAST(len(list_filter({ws}, lambda w: w IN ({QUOTED(words)}))) AS BIGINT)"


METRICS = f"""m AS (SELECT doc_id, chapter, CAST(len(regexp_extract_all(text, '{WORD}')) AS BIGINT) AS n_words,
  CAST(greatest(1, len({sentences_sql("text")})) AS BIGINT) AS n_sentences,
  CAST(len(list_filter(string_split(text, chr(10)), lambda s: length(trim(s)) > 0)) AS BIGINT) AS n_paragraphs,
  CAST(length(text) - length(regexp_replace(text, '{SPEECH}', '', 'g')) AS BIGINT) AS dialogue_chars, CAST(length(text) AS BIGINT) AS chars,
  CAST(len(regexp_extract_all(text, '[!¡]')) AS BIGINT) AS exclamations, CAST(len(regexp_extract_all(text, '[?¿]')) AS BIGINT) AS questions,
  CAST(len(list_filter({WS}, lambda w: regexp_matches(w, '({"|".join(L.ACTION)})$'))) AS BIGINT) AS n_action FROM chap)"""


def _norm(c):
    return f"CASE WHEN max({c}) OVER d = min({c}) OVER d THEN 0.5 ELSE ({c} - min({c}) OVER d) / (max({c}) OVER d - min({c}) OVER d) END"


CURVE = f"""s AS (SELECT *, n_action / n_words AS action, n_words / n_sentences AS sentence, dialogue_chars / chars AS dialogue, exclamations * 100 / n_words AS exclaim,
  questions * 100 / n_words AS ask, n_words / greatest(n_paragraphs, 1) AS paragraph FROM m WHERE n_words > 0),
curve AS (SELECT doc_id, chapter, n_words, CAST(sum(n_words) OVER (PARTITION BY doc_id ORDER BY chapter) AS BIGINT) AS position,
  round(CAST(0.25 AS DOUBLE) * ({_norm("action")}) + CAST(0.20 AS DOUBLE) * (1 - ({_norm("sentence")})) + CAST(0.10 AS DOUBLE) * ({_norm("dialogue")}) + CAST(0.15 AS DOUBLE) * ({_norm("exclaim")})
  + CAST(0.15 AS DOUBLE) * ({_norm("ask")}) + CAST(0.15 AS DOUBLE) * (1 - ({_norm("paragraph")})), 6) AS tension FROM s WINDOW d AS (PARTITION BY doc_id))"""


@query(f"""
WITH w AS (SELECT doc_id, unnest(ws) AS token, unnest(range(len(ws))) AS word_idx
  FROM (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '{SPEECH}', ' ', 'g'), '{WORD}') AS ws FROM documents)),
g AS (SELECT doc_id, lower(token) AS word, word_idx - lag(word_idx) OVER (PARTITION BY doc_id, lower(token) ORDER BY word_idx) AS gap
  FROM w WHERE length(token) >= 3 AND lower(token) NOT IN ({QUOTED(L.STOP_WORDS)})),
a AS (SELECT doc_id, word, count(*) AS n, min(gap) AS min_gap, max(gap) AS max_gap, avg(gap) AS avg_gap FROM g GROUP BY 1, 2)
SELECT *, CASE WHEN min_gap < 10 THEN 'high' WHEN min_gap < 30 THEN 'medium' ELSE 'low' END AS severity, CAST(CASE WHEN min_gap < 20 THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence
FROM a WHERE min_gap <= 50""")
def lexical_repetition(spark, sf_dir):
    return style.lexical_repetition(load(spark, sf_dir, "documents"))


@query(f"""WITH {SENT}, s AS (SELECT doc_id, sent_idx, ws[1] || ' ' || ws[2] AS start FROM (SELECT doc_id, sent_idx, {WS} AS ws FROM sent) WHERE len(ws) >= 2)
SELECT doc_id, sent_idx, start FROM (SELECT *, lag(start) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS b FROM s) WHERE start = b""")
def repeated_sentence_starts(spark, sf_dir):
    return style.repeated_sentence_starts(load(spark, sf_dir, "documents"))


SYL = """CASE WHEN length(regexp_replace(lower(w), '[^a-záéíóúüñ]', '', 'g')) = 0 THEN 0 ELSE greatest(1,
  len(regexp_extract_all(regexp_replace(lower(w), '[^a-záéíóúüñ]', '', 'g'), '[aeiouáéíóúü]+'))
  + list_sum(list_transform(regexp_extract_all(regexp_replace(lower(w), '[^a-záéíóúüñ]', '', 'g'), '[aeoáéó]{2,}'), lambda g: length(g) - 1))) END"""


@query(f"""
WITH b AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, len({sentences_sql("coalesce(text, '')")}) AS ns FROM documents),
y AS (SELECT doc_id, sum(len(regexp_extract_all(lower(w), '[aeiouáéíóúü]+'))) AS g0, CAST(sum(greatest(1, len(regexp_extract_all(lower(w), '[aeiouáéíóúü]+'))
  + coalesce(list_sum(list_transform(regexp_extract_all(lower(w), '[aeoáéó]{{2,}}'), lambda g: length(g) - 1)), 0))) AS BIGINT) AS n_syllables
  FROM (SELECT doc_id, unnest(ws) AS w FROM b) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(greatest(1, ns) AS BIGINT) AS n_sentences, n_syllables FROM b JOIN y USING (doc_id))
SELECT *, round(greatest(0.0, least(100.0, CAST(206.84 AS DOUBLE) - CAST(62.3 AS DOUBLE) * (n_syllables / n_words) - CAST(1.02 AS DOUBLE) * (n_words / n_sentences))), 6) AS szigriszt,
  round(greatest(0.0, least(100.0, CAST(206.84 AS DOUBLE) - CAST(0.60 AS DOUBLE) * (100 * (n_syllables / n_words)) - CAST(1.02 AS DOUBLE) * (n_words / n_sentences))), 6) AS fernandez_huerta FROM c""")
def readability(spark, sf_dir):
    return style.readability(load(spark, sf_dir, "documents"))


@query(f"""WITH {SENT}, n AS (SELECT doc_id, len(regexp_extract_all(text, '{WORD}')) AS n FROM sent)
SELECT doc_id, CASE WHEN n < 10 THEN 'short' WHEN n <= 20 THEN 'medium' WHEN n <= 35 THEN 'long' ELSE 'very_long' END AS bucket, count(*) AS n FROM n GROUP BY 1, 2""")
def sentence_length_buckets(spark, sf_dir):
    return style.sentence_length_buckets(load(spark, sf_dir, "documents"))


@query(f"""WITH {SENT}, g AS (SELECT doc_id, sent_idx, CAST(len(ws) AS BIGINT) AS n_words, {_n(L.GLUE_WORDS)} AS n_glue FROM (SELECT doc_id, sent_idx, {WS} AS ws FROM sent) WHERE len(ws) >= 5)
SELECT * FROM g WHERE n_glue >= CAST(0.4 AS DOUBLE) * n_words""")
def sticky_sentences(spark, sf_dir):
    return style.sticky_sentences(load(spark, sf_dir, "documents"))


@query(f"""
WITH t AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_words,
  -- phrases are read with the mark before them; a doubled separator lets neighbours each have their own
  regexp_extract_all(regexp_replace(' ' || lower(coalesce(text, '')) || ' ', '([^a-záéíóúüñA-ZÁÉÍÓÚÜÑ])', '\\1\\1', 'g'),
    '[^a-záéíóúüñA-ZÁÉÍÓÚÜÑ](' || '{"|".join(f.replace(" ", "  ") for f in sorted(L.FILLERS, key=lambda f: (-len(f), f)))}' || ')[^a-záéíóúüñA-ZÁÉÍÓÚÜÑ]', 1) AS f FROM documents)
SELECT doc_id, replace(f, '  ', ' ') AS filler, n_words, count(*) AS n, round(count(*) * 1000 / n_words, 6) AS per_1000 FROM (SELECT doc_id, n_words, unnest(f) AS f FROM t) GROUP BY doc_id, f, n_words""")
def filler_words(spark, sf_dir):
    return style.filler_words(load(spark, sf_dir, "documents"))


@query(f"""SELECT doc_id, d AS dialogue_chars, c AS chars, CASE WHEN c = 0 THEN 0.0::DOUBLE ELSE d / c END AS density
FROM (SELECT doc_id, CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '{SPEECH}', '', 'g')) AS BIGINT) AS d, CAST(length(coalesce(text, '')) AS BIGINT) AS c FROM documents)""")
def dialogue_density(spark, sf_dir):
    return style.dialogue_density(load(spark, sf_dir, "documents"))


_SENSE = lambda ks: f"CAST(len(list_filter(ws, lambda w: regexp_matches(w, '^({'|'.join(ks)})[a-záéíóúüñA-ZÁÉÍÓÚÜÑ]{{0,3}}$'))) AS BIGINT)"


@query(f"""
WITH c AS (SELECT doc_id, len(ws) AS n, {", ".join(f"{_SENSE(k)} AS {s}" for s, k in L.SENSES.items())} FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS ws FROM documents) WHERE len(ws) > 0),
t AS (SELECT *, {" + ".join(L.SENSES)} AS total FROM c)
SELECT doc_id, {", ".join(L.SENSES)}, round(total * 1000 / n, 6) AS per_1000,
  round(CASE WHEN total = 0 THEN 0.0 ELSE greatest(0.0, 1 - sqrt(({" + ".join(f"power({s} - total / 5, 2)" for s in L.SENSES)}) / 5) / (total / 5) / 2) END, 6) AS balance FROM t""")
def sensory_report(spark, sf_dir):
    return style.sensory_report(load(spark, sf_dir, "documents"))


@query(f"""
WITH {PARA}, c AS (SELECT doc_id, para_idx, {_n(L.FIRST_PERSON)} AS first, {_n(L.SECOND_PERSON)} AS second, {_n(L.THIRD_PERSON)} AS third
  FROM (SELECT doc_id, para_idx, {WS} AS ws FROM para WHERE NOT regexp_matches(text, '^\\s*[—«“"-]'))),
p AS (SELECT *, CASE WHEN first >= greatest(second, third) THEN 'first' WHEN second >= third THEN 'second' ELSE 'third' END AS person FROM c WHERE greatest(first, second, third) >= 2)
SELECT *, coalesce(lag(person) OVER (PARTITION BY doc_id ORDER BY para_idx) <> person, false) AS shift FROM p""")
def point_of_view(spark, sf_dir):
    return style.point_of_view(load(spark, sf_dir, "documents"))


@query(f"WITH {CHAP}, {METRICS} SELECT * FROM m")
def chapter_metrics(spark, sf_dir):
    return style.chapter_metrics(load(spark, sf_dir, "documents"))


@query(f"WITH {CHAP}, {METRICS}, {CURVE} SELECT * FROM curve")
def tension_curve(spark, sf_dir):
    return style.tension_curve(load(spark, sf_dir, "documents"))


@query(f"""
WITH {CHAP}, {METRICS}, {CURVE},
i AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY doc_id) AS n, lag(tension) OVER w AS b, lead(tension) OVER w AS f FROM curve WINDOW w AS (PARTITION BY doc_id ORDER BY chapter)),
g AS (SELECT doc_id, any_value(n) AS n, max(tension) - min(tension) AS r, count(*) FILTER ((tension > b AND tension > f) OR (tension < b AND tension < f)) AS t,
  avg(tension) FILTER (i <= n // 3) AS a, avg(tension) FILTER (i > n // 3 AND i <= 2 * (n // 3)) AS m, avg(tension) FILTER (i > 2 * (n // 3)) AS c FROM i GROUP BY doc_id)
SELECT doc_id, n AS n_chapters, t AS n_turns, CASE WHEN n < 3 OR r < CAST(0.15 AS DOUBLE) THEN 'flat' WHEN n >= 6 AND t >= n // 3 THEN 'wave'
  WHEN m > a + CAST(0.08 AS DOUBLE) AND m > c + CAST(0.08 AS DOUBLE) THEN 'mountain' WHEN m < a - CAST(0.08 AS DOUBLE) AND m < c - CAST(0.08 AS DOUBLE) THEN 'valley' WHEN c > a THEN 'rising' ELSE 'falling' END AS arc FROM g""")
def tension_arc(spark, sf_dir):
    return style.tension_arc(style.tension_curve(load(spark, sf_dir, "documents")))


@query(f"""
WITH {CHAP}, {METRICS}, w AS (SELECT doc_id, chapter, n_words, sum(n_words) OVER d AS t, count(*) OVER d AS n FROM m WINDOW d AS (PARTITION BY doc_id)),
r AS (SELECT doc_id, chapter, n_words, CAST(n_words * n AS DOUBLE) / CAST(t AS DOUBLE) AS r FROM w WHERE n > 1 AND t > 0)
SELECT doc_id, chapter, n_words, round(r, 6) AS ratio, CASE WHEN r > 1.5 THEN 'too_long' ELSE 'too_short' END AS issue FROM r WHERE r > 1.5 OR r < 1 / 1.5""")
def chapter_balance(spark, sf_dir):
    return style.chapter_balance(load(spark, sf_dir, "documents"))


@query(f"""
WITH {PARA}, p AS (SELECT *, sum(CAST(regexp_matches(text, '{SPEECH}') AS INT)) OVER (PARTITION BY doc_id ORDER BY para_idx) AS island, regexp_matches(text, '{SPEECH}') AS speech FROM para WHERE length(trim(text)) > 0)
SELECT doc_id, min(para_idx) AS first_para, count(*) AS n_paragraphs, CAST(sum(len(regexp_extract_all(text, '{WORD}'))) AS BIGINT) AS n_words FROM p WHERE NOT speech GROUP BY doc_id, island HAVING sum(len(regexp_extract_all(text, '{WORD}'))) > 150""")
def dense_blocks(spark, sf_dir):
    return style.dense_blocks(load(spark, sf_dir, "documents"))


@query(f"""
WITH {TOK}, n AS (SELECT doc_id, count(*) AS t FROM tok GROUP BY doc_id HAVING count(*) >= 100),
c AS (SELECT doc_id, token_lc AS word, count(*) AS n FROM tok WHERE token_lc NOT IN ({QUOTED(L.STOP_WORDS)}) GROUP BY 1, 2 HAVING count(*) >= 3),
z AS (SELECT doc_id, word, n, (CAST(n * 10000 AS DOUBLE) / t - 5.0::DOUBLE) / 2.5::DOUBLE AS z FROM c JOIN n USING (doc_id))
SELECT doc_id, word, n, round(z, 6) AS z FROM z WHERE z >= 2""")
def crutch_words(spark, sf_dir):
    return style.crutch_words(load(spark, sf_dir, "documents"))


_RX = lambda p: f"CAST(len(regexp_extract_all(t, '{p}')) AS BIGINT)"


@query(f"""
SELECT doc_id, {_RX("[.]{4,}")} AS long_ellipsis, {_RX("[^.][.][.](?:[^.]|$)")} AS short_ellipsis, {_RX("  +")} AS multiple_spaces, {_RX(" [,.;:!?]")} AS space_before_mark, {_RX("[,;:][A-Za-z]")} AS no_space_after_mark,
  {_RX("[!?]{3,}|,,+")} AS sequences, (length(t) - length(replace(t, '"', ''))) % 2 = 1 AS odd_quotes, length(replace(t, '(', '')) <> length(replace(t, ')', '')) AS unclosed_brackets
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def typography(spark, sf_dir):
    return style.typography(load(spark, sf_dir, "documents"))


@query(f"""WITH {SENT}, c AS (SELECT doc_id, sent_idx, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(text) - length(replace(text, ',', '')) AS BIGINT) AS n_commas,
  {_n(["que", "porque", "cuando", "aunque", "that", "which", "dass", "wenn"])} AS n_subordinate FROM (SELECT *, {WS} AS ws FROM sent))
SELECT * FROM c WHERE n_words > 40""")
def clarity(spark, sf_dir):
    return style.clarity(load(spark, sf_dir, "documents"))


@query("""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, unnest(regexp_extract_all(coalesce(text, ''), '[A-ZÁÉÍÓÚÑÄÖÜ]{2,6}')) AS acronym FROM documents)
SELECT doc_id, acronym, count(*) AS n, bool_or(contains(t, '(' || acronym || ')')) AS defined FROM a GROUP BY 1, 2""")
def acronyms(spark, sf_dir):
    return style.acronyms(load(spark, sf_dir, "documents"))


@query(f"""
WITH {TOK}, l AS (SELECT * FROM (VALUES {", ".join(f"('{w}', '{r}')" for w, r in L.REGIONAL.items())}) v(token_lc, region)),
h AS (SELECT doc_id, region, token_lc, count(*) AS n FROM tok JOIN l USING (token_lc) GROUP BY 1, 2, 3),
r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, region) AS ir FROM h),
d AS (SELECT *, first_value(region) OVER (PARTITION BY doc_id ORDER BY ir DESC, region) AS dominant FROM r)
SELECT doc_id, region, token_lc AS word, n, dominant FROM d WHERE region <> dominant""")
def regional_terms(spark, sf_dir):
    return style.regional_terms(load(spark, sf_dir, "documents"))


@query(f"""
WITH {PARA}, w AS (SELECT doc_id, para_idx, list_distinct(list_filter({WS}, lambda w: length(w) >= 3 AND w NOT IN ({QUOTED(L.STOP_WORDS)}))) AS ws FROM para WHERE length(trim(text)) > 0),
p AS (SELECT *, lag(ws) OVER (PARTITION BY doc_id ORDER BY para_idx) AS b FROM w),
j AS (SELECT doc_id, para_idx, len(list_intersect(ws, b)) AS k, len(list_distinct(list_concat(ws, b))) AS u FROM p WHERE b IS NOT NULL)
SELECT doc_id, para_idx, round(k / u, 6) AS similarity FROM j WHERE u > 0 AND round(k / u, 6) >= CAST(0.6 AS DOUBLE)""")
def neighbour_paragraph_overlap(spark, sf_dir):
    return style.neighbour_paragraph_overlap(load(spark, sf_dir, "documents"))


@query("""WITH g AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[a-záéíóúüñ,;] ([A-ZÁÉÍÓÚÑ][a-záéíóúüñ]{2,})', 1)) AS term FROM documents)
SELECT doc_id, term, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 50""")
def glossary_candidates(spark, sf_dir):
    return style.glossary_candidates(load(spark, sf_dir, "documents"))


@query(f"""
WITH {PARA}, c AS (SELECT doc_id, para_idx, len(ws) AS n, len(list_filter(ws, lambda w: length(w) >= 9)) AS k FROM (SELECT doc_id, para_idx, regexp_extract_all(text, '{WORD}') AS ws FROM para WHERE NOT regexp_matches(text, '{SPEECH}')) WHERE len(ws) >= 5),
r AS (SELECT doc_id, para_idx, CASE WHEN k * 10 >= n * 3 THEN 'formal' WHEN k * 10 >= n THEN 'neutral' ELSE 'colloquial' END AS register FROM c)
SELECT doc_id, para_idx, before, register FROM (SELECT *, lag(register) OVER (PARTITION BY doc_id ORDER BY para_idx) AS before FROM r) WHERE before <> register""")
def register_changes(spark, sf_dir):
    return style.register_changes(load(spark, sf_dir, "documents"))


@query(f"""
WITH {TOK}, p AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in L.CONFUSED)}) v(word, other))
SELECT a.doc_id, a.word_idx, count(*) AS n_near, p.word, p.other FROM p JOIN tok a ON a.token_lc = p.word JOIN tok b ON b.token_lc = p.other AND b.doc_id = a.doc_id AND abs(a.word_idx - b.word_idx) <= 15 GROUP BY 1, 2, 4, 5""")
def confused_words(spark, sf_dir):
    return style.confused_words(load(spark, sf_dir, "documents"))


_TYPES = {"first_person": L.FIRST_PERSON, "second_person": L.SECOND_PERSON, "third_person": L.THIRD_PERSON, "glue": tuple(L.STOP_WORDS[:10])}


@query(f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS ws FROM documents),
s AS ({" UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, {_n(v)} AS score FROM w" for k, v in _TYPES.items())}),
g AS (SELECT doc_id, sum(score) AS total, max(score) AS top FROM s GROUP BY doc_id),
b AS (SELECT s.doc_id, max(s.type) AS type FROM s JOIN g ON s.doc_id = g.doc_id AND s.score = g.top GROUP BY s.doc_id)
SELECT doc_id, CASE WHEN total > 0 AND top / CAST(total AS DOUBLE) >= 0.25 AND top >= 3 THEN type ELSE 'unknown' END AS type, round(CASE WHEN total > 0 THEN top / CAST(total AS DOUBLE) ELSE 0.0 END, 6) AS confidence FROM g JOIN b USING (doc_id)""")
def classify_documents(spark, sf_dir):
    return style.classify_documents(load(spark, sf_dir, "documents"), _TYPES)


@query("""
WITH m AS (SELECT doc_id, t, unnest(['angular', 'curly', 'dash', 'straight']) AS mark, unnest(['«', '“', '—', '"']) AS c FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
n AS (SELECT doc_id, mark, CAST(length(t) - length(replace(t, c, '')) AS BIGINT) AS n FROM m)
SELECT doc_id, mark, n FROM n WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, mark) = 1""")
def quote_style(spark, sf_dir):
    return style.quote_style(load(spark, sf_dir, "documents"))
