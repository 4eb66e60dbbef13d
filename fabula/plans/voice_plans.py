"""Voice queries over `conversations`."""

from pyspark.sql import functions as F

from fabula.functions import lexicons as L
from fabula.operators import voice
from fabula.plans.catalog import query
from fabula.plans.style_plans import QUOTED, WORD
from fabula.sources.tables import load

LINES = f"lines AS (SELECT conv_id, turn, role, text, regexp_extract_all(lower(text), '{WORD}') AS ws FROM conversations)"
WORDS = "w AS (SELECT conv_id, role, unnest(ws) AS word FROM lines)"


def _sum(words):
    return " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words)


TONE = f"""tone AS (SELECT conv_id, turn, role, p AS n_positive, n AS n_negative, CASE WHEN p + n = 0 THEN 0.0::DOUBLE ELSE (p - n) / (p + n) END AS tone
  FROM (SELECT *, CAST({_sum(L.POSITIVE)} AS BIGINT) AS p, CAST({_sum(L.NEGATIVE)} AS BIGINT) AS n FROM (SELECT conv_id, turn, role, lower(coalesce(text, '')) AS t FROM conversations)))"""


@query(f"""
WITH {LINES}, {WORDS}, s AS (SELECT role, count(*) AS n_lines, CAST(sum(len(ws)) AS BIGINT) AS n_words, round(avg(len(ws)), 6) AS mean_words, round(coalesce(stddev_samp(len(ws)), 0), 6) AS std_words,
  CAST(min(len(ws)) AS BIGINT) AS min_words, CAST(max(len(ws)) AS BIGINT) AS max_words FROM lines GROUP BY role),
o AS (SELECT role, count(*) AS n_distinct, count(*) FILTER (c = 1) AS n_once FROM (SELECT role, word, count(*) AS c FROM w GROUP BY 1, 2) GROUP BY role)
SELECT s.*, coalesce(n_distinct, 0) AS n_distinct, coalesce(n_once, 0) AS n_once, CASE WHEN n_words > 0 THEN round(coalesce(n_distinct, 0) / n_words, 6) ELSE 0.0 END AS type_token_ratio FROM s LEFT JOIN o USING (role)""")
def voice_profiles(spark, sf_dir):
    return voice.profiles(load(spark, sf_dir, "conversations"))


@query(f"""
WITH {LINES}, {WORDS}, c AS (SELECT role, word, count(*) AS n FROM w GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY role) AS of_role, sum(n) OVER (PARTITION BY word) AS of_word, sum(n) OVER () AS total FROM c),
s AS (SELECT role, word, n, round((CAST(n AS DOUBLE) / CAST(of_role AS DOUBLE)) * (1 / (CAST(of_word AS DOUBLE) / CAST(total AS DOUBLE) + 0.001::DOUBLE)), 6) AS score FROM t)
SELECT role, word, n, score, CAST(row_number() OVER (PARTITION BY role ORDER BY score DESC, word) AS INT) AS rank FROM s WHERE score > 1 AND n >= 2 QUALIFY rank <= 20""")
def characteristic_words(spark, sf_dir):
    return voice.characteristic_words(load(spark, sf_dir, "conversations"))


@query(f"""
WITH {LINES}, p AS (SELECT role, 'start' AS kind, ws[1] || ' ' || ws[2] AS pattern FROM lines WHERE len(ws) >= 2
  UNION ALL SELECT role, 'pair', unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM lines WHERE len(ws) >= 2),
c AS (SELECT role, kind, pattern, count(*) AS n FROM p GROUP BY 1, 2, 3)
SELECT *, CAST(row_number() OVER (PARTITION BY role, kind ORDER BY n DESC, pattern) AS INT) AS rank FROM c QUALIFY rank <= 5""")
def speech_patterns(spark, sf_dir):
    return voice.speech_patterns(load(spark, sf_dir, "conversations"))


@query(f"""
WITH {LINES}, s AS (SELECT conv_id, turn, role, CAST(len(ws) AS BIGINT) AS n_words, avg(len(ws)) OVER (PARTITION BY role) AS m, coalesce(stddev_samp(len(ws)) OVER (PARTITION BY role), 0) AS sd FROM lines),
z AS (SELECT conv_id, turn, role, n_words, round(abs(n_words - m) / greatest(sd, 1.0), 6) AS z FROM s)
SELECT *, CASE WHEN z > 4 THEN 'high' WHEN z > 3 THEN 'medium' ELSE 'low' END AS severity FROM z WHERE z > 2""")
def voice_deviations(spark, sf_dir):
    return voice.deviations(load(spark, sf_dir, "conversations"))


@query(f"WITH {TONE} SELECT * FROM tone")
def dialogue_tone(spark, sf_dir):
    return voice.tone(load(spark, sf_dir, "conversations"))


@query(f"""WITH {TONE}, b AS (SELECT *, lag(tone) OVER (PARTITION BY conv_id, role ORDER BY turn) AS b FROM tone)
SELECT conv_id, turn, role, round(b, 6) AS before, round(tone, 6) AS tone FROM b WHERE abs(tone - b) > 0.5""")
def tone_shifts(spark, sf_dir):
    return voice.tone_shifts(load(spark, sf_dir, "conversations"))


@query("""WITH b AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
g AS (SELECT conv_id, count(*) AS n_turns, count(*) FILTER (b <> role) AS n_changes, count(DISTINCT role) AS n_speakers FROM b GROUP BY conv_id)
SELECT *, n_changes = n_turns - 1 AND n_speakers = 2 AS alternates FROM g""")
def speaker_alternation(spark, sf_dir):
    return voice.alternation(load(spark, sf_dir, "conversations"))


WINDOWS = f"""{LINES}, i AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, len(ws) AS n FROM lines),
s AS (SELECT conv_id, unnest(range(CAST(greatest(0, ceil((i - 2) / 2.0)) AS BIGINT), i // 2 + 1)) AS win, n FROM i),
g AS (SELECT conv_id, win AS "window", count(*) AS n_turns, CAST(sum(n) AS BIGINT) AS n_words FROM s GROUP BY 1, 2 HAVING sum(n) >= 20)"""


@query(f"WITH {WINDOWS} SELECT * FROM g")
def speech_windows(spark, sf_dir):
    return voice.speech_windows(load(spark, sf_dir, "conversations"))


@query(f"""WITH {WINDOWS}, b AS (SELECT *, n_words / n_turns AS v, lag(n_words / n_turns) OVER o AS b, lag(n_turns) OVER o AS nb FROM g WINDOW o AS (PARTITION BY conv_id ORDER BY "window")),
z AS (SELECT conv_id, "window", abs(v - b) / (greatest(0.1::DOUBLE, (v + b) / 20) * sqrt(1 / n_turns + 1 / nb)) AS z, abs(v - b) / b AS change FROM b WHERE b > 0)
SELECT conv_id, "window", round(z, 6) AS z, round(change, 6) AS change FROM z WHERE z > 1.96 AND change > 0.5""")
def speech_changes(spark, sf_dir):
    return voice.window_changes(load(spark, sf_dir, "conversations"))


NAMES = ("the", "than", "ness", "ther", "ano")


@query(f"""WITH {LINES}, {WORDS} SELECT role, word AS name, count(*) AS n, count(DISTINCT conv_id) AS n_conversations FROM w WHERE word IN ({QUOTED(NAMES)}) GROUP BY 1, 2""")
def mentions_in_speech(spark, sf_dir):
    names = F.broadcast(spark.createDataFrame([(n,) for n in NAMES], "name_lc string"))
    return voice.mentions_in_speech(load(spark, sf_dir, "conversations"), names)
