"""Temporal queries over `documents` and the timelines in `orders`."""

from fabula.functions import lexicons as L
from fabula.operators import temporal as P
from fabula.plans.catalog import query
from fabula.plans.story_plans import EVENTS, ORDER, _events
from fabula.plans.style_plans import TOK
from fabula.sources.tables import load


def _docs(spark, d):
    return load(spark, d, "documents")


@query(f"SELECT doc_id, kind, count(*) AS n FROM ({P.located_sql(P.KINDS)}) GROUP BY 1, 2")
def temporal_marker_counts(spark, sf_dir):
    return P.marker_counts(_docs(spark, sf_dir))


@query(P.markers_sql())
def temporal_markers(spark, sf_dir):
    return P.markers(_docs(spark, sf_dir))


@query(P.located_sql(P.ORDER_SIGNALS))
def non_linear_signals(spark, sf_dir):
    return P.located(_docs(spark, sf_dir), P.ORDER_SIGNALS)


@query(P.chapter_orders_sql())
def chapter_orders(spark, sf_dir):
    return P.chapter_orders(_docs(spark, sf_dir))


# Turns of phrase of events, in plain text.
SIGNALS = {
    "dream": "son(?:o|aba)|en +suenos|pesadillas?|desperto +sobresaltad[oa]", "death": "murio|fallecio|habia +muerto|(?:fue|lo|la) +(?:asesinad[oa]|mataron)|perdio +la +vida",
    "time_skip": "(?:dias|semanas|meses|anos) +(?:despues|mas +tarde)|al +(?:dia|ano|mes) +siguiente", "memory": "record(?:o|aba|ando)|evoc(?:o|aba|ando)|(?:anos|tiempo) +atras",
    "declared_emotion": "(?:estaba|parecia|se +(?:sentia|sintio)) +(?:feliz|triste|furios[oa]|asustad[oa]|cansad[oa]|content[oa]|nervios[oa])"}


@query(P.located_sql(SIGNALS))
def event_signals(spark, sf_dir):
    return P.located(_docs(spark, sf_dir), SIGNALS)


@query(f"""WITH {TOK}, t AS (SELECT * FROM (VALUES {", ".join(f"('{w}', {y})" for w, y in L.EARLIEST_YEAR.items())}) v(token_lc, earliest)), y AS (SELECT doc_id, CAST(unnest(regexp_extract_all(coalesce(text, ''), '\\b(\\d{{4}})\\b', 1)) AS BIGINT) AS y FROM documents),
p AS (SELECT doc_id, max(y) AS l FROM y WHERE y BETWEEN 1000 AND 2029 GROUP BY 1), u AS (SELECT doc_id, token_lc AS word, earliest - l AS gap, count(*) AS n FROM tok JOIN t USING (token_lc) JOIN p USING (doc_id) WHERE earliest > l GROUP BY 1, 2, 3)
SELECT doc_id, word, n, gap, CAST(CASE WHEN gap > 200 THEN 0.95 WHEN gap > 50 THEN 0.85 ELSE 0.7 END AS DOUBLE) AS confidence FROM u""")
def anachronisms(spark, sf_dir):
    return P.anachronisms(_docs(spark, sf_dir))


@query(f"""WITH {EVENTS}, e AS (SELECT doc_id, event_id, number AS age, lag(number) OVER {ORDER} AS age0, CASE WHEN is_dated THEN story_date END AS d, lag(CASE WHEN is_dated THEN story_date END) OVER {ORDER} AS d0 FROM ev),
k AS (SELECT *, abs((age - age0) - (d - d0) / 365.25::DOUBLE) AS off FROM e WHERE age0 IS NOT NULL)
SELECT doc_id, event_id, age, age0, CASE WHEN off > 1.5 THEN 'pace' ELSE 'falls' END AS kind FROM k WHERE off > 1.5 OR (off IS NULL AND age < age0)""")
def inconsistent_ages(spark, sf_dir):
    return P.inconsistent_ages(_events(spark, sf_dir))


@query(f"""WITH {EVENTS}, c AS (SELECT doc_id, chapter, min(story_date) AS told FROM ev WHERE is_dated GROUP BY 1, 2)
SELECT doc_id, chapter, CAST(told AS VARCHAR) AS date, CAST(coalesce((told - lag(told) OVER (PARTITION BY doc_id ORDER BY chapter)) * 24, 0) AS BIGINT) AS gap_hours FROM c""")
def chapter_times(spark, sf_dir):
    return P.chapter_times(_events(spark, sf_dir))


@query(f"""WITH {EVENTS}, d AS (SELECT doc_id, min(story_date) AS death FROM ev WHERE number = 0 AND is_dated GROUP BY 1), t AS (SELECT doc_id, chapter, min(CASE WHEN is_dated THEN story_date END) AS told FROM ev GROUP BY 1, 2)
SELECT doc_id, chapter, coalesce(death >= told, true) AS alive FROM t LEFT JOIN d USING (doc_id)""")
def alive_in_chapters(spark, sf_dir):
    return P.alive_in_chapters(_events(spark, sf_dir))


@query(f"""WITH {EVENTS}, t AS (SELECT doc_id, chapter, min(story_date) AS told FROM ev WHERE is_dated GROUP BY 1, 2), r AS (SELECT doc_id, story_date AS ref, max(number) AS age FROM ev WHERE is_dated AND number % 2 = 1 GROUP BY 1, 2)
SELECT doc_id, chapter, CAST(greatest(0, floor(age + (told - ref) / 365.25::DOUBLE)) AS BIGINT) AS age FROM t JOIN r USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id, chapter ORDER BY abs(told - ref), ref) = 1""")
def ages_by_chapter(spark, sf_dir):
    return P.ages_by_chapter(_events(spark, sf_dir))
