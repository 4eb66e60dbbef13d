"""Story queries: the star schema read as entities, mentions, interactions and dated events; documents read as versions."""

from pyspark.sql import functions as F

from fabula.operators import story as S
from fabula.plans.catalog import query
from fabula.plans.style_plans import CHAP, TOK
from fabula.sources import tables
from fabula.sources.tables import load

MENTIONS = """mentions AS (SELECT l_partkey AS entity_id, l_orderkey // 100 AS doc_id, CAST(l_linenumber AS BIGINT) AS chapter, CAST(trunc(l_extendedprice) AS BIGINT) % 20000 AS start_char,
  CAST(trunc(l_extendedprice) AS BIGINT) % 20000 + CAST(l_quantity AS BIGINT) AS end_char, l_returnflag <> 'R' AS is_active FROM lineitem)"""
ENTITIES = """entities AS (SELECT p_partkey AS entity_id, p_name || ' ' || (p_partkey % 20) AS name, lower(p_type) AS entity_type, ['primary', 'secondary', 'minor'][p_size % 3 + 1] AS importance FROM part)"""
INTERACTIONS = """x AS (SELECT * FROM (SELECT l_orderkey // 100 * 8 + l_partkey % 8 AS a, l_orderkey // 100 * 8 + l_suppkey % 8 AS b, CAST(l_linenumber AS BIGINT) AS chapter, l_orderkey AS start_char, CAST(trunc(l_discount * 100) AS BIGINT) * 20 - 100 AS tone_pct, lower(l_linestatus) AS kind FROM lineitem) WHERE a <> b),
p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, a < b AS started, chapter, start_char, tone_pct AS tone, kind FROM x)"""
EVENTS = """ev AS (SELECT o_custkey AS doc_id, o_orderkey AS event_id, o_orderkey % 12 AS chapter, o_orderkey * 7 % 3000 AS start_char, CAST(o_orderdate AS DATE) AS story_date, o_orderpriority <> '5-LOW' AS is_dated,
  CAST(floor(o_totalprice) AS BIGINT) % 40 AS number FROM orders)"""
# names: one row for each distinct name of a type (and book), and pairs of different ones that share a trigram
NAMES = """c AS (SELECT entity_type, lower(name) AS norm, min(entity_id) AS a, max(entity_id) AS last, count(*) AS n FROM entities GROUP BY 1, 2),
g AS (SELECT DISTINCT a, entity_type, n, substr(norm, i, 3) AS gram FROM (SELECT *, unnest(range(1, length(norm) - 1)) AS i FROM c)), z AS (SELECT a, count(*) AS z FROM g GROUP BY 1)"""
ALIKE = """k AS (SELECT x.a, y.a AS b, x.n AS na, y.n AS nb, count(*) AS k FROM g x JOIN g y ON x.gram = y.gram AND x.entity_type = y.entity_type AND x.a < y.a {more} GROUP BY 1, 2, 3, 4),
s AS (SELECT k.a, k.b, na, nb, round(k / (p.z + q.z - k), 6) AS similarity FROM k JOIN z p ON p.a = k.a JOIN z q ON q.a = k.b)"""
ORDER = "(PARTITION BY doc_id ORDER BY chapter, start_char, event_id)"


def _mentions(spark, d):
    return tables.mentions(load(spark, d, "lineitem"))


def _entities(spark, d):
    return tables.entities(load(spark, d, "part"))


def _interactions(spark, d):
    return tables.interactions(load(spark, d, "lineitem"))


def _events(spark, d):
    return tables.timeline(load(spark, d, "orders"))


def _markers(spark, d):
    e = load(spark, d, "orders")
    return e.select(F.floor(F.col("o_orderkey") / tables.STORY).alias("doc_id"), (F.col("o_custkey") % 7 + 1).alias("chapter"), F.col("o_orderkey").alias("marker_id"), (F.col("o_totalprice").cast("long") % 20000).alias("at"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).alias("direction"))


MARKERS = "markers AS (SELECT o_orderkey // 100 AS doc_id, o_custkey % 7 + 1 AS chapter, o_orderkey AS marker_id, CAST(trunc(o_totalprice) AS BIGINT) % 20000 AS at, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS direction FROM orders)"
PAIRS = f"{MENTIONS}, pairs AS (SELECT m.doc_id, m.chapter, m.entity_id AS a, n.entity_id AS b, abs(m.start_char - n.start_char) AS distance FROM mentions m JOIN mentions n ON m.doc_id = n.doc_id AND m.chapter = n.chapter AND m.entity_id < n.entity_id AND abs(m.start_char - n.start_char) <= 500)"
EDGES = "edges AS (SELECT a, b, round(sum(greatest(0.1::DOUBLE, 1 - distance / 500)), 6) AS weight, count(*) AS n, array_to_string(list_sort(list_distinct(list(chapter))), ',') AS chapters FROM pairs GROUP BY 1, 2)"


@query(f"WITH {MENTIONS}, {ENTITIES} SELECT entity_id, name, entity_type, doc_id, chapter, start_char, end_char FROM mentions JOIN entities USING (entity_id) WHERE is_active")
def entity_mentions(spark, sf_dir):
    return S.entity_mentions(_mentions(spark, sf_dir), _entities(spark, sf_dir))


@query(f"WITH {ENTITIES} SELECT 'entity_type' AS dimension, entity_type AS value, count(*) AS n FROM entities GROUP BY 2 UNION ALL SELECT 'importance', importance, count(*) FROM entities GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*) FROM entities")
def entity_stats(spark, sf_dir):
    return S.entity_stats(_entities(spark, sf_dir))


@query(f"""WITH {MENTIONS}, {ENTITIES}, g AS (SELECT entity_id, min(chapter) AS f, max(chapter) AS l, count(*) AS n, count(DISTINCT doc_id) AS d FROM mentions GROUP BY 1)
SELECT entity_id, name, coalesce(f, 0) AS first_chapter, coalesce(l, 0) AS last_chapter, coalesce(n, 0) AS n, coalesce(d, 0) AS n_docs FROM entities LEFT JOIN g USING (entity_id)""")
def first_appearances(spark, sf_dir):
    return S.first_appearances(_mentions(spark, sf_dir), _entities(spark, sf_dir))


@query(f"""WITH {MENTIONS}, {ENTITIES} SELECT doc_id, entity_id, min(chapter) AS first, max(chapter) AS last, count(*) AS n FROM mentions JOIN entities USING (entity_id) WHERE entity_type IN ('economy', 'promo') GROUP BY 1, 2
HAVING min(chapter) <= 3 AND (max(chapter) = min(chapter) OR count(*) <= 2)""")
def chekhov_elements(spark, sf_dir):
    return S.chekhov_elements(_mentions(spark, sf_dir), _entities(spark, sf_dir), ("economy", "promo"))


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def cooccurrences(spark, sf_dir):
    return S.cooccurrences(_mentions(spark, sf_dir))


@query(f"WITH {PAIRS}, {EDGES} SELECT * FROM edges")
def character_network(spark, sf_dir):
    return S.network(S.cooccurrences(_mentions(spark, sf_dir)))


@query(f"WITH {PAIRS}, {EDGES} SELECT node, count(*) AS degree, round(sum(weight), 4) AS weighted_degree FROM (SELECT a AS node, weight FROM edges UNION ALL SELECT b, weight FROM edges) GROUP BY 1")
def network_degrees(spark, sf_dir):
    return S.degrees(S.network(S.cooccurrences(_mentions(spark, sf_dir))))


@query(f"""WITH {PAIRS}, e AS (SELECT DISTINCT a, b FROM pairs), t AS (SELECT x.a, x.b AS m, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b),
n AS (SELECT node, count(*) AS t FROM (SELECT a AS node FROM t UNION ALL SELECT m FROM t UNION ALL SELECT c FROM t) GROUP BY 1), d AS (SELECT node, count(*) AS d FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1)
SELECT node, d AS degree, coalesce(t, 0) AS triangles, CASE WHEN d < 2 THEN 0.0 ELSE round(2 * coalesce(t, 0) / (d * (d - 1)), 6) END AS coefficient FROM d LEFT JOIN n USING (node)""")
def network_clustering(spark, sf_dir):
    return S.clustering_coefficients(S.cooccurrences(_mentions(spark, sf_dir)))


@query(f"""WITH {PAIRS}, e AS (SELECT chapter, count(DISTINCT (a, b)) AS n_edges FROM pairs GROUP BY 1), n AS (SELECT chapter, count(DISTINCT node) AS n_nodes FROM (SELECT chapter, a AS node FROM pairs UNION ALL SELECT chapter, b FROM pairs) GROUP BY 1)
SELECT chapter, n_edges, n_nodes, round(2 * n_edges / (n_nodes * (n_nodes - 1)), 6) AS density FROM e JOIN n USING (chapter)""")
def network_by_chapter(spark, sf_dir):
    return S.chapter_evolution(S.cooccurrences(_mentions(spark, sf_dir)))


@query(f"""WITH {MENTIONS}, {MARKERS}, j AS (SELECT k.doc_id, k.chapter, marker_id, entity_id, abs(k.at - m.start_char) AS distance FROM markers k JOIN mentions m ON m.doc_id = k.doc_id AND m.chapter = k.chapter AND abs(k.at - m.start_char) <= 200)
SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, chapter, marker_id ORDER BY distance, entity_id) = 1""")
def closest_entity(spark, sf_dir):
    return S.closest_entity(_markers(spark, sf_dir), _mentions(spark, sf_dir))


@query(f"WITH {MARKERS} SELECT a.doc_id, a.chapter, a.marker_id AS a, b.marker_id AS b FROM markers a JOIN markers b ON a.doc_id = b.doc_id AND a.chapter = b.chapter AND a.marker_id <> b.marker_id AND a.direction = -b.direction AND abs(a.at - b.at) < 500")
def marker_conflicts(spark, sf_dir):
    return S.opposite_markers(_markers(spark, sf_dir))


@query(f"WITH {MENTIONS}, {ENTITIES} SELECT entity_id, count(doc_id) AS mention_count FROM entities LEFT JOIN (SELECT * FROM mentions WHERE is_active) USING (entity_id) GROUP BY 1")
def mention_counts(spark, sf_dir):
    return S.reconcile_counts(_mentions(spark, sf_dir), _entities(spark, sf_dir))


@query(f"WITH {MENTIONS} SELECT CASE WHEN entity_id < 10 THEN 0 ELSE entity_id END AS entity_id, doc_id, chapter, start_char, max(end_char) AS end_char FROM mentions GROUP BY 1, 2, 3, 4")
def moved_mentions(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    remap = m.filter("entity_id < 10").select("entity_id").distinct().withColumn("new_id", F.lit(0).cast("long"))
    return S.move_mentions(m, remap)


@query(f"""WITH {INTERACTIONS} SELECT a, b, count(*) AS n, round(avg(tone), 6) AS mean_tone, round(coalesce(var_samp(tone), 0), 4) AS var_tone, min(chapter) AS first_chapter, max(chapter) AS last_chapter,
  round(count(*) FILTER (started) / count(*), 6) AS share FROM p GROUP BY 1, 2""")
def interaction_stats(spark, sf_dir):
    return S.interaction_stats(_interactions(spark, sf_dir))


@query(f"""WITH {INTERACTIONS}, g AS (SELECT a, b, count(*) AS n, round(count(*) FILTER (started) / count(*), 6) AS share FROM p GROUP BY 1, 2) SELECT * FROM g WHERE n >= 5 AND (share >= 0.7::DOUBLE OR share <= 1 - 0.7::DOUBLE)""")
def asymmetric_pairs(spark, sf_dir):
    return S.asymmetric_pairs(_interactions(spark, sf_dir))


@query(f"""WITH {INTERACTIONS}, i AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY chapter, start_char, tone) AS i, count(*) OVER (PARTITION BY a, b) AS n FROM p),
g AS (SELECT a, b, any_value(n) AS n, avg(tone) FILTER (i <= n // 2) AS u, avg(tone) FILTER (i > n // 2) AS v, var_samp(tone) AS s FROM i GROUP BY 1, 2)
SELECT a, b, n, CASE WHEN s > 3000 THEN 'volatile' WHEN v - u > 20 THEN 'improving' WHEN v - u < -20 THEN 'worsening' ELSE 'stable' END AS trend FROM g WHERE n >= 2""")
def interaction_trend(spark, sf_dir):
    return S.interaction_trend(_interactions(spark, sf_dir))


@query(f"""WITH {INTERACTIONS}, l AS (SELECT a, b, chapter, start_char, tone, lag(tone) OVER (PARTITION BY a, b ORDER BY chapter, start_char, tone) AS before FROM p) SELECT * FROM l WHERE abs(tone - before) > 100""")
def sudden_changes(spark, sf_dir):
    return S.sudden_changes(_interactions(spark, sf_dir))


@query(f"""WITH {INTERACTIONS} SELECT a, b, chapter, start_char, tone, start_char // 100 AS bucket FROM p QUALIFY row_number() OVER (PARTITION BY a, b, chapter, start_char // 100 ORDER BY tone DESC, start_char) = 1""")
def deduplicated_interactions(spark, sf_dir):
    return S.deduplicated_interactions(_interactions(spark, sf_dir))


@query(f"""WITH {INTERACTIONS}, e AS (SELECT a, b FROM x UNION SELECT b, a FROM x) SELECT a AS node, array_to_string(list_sort(list(b)), ',') AS neighbours, count(*) AS degree FROM e GROUP BY 1""")
def relationship_graph(spark, sf_dir):
    return S.relationship_graph(_interactions(spark, sf_dir))


@query(f"""WITH RECURSIVE {INTERACTIONS}, e AS (SELECT a, b FROM x UNION SELECT b, a FROM x),
r AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON r.node = e.a WHERE r.depth < 2) SELECT node, min(depth) AS depth FROM r GROUP BY 1""")
def bounded_search(spark, sf_dir):
    return S.bounded_search(_interactions(spark, sf_dir), 0)


@query(f"""WITH {EVENTS}, d AS (SELECT doc_id, chapter * 10000000000 + start_char * 1000000 + event_id AS k, story_date FROM ev WHERE is_dated), f AS (SELECT doc_id, arg_min(story_date, k) AS fa FROM d GROUP BY 1),
u AS (SELECT doc_id, event_id, chapter * 10000000000 + start_char * 1000000 + event_id AS k FROM ev WHERE NOT is_dated)
SELECT u.doc_id, u.event_id, CAST(coalesce(d.story_date, fa) AS VARCHAR) AS anchor FROM u ASOF LEFT JOIN d ON u.doc_id = d.doc_id AND u.k >= d.k LEFT JOIN f ON f.doc_id = u.doc_id WHERE coalesce(d.story_date, fa) IS NOT NULL""")
def nearest_anchor(spark, sf_dir):
    return S.nearest_anchor(_events(spark, sf_dir))


@query(f"""WITH {EVENTS}, r AS (SELECT *, CAST(rank() OVER (PARTITION BY doc_id ORDER BY story_date) AS INT) AS rank FROM ev WHERE is_dated),
m AS (SELECT *, max(rank) OVER (PARTITION BY doc_id ORDER BY chapter, start_char, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM r)
SELECT doc_id, event_id, rank, mark, CASE WHEN rank < mark THEN 'analepsis' ELSE 'prolepsis' END AS kind FROM m WHERE rank < mark OR rank > mark + 3""")
def narrative_order(spark, sf_dir):
    return S.narrative_order(_events(spark, sf_dir))


@query(f"""WITH {EVENTS}, c AS (SELECT *, CAST(sum(CASE WHEN is_dated THEN 0 WHEN event_id % 2 = 0 THEN number ELSE -number END) OVER {ORDER} AS BIGINT) AS days, first_value(story_date) OVER {ORDER} AS s FROM ev)
SELECT doc_id, event_id, days, CAST(s + CAST(days AS INT) AS VARCHAR) AS resolved FROM c WHERE NOT is_dated""")
def relative_chain(spark, sf_dir):
    return S.relative_chain(_events(spark, sf_dir))


@query(f"""WITH {EVENTS}, g AS (SELECT doc_id, event_id, CAST(story_date - lag(story_date) OVER {ORDER} AS BIGINT) AS days FROM ev WHERE is_dated) SELECT * FROM g WHERE abs(days) > 1825""")
def suspicious_jumps(spark, sf_dir):
    return S.suspicious_jumps(_events(spark, sf_dir))


@query(f"""WITH {EVENTS}, g AS (SELECT doc_id, event_id, number AS age, lag(number) OVER {ORDER} AS before FROM ev) SELECT * FROM g WHERE age < before""")
def age_regressions(spark, sf_dir):
    return S.age_regressions(_events(spark, sf_dir))


@query(f"""WITH {EVENTS}, y AS (SELECT doc_id, year(story_date) - number AS y FROM ev WHERE is_dated) SELECT doc_id, CAST(floor(median(y)) AS BIGINT) AS birth_year, max(y) - min(y) AS spread, count(*) AS n, max(y) - min(y) > 3 AS contradiction FROM y GROUP BY 1""")
def birth_years(spark, sf_dir):
    return S.birth_years(_events(spark, sf_dir))


@query(f"""WITH {EVENTS}, s AS (SELECT doc_id, CASE WHEN number % 2 = 0 THEN 1 ELSE -1 END AS s, sum(CASE WHEN number % 2 = 0 THEN 1 ELSE -1 END) OVER {ORDER} AS b FROM ev),
g AS (SELECT doc_id, count(*) FILTER (s = 1) AS opened, count(*) FILTER (s = -1) AS c, CAST(greatest(0, -min(b)) AS BIGINT) AS unmatched FROM s GROUP BY 1) SELECT doc_id, opened, unmatched, opened - (c - unmatched) AS left_open FROM g""")
def event_continuity(spark, sf_dir):
    return S.continuity(_events(spark, sf_dir))


@query(f"""WITH {EVENTS}, f AS (SELECT doc_id, number % 5 AS fact, chapter, event_id % 2 = 0 AS acq FROM ev), g AS (SELECT doc_id, fact, min(chapter) AS acquired FROM f WHERE acq GROUP BY 1, 2)
SELECT f.doc_id, f.fact, acquired, count(*) AS n_uses, min(chapter) AS first_use FROM f JOIN g ON f.doc_id = g.doc_id AND f.fact = g.fact WHERE NOT acq AND chapter < acquired GROUP BY 1, 2, 3""")
def knowledge_before_acquired(spark, sf_dir):
    return S.knowledge_before_acquired(_events(spark, sf_dir))


@query(f"""WITH {EVENTS}, l AS (SELECT doc_id, chapter, event_id, lag(number % 4) OVER (PARTITION BY doc_id, chapter ORDER BY start_char, event_id) AS before, number % 4 AS place FROM ev) SELECT * FROM l WHERE before <> place""")
def location_changes(spark, sf_dir):
    return S.location_changes(_events(spark, sf_dir))


@query(f"""WITH {EVENTS}, k AS (SELECT *, row(chapter, start_char, event_id) AS k FROM ev), d AS (SELECT doc_id, max(k) AS dk, arg_max(event_id, k) AS death_event FROM k WHERE number = 0 GROUP BY 1)
SELECT k.doc_id, death_event, arg_min(event_id, k) AS alive_event, count(*) AS n_later FROM k JOIN d ON k.doc_id = d.doc_id AND k.k > d.dk WHERE number <> 0 GROUP BY 1, 2""")
def death_then_alive(spark, sf_dir):
    return S.death_then_alive(_events(spark, sf_dir))


@query(f"""
WITH {TOK}, n AS (SELECT token, trim(regexp_replace(translate(lower(token), 'áéíóúüñ', 'aeiouun'), '\\s+', ' ', 'g')) AS norm FROM tok WHERE regexp_matches(token, '^[A-ZÁÉÍÓÚÑ]') AND length(token) >= 4),
g AS (SELECT norm, token, count(*) AS n FROM n GROUP BY 1, 2),
w AS (SELECT *, count(*) OVER p AS forms, CAST(sum(n) OVER p AS BIGINT) AS total, row_number() OVER (PARTITION BY norm ORDER BY n DESC, token) AS r FROM g WINDOW p AS (PARTITION BY norm))
SELECT norm, token AS canonical, forms, total, round(least(0.95::DOUBLE, 0.5::DOUBLE + 0.45::DOUBLE * n / total), 6) AS confidence FROM w WHERE forms > 1 AND r = 1""")
def name_variants(spark, sf_dir):
    return S.name_variants(tables.tokens(load(spark, sf_dir, "documents")))


@query(f"""
WITH {ENTITIES}, {NAMES}, {ALIKE.format(more="")}
SELECT a, b, similarity, n FROM (SELECT a, b, similarity, na + nb AS n FROM s WHERE similarity >= 0.5 UNION ALL SELECT a, last, 1.0, n FROM c WHERE n > 1) ORDER BY similarity DESC, a, b LIMIT 50""")
def merge_suggestions(spark, sf_dir):
    return S.merge_suggestions(_entities(spark, sf_dir))


@query("""WITH RECURSIVE n AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region),
r AS (SELECT node, parent AS ancestor, CAST(1 AS BIGINT) AS depth FROM n WHERE parent IS NOT NULL UNION ALL SELECT r.node, n.parent, depth + 1 FROM r JOIN n ON r.ancestor = n.node WHERE n.parent IS NOT NULL AND depth < 5) SELECT * FROM r""")
def location_ancestors(spark, sf_dir):
    c, n, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    link = lambda df, a, k, b, p: df.select(F.concat(F.lit(a), F.col(k).cast("string")).alias("node"), F.concat(F.lit(b), F.col(p).cast("string")).alias("parent"))
    nodes = link(c, "c", "c_custkey", "n", "c_nationkey").unionByName(link(n, "n", "n_nationkey", "r", "n_regionkey")).unionByName(r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("parent")))
    return S.ancestors(nodes)


@query("""
WITH s AS (SELECT o_custkey AS traveller, o_orderkey AS seq, CAST(epoch(o_orderdate) AS BIGINT) // 3600 AS hours, (o_orderkey * 37 % 180) - 90.0::DOUBLE AS lat, (o_orderkey * 53 % 360) - 180.0::DOUBLE AS lon FROM orders),
w AS (SELECT *, lag(hours) OVER o AS h0, lag(lat) OVER o AS lat0, lag(lon) OVER o AS lon0 FROM s WINDOW o AS (PARTITION BY traveller ORDER BY seq)),
k AS (SELECT traveller, seq, hours - h0 AS h, round(2 * 6371.0::DOUBLE * asin(sqrt(power(sin((radians(lat) - radians(lat0)) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * power(sin((radians(lon) - radians(lon0)) / 2), 2))), 3) AS km FROM w WHERE h0 IS NOT NULL)
SELECT traveller, seq, km FROM k WHERE km > 1 * h""")
def impossible_travel(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    stops = o.select(F.col("o_custkey").alias("traveller"), F.col("o_orderkey").alias("seq"), F.floor(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 3600).alias("hours"), (F.col("o_orderkey") * 37 % 180 - 90.0).alias("lat"), (F.col("o_orderkey") * 53 % 360 - 180.0).alias("lon"))
    return S.impossible_travel(stops, 1.0)


@query(f"""
WITH {CHAP}, o AS (SELECT doc_id // 2 AS doc_id, chapter, md5(trim(text)) AS o FROM chap WHERE doc_id % 2 = 0), n AS (SELECT doc_id // 2 AS doc_id, chapter, md5(trim(text)) AS n FROM chap WHERE doc_id % 2 = 1),
b AS (SELECT doc_id, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' WHEN o <> n THEN 'modified' ELSE 'equal' END AS k FROM o FULL JOIN n USING (doc_id, chapter))
SELECT doc_id, count(*) FILTER (k = 'added') AS added, count(*) FILTER (k = 'removed') AS removed, count(*) FILTER (k = 'modified') AS modified, count(*) FILTER (k = 'equal') AS equal, round(count(*) FILTER (k <> 'equal') / count(*), 6) AS ratio FROM b GROUP BY 1""")
def version_diffs(spark, sf_dir):
    c = tables.chapters(load(spark, sf_dir, "documents"))
    half = lambda r: c.filter(F.col("doc_id") % 2 == r).withColumn("doc_id", F.floor(F.col("doc_id") / 2))
    return S.chapter_diffs(half(0), half(1))


@query("""WITH c AS (SELECT user_id, event_type, event_id, value, 0 AS n FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT user_id, event_type, event_id, value, 1 FROM events WHERE event_id % 3 = 0)
SELECT user_id, event_type, event_id, value FROM c QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY n DESC, event_id DESC) = 1""")
def upserted_values(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return S.upsert(e.filter("event_id % 3 <> 0"), e.filter("event_id % 3 = 0"), ["user_id", "event_type"], "event_id")
