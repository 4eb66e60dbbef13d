"""Correction, configuration, cross-book and scoring queries."""

from pyspark.sql import functions as F

from fabula.operators import corrections as C
from fabula.operators import models as M
from fabula.operators import story as S
from fabula.operators.joins import parts_for
from fabula.plans.catalog import query
from fabula.plans.story_plans import EDGES, ENTITIES, MENTIONS, PAIRS, _entities, _mentions
from fabula.plans.style_plans import TOK
from fabula.plans.text_plans import PARAS
from fabula.sources.tables import load


def _docs(spark, d):
    return load(spark, d, "documents")


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS rule, n FROM (SELECT doc_id, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '{p}')) AS BIGINT) AS n FROM documents) WHERE n > 0" for k, p in C.RULES.items()))
def correction_rules(spark, sf_dir):
    return C.rule_counts(_docs(spark, sf_dir))


@query(f"""WITH {TOK}, v AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in C.VARIANTS.items())}) v(token_lc, preferred))
SELECT doc_id, token, CASE WHEN regexp_matches(token, '^[A-Z]') THEN array_to_string(list_transform(string_split(preferred, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE preferred END AS suggestion, count(*) AS n, min(word_idx) AS first_idx FROM tok JOIN v USING (token_lc) GROUP BY 1, 2, 3""")
def orthographic_variants(spark, sf_dir):
    return C.orthographic_variants(_docs(spark, sf_dir))


@query(f"""WITH {PARAS}, s AS (SELECT *, regexp_matches(text, '^\\s*(?:\\*{{3,}}|-{{3,}}|#|)\\s*$') AS sep FROM paras), i AS (SELECT *, sum(CAST(sep AS INT)) OVER (PARTITION BY doc_id ORDER BY para_idx) AS island FROM s)
SELECT doc_id, min(start_char) AS start_char, max(start_char + length(text)) AS end_char, count(*) AS n_lines FROM i WHERE NOT sep GROUP BY doc_id, island""")
def scenes(spark, sf_dir):
    return C.scene_breaks(_docs(spark, sf_dir))


@query(f"""WITH {PARAS}, k AS (SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) < 40 AND trim(text) = upper(trim(text)) AND trim(text) <> lower(trim(text)) THEN 'capitals' WHEN regexp_matches(trim(text), '^(?i:cap[ií]tulo|chapter|copyright|isbn|licensed)\\b') THEN 'metadata' END AS kind FROM paras)
SELECT doc_id, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1, 2""")
def non_narrative_lines(spark, sf_dir):
    return C.non_narrative_lines(_docs(spark, sf_dir))


@query(f"""WITH {PARAS}, s AS (SELECT doc_id, para_idx, round(CASE WHEN length(trim(text)) <= 60 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(trim(text), '^[A-ZÁÉÍÓÚÑ]') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN NOT regexp_matches(trim(text), '[.!?]$') THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN regexp_matches(trim(text), '[:—-]') THEN 0.1::DOUBLE ELSE 0 END, 2) AS score FROM paras WHERE length(trim(text)) > 0) SELECT * FROM s WHERE score > 0.5""")
def title_lines(spark, sf_dir):
    return C.titles(_docs(spark, sf_dir))


@query("""WITH c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\\[(\\d{1,3})\\]', 1)) AS n, true AS cited FROM documents), l AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?m)^(\\d{1,3})\\. ', 1)) AS n, true AS listed FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN listed IS NULL THEN 'orphan' WHEN cited IS NULL THEN 'unused' ELSE 'ok' END AS kind FROM c FULL JOIN l USING (doc_id, n)""")
def citation_references(spark, sf_dir):
    return C.references(_docs(spark, sf_dir))


@query()
def spans_without_overlaps(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    return C.without_overlaps(m.select(F.col("doc_id"), (F.col("chapter") * 100_000 + F.col("start_char")).alias("start"), (F.col("chapter") * 100_000 + F.col("end_char")).alias("stop")))


@query(f"""WITH {ENTITIES}, o AS (SELECT name, entity_id % 2 = 0 AS keep FROM entities WHERE entity_id < 20), u AS (SELECT name, entity_type, false AS keep FROM entities WHERE entity_id BETWEEN 10 AND 60),
bo AS (SELECT e.entity_id, bool_and(keep) AS o FROM entities e JOIN o USING (name) GROUP BY 1), bu AS (SELECT DISTINCT e.entity_id, false AS u FROM entities e JOIN u ON u.name = e.name AND u.entity_type = e.entity_type)
SELECT e.entity_id, coalesce(o, u, NOT CASE WHEN regexp_matches(name, '^red') THEN true END, true) AS keep, CASE WHEN o IS NOT NULL THEN 'override' WHEN u IS NOT NULL THEN 'user' WHEN regexp_matches(name, '^red') THEN 'system' ELSE 'default' END AS decided_by
FROM entities e LEFT JOIN bo USING (entity_id) LEFT JOIN bu USING (entity_id)""")
def entity_filter(spark, sf_dir):
    e = _entities(spark, sf_dir)
    overrides = e.filter("entity_id < 20").select("name", F.lit(None).cast("string").alias("entity_type"), (F.col("entity_id") % 2 == 0).alias("keep"))
    rejected = e.filter("entity_id between 10 and 60").select("name", "entity_type", F.lit(False).alias("keep"))
    return M.entity_filter(e, spark.createDataFrame([("^red",)], "pattern string"), rejected, overrides)


CONFIG = "cfg AS (SELECT user_id % 20 AS scope, event_type AS path, CAST(round(value) AS BIGINT) AS value, event_id % 6 AS level FROM events)"


@query(f"WITH {CONFIG} SELECT scope, path, arg_max(value, row(level, value)) AS value, max(level) AS level FROM cfg GROUP BY 1, 2")
def resolved_config(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return M.resolved_config(e.select((F.col("user_id") % 20).alias("scope"), F.col("event_type").alias("path"), F.round("value").cast("long").alias("value"), (F.col("event_id") % 6).alias("level")))


@query(f"""
WITH {ENTITIES}, c AS (SELECT entity_id % 3 AS book, entity_type, lower(name) AS norm, min(entity_id) AS id, count(*) AS n FROM entities GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT book, id, n, entity_type, norm, substr(norm, i, 3) AS gram FROM (SELECT *, unnest(range(1, length(norm) - 1)) AS i FROM c)), z AS (SELECT id, count(*) AS z FROM g GROUP BY 1),
k AS (SELECT x.id AS a, y.id AS b, x.n AS n_a, y.n AS n_b, x.norm = y.norm AS same, count(*) AS k FROM g x JOIN g y ON x.gram = y.gram AND x.entity_type = y.entity_type AND x.book < y.book GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT a, b, CASE WHEN same THEN 1.0 ELSE round(k / (p.z + q.z - k), 6) END AS score, n_a, n_b FROM k JOIN z p ON p.id = a JOIN z q ON q.id = k.b) SELECT * FROM s WHERE score >= 0.5 AND NOT (a % 10 = 0 AND b = a + 1)""")
def link_suggestions(spark, sf_dir):
    e = _entities(spark, sf_dir).withColumn("book", F.col("entity_id") % 3)
    ids = e.select(F.col("entity_id").alias("a")).filter("a % 10 = 0")
    linked = ids.join(e.select(F.col("entity_id").alias("b")), F.col("b") == F.col("a") + 1)  # links that exist already
    return M.link_suggestions(e, linked)


@query("""WITH v AS (SELECT l_partkey AS entity, l_linestatus AS key, l_suppkey % 3 AS book, lower(trim(l_returnflag || (l_quantity % 2)::INT)) AS value, l_discount AS confidence FROM lineitem),
g AS (SELECT entity, key, book, list_sort(list_distinct(list(value))) AS vs, arg_max(value, row(confidence, value)) AS best FROM v GROUP BY 1, 2, 3)
SELECT a.entity, a.key, a.book AS book_a, b.book AS book_b, a.best AS best_a, b.best AS best_b FROM g a JOIN g b ON a.entity = b.entity AND a.key = b.key AND a.book < b.book AND a.vs <> b.vs""")
def attribute_conflicts(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return M.attribute_conflicts(li.select(F.col("l_partkey").alias("entity"), F.col("l_linestatus").alias("key"), (F.col("l_suppkey") % 3).alias("book"), F.concat("l_returnflag", (F.col("l_quantity") % 2).cast("int").cast("string")).alias("value"), F.col("l_discount").alias("confidence")))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS entity, l_suppkey % 2 AS book, l_orderkey % 10 AS item, CASE WHEN l_linenumber % 2 = 0 THEN 'acquire' ELSE 'lose' END AS kind FROM lineitem)
SELECT a.entity, a.item FROM e a JOIN e l ON l.entity = a.entity AND l.item = a.item AND l.book = 1 AND l.kind = 'lose' WHERE a.book = 0 AND a.kind = 'acquire'
  AND NOT EXISTS (SELECT 1 FROM e x WHERE x.entity = a.entity AND x.item = a.item AND x.book = 0 AND x.kind = 'lose') AND NOT EXISTS (SELECT 1 FROM e x WHERE x.entity = a.entity AND x.item = a.item AND x.book = 1 AND x.kind = 'acquire')""")
def lost_without_having(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return M.lost_without_having(li.select(F.col("l_partkey").alias("entity"), (F.col("l_suppkey") % 2).alias("book"), (F.col("l_orderkey") % 10).alias("item"), F.when(F.col("l_linenumber") % 2 == 0, "acquire").otherwise("lose").alias("kind")))


STATES = "st AS (SELECT l_orderkey // 100 AS doc_id, l_linenumber AS chapter, l_partkey % 20 AS entity_id, l_orderkey * 10 + l_linenumber AS row_id, CAST(trunc(l_extendedprice) AS BIGINT) % 20000 AS at, CASE WHEN l_discount > 0.05 THEN 1 ELSE -1 END AS tone, l_returnflag FROM lineitem)"


@query(f"""WITH {STATES} SELECT a.doc_id, a.chapter, a.entity_id, a.row_id AS a, b.row_id AS b FROM st a JOIN st b ON a.doc_id = b.doc_id AND a.chapter = b.chapter AND a.entity_id = b.entity_id AND abs(a.at - b.at) <= 500 AND a.tone * b.tone < 0 WHERE a.l_returnflag = 'A' AND b.l_returnflag <> 'A'""")
def emotional_inconsistencies(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    st = li.select(F.floor(F.col("l_orderkey") / 100).alias("doc_id"), F.col("l_linenumber").alias("chapter"), (F.col("l_partkey") % 20).alias("entity_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), (F.col("l_extendedprice").cast("long") % 20000).alias("at"), F.when(F.col("l_discount") > 0.05, 1).otherwise(-1).alias("tone"), "l_returnflag")
    return M.emotional_inconsistencies(st.filter("l_returnflag = 'A'"), st.filter("l_returnflag <> 'A'"))


@query(f"""WITH {MENTIONS} SELECT a.doc_id, a.chapter, a.entity_id AS a, a.start_char AS at, count(*) AS n, arg_max(b.entity_id, row(b.start_char, b.entity_id)) AS nearest FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.chapter = b.chapter
  AND abs(a.start_char // 100 - b.start_char // 100) <= 3 AND b.start_char < a.start_char AND a.entity_id <> b.entity_id GROUP BY 1, 2, 3, 4""")
def antecedent_candidates(spark, sf_dir):
    return M.antecedent_candidates(_mentions(spark, sf_dir))


@query("""WITH s AS (SELECT user_id AS entity_id, event_type AS archetype, count(*) AS score FROM events GROUP BY 1, 2)
SELECT entity_id, archetype, round(score * 100 / max(score) OVER (PARTITION BY entity_id), 4) AS scaled, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, archetype) AS INT) AS rank FROM s QUALIFY rank <= 2""")
def archetypes(spark, sf_dir):
    return M.archetypes(load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity_id"), F.col("event_type").alias("archetype")).agg(F.count("*").alias("score")))


@query("""WITH v AS (SELECT c_nationkey AS grp, c_custkey AS id, c_acctbal AS value FROM customer), w AS (SELECT *, min(value) OVER (PARTITION BY grp) AS lo, max(value) OVER (PARTITION BY grp) AS hi FROM v)
SELECT grp, id, CASE WHEN hi = lo THEN 50.0 ELSE round_even(least(100.0, greatest(0.0, 10 + 80 * (value - lo) / (hi - lo))), 3) END AS rank FROM w""")
def percentile_ranks(spark, sf_dir):
    return M.percentile_ranks(load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")))


@query("""WITH c AS (SELECT user_id AS id, count(*) FILTER (event_type = 'error' AND value > 30) AS a, count(*) FILTER (event_type = 'error' AND value <= 30) AS b, count(*) FILTER (event_type <> 'error' AND value > 30) AS c, count(*) FILTER (event_type <> 'error' AND value <= 30) AS d FROM events GROUP BY 1),
x AS (SELECT id, (a + b + c + d) AS n, greatest(0.0::DOUBLE, abs(a * d - b * c) - (a + b + c + d) / 2) AS g, CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d) AS v FROM c)
SELECT id, round(CASE WHEN v = 0 THEN 0.0 ELSE n * g * g / v END, 4) AS chi2, CASE WHEN v = 0 THEN false ELSE n * g * g / v > 3.841 END AS significant FROM x""")
def chi_squared(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    err, high = F.col("event_type") == "error", F.col("value") > 30
    return M.chi_squared(e.groupBy(F.col("user_id").alias("id")).agg(F.count_if(err & high).alias("a"), F.count_if(err & ~high).alias("b"), F.count_if(~err & high).alias("c"), F.count_if(~err & ~high).alias("d")))


@query(f"""WITH {PAIRS}, m AS (SELECT entity_id, count(*) AS n, count(DISTINCT (doc_id, chapter)) AS c FROM mentions GROUP BY 1), p AS (SELECT e AS entity_id, count(DISTINCT o) AS p FROM (SELECT a AS e, b AS o FROM pairs UNION ALL SELECT b, a FROM pairs) GROUP BY 1),
j AS (SELECT entity_id, n, c, coalesce(p, 0) AS p FROM m LEFT JOIN p USING (entity_id)), s AS (SELECT entity_id, 0.5::DOUBLE * n / max(n) OVER () + 0.2::DOUBLE * c / max(c) OVER () + 0.3::DOUBLE * p / greatest(max(p) OVER (), 1) AS s FROM j)
SELECT entity_id, round(s, 6) AS score, CASE WHEN s >= 0.7 THEN 'protagonist' WHEN s >= 0.45 THEN 'main' WHEN s >= 0.2 THEN 'secondary' ELSE 'minor' END AS role FROM s""")
def character_importance(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    return M.importance(m, S.cooccurrences(m))


def _propagated(rounds):
    sql = f"WITH {PAIRS}, {EDGES}, arcs AS (SELECT a, b, n AS weight FROM edges UNION ALL SELECT b, a, n FROM edges), l0 AS (SELECT DISTINCT a AS node, a AS label FROM arcs)"
    for i in range(rounds):
        sql += f", w{i} AS (SELECT arcs.a AS node, label, sum(weight) AS w FROM arcs JOIN l{i} ON arcs.b = l{i}.node GROUP BY 1, 2), l{i + 1} AS (SELECT node, arg_max(label, row(w, -label)) AS label FROM w{i} GROUP BY 1)"
    return sql + f" SELECT node, label FROM l{rounds}"


@query(_propagated(3))
def communities(spark, sf_dir):
    mentions = _mentions(spark, sf_dir)
    edges = S.network(S.cooccurrences(mentions), parts_for(mentions, S.MENTIONS)).select("a", "b", F.col("n").alias("weight"))
    return M.communities(edges)
