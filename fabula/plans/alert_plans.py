"""Alert queries over the event log, read as findings."""

from pyspark.sql import functions as F

from fabula.operators import alerts as A
from fabula.plans.catalog import query
from fabula.sources import tables
from fabula.sources.tables import load

ALERTS = """alerts AS (SELECT event_id AS alert_id, user_id % 10 AS project_id, event_type AS alert_type, ['critical', 'warning', 'info', 'hint', 'other'][event_id % 5 + 1] AS severity,
  ['new', 'open', 'dismissed', 'resolved', 'acknowledged'][(event_id // 5) % 5 + 1] AS status, 'module_' || (user_id % 7) AS source_module, CASE WHEN event_id % 37 = 0 THEN NULL ELSE event_id % 37 END AS chapter,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 13 % 5000 END AS start_char, (CAST(round(value * 100) AS BIGINT) % 100) / 100 AS confidence, [user_id, event_id % 50] AS entity_ids,
  event_type || ' ' || (event_id % 11) AS title, ts AS created_at, user_id AS entity_id FROM events)"""
HASHED = """hashed AS (SELECT *, substr(sha256(project_id || '|' || alert_type || '|[' || array_to_string(list_sort(entity_ids), ', ') || ']|' || coalesce(chapter, 0) || '|' || title), 1, 16) AS content_hash FROM alerts)"""
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 WHEN 'hint' THEN 3 ELSE 4 END"
CLOSED = "('dismissed', 'resolved', 'acknowledged')"


def _alerts(spark, sf_dir):
    return tables.alerts(load(spark, sf_dir, "events"))


@query(f"""WITH {ALERTS} SELECT alert_id, alert_type, severity, status, confidence FROM alerts WHERE severity IN ('critical', 'warning') AND status IN ('new', 'open') AND chapter BETWEEN 3 AND 20
  AND list_has_any(entity_ids, [CAST(1 AS BIGINT), 2, 3, 4, 5]) AND confidence BETWEEN 0.3 AND 1.0""")
def alert_filter(spark, sf_dir):
    return A.matching(_alerts(spark, sf_dir), severities=("critical", "warning"), statuses=("new", "open"), chapters=(3, 20), entities=(1, 2, 3, 4, 5), confidence=(0.3, 1.0)).select("alert_id", "alert_type", "severity", "status", "confidence")


@query(f"""WITH {ALERTS} SELECT project_id, alert_id, severity, confidence, CAST(row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN chapter = 7 THEN 0 ELSE 1 END, {RANK}, confidence DESC,
  coalesce(start_char, chapter * 10000, 999999999), alert_id) AS INT) AS rank FROM alerts QUALIFY rank <= 50""")
def alerts_prioritized(spark, sf_dir):
    return A.prioritized(_alerts(spark, sf_dir), 7, 50)


_DIM = lambda k: f"SELECT '{k}' AS dimension, CAST({k} AS VARCHAR) AS value, count(*) AS n, count(*) FILTER (status NOT IN {CLOSED}) AS n_open FROM alerts WHERE {k} IS NOT NULL GROUP BY {k}"


@query(f"""WITH {ALERTS} {" UNION ALL ".join(map(_DIM, ("alert_type", "severity", "status", "source_module", "chapter")))} UNION ALL SELECT 'all', NULL, count(*), count(*) FILTER (status NOT IN {CLOSED}) FROM alerts""")
def alert_summary(spark, sf_dir):
    return A.summary(_alerts(spark, sf_dir))


FACTORS = "factors AS (SELECT alert_type, source_module, count(*) AS total, count(*) FILTER (status = 'dismissed') AS dismissed, round(1 - 0.5::DOUBLE * (count(*) FILTER (status = 'dismissed') / count(*)), 4) AS factor FROM alerts GROUP BY 1, 2)"


@query(f"WITH {ALERTS}, {FACTORS} SELECT * FROM factors")
def detector_calibration(spark, sf_dir):
    return A.calibration(_alerts(spark, sf_dir))


@query(f"""WITH {ALERTS}, {FACTORS}, b AS (SELECT alert_id, alert_type, chapter, confidence * coalesce(factor, 1.0::DOUBLE) AS b FROM alerts LEFT JOIN factors USING (alert_type, source_module))
SELECT alert_id, alert_type, round(CASE WHEN alert_type IN ('click', 'error') AND chapter IS NOT NULL THEN greatest(0.15::DOUBLE, b * power(0.97::DOUBLE, abs(chapter - 10))) ELSE b END + 1e-9::DOUBLE, 6) AS effective FROM b""")
def effective_confidence(spark, sf_dir):
    a = _alerts(spark, sf_dir)
    return A.effective_confidence(a, A.calibration(a), 10, ("click", "error"))


@query(f"WITH {ALERTS}, {HASHED} SELECT alert_id, content_hash FROM hashed")
def alert_content_hash(spark, sf_dir):
    return A.content_hash(_alerts(spark, sf_dir)).select("alert_id", "content_hash")


@query(f"WITH {ALERTS} SELECT alert_id, alert_type, source_module FROM alerts WHERE NOT (alert_type LIKE 'p%' OR source_module LIKE '%\\_3' ESCAPE '\\' AND alert_type LIKE 'c%')")
def alerts_not_suppressed(spark, sf_dir):
    rules = spark.createDataFrame([("p*", None), ("c*", "*_3")], "type_glob string, module_glob string")
    return A.suppressed(_alerts(spark, sf_dir), rules).select("alert_id", "alert_type", "source_module")


@query(f"""WITH {ALERTS}, {HASHED}, d AS (SELECT DISTINCT content_hash FROM hashed WHERE alert_id % 4 = 0 AND status = 'dismissed')
SELECT alert_id, content_hash, CASE WHEN content_hash IN (SELECT content_hash FROM d) AND status NOT IN {CLOSED} THEN 'dismissed' ELSE status END AS status FROM hashed""")
def apply_dismissals(spark, sf_dir):
    hashed = A.content_hash(_alerts(spark, sf_dir))
    return A.apply_dismissals(hashed, hashed.filter("alert_id % 4 = 0 and status = 'dismissed'"))


@query(f"""
WITH RECURSIVE {ALERTS}, f AS (SELECT project_id, alert_type, status = 'dismissed' AS dismissed, row_number() OVER (PARTITION BY project_id, alert_type ORDER BY created_at, alert_id) AS i FROM alerts WHERE status IN {CLOSED}),
r AS (SELECT project_id, alert_type, CAST(0 AS BIGINT) AS i, 1.0::DOUBLE AS weight, CAST(0 AS BIGINT) AS d FROM (SELECT DISTINCT project_id, alert_type FROM f)
  UNION ALL SELECT r.project_id, r.alert_type, f.i, round(greatest(0.1::DOUBLE, least(1.0::DOUBLE, r.weight + CASE WHEN f.dismissed THEN -0.05::DOUBLE ELSE 0.025::DOUBLE END)), 4), r.d + CAST(f.dismissed AS BIGINT)
  FROM r JOIN f ON f.project_id = r.project_id AND f.alert_type = r.alert_type AND f.i = r.i + 1)
SELECT project_id, alert_type, weight, i AS n_feedback, d AS n_dismissed FROM r QUALIFY row_number() OVER (PARTITION BY project_id, alert_type ORDER BY i DESC) = 1""")
def adaptive_weights(spark, sf_dir):
    f = _alerts(spark, sf_dir).filter(F.col("status").isin(*A.CLOSED)).select("project_id", "alert_type", F.col("created_at").alias("ts"), "alert_id", (F.col("status") == "dismissed").alias("dismissed"))
    return A.adaptive_weights(f)


@query(f"""
WITH {ALERTS}, {HASHED}, o AS (SELECT *, alert_id AS old_id FROM hashed WHERE alert_id % 2 = 0), n AS (SELECT *, alert_id AS new_id FROM hashed WHERE alert_id % 3 = 0),
h AS (SELECT old_id, min(new_id) AS new_id FROM o JOIN n USING (content_hash) GROUP BY old_id),
e AS (SELECT o.old_id, min(n.new_id) AS new_id FROM o JOIN n ON o.alert_type = n.alert_type AND o.chapter = n.chapter AND list_has_any(o.entity_ids, n.entity_ids)
  WHERE o.old_id NOT IN (SELECT old_id FROM h) AND n.new_id NOT IN (SELECT new_id FROM h) GROUP BY o.old_id)
SELECT old_id, new_id, 'hash' AS how, 1.0::DOUBLE AS score FROM h UNION ALL SELECT old_id, new_id, 'entity', 0.8::DOUBLE FROM e
UNION ALL SELECT old_id, -1, 'removed', 0.5::DOUBLE FROM o WHERE old_id NOT IN (SELECT old_id FROM h) AND old_id NOT IN (SELECT old_id FROM e)""")
def alert_diff(spark, sf_dir):
    a = _alerts(spark, sf_dir)
    return A.diff(a.filter("alert_id % 2 = 0"), a.filter("alert_id % 3 = 0"))


@query(f"""WITH {ALERTS} SELECT 'alert_type' AS dimension, alert_type AS value, count(*) AS n FROM alerts WHERE status = 'dismissed' GROUP BY 2 UNION ALL SELECT 'source_module', source_module, count(*) FROM alerts WHERE status = 'dismissed' GROUP BY 2""")
def dismissal_stats(spark, sf_dir):
    return A.dismissal_stats(_alerts(spark, sf_dir))


@query(f"WITH {ALERTS}, r AS (SELECT project_id, alert_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, alert_id DESC) AS INT) AS r FROM alerts) SELECT project_id, alert_id, CASE WHEN r <= 10 THEN r ELSE 0 END AS rank, r > 10 AS removed FROM r")
def snapshot_cleanup(spark, sf_dir):
    return A.latest_versions(_alerts(spark, sf_dir), 10)


@query(f"WITH {ALERTS} SELECT alert_type, count(*) AS n, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (confidence < 0.5) AS low FROM alerts GROUP BY 1")
def review_report(spark, sf_dir):
    return A.review_report(_alerts(spark, sf_dir))


VOTES = "votes AS (SELECT entity_id AS item, alert_type AS candidate, confidence AS score, (alert_id % 4 + 1) / 4 AS weight FROM alerts)"


def _votes(spark, sf_dir):
    return _alerts(spark, sf_dir).select(F.col("entity_id").alias("item"), F.col("alert_type").alias("candidate"), F.col("confidence").alias("score"), ((F.col("alert_id") % 4 + 1) / 4).alias("weight"))


@query(f"""WITH {ALERTS}, {VOTES}, g AS (SELECT item, candidate, round(sum(score * weight) / sum(weight), 6) AS mean FROM votes GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER o AS rank, lead(mean) OVER o AS nx FROM g WINDOW o AS (PARTITION BY item ORDER BY mean DESC, candidate))
SELECT item, candidate, mean, CASE WHEN nx IS NULL OR mean = 0 THEN 0.0 ELSE round(1 - (mean - nx) / mean, 6) END AS ambiguity FROM r WHERE rank = 1""")
def weighted_vote(spark, sf_dir):
    return A.weighted_vote(_votes(spark, sf_dir))


@query(f"""WITH {ALERTS}, {VOTES}, g AS (SELECT item, candidate, sum(score * weight) AS s, sum(weight) AS w, count(*) AS n, max(score) AS one FROM votes GROUP BY 1, 2)
SELECT item, candidate, n, round(CASE WHEN n = 1 THEN one * (0.85::DOUBLE + 0.15::DOUBLE * w) ELSE least(1.0::DOUBLE, s / w + least(0.15::DOUBLE, 0.05::DOUBLE * (n - 1))) END + 1e-9::DOUBLE, 6) AS confidence FROM g""")
def attribute_vote(spark, sf_dir):
    return A.attribute_vote(_votes(spark, sf_dir))


@query("""WITH e AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800000000, true) AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(CAST(nw AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM e)
SELECT user_id, session, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM s GROUP BY 1, 2""")
def event_sessions(spark, sf_dir):
    return A.sessions(load(spark, sf_dir, "events"))


@query("SELECT user_id % 10 AS project_id, event_type AS phase, bool_or(value > 50) AS executed, max(event_id) AS last_run FROM events GROUP BY 1, 2")
def executed_phases(spark, sf_dir):
    return A.executed_phases(load(spark, sf_dir, "events"))


@query("SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS revision, CASE WHEN event_type = 'error' THEN 3 ELSE 1 END AS n_stale FROM events WHERE event_type IN ('purchase', 'error')")
def invalidation_revisions(spark, sf_dir):
    return A.revisions(load(spark, sf_dir, "events"))
