"""Alert operators: filters, priorities, summaries, confidence arithmetic, feedback folds, suppression, version diffs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.operators.joins import broadcast_if_small
from fabula.sources.shared import written

CLOSED = ("dismissed", "resolved", "acknowledged")
SEVERITIES = ("critical", "warning", "info", "hint")
DECAY, FLOOR = 0.97, 0.15
WEIGHT_FLOOR, WEIGHT_CEILING = 0.1, 1.0


def severity_rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def matching(alerts: DataFrame, severities=None, statuses=None, types=None, modules=None, chapters=None, entities=None, confidence=(0.0, 1.0)) -> DataFrame:
    """All given conditions hold; a condition left out lets everything pass. Built of column predicates, so scans get them."""
    for column, wanted in (("severity", severities), ("status", statuses), ("alert_type", types), ("source_module", modules)):
        if wanted is not None:
            alerts = alerts.filter(F.col(column).isin(list(wanted)))
    if chapters is not None:
        alerts = alerts.filter(F.col("chapter").between(*chapters))
    if entities is not None:
        alerts = alerts.filter(F.arrays_overlap("entity_ids", F.array(*[F.lit(e).cast("bigint") for e in entities])))
    return alerts.filter(F.col("confidence").between(*confidence))


def prioritized(alerts: DataFrame, current_chapter: int, top: int) -> DataFrame:
    """Per project: current chapter first, then severity, confidence and place in the text; the first `top`."""
    place = F.coalesce("start_char", F.col("chapter") * 10_000, F.lit(999_999_999))
    near = F.when(F.col("chapter") == current_chapter, 0).otherwise(1)
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(near, severity_rank(F.col("severity")), F.desc("confidence"), place, "alert_id"))
    return alerts.withColumn("rank", rank).filter(F.col("rank") <= top).select("project_id", "alert_id", "severity", "confidence", "rank")


def summary(alerts: DataFrame) -> DataFrame:
    """Counts by category in one pass: grouping sets over type, severity, status, module and chapter, and all."""
    keys = ["alert_type", "severity", "status", "source_module", "chapter"]
    sets = alerts.select("alert_type", "severity", "status", "source_module", F.col("chapter").cast("string").alias("chapter")).groupingSets([[k] for k in keys] + [[]], *keys).agg(
        F.count("*").alias("n"), F.count_if(~F.col("status").isin(*CLOSED)).alias("n_open"), F.grouping_id().alias("g"))
    named = F.lit("all")
    for i, k in enumerate(keys):
        named = F.when(F.col("g") == 31 - (1 << (4 - i)), k).otherwise(named)
    return sets.select(named.alias("dimension"), F.coalesce(*keys).alias("value"), "n", "n_open").filter((F.col("dimension") == "all") | F.col("value").isNotNull())


def calibration(alerts: DataFrame) -> DataFrame:
    """Per type and module: share dismissed and the factor 1 - half of it."""
    g = alerts.groupBy("alert_type", "source_module").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "dismissed").alias("dismissed"))
    return g.withColumn("factor", F.round(1 - 0.5 * (F.col("dismissed") / F.col("total")), 4))


def effective_confidence(alerts: DataFrame, factors: DataFrame, current_chapter: int, decaying: tuple[str, ...]) -> DataFrame:
    """confidence * calibration * 0.97 ^ distance (floor 0.15, some types only)."""
    joined = alerts.join(factors.select("alert_type", "source_module", "factor"), ["alert_type", "source_module"], "left")
    base = F.col("confidence") * F.coalesce("factor", F.lit(1.0))
    distance = F.abs(F.col("chapter") - current_chapter)
    decayed = F.greatest(F.lit(FLOOR), base * F.pow(F.lit(DECAY), distance))
    value = F.when(F.col("alert_type").isin(*decaying) & F.col("chapter").isNotNull(), decayed).otherwise(base)
    return joined.select("alert_id", "alert_type", F.round(value + 1e-9, 6).alias("effective"))


def content_hash(alerts: DataFrame) -> DataFrame:
    """A hash of project, type, sorted entities, chapter and title that outlives ids: 16 hex digits of SHA-256."""
    entities = F.concat(F.lit("["), F.array_join(F.array_sort("entity_ids"), ", "), F.lit("]"))
    raw = F.concat_ws("|", F.col("project_id").cast("string"), "alert_type", entities, F.coalesce("chapter", F.lit(0)).cast("string"), F.substring("title", 1, 100))
    return alerts.withColumn("content_hash", F.substring(F.sha2(raw, 256), 1, 16))


def suppressed(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts that no rule (type_glob, module_glob; null matches all) covers. Globs become patterns once. The kinds of alert, type and module, are
    few whatever the number of alerts: rules are matched with these, and alerts are joined with the kinds that are covered."""
    pattern = lambda c: F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace(c, r"([.+^$(){}\[\]|\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    r = rules.select(pattern(F.coalesce("type_glob", F.lit("*"))).alias("tp"), pattern(F.coalesce("module_glob", F.lit("*"))).alias("mp")).distinct()
    kinds = alerts.select("alert_type", "source_module").distinct()
    covered = kinds.join(broadcast_if_small(r), F.expr("alert_type rlike tp and source_module rlike mp"), "left_semi")
    return alerts.join(broadcast_if_small(covered), ["alert_type", "source_module"], "left_anti").select(alerts.columns)


def apply_dismissals(alerts: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Open alerts whose hash was dismissed become dismissed; the hashes are joined, never collected."""
    flagged = alerts.join(dismissed.select("content_hash").distinct().withColumn("hit", F.lit(True)), "content_hash", "left")
    change = F.col("hit").isNotNull() & (F.col("content_hash") != "") & ~F.col("status").isin(*CLOSED)
    return flagged.select("alert_id", "content_hash", F.when(change, "dismissed").otherwise(F.col("status")).alias("status"))


def _clamped_sums(rate: float):
    """Of a task's feedback in order: for each key the fold of its steps as one step (shift, low, high), in units of 0.0001."""
    down, up, floor, ceiling = (round(x * 10_000) for x in (-rate, rate / 2, WEIGHT_FLOOR, WEIGHT_CEILING))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, state = TaskContext.get().partitionId(), None, None
        for b in it:
            out = []
            for project, kind, dismissed in zip(*(b.column(c).to_pylist() for c in ("project_id", "alert_type", "dismissed")), strict=True):
                if state is None or (project, kind) != key:
                    out += [] if state is None else [(*key, part, *state)]
                    key, state = (project, kind), (0, -(10**9), 10**9, 0, 0)
                shift, low, high, n, gone = state
                d = down if dismissed else up
                state = (shift + d, max(floor, min(ceiling, low + d)), max(floor, min(ceiling, high + d)), n + 1, gone + bool(dismissed))
            schema = pa.schema([b.schema.field("project_id"), b.schema.field("alert_type"), *((c, pa.int64()) for c in ("part", "shift", "low", "high", "n", "gone"))])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), schema.types, strict=True)], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, part, *state), schema.types, strict=True)], schema=schema)

    return batches


def adaptive_weights(feedback: DataFrame, rate: float = 0.05) -> DataFrame:
    """Weight per (project, type) after feedback in order: minus rate on dismissal, plus half of it on confirmation, clamped and rounded each time.

    The fold depends on order, (ts, alert_id), but clamped steps compose: the feedback is dealt by ranges of key and order, so that a
    frequent key spans many tasks; each task folds its range, and a key's few folds are applied in order."""
    order = ["project_id", "alert_type", "ts", "alert_id", "dismissed"]
    rows = feedback.select(order).repartitionByRange(*order).sortWithinPartitions(*order).select("project_id", "alert_type", "dismissed")
    types = {f.name: f.dataType.simpleString() for f in feedback.schema.fields}
    parts = rows.mapInArrow(_clamped_sums(rate), f"project_id {types['project_id']}, alert_type {types['alert_type']}, part long, shift long, low long, high long, n long, gone long")
    g = parts.groupBy("project_id", "alert_type").agg(F.array_sort(F.collect_list(F.struct("part", "shift", "low", "high"))).alias("steps"), F.sum("n").alias("n_feedback"), F.sum("gone").alias("n_dismissed"))
    step = lambda w, e: F.greatest(e["low"], F.least(e["high"], w + e["shift"]))
    return g.select("project_id", "alert_type", (F.aggregate("steps", F.lit(10_000).cast("long"), step) / 10_000).alias("weight"), "n_feedback", "n_dismissed")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new alerts by content hash, then by type and chapter with a shared entity: matched or removed (new_id -1)."""
    o, n = content_hash(old).select("content_hash", "alert_type", "chapter", "entity_ids", F.col("alert_id").alias("old_id")), content_hash(new).select("content_hash", "alert_type", "chapter", "entity_ids", F.col("alert_id").alias("new_id"))
    first = F.min("new_id").alias("new_id")
    by_hash = written(o.join(n.groupBy("content_hash").agg(first), "content_hash").groupBy("old_id").agg(first)).withColumn("how", F.lit("hash")).withColumn("score", F.lit(1.0))
    # only the least new alert of an entity counts, so one row of each type, chapter and entity is joined, however many alerts share these
    by = lambda alerts, key: alerts.select("alert_type", "chapter", F.explode("entity_ids").alias("entity"), key)
    least = by(n.join(by_hash, "new_id", "left_anti"), "new_id").groupBy("alert_type", "chapter", "entity").agg(first)
    by_entity = written(by(o.join(by_hash, "old_id", "left_anti"), "old_id").join(least, ["alert_type", "chapter", "entity"]).groupBy("old_id").agg(first)).withColumn("how", F.lit("entity")).withColumn("score", F.lit(0.8))
    matched = by_hash.unionByName(by_entity)
    gone = o.join(matched, "old_id", "left_anti").select("old_id", F.lit(-1).cast("long").alias("new_id"), F.lit("removed").alias("how"), F.lit(0.5).alias("score"))
    return matched.unionByName(gone)


def dismissal_stats(alerts: DataFrame) -> DataFrame:
    """Dismissals by type and by module in one pass; empty names left out."""
    d = alerts.filter("status = 'dismissed'")
    g = d.groupingSets([["alert_type"], ["source_module"]], "alert_type", "source_module").agg(F.count("*").alias("n"))
    return g.select(F.when(F.col("alert_type").isNotNull(), "alert_type").otherwise("source_module").alias("dimension"), F.coalesce("alert_type", "source_module").alias("value"), "n").filter("value <> ''")


def latest_versions(alerts: DataFrame, keep: int) -> DataFrame:
    """Every row of each project: the newest `keep` with their rank, the rest (rank 0) marked for removal. Only the newest are ranked, so each task keeps `keep` rows of a project at most."""
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("alert_id")))
    newest = alerts.select("project_id", "alert_id", "created_at").withColumn("rank", rank).filter(F.col("rank") <= keep).select("alert_id", "rank")
    return alerts.select("project_id", "alert_id").join(newest, "alert_id", "left").select("project_id", "alert_id", F.coalesce("rank", F.lit(0)).alias("rank"), F.col("rank").isNull().alias("removed"))


def review_report(alerts: DataFrame) -> DataFrame:
    """Per type: total, and findings of high (0.8), medium (0.5) and low confidence."""
    c = F.col("confidence")
    return alerts.groupBy("alert_type").agg(F.count("*").alias("n"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"))


def weighted_vote(votes: DataFrame) -> DataFrame:
    """Per item: the candidate with the highest weighted mean score, and how close the runner-up comes."""
    g = votes.groupBy("item", "candidate").agg(F.sum(F.col("score") * F.col("weight")).alias("s"), F.sum("weight").alias("w"), F.count("*").alias("n"))
    g = g.withColumn("mean", F.round(F.col("s") / F.col("w"), 6))
    order = Window.partitionBy("item").orderBy(F.desc("mean"), "candidate")
    g = g.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("mean").over(order)).filter("rank = 1")
    return g.select("item", "candidate", "mean", F.when(F.col("next").isNull() | (F.col("mean") == 0), 0.0).otherwise(F.round(1 - (F.col("mean") - F.col("next")) / F.col("mean"), 6)).alias("ambiguity"))


def attribute_vote(votes: DataFrame) -> DataFrame:
    """One vote: score * (0.85 + 0.15 * weight); several: weighted mean plus min(0.15, 0.05 * (n - 1)), at most 1."""
    g = votes.groupBy("item", "candidate").agg(F.sum(F.col("score") * F.col("weight")).alias("s"), F.sum("weight").alias("w"), F.count("*").alias("n"), F.max("score").alias("one"))
    many = F.least(F.lit(1.0), F.col("s") / F.col("w") + F.least(F.lit(0.15), 0.05 * (F.col("n") - 1)))
    return g.select("item", "candidate", "n", F.round(F.when(F.col("n") == 1, F.col("one") * (0.85 + 0.15 * F.col("w"))).otherwise(many) + 1e-9, 6).alias("confidence"))


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Sessions of a user: events with gaps of at most gap_minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    new = F.coalesce(at - F.lag(at).over(w) > gap_minutes * 60_000_000, F.lit(True))
    numbered = events.withColumn("new", new.cast("int")).withColumn("session", F.sum("new").over(w))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.unix_micros(F.min(F.col("ts").cast("timestamp"))).alias("first_us"), F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("last_us")).withColumn("session", F.col("session").cast("long"))


def executed_phases(events: DataFrame) -> DataFrame:
    """Whether a phase ran in any of a project's runs, and the last run that had it."""
    return events.groupBy((F.col("user_id") % 10).alias("project_id"), F.col("event_type").alias("phase")).agg(F.max(F.col("value") > 50).alias("executed"), F.max("event_id").alias("last_run"))


def revisions(events: DataFrame) -> DataFrame:
    """Invalidation events with their revision (one more than the last of the project) and how many caches each marks stale."""
    e = events.filter("event_type in ('purchase', 'error')")
    rev = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    stale = F.when(F.col("event_type") == "error", 3).otherwise(1)
    return e.select("user_id", "event_id", "event_type", rev.alias("revision"), stale.alias("n_stale"))
