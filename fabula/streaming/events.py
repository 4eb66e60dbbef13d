"""Streaming forms of the event operators: the same semantics as the batch ones, over readStream with watermarks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fabula.sources.shared import shared_dir


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet event files as a stream; the schema comes from the files that are there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events and values of each type in tumbling event-time windows; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: events with gaps of under `gap`."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


#: How long a key's state is kept after its last event, in hours of event time; what a user may leave open before the oldest is given up.
KEEP_HOURS, MOST_OPEN = 24 * 30, 1000


def _keep(state: GroupState, last: pd.Timestamp, hours: int) -> None:
    """State goes when the watermark passes the key's last event by `hours`."""
    due = int(pd.Timestamp(last).timestamp() * 1000) + hours * 3_600_000
    state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))


def adaptive_weights(feedback: DataFrame, rate: float = 0.05, floor: float = 0.1, ceiling: float = 1.0, late: str = "10 minutes", keep_hours: int = KEEP_HOURS) -> DataFrame:
    """Running weights per (user_id, event_type) from feedback (dismissed), kept in state: the fold that batch runs over sorted rows.

    Rows of a key are applied in order of (ts, event_id) within each micro-batch. A key without feedback for keep_hours of event time is forgotten: its next feedback starts from 1."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        weight, n = state.get if state.exists else (1.0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for dismissed in rows["dismissed"]:
            weight = round(max(floor, min(ceiling, weight + (-rate if dismissed else rate / 2))), 4)
            n += 1
        state.update((weight, n))
        _keep(state, rows["ts"].iloc[-1], keep_hours)
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "weight": [weight], "n": [n]})

    keyed = feedback.withWatermark("ts", late).groupBy("user_id", "event_type")
    return keyed.applyInPandasWithState(update, "user_id long, event_type string, weight double, n long", "weight double, n long", "update", GroupStateTimeout.EventTimeTimeout)


def continuity(events: DataFrame, late: str = "10 minutes", keep_hours: int = KEEP_HOURS, most_open: int = MOST_OPEN) -> DataFrame:
    """Opening events (purchase) paired first in, first out with closing ones (error) of the same user, state kept per user: user_id, opened, closed.

    An opening event is given up, as a row without closed, when its user leaves more than most_open of them open, or has no event for keep_hours of event time. So state is bounded and nothing vanishes."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, out = list(state.get[0]) if state.exists else [], []
        if state.hasTimedOut:
            out = [(key[0], opened, None) for opened in waiting]
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for event_id, kind in zip(rows["event_id"], rows["event_type"], strict=True):
                if kind == "purchase":
                    waiting.append(int(event_id))
                    if len(waiting) > most_open:
                        out.append((key[0], waiting.pop(0), None))
                elif waiting:
                    out.append((key[0], waiting.pop(0), int(event_id)))
            state.update((waiting,))
            _keep(state, rows["ts"].iloc[-1], keep_hours)
        yield pd.DataFrame(out, columns=["user_id", "opened", "closed"]).astype({"user_id": "Int64", "opened": "Int64", "closed": "Int64"})

    kept = events.withWatermark("ts", late).filter("event_type in ('purchase', 'error')").groupBy("user_id")
    return kept.applyInPandasWithState(update, "user_id long, opened long, closed long", "waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def replayed_windows(spark: SparkSession, path: str, size: str = "1 hour") -> DataFrame:
    """Events of a folder or file replayed as a stream into tumbling windows, every update written to the shared folder: start, event_type, n, total as the last update of each window has them.

    The watermark lies so far back that no row is late: a replay holds all of the log."""
    folder = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    head, _, name = path.rpartition("/")
    # as a glob, as a stream takes a folder or a glob, but no single file by name
    counts = windowed_counts(stream(spark, f"{head}/[{name[0]}]{name[1:]}"), late="36500 days", size=size)

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{folder}/updates")

    q = counts.writeStream.foreachBatch(append).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema("start timestamp, event_type string, n long, total double, batch long").parquet(f"{folder}/updates")
    last = F.max_by(F.struct("n", "total"), "batch").alias("u")
    return rows.groupBy("start", "event_type").agg(last).select("start", "event_type", "u.n", "u.total")


def run_to_memory(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drives a stream over all that is available now into an in-memory table; for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
