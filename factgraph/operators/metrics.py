"""Metrics, retries, recovery, the outbox and progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hot

from ..functions.times import MAX_ATTEMPTS, backoff_seconds, next_stage

LATE_SECONDS = 15


def ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """``metric``, ``value``: rows of each table."""
    counts = [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def event_counts(events: DataFrame, kind: str = "event_type") -> DataFrame:
    return events.groupBy(F.coalesce(kind, F.lit("UNKNOWN")).alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


def failures(events: DataFrame, kind: str = "event_type", failed: str = "error") -> DataFrame:
    return events.agg(F.count_if(F.col(kind) == failed).alias("failed"), F.avg(F.when(F.col("value") > 0, F.col("value"))).alias("mean_latency"))


def total_tokens(chunks: DataFrame, tokens: str = "token_estimate") -> DataFrame:
    """``total_tokens``: 0 where there is no chunk or none is counted."""
    return chunks.agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("total_tokens"))


def latency(events: DataFrame, now, kind: str = "DOCUMENT_GRAPH_READY", ts: str = "ts") -> DataFrame:
    """``n``, ``mean_latency_ms`` of events of a kind: from the event's time to ``now`` (a column: when it was handled), if positive."""
    ms = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1000
    late = events.where(F.col("event_type") == kind).select(ms.alias("ms")).where("ms > 0")
    return late.agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_latency_ms"))


def recent(events: DataFrame, n: int = 50, ts: str = "ts", key: str = "event_id") -> DataFrame:
    return events.orderBy(F.desc(ts), F.desc(key)).limit(n)


def throughput(events: DataFrame, ts: str = "ts", every: str = "10 seconds", points: int = 60) -> DataFrame:
    """Events in the last ``points`` windows that have any."""
    out = events.groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "n").orderBy(F.desc("window_start")).limit(points)


def growth(snapshots: DataFrame, at: str = "at", value: str = "n", group: str | None = None) -> DataFrame:
    """Change of a value a second between snapshots."""
    rows = hot.previous(snapshots, [group] if group else [], at, [value])
    before = F.col("_previous")
    seconds = (hot.micros(at) - F.unix_micros(before[at].cast("timestamp"))) / 1_000_000
    return rows.withColumn("rate", F.round(ratio(F.col(value) - before[value], seconds), 6)).drop("_previous")


def progress(snapshots: DataFrame, at: str = "at", job: str = "job") -> DataFrame:
    """Percent, throughput (only over more than two seconds) and whole seconds left, from ``processed`` and ``total``."""
    w = Window.partitionBy(job).orderBy(at)
    seconds = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) / 1_000_000
    speed = F.when(seconds > 2, (F.col("processed") - F.lag("processed").over(w)) / seconds)
    percent = F.least(F.lit(100), F.when(F.col("total") > 0, F.round(F.col("processed") * 100 / F.col("total"))).otherwise(0)).cast("long")
    out = snapshots.withColumn("percent", percent).withColumn("throughput", F.round(speed, 6))
    return out.withColumn("eta_s", F.when(speed > 0, F.floor((F.col("total") - F.col("processed")) / speed)).cast("long"))


def status_list(states: DataFrame) -> DataFrame:
    """States with the share of chunks done and a bucket, by path."""
    done = F.size(F.filter(F.array_distinct(F.split(F.coalesce("completed_chunks", F.lit("")), ",")), lambda c: c != ""))
    bucket = F.when(F.col("status").isin("QUERYABLE"), "ok").when(F.col("status").startswith("FAILED"), "failed").when(F.col("status") == "RETRYING", "retrying").otherwise("running")
    return states.select("path", "status", bucket.alias("bucket"), done.cast("long").alias("done"), "total_chunks", F.round(ratio(done.cast("double"), F.col("total_chunks")), 6).alias("progress"))


def find_state(states: DataFrame, path: str) -> DataFrame:
    """The state of a path, or of the first path with its file name."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    rank = F.when(F.col("path") == path, 0).when(F.col("path") == name, 1).when(F.col("path").endswith("/" + name), 2)
    return states.where(rank.isNotNull()).orderBy(rank, "path").limit(1)


def severity(kind):
    return F.when(F.contains(kind, F.lit("FAILED")), "error").when(F.contains(kind, F.lit("COMPLETED")) | F.contains(kind, F.lit("READY")) | F.contains(kind, F.lit("CREATED")), "success").otherwise("info")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Latest-wins merge: of each key the row of the last ``order``."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def schedule_retries(states: DataFrame, now) -> DataFrame:
    """``next_status``, ``next_retry_at`` of failed stages: backoff doubles until attempts run out."""
    more = F.col("retry_count") < MAX_ATTEMPTS
    attempt = F.least(F.col("retry_count") + 1, F.lit(MAX_ATTEMPTS))
    at = F.timestamp_micros(F.unix_micros(now.cast("timestamp")) + backoff_seconds(attempt).cast("long") * 1_000_000)
    return states.withColumn("next_status", F.when(more, "RETRYING").otherwise("FAILED_FATAL")).withColumn("next_retry_at", F.when(more, at.cast("timestamp_ntz")))


def due(states: DataFrame, now) -> DataFrame:
    return states.where((F.col("status") == "RETRYING") & (F.col("next_retry_at") <= now))


def recover(states: DataFrame) -> DataFrame:
    return states.withColumn("next_stage", next_stage(F.col("status"), F.col("current_stage"), F.col("total_chunks") > 0))


def stale_workers(beats: DataFrame, now, seconds: int = LATE_SECONDS) -> DataFrame:
    last = beats.groupBy("worker_id").agg(F.max("ts").alias("last_beat"))
    return last.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_beat").cast("timestamp")) > seconds * 1_000_000)


def workers(beats: DataFrame, now, seconds: int = LATE_SECONDS) -> DataFrame:
    """``worker_id``, ``last_beat`` of live workers, by name."""
    last = beats.groupBy("worker_id").agg(F.max("ts").alias("last_beat"))
    return last.join(stale_workers(beats, now, seconds), "worker_id", "left_anti").orderBy("worker_id")


def failed_states(states: DataFrame, now) -> DataFrame:
    """States of failed stages as they go on: the retry is counted, and ``status``, ``next_retry_at`` follow; out of attempts, progress is lost."""
    planned = schedule_retries(states, now)
    lost = F.col("next_status") == "FAILED_FATAL"
    done = [F.when(~lost, F.col(c)).otherwise(empty).alias(c) for c, empty in (("completed_chunks", F.lit("")), ("total_chunks", F.lit(0))) if c in states.columns]
    kept = [c for c in states.columns if c not in ("status", "retry_count", "next_retry_at", "completed_chunks", "total_chunks")]
    return planned.select(*kept, F.col("next_status").alias("status"), (F.col("retry_count") + 1).alias("retry_count"), "next_retry_at", *done)


def outbox_batch(outbox: DataFrame, n: int = 100) -> DataFrame:
    """The oldest unpublished events."""
    return outbox.where("published_at is null").orderBy("created_at", "id").limit(n)


def mark_published(outbox: DataFrame, sent: DataFrame, now) -> DataFrame:
    done = sent.select("id").distinct().withColumn("_sent", F.lit(True))
    return outbox.join(done, "id", "left").withColumn("published_at", F.coalesce("published_at", F.when(F.col("_sent"), now))).drop("_sent")
