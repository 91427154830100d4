"""Structured Streaming jobs: the batch functions in micro-batches, deduplication within a watermark, retries with timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import BASE_SECONDS, MAX_ATTEMPTS


def run_available(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there in micro-batches and end; a restart goes on from ``checkpoint``."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_always(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str = "2 seconds") -> StreamingQuery:
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def append_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that may get a batch again: each batch has a directory of its own, which a repetition overwrites."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def dedup(stream: DataFrame, key: str = "checksum", ts: str = "ts", ttl: str = "168 hours") -> DataFrame:
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, ts: str = "ts", every: str = "10 seconds", late: str = "1 minute", kind: str = "event_type") -> DataFrame:
    """Events by type and window, once the watermark has passed."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every), F.coalesce(kind, F.lit("UNKNOWN")).alias(kind)).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, path: str = "path", ts: str = "ts", gap: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Debounce: the last event of each run of events closer than ``gap``."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), path).agg(F.max(ts).alias(ts), F.count(F.lit(1)).alias("merged"))


def retries(stream: DataFrame, key: str = "path", ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """``path``, ``attempt``, ``status``, ``retry_at`` for a stream of failures (path, ts): attempts are counted in state.

    A failure gives ``RETRYING`` with the time of the next attempt, or ``FAILED_FATAL``. When the watermark reaches that time a
    timer wakes the key and gives ``DUE``, unless another failure came first.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        attempt, due = state.get if state.exists else (0, None)
        if state.hasTimedOut:
            state.update((attempt, None))
            yield pd.DataFrame([(k[0], attempt, "DUE", pd.Timestamp(due, unit="us"))], columns=[key, "attempt", "status", "retry_at"])
            return
        out = []
        for frame in frames:
            for at in sorted(frame[ts]):
                attempt += 1
                wait = pd.Timedelta(seconds=BASE_SECONDS * 2 ** (min(attempt, MAX_ATTEMPTS) - 1))
                fatal = attempt > MAX_ATTEMPTS
                out.append((k[0], attempt, "FAILED_FATAL" if fatal else "RETRYING", pd.NaT if fatal else at + wait))
        last = out[-1][3]
        due = None if last is pd.NaT else int(last.value // 1000)
        state.update((attempt, due))
        if due is not None:
            state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "attempt", "status", "retry_at"])

    rows = stream.select(F.col(key).cast("string").alias(key), F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, late)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} string, attempt int, status string, retry_at timestamp", "attempt int, due long", "append", "EventTimeTimeout")


def dedup_ttl(stream: DataFrame, key: str = "checksum", ts: str = "ts", hours: int = 168, late: str = "0 seconds") -> DataFrame:
    """``key``, ``ts`` of accepted events: the first, then the first at least ``hours`` after the last *accepted* one.

    What a key's state holds is the time of that one; it goes when the watermark, ``late`` behind, has passed its term. Events
    that come before others of earlier times are taken as they come, as far as ``late`` allows.
    """
    ttl = pd.Timedelta(hours=hours)
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = np.sort(np.concatenate([f[ts].to_numpy("datetime64[us]") for f in frames]))
        last = np.datetime64(state.get[0], "us") if state.exists else None
        taken, at, term = [], 0, np.timedelta64(int(ttl.total_seconds() * 1_000_000), "us")
        while True:
            at = at if last is None else int(np.searchsorted(times, last + term))
            if at >= len(times):
                break
            last = times[at]
            taken.append(last)
        if taken:
            state.update((int(last.astype("int64")),))
        due = int((last + term).astype("int64"))
        state.setTimeoutTimestamp(max(-(-due // 1000), state.getCurrentWatermarkMs() + 1))
        if taken:
            yield pd.DataFrame({key: [k[0]] * len(taken), ts: pd.Series(taken)})

    rows = stream.where(F.col(ts).isNotNull()).select(F.col(key), F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, late)
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{ts}` timestamp", "last long", "append", "EventTimeTimeout")


def debounce(stream: DataFrame, path: str = "path", ts: str = "ts", delay: str = "delay_s", event: str = "event_id", late: str = "0 seconds") -> DataFrame:
    """``event``, ``path``, ``ts``, ``delay`` of events that no later event of their path resets within the seconds of their own ``delay``.

    A path's last event waits in its state; it is out when another one comes late enough, or when the watermark, ``late``
    behind, has passed its delay and the timer wakes the path. So each kind of event has its own delay, in append mode.
    """
    kinds = dict(stream.dtypes)
    names = [event, path, ts, delay]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting = [state.get] if state.exists else []
        out = []
        if state.hasTimedOut:
            out, waiting = waiting, []
        else:
            new = [(int(t.value // 1000), e, d) for f in frames for t, e, d in zip(f[ts], f[event], f[delay])]
            for row in sorted(new):
                if waiting and row[0] - waiting[0][0] >= waiting[0][2] * 1_000_000:
                    out += waiting
                waiting = [row]
        if waiting:
            us, e, d = waiting[0]
            state.update((int(us), int(e), int(d)))
            state.setTimeoutTimestamp(max(-(-(us + d * 1_000_000) // 1000), state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame([(e, k[0], pd.Timestamp(us, unit="us"), d) for us, e, d in out], columns=names)

    rows = stream.select(F.col(event).cast("long").alias(event), path, F.col(ts).cast("timestamp").alias(ts), F.col(delay).cast("long").alias(delay)).withWatermark(ts, late)
    return rows.groupBy(path).applyInPandasWithState(step, f"`{event}` long, `{path}` {kinds[path]}, `{ts}` timestamp, `{delay}` long", "us long, event long, delay long", "append", "EventTimeTimeout")


def collected(spark: SparkSession, stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into Parquet and read the result."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
