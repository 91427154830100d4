"""Sinks: topics with retries, the outbox publisher, topic handlers and the log of retries.

A topic is written through a ``send`` function of (topic, rows with ``key`` and ``value``); ``kafka`` is one. Rows are sent at
least once: what was sent before a failure may be sent again, and its keys make that harmless.
"""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import mark_published, outbox_batch
from .files import Store

Send = Callable[[str, DataFrame], None]
#: Topics of the pipeline's events.
TOPICS = ("chunk.created", "assertion.generated", "graph.update", "cluster.update", "version.update")
RETRY_LOG = "document_id string, attempt int, at timestamp, message string, trace string"


def kafka(servers: str) -> Send:
    """Rows to a Kafka topic; needs the connector's jar on the class path."""
    return lambda topic, rows: rows.select(F.col("key").cast("string"), F.col("value").cast("string")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def with_retries(send: Send, attempts: int = 3, first: float = 1.0, longest: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> Send:
    """``send`` that tries again after a second, doubling up to ten; the last failure is raised."""

    def run(topic: str, rows: DataFrame) -> None:
        for attempt in range(attempts):
            try:
                return send(topic, rows)
            except Exception:
                if attempt + 1 == attempts:
                    raise
                sleep(min(first * 2**attempt, longest))

    return run


def events(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` as events: ``key`` and the whole row as JSON."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def publish(outbox: DataFrame, send: Send, now, n: int = 100) -> DataFrame:
    """Send the oldest ``n`` unpublished events (id, topic, key_str, payload) topic by topic and return the outbox with their stamps.

    Events of a topic that could not be sent stay unpublished, and so do those whose payload is not JSON; the others go on.
    """
    batch = outbox_batch(outbox, n).where(F.try_parse_json("payload").isNotNull()).select("id", "topic", "key_str", "payload").collect()  # n rows
    spark, sent = outbox.sparkSession, []
    for topic in sorted({r["topic"] for r in batch}):
        own = [r for r in batch if r["topic"] == topic]
        try:
            send(topic, spark.createDataFrame([(r["key_str"], r["payload"]) for r in own], "key string, value string"))
            sent += [(r["id"],) for r in own]
        except Exception:
            traceback.print_exc()
    return mark_published(outbox, spark.createDataFrame(sent, outbox.select("id").schema), now)


def dispatch(handlers: dict[str, Callable[[DataFrame], None]], schemas: dict[str, str], active: Callable[[], bool] = lambda: True) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for rows with ``topic`` and ``value``: each topic's events, parsed, go to its handler.

    While ``active`` says no, events are acknowledged and dropped, as are those of topics without a handler.
    """

    def run(batch: DataFrame, _: int) -> None:
        if not active():
            return
        batch = batch.persist()
        try:
            for topic, handle in handlers.items():
                own = batch.where(F.col("topic") == topic).select(F.from_json(F.col("value").cast("string"), schemas[topic]).alias("e")).select("e.*")
                if not own.isEmpty():
                    handle(own)
        finally:
            batch.unpersist()

    return run


class RetryLog:
    """What went wrong with documents, attempt by attempt, as a table of a store."""

    def __init__(self, store: Store, name: str = "retry_log"):
        self.store, self.name = store, name

    def add(self, document_id: str, attempt: int, error: BaseException, at: datetime) -> None:
        trace = "".join(traceback.format_exception(error))
        self.store.append(self.name, self.store.spark.createDataFrame([(document_id, attempt, at, str(error), trace)], RETRY_LOG))

    def of(self, document_id: str) -> DataFrame:
        spark: SparkSession = self.store.spark
        rows = self.store.read(self.name) if self.store.exists(self.name) else spark.createDataFrame([], RETRY_LOG)
        return rows.where(F.col("document_id") == document_id).orderBy("at", "attempt")


def lines(row) -> str:
    """A failed attempt as a log shows it."""
    return f"[{row['at']}] Attempt #{row['attempt']} failed:\nError message: {row['message']}\nStacktrace:\n{row['trace']}"

