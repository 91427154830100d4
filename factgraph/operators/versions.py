"""Versions of documents, chunk differences between them, and skips of work already done."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import hot


def by_checksum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``checksum``, the first document that has it, and how many do."""
    return docs.groupBy(T.sha256(F.coalesce(text_col, F.lit(""))).alias("checksum")).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"))


def versions(events: DataFrame, path: str = "path", order: str = "seq", text_col: str = "text") -> DataFrame:
    """Content changes of each path, numbered: an unchanged checksum makes no version. Run ids follow from path and version."""
    w = Window.partitionBy(path).orderBy(order)
    rows = events.select(path, order, T.sha256(F.col(text_col)).alias("checksum"))
    changed = rows.withColumn("before", F.lag("checksum").over(w)).where(~F.col("checksum").eqNullSafe(F.col("before")))
    out = changed.withColumn("version", F.row_number().over(w))
    return out.select(path, order, "checksum", "version", T.sha256(F.concat_ws("|", F.col(path), F.col("version"))).alias("ingestion_run_id"), T.project_root(F.col(path)).alias("project_root"))


def runs(version_rows: DataFrame, states: DataFrame | None = None, trigger: str = "FILE_EVENT") -> DataFrame:
    """One ingestion run for each version: ``ingestion_run_id``, ``document_id`` (the path), ``run_status``, ``triggered_by``, ``created_at``.

    A run's status follows from its document's: the latest run of a queryable document is completed, of a failed one failed, of
    others started; earlier runs are superseded.
    """
    last = Window.partitionBy("path").orderBy(F.desc("version"))
    rows = version_rows.withColumn("_n", F.row_number().over(last))
    if states is None:
        status = F.when(F.col("_n") > 1, "SUPERSEDED").otherwise("STARTED")
    else:
        rows = rows.join(states.select("path", "status"), "path", "left")
        status = F.when(F.col("_n") > 1, "SUPERSEDED").when(F.col("status") == "QUERYABLE", "COMPLETED").when(F.col("status").startswith("FAILED"), "FAILED").otherwise("STARTED")
    return rows.select("ingestion_run_id", F.col("path").alias("document_id"), status.alias("run_status"), F.lit(trigger).alias("triggered_by"), F.col("seq").alias("created_at"))


def skip_unchanged(files: DataFrame, states: DataFrame) -> DataFrame:
    """``files`` (path, checksum) without those that are queryable with the same checksum already."""
    return files.join(states.where("status = 'QUERYABLE'").select("path", "checksum").distinct(), ["path", "checksum"], "left_anti")


def version_tag(version, checksum):
    return F.format_string("v%05d-%s", version, F.substring(checksum, 1, 8))


def diff(chunks: DataFrame) -> DataFrame:
    """``chunks`` (document_id, version, sequence_number, chunk_checksum) with ``previous_sequence``: the first chunk of the version before with the same checksum."""
    before = chunks.groupBy("document_id", (F.col("version") + 1).alias("version"), "chunk_checksum").agg(F.min("sequence_number").alias("previous_sequence"))
    return chunks.join(before, ["document_id", "version", "chunk_checksum"], "left")


def unchanged(chunks: DataFrame) -> DataFrame:
    return diff(chunks).where("previous_sequence is not null")


def to_extract(chunks: DataFrame, completed: DataFrame | None = None) -> DataFrame:
    """Chunks that an extractor must see: changed ones, without those that a run had completed."""
    out = diff(chunks).where("previous_sequence is null").drop("previous_sequence")
    return out if completed is None else out.join(completed, ["document_id", "version", "chunk_checksum"], "left_anti")


def carry_forward(chunks: DataFrame, assertions: DataFrame) -> DataFrame:
    """Assertions (document_id, version, sequence_number, ...) of unchanged chunks, re-keyed to the new version."""
    same = unchanged(chunks).select("document_id", "version", "sequence_number", "previous_sequence")
    old = assertions.withColumnRenamed("version", "_version").withColumnRenamed("sequence_number", "previous_sequence")
    hit = same.join(old, ["document_id", "previous_sequence"]).where(F.col("_version") == F.col("version") - 1)
    return hit.drop("_version", "previous_sequence")


def new_assertions(rows: DataFrame, existing: DataFrame, order: str = "seq") -> DataFrame:
    """The first of each (document, version, semantic checksum) that ``existing`` does not have."""
    key = ["document_id", "version", "semantic_checksum"]
    w = Window.partitionBy(*key).orderBy(order)
    return rows.join(existing, key, "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def debounce(events: DataFrame, path: str = "path", ts: str = "ts", delay: str = "delay_s") -> DataFrame:
    """Events that no later event of their path resets: the next is at least ``delay_s`` seconds away."""
    w = Window.partitionBy(path).orderBy(ts, "event_id")
    gap = F.unix_micros(F.lead(ts).over(w).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= F.col(delay) * 1_000_000)).drop("_gap")


def rate_window(calls: DataFrame, key: str, ts: str = "ts", seconds: int = 60, limit: int = 15) -> DataFrame:
    """Calls of a key in the last ``seconds`` and whether the limit allows this one; calls without a time are left out."""
    return hot.counted_back(calls.where(F.col(ts).isNotNull()), key, ts, seconds, "in_window").withColumn("allowed", F.col("in_window") <= limit)


def admitted(calls: DataFrame, key: str, ts: str = "ts", order: str = "event_id", limit: int = 15, window_ms: int = 60_001) -> DataFrame:
    """``admitted_at`` of each call when those beyond ``limit`` a window wait, first come first served, instead of being refused.

    The k-th call waits for the (k - limit)-th to leave the window. So every ``limit``-th call is a chain, a(k) = max(t(k),
    a(k - 1) + window), which is a running maximum of t(k) - k * window, plus k * window. Both the numbers of calls and the
    maxima are found slice by slice.
    """
    rows = hot.numbered(calls, key, ts, order).withColumn("_chain", F.col("_n") % limit).withColumn("_k", F.floor(F.col("_n") / limit))
    step = F.col("_k") * (window_ms * 1000)
    out = hot.running_max(rows, [key, "_chain"], "_k", hot.micros(ts) - step, "_at")
    return out.withColumn("admitted_at", F.timestamp_micros(F.col("_at") + step).cast("timestamp_ntz")).drop("_n", "_chain", "_k", "_at")


def dedup_ttl(events: DataFrame, key: str, ts: str = "ts", hours: int = 168, mark: Column | None = None) -> DataFrame:
    """``key``, ``ts`` of accepted events: the first, then the first at least ``hours`` after the last *accepted* one.

    Acceptance is a chain. Events are dealt by key and sorted, and a task walks along them with one time in hand, from one
    accepted event straight to the next; it holds a batch of rows, whatever a key has. Null times are left out.
    """
    ttl = hours * 3600 * 1_000_000
    kind = dict(events.dtypes)[key]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, None
        for batch in batches:
            marks, times = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            keys = batch.column(0)
            other = marks[1:] != marks[:-1]
            if batch.num_rows > 1:  # equal marks may be of two keys, whose rows follow each other
                other |= ~pc.fill_null(pc.equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False) & ~(pc.is_null(keys[1:]).to_numpy(zero_copy_only=False) & pc.is_null(keys[:-1]).to_numpy(zero_copy_only=False))
            ends = [*(np.flatnonzero(other) + 1).tolist(), len(marks)]
            taken, begin = [], 0
            for end in ends:
                if end == begin:
                    continue
                own = keys[begin].as_py()
                at = begin if last is None or own != last_key else begin + int(np.searchsorted(times[begin:end], last + ttl))
                last_key = own
                while at < end:
                    taken.append(at)
                    last = int(times[at])
                    at = begin + int(np.searchsorted(times[begin:end], last + ttl))
                begin = end
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken, pa.int64())), batch.column(2).take(pa.array(taken, pa.int64()))], [key, "us"])

    # A hash stands for the key where rows are dealt; two keys of one hash follow each other and are told apart.
    mark = F.xxhash64(key) if mark is None else mark
    rows = events.where(F.col(ts).isNotNull()).select(F.col(key), mark.alias("mark"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    dealt = rows.repartition("mark").sortWithinPartitions("mark", key, "us").mapInArrow(walk, f"`{key}` {kind}, us long")
    return dealt.select(key, F.timestamp_micros("us").cast("timestamp_ntz").alias(ts))


def owners(paths: DataFrame, workers: DataFrame, path: str = "path") -> DataFrame:
    """The worker of each path by rendezvous hashing; of equal weights the first name. Workers are few and checked to be.

    A cluster has at most thousands of workers, which are held in an array literal, so no join multiplies the paths.
    """
    from ..functions.times import rendezvous_weight

    names = sorted(r[0] for r in workers.select("worker_id").distinct().limit(10_001).collect())
    if len(names) > 10_000:
        raise ValueError("more than 10,000 workers")
    scored = F.transform(F.lit(names) if names else F.array().cast("array<string>"), lambda w: F.struct((-rendezvous_weight(w, F.col(path))).alias("low"), w.alias("w")))
    return paths.withColumn("owner", F.array_min(scored)["w"])
