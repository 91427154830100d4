"""State in streams over several runs: the same rows as a batch over everything, whatever is cut where."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from factgraph.operators import versions as V
from factgraph.sources.files import table_stream
from factgraph.streaming import jobs

SCHEMA = "event_id long, path string, ts timestamp_ntz, delay_s long"
START = datetime(2024, 1, 1)


def events(n=400, seed=4):
    rng, at = random.Random(seed), START
    rows = []
    for k in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 50, 300, 4000]))
        rows.append((k, rng.choice(["a", "b", "c", "hot", "hot", "hot"]), at, rng.choice([100, 200, 2000])))
    return rows + [(n, "end", at + timedelta(days=30), 1)]


def in_runs(spark, tmp_path, rows, cuts, work):
    """``work`` of a stream that gets its files in several runs with one checkpoint."""
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[a:b], SCHEMA).repartition(1).write.mode("append").parquet(folder)
        got = jobs.collected(spark, work(table_stream(spark, folder)), str(tmp_path / "checkpoint"), out)
    return got


def test_debounce_by_kind_in_runs(spark, tmp_path):
    rows = events()
    got = in_runs(spark, tmp_path, rows, [90, 91, 250], jobs.debounce)
    want = V.debounce(spark.createDataFrame(rows, SCHEMA)).where("path != 'end'")
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in want.collect())


def test_terms_from_acceptance_in_runs(spark, tmp_path):
    rows = events()
    got = in_runs(spark, tmp_path, rows, [1, 130, 300], lambda s: jobs.dedup_ttl(s, "path", hours=5))
    want = V.dedup_ttl(spark.createDataFrame(rows, SCHEMA), "path", hours=5)
    assert sorted((r["path"], r["ts"]) for r in got.select("path", F.col("ts").cast("timestamp_ntz").alias("ts")).collect()) == sorted((r["path"], r["ts"]) for r in want.collect())


def test_keys_of_equal_hash_are_told_apart(spark):
    """Runs of rows are told apart by the keys themselves, not by their marks alone."""
    rows = [(k, p, START + timedelta(hours=h), 1) for k, (p, h) in enumerate([("a", 0), ("b", 1), ("a", 2), ("b", 9), ("a", 10)])]
    marked = V.dedup_ttl(spark.createDataFrame(rows, SCHEMA), "path", hours=8, mark=F.lit(1).cast("long"))
    assert sorted((r["path"], r["ts"].hour) for r in marked.collect()) == [("a", 0), ("a", 10), ("b", 1), ("b", 9)]
