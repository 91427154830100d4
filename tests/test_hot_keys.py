"""Windows over one single key, near names among many, limits that hold, deleted documents, several tables at once."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factgraph.functions import predicates as P
from factgraph.operators import graph as G
from factgraph.operators import hot, retrieve
from factgraph.operators import metrics as X
from factgraph.operators import versions as V
from factgraph.sources import extractors, files

START = datetime(2024, 1, 1)


def events(n=600, key="one", seed=3):
    rng, at, out = random.Random(seed), START, []
    for k in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 2, 30, 7200]))
        out.append((k, key, at, float(rng.randint(0, 9))))
    return out


@pytest.fixture()
def spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


SCHEMA = "event_id long, key string, ts timestamp_ntz, value double"


@pytest.mark.parametrize("key", ["one", None])
def test_one_key_is_several_tasks(spread, key):
    rows = events(key=key)
    df = spread.createDataFrame(rows, SCHEMA)
    counted = V.rate_window(df, "key").withColumn("task", F.spark_partition_id()).collect()
    assert len(counted) == len(rows) and len({r["task"] for r in counted}) > 1
    for r in counted:
        assert r["in_window"] == sum(r["ts"] - timedelta(seconds=60) <= t <= r["ts"] for _, _, t, _ in rows)
    waits = {r["event_id"]: r["admitted_at"] for r in V.admitted(df, "key").collect()}
    admitted = []
    for k, _, t, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        at = max(t, admitted[-15] + timedelta(milliseconds=60_001)) if len(admitted) >= 15 else t
        admitted.append(at)
        assert waits[k] == at
    numbers = hot.numbered(df, "key", "ts", "event_id").collect()
    assert {r["event_id"]: r["_n"] for r in numbers} == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}


def test_growth_without_a_group_is_several_tasks(spread):
    rows = [(START + timedelta(hours=5 * k), float(k * k)) for k in range(60)]
    out = X.growth(spread.createDataFrame(rows, "at timestamp_ntz, n double")).withColumn("task", F.spark_partition_id()).orderBy("at").collect()
    assert [r["rate"] for r in out][1:] == [round((2 * k - 1) / 18000, 6) for k in range(1, 60)]
    assert out[0]["rate"] in (None, 0.0) and len({r["task"] for r in X.growth(spread.createDataFrame(rows, "at timestamp_ntz, n double")).withColumn("task", F.spark_partition_id()).collect()}) > 1


def test_running_maxima_over_blocks(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 100)) for k in range(200)]
    got = hot.running_max(spark.createDataFrame(rows, "k long, v long").withColumn("g", F.lit(1)), ["g"], "k", F.col("v"), "m", block=7).orderBy("k").collect()
    assert [r["m"] for r in got] == [max(v for _, v in rows[: k + 1]) for k in range(200)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_near_names_meet_by_shortened_forms(spark):
    rng = random.Random(8)
    active = ["CONTAINS", "USES", "HAS", "IS", "A", "PART_OF", "DEPENDS_ON", "CALLS"]
    names = {"", "A", "AB", "ABC", "CONTANS", "XCONTAINSX", "SU", "CALLSXY", "PARTOF"}
    for _ in range(150):
        name = list(rng.choice(active))
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(name))
            name[at : at + rng.randint(0, 1)] = rng.choice(["", "Q", "S"])
        names.add("".join(name))
    df, taxonomy = spark.createDataFrame([(n,) for n in names], "predicate string"), spark.createDataFrame([(a,) for a in active], "name string")
    want = {}
    for n in names:
        near = sorted((distance(n, a), len(a), a) for a in active if distance(n, a) <= 2)
        if near:
            want[n] = (near[0][2], near[0][0])
    assert {r["predicate"]: (r["nearest"], r["distance"]) for r in P.nearest(df, taxonomy).collect()} == want


def test_few_candidates_among_many_names(spark):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    digit = lambda k: F.substring(F.lit(letters), (F.conv(F.substring(F.md5(F.col("id").cast("string")), k, 2), 16, 10).cast("int") % 26) + 1, F.lit(1))
    names = spark.range(20_000).select(F.concat(*(digit(2 * k + 1) for k in range(12))).alias("predicate"))
    active = P.seed(spark)
    pairs = P.near_pairs(names, active).count()
    assert pairs < 10 * 20_000


def test_calls_a_minute_are_not_exceeded_by_tasks(spark):
    chunks = spark.createDataFrame([(f"c{k}", "S", "text") for k in range(5)], "chunk_id string, section_path string, content string")
    asked = extractors.http(chunks, "http://none", extractors.request_template("ollama"), [], "m", tasks=8, per_minute=5, send=lambda *a: "x")
    assert asked.rdd.getNumPartitions() == 5 and asked.count() == 5


def test_deleted_documents_are_not_explained_or_looked_up(spark):
    facts = [("d1", 1, "A", "USES", "B", "t"), ("d2", 2, "B", "USES", "C", "t"), ("d2", 3, "C", "USES", "D", "t"), ("d3", 4, "A", "HAS", "C", "t")]
    a = G.identify(spark.createDataFrame(facts, "document_id string, seq long, subject string, predicate string, object string, raw_text string")).cache()
    ids = {r["seq"]: r["assertion_id"] for r in a.collect()}
    gone = spark.createDataFrame([("d2",)], "document_id string")
    assert retrieve.lookup(a, ids[2], gone).count() == 0 == retrieve.explain(a, ids[2], deleted=gone).count()
    left = a.where("document_id != 'd2'")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(retrieve.explain(a, ids[1], deleted=gone)) == rows(retrieve.explain(left, ids[1])) != rows(retrieve.explain(a, ids[1]))
    assert rows(retrieve.render_explanation(a, ids[1], deleted=gone)) == rows(retrieve.render_explanation(left, ids[1]))
    a.unpersist()


def test_long_lists_say_how_many_more(spark):
    ids = spark.createDataFrame([(f"n{k}",) for k in range(5)], "id string")
    assert [r["line"] for r in retrieve._listed(ids, "NODES", 0, 3).collect()] == ["NODES (5): n0, n1, n2 and 2 more"]
    assert [r["line"] for r in retrieve._listed(ids, "NODES", 0).collect()] == ["NODES (5): n0, n1, n2, n3, n4"] and retrieve._listed(ids.limit(0), "X", 0).count() == 0


def test_tables_of_an_action_change_together(spark, tmp_path, monkeypatch):
    store = files.Store(spark, f"file://{tmp_path}/store")
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    store.write_all({"a": frame(1), "b": frame(1)})
    bad = frame(2).select(F.raise_error(F.lit("lost")).cast("int").alias("x"))
    with pytest.raises(Exception, match="lost"):
        store.write_all({"a": frame(2), "b": bad})
    assert [store.read(n).first()["x"] for n in "ab"] == [1, 1]
    real = store._snapshot

    def raced(name, df, after=None):
        done = real(name, df, after)
        if name == "b":
            monkeypatch.undo()
            store.write("b", frame(7))
        return done

    monkeypatch.setattr(store, "_snapshot", raced)
    with pytest.raises(files.Conflict):
        store.write_all({"a": frame(3), "b": frame(3)})
    assert [store.read(n).first()["x"] for n in "ab"] == [1, 7]
