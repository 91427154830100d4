"""The jobs: two runs over growing copies of the tables, runs that fail in between, reruns, odd rows, and the command lines."""

from __future__ import annotations

import json
import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from factgraph.operators import deltas as D
from factgraph.operators import graph as G
from jobs import ingest_documents, monthly_graph

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def rows(df, *drop):
    return sorted(str(r) for r in df.drop(*drop).collect())


def same(spark, one, other):
    a, b = ingest_documents.tables(spark, one), ingest_documents.tables(spark, other)
    assert rows(a["documents"], "version") == rows(b["documents"], "version")
    assert rows(a["chunks"], "fresh") == rows(b["chunks"], "fresh")
    for name in ("edges", "nodes"):
        assert rows(a[name]) == rows(b[name]), name
    assert rows(a["facts"], "raw_text") == rows(b["facts"], "raw_text")


def document(k, text, lang="en"):
    return (k, text, lang, "s", len(text or ""))


FIRST = [document(1, "Alpha is beta. Beta is gamma."), document(2, "# One\n\nAlpha is beta\n\n## Two\n\nDelta was eta"), document(3, None), document(4, "Gamma is here. Alpha IS beta"), document(None, "Nameless is nothing")]
#: A copy under a new identifier, a document that loses a fact and gets one, one without change, and one that is emptied.
MORE = [document(5, "Alpha is beta. Beta is gamma."), document(2, "# One\n\nAlpha is beta\n\n## Two\n\nZeta ist theta"), document(1, "Alpha is beta. Beta is gamma."), document(4, "")]
FINAL = [FIRST[0], MORE[0], MORE[1], FIRST[2], MORE[3], FIRST[4]]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, folder, name, data):
    """One more file in a table's folder."""
    aside = f"{folder}-{name}"
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(aside)
    os.makedirs(folder, exist_ok=True)
    shutil.move(next(Path(aside).glob("*.parquet")), f"{folder}/{name}.parquet")


def test_ingest_takes_what_is_new(spark, tmp_path):
    docs, out, checkpoint = (str(tmp_path / n) for n in ("docs", "out", "checkpoint"))
    put(spark, docs, "a", FIRST)
    assert ingest_documents.ingest(spark, docs, out, checkpoint) == 1
    edges = {(r["predicate"], r["support"]) for r in ingest_documents.tables(spark, out)["edges"].collect()}
    assert edges == {("IS", 3), ("IS", 1), ("WAS", 1)}
    assert ingest_documents.ingest(spark, docs, out, checkpoint) == 0
    put(spark, docs, "b", MORE)
    assert ingest_documents.ingest(spark, docs, out, checkpoint) == 1
    t = ingest_documents.tables(spark, out)
    assert {r["document_id"]: r["version"] for r in t["documents"].collect()} == {"1": 1, "2": 2, "3": 1, "4": 2, "5": 1}
    written = ingest_documents._read(spark, out, "records").where("batch = 1")
    assert [r["subject"] for r in written.collect()] == ["Zeta"]  # only what was never seen is extracted
    assert {(r["subject"], r["sign"]) for r in ingest_documents._read(spark, out, "facts").where("batch = 1 and document_id = '2'").collect()} == {("Delta", -1), ("Zeta", 1)}
    put(spark, str(tmp_path / "all"), "a", FINAL)
    ingest_documents.ingest(spark, str(tmp_path / "all"), str(tmp_path / "out-2"), str(tmp_path / "checkpoint-2"))
    same(spark, out, str(tmp_path / "out-2"))


@pytest.mark.parametrize("where", ["firsts", "edges"])
def test_ingest_goes_on_after_a_failure(spark, tmp_path, monkeypatch, where):
    docs, out, checkpoint = (str(tmp_path / n) for n in ("docs", "out", "checkpoint"))
    put(spark, docs, "a", FIRST)
    ingest_documents.ingest(spark, docs, out, checkpoint)
    put(spark, docs, "b", MORE)
    real = ingest_documents._put

    def broken(table, folder, name, batch):
        done = real(table, folder, name, batch)
        if name == where:
            raise OSError("lost")
        return done

    monkeypatch.setattr(ingest_documents, "_put", broken)
    with pytest.raises(StreamingQueryException):
        ingest_documents.ingest(spark, docs, out, checkpoint)
    monkeypatch.setattr(ingest_documents, "_put", real)
    assert ingest_documents.ingest(spark, docs, out, checkpoint) == 1
    put(spark, str(tmp_path / "all"), "a", FINAL)
    ingest_documents.ingest(spark, str(tmp_path / "all"), str(tmp_path / "out-2"), str(tmp_path / "checkpoint-2"))
    same(spark, out, str(tmp_path / "out-2"))


def test_ingest_of_an_empty_table(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    put(spark, docs, "a", [])
    ingest_documents.ingest(spark, docs, out, str(tmp_path / "checkpoint"))
    assert all(t.count() == 0 for t in ingest_documents.tables(spark, out).values())


@here
def test_ingest_of_a_driver_table_in_two_runs(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    folder, out, checkpoint = (str(tmp_path / n) for n in ("docs", "out", "checkpoint"))
    for name, part in (("a", docs[:120]), ("b", docs[120:])):
        put(spark, folder, name, [tuple(r) for r in part])
        ingest_documents.ingest(spark, folder, out, checkpoint)
    ingest_documents.ingest(spark, f"{SF}/documents.parquet", str(tmp_path / "out-2"), str(tmp_path / "checkpoint-2"))
    same(spark, out, str(tmp_path / "out-2"))


ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"
LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"


def shop(spark, folder, orders, lines):
    o = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d string").select("o_orderkey", "o_custkey", F.to_timestamp_ntz("d").alias("o_orderdate"))
    o.write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, LINES).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")


def test_monthly_graph_replaces_its_months_alone(spark, tmp_path):
    folder, out = str(tmp_path / "tables"), str(tmp_path / "out")
    day = "2024-{:02d}-03 00:00:00".format
    orders, lines = [(1, 7, day(1)), (2, 7, day(2)), (3, 8, day(2)), (4, 9, None)], [(1, 1, 5, 2), (2, 1, 5, 2), (2, 2, 6, 2), (3, 1, 5, 2), (4, 1, 5, 2), (99, 1, 1, 1)]
    shop(spark, folder, orders, lines)
    assert monthly_graph.build(spark, folder, out) == ["2024-01", "2024-02"]
    first = {n: rows(monthly_graph.read_table(spark, out, n)) for n in monthly_graph.SCHEMAS}
    monthly_graph.build(spark, folder, out)
    assert first == {n: rows(monthly_graph.read_table(spark, out, n)) for n in monthly_graph.SCHEMAS}
    shop(spark, folder, orders + [(5, 7, day(2)), (6, 7, day(1))], lines)
    config = monthly_graph.Config(first="2024-02", last="2024-02")
    assert monthly_graph.build(spark, folder, out, config) == ["2024-02"]
    now = {r["month"]: r["documents"] for r in monthly_graph.read_table(spark, out, "metrics").collect()}
    assert now == {"2024-01": 1, "2024-02": 3}
    provides = monthly_graph.whole(spark, out).where("predicate = 'PROVIDES'").orderBy("support").collect()
    assert [(r["support"], r["document_id"]) for r in provides] == [(1, "order/2"), (3, "order/1")]


@here
def test_monthly_graph_merges_to_the_whole_graph(spark, tmp_path):
    monthly_graph.build(spark, SF, str(tmp_path / "out"))
    orders = spark.read.parquet(f"{SF}/orders.parquet").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    whole = G.edges(G.identify(monthly_graph.facts(orders, spark.read.parquet(f"{SF}/lineitem.parquet"))))
    assert rows(monthly_graph.whole(spark, str(tmp_path / "out")), "document_id") == rows(whole.select("edge_id", "from_node_id", "predicate", "to_node_id", "support"))


@here
@pytest.mark.parametrize("job", ["ingest_documents", "monthly_graph"])
def test_command_lines(tmp_path, job):
    own = ["--documents", f"{SF}/documents.parquet", "--checkpoint", f"{tmp_path}/checkpoint"] if job == "ingest_documents" else ["--tables", SF]
    config = json.loads((ROOT / f"jobs/{job}.json").read_text())
    config |= {} if job == "ingest_documents" else {"first": "1995-01", "last": "1995-03"}
    (tmp_path / "config.json").write_text(json.dumps(config))
    done = subprocess.run([sys.executable, str(ROOT / f"jobs/{job}.py"), "--master", "local[2]", "--config", str(tmp_path / "config.json"), "--out", f"{tmp_path}/out", *own], capture_output=True, text=True, timeout=600, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "wrote" in done.stderr and "read" in done.stderr and any(Path(f"{tmp_path}/out").iterdir())


def test_deltas_are_builds_from_scratch(spark):
    """Random additions and removals, also of first and last writers and of all that an edge or node has."""
    rng = random.Random(11)
    facts = [(f"d{rng.randint(0, 9)}", k, rng.choice("ab_ A").strip() or "a", rng.choice(["IS", "HAS"]), rng.choice("abcde"), "t") for k in range(120)]
    every = G.identify(spark.createDataFrame(facts, "document_id string, seq long, subject string, predicate string, object string, raw_text string")).cache()
    before = every.where("seq < 70")
    state = D.build(before)
    for condition in ("seq between 30 and 99", "seq % 2 = 0", "document_id < 'd2'", "seq < 0", "true"):
        after = every.where(condition)
        moved = D.advance(state, D.changes(before, after, "assertion_id"), after)
        new, scratch = D.replace(state, moved), D.build(after)
        for name in ("edges", "nodes"):
            assert rows(new[name].select(*scratch[name].columns)) == rows(scratch[name]), (condition, name)
        gone = state["edges"].select("edge_id").join(scratch["edges"], "edge_id", "left_anti")
        assert rows(D.orphans(moved, "edges")) == rows(gone)
        before, state = after, {n: spark.createDataFrame(new[n].collect(), new[n].schema) for n in new}
    assert rows(D.edges(state).select("edge_id", "document_id", "support")) == rows(G.edges(every).select("edge_id", "document_id", "support"))
