"""The index of segments against scans of what is there, whatever was added, deleted, added again and merged."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from factgraph.functions import text as T
from factgraph.operators import graph as G
from factgraph.operators import index as I
from factgraph.operators import retrieve as R
from factgraph.operators import segments as S
from factgraph.session import scratch

FACTS = "document_id string, seq long, subject string, predicate string, object string, raw_text string"
QUESTIONS = [("alpha holds beta", 3), ("holds", 20), ("w3 w17 holds alpha", 20), ("unheard", 3)]


def facts(spark, seed, documents, n):
    rng = random.Random(seed)
    names = ["Alpha", "Beta", "Gamma", *(f"W{k}" for k in range(40))]
    rows = []
    for k in range(n):
        a, b = rng.choice(names), rng.choice(names[: rng.randint(1, 43)])
        rows.append((rng.choice(documents), seed * 100_000 + k, a, "HOLDS", b, f"{a} holds {b} " + " ".join(rng.choice(names) for _ in range(rng.randint(0, 6)))))
    return G.identify(spark.createDataFrame(rows, FACTS))


def listed(df):
    return sorted(str(r) for r in df.select(*sorted(df.columns)).collect())


def same(spark, index, live):
    plain = R.Plain(live.cache())
    for question, k in QUESTIONS:
        a, b = ({r["assertion_id"]: round(r["bm25_score"], 9) for r in R.bm25(x, question, k).collect()} for x in (index, plain))
        assert a == b, question
    assert listed(index.postings().select("term", "assertion_id", "tf", "dl")) == listed(plain.postings().select("term", "assertion_id", "tf", "dl"))
    start = spark.range(1).select(T.node_id(F.lit("W7")).alias("node_id"))
    assert listed(R.neighbours(index, start, 1)) == listed(R.neighbours(plain, start, 1))
    some = [r["assertion_id"] for r in live.limit(3).collect()]
    assert listed(R.lookup(index, some[0])) == listed(R.lookup(plain, some[0])) if some else index.n == 0
    assert index.n == live.count() and abs(index.mean_length - plain.statistics()[1]) < 1e-12


@pytest.mark.parametrize("hot", [S.HOT, 60])
def test_additions_deletions_and_merges(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "PER_BLOCK", 16)
    monkeypatch.setattr(S, "PER_BUCKET", 100)
    folder = str(tmp_path / "index")
    one, two, again = facts(spark, 1, ["d1", "d2", "d3"], 300), facts(spark, 2, ["d4", "d5"], 150), facts(spark, 3, ["d2"], 50)
    index = S.build(one, folder)
    index = index.append(two)
    index = index.delete(spark.createDataFrame([("d2",), ("d4",), ("nobody",)], "document_id string"))
    left = one.unionByName(two).where("document_id not in ('d2', 'd4')")
    same(spark, index, left)
    index = index.append(again)  # a deleted document comes back
    same(spark, S.open_index(spark, folder), left.unionByName(again))
    for apart in ([0, 1], [2, 3], [0]):
        with pytest.raises(ValueError):
            index.merge(apart)
    assert listed(R.query_graph(index, "w3 w17 holds alpha", 1, k=3)) == listed(R.query_graph(left.unionByName(again), "w3 w17 holds alpha", 1, k=3))
    merged = index.merge()
    assert len(merged.segments) == 1
    same(spark, merged, left.unionByName(again))
    grown = merged.append(facts(spark, 4, ["d6"], 30)).append(facts(spark, 5, ["d7"], 30))
    assert len(grown.merge([5, 6]).segments) == 2 and S.open_index(spark, folder).n == grown.n  # two small ones among themselves
    assert S.open_index(spark, folder).delete(spark.createDataFrame([(f"d{k}",) for k in range(1, 8)], "document_id string")).n == 0


def test_only_new_files_are_written_and_half_segments_are_not_seen(spark, tmp_path):
    folder = str(tmp_path / "index")
    files = lambda: {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names}
    index = S.build(facts(spark, 1, ["d1"], 60), folder)
    before = files()
    more = facts(spark, 2, ["d2"], 40)
    bucketed = index._settle
    with pytest.raises(OSError):
        index._settle = lambda *a: (_ for _ in ()).throw(OSError("lost"))
        index.append(more)
    index._settle = bucketed
    assert S.open_index(spark, folder).n == 60 and S.open_index(spark, folder).postings().select("document_id").distinct().count() == 1
    index = S.open_index(spark, folder).append(more)
    after = files()
    assert all(after[f] == t for f, t in before.items()) and index.n == 100
    assert index.postings().select("document_id").distinct().count() == 2


def test_blocks_out_of_reach_are_not_read(spark, tmp_path, monkeypatch):
    """A term that all texts have, asked with a rare one: few of its blocks are read; and no bucket has more than its share of it."""
    monkeypatch.setattr(S, "HOT", 1000)
    monkeypatch.setattr(S, "PER_BUCKET", 500)
    monkeypatch.setattr(S, "PER_BLOCK", 8)
    rows = [("d", k, f"N{k}", "IS", f"M{k % 500}", f"N{k} is M{k % 500}") for k in range(4000)]
    every = G.identify(spark.createDataFrame(rows, FACTS))
    index = S.build(every, str(tmp_path / "index"))
    assert listed(R.bm25(index, "M7 is N507", 5).select("assertion_id")) == listed(R.bm25(every, "M7 is N507", 5).select("assertion_id"))
    read, real = [], S.SegmentIndex._opened

    def counting(self, blocks):
        read.append(blocks.count())
        return real(self, blocks)

    monkeypatch.setattr(S.SegmentIndex, "_opened", counting)
    R.bm25(index, "M7 is N507", 5).collect()
    blocks = index._table("postings").where("term = 'is'").count()
    assert blocks > 400 and sum(read) < blocks / 10
    asked = index._blocks(["is"], every.limit(5).select("assertion_id"))
    plan = asked._jdf.queryExecution().toString()
    assert "In(slot" in plan.replace("PushedFilters", "") or "slot" in plan.split("PushedFilters")[1][:400]
    share = [r["n"] for r in index._table("postings").where("term = 'is'").groupBy("hot", "bucket").agg(F.sum("n").alias("n")).collect()]
    assert len(share) == 8 and max(share) < 2 * 4000 / 8


def test_traces_ask_an_index(spark):
    facts = [("d%d" % (k % 3), k, "n%d" % (k % 7), "USES", "n%d" % (k % 11), f"n{k % 7} uses n{k % 11}") for k in range(80)]
    a = G.identify(spark.createDataFrame(facts, "document_id string, seq long, subject string, predicate string, object string, raw_text string")).cache()
    docs = spark.createDataFrame([("d0", "zero", "/d0.md")], "document_id string, name string, path string")
    ids = a.where("subject = 'n3' and object = 'n5'").select("subject_node_id", "object_node_id").first()
    rows = lambda df: sorted(map(str, df.collect()))
    for source in (I.build(a, scratch(spark, "traces"), buckets=5), S.build(a.where("seq < 50"), scratch(spark, "traces")).append(a.where("seq >= 50"))):
        for ask in (lambda s: G.node_trace(s, docs, ids[0]), lambda s: G.node_trace(s, docs, "none"), lambda s: G.edge_trace(s, docs, ids[0], "uses", ids[1]), lambda s: G.edge_trace(s, docs, ids[1], "uses", "none")):
            assert rows(ask(source)) == rows(ask(a))
    assert len(rows(G.node_trace(a, docs, ids[0]))) > len(rows(G.edge_trace(a, docs, ids[0], "uses", ids[1]))) > 0
    a.unpersist()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_the_queries_merge_both_additions(spark):
    """The index of the queries is one merged addition and a deletion, with the rows of a fresh build."""
    from factgraph.plans import fixtures, graph_queries

    sf = "/root/testdata/sf0.001"
    index, every = graph_queries.segments(spark, sf), fixtures.assertions(spark, sf)
    gone = every.where("document_id = 'provides'").count()
    assert list(index.counts.values()) == [every.count(), -gone] and index.last == 3
    assert index.postings().count() == R.Plain(every.where("document_id != 'provides'")).postings().count()
