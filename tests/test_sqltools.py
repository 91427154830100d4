"""The tools as table functions of SQL: the same rows as the operators, over plain tables and an index, with hidden documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factgraph.api import Graph
from factgraph.functions import text as T
from factgraph.operators import index as I
from factgraph.operators import retrieve as R
from factgraph.operators import sqltools
from factgraph.session import scratch

#: A ring a-b-c-d-a with a tail d-e-f, a loop at f, and a second edge between a and b from another document.
TRIPLES = [("a", "b", "d1"), ("b", "c", "d1"), ("c", "d", "d2"), ("d", "a", "d2"), ("d", "e", "d2"), ("e", "f", "d3"), ("f", "f", "d3"), ("b", "a", "d3")]


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(f"x{i}", doc, s, "uses", o, f"{s} uses {o} in step {i % 3}", f"e-{s}-{o}") for i, (s, o, doc) in enumerate(TRIPLES)]
    df = spark.createDataFrame(rows, "assertion_id string, document_id string, subject string, predicate string, object string, raw_text string, edge_id string")
    node = lambda c: T.node_id(F.col(c))
    return df.withColumn("seq", F.lit(1)).withColumn("subject_node_id", node("subject")).withColumn("object_node_id", node("object")).withColumn("semantic_checksum", F.sha2("assertion_id", 256)).cache()


@pytest.fixture(scope="module", params=["plain", "index"])
def source(request, spark, facts):
    return facts if request.param == "plain" else I.build(facts, scratch(spark, "index"), 3)


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def node(spark, name):
    return spark.range(1).select(T.node_id(F.lit(name))).first()[0]


@pytest.mark.parametrize("hidden", [None, "d2"])
def test_functions_are_the_operators(spark, source, hidden):
    deleted = None if hidden is None else spark.createDataFrame([(hidden,)], "document_id string")
    assert sqltools.register(source, "t_", deleted) == ["t_" + n for n in ("neighbours", "neighbourhood", "search", "query_graph", "explain_path", "assertion_by_id")]
    start = node(spark, "a")
    ask = lambda text, **v: rows(spark.sql(text, v))
    for depth in (0, 2, 4):
        want = R.neighbours(source, spark.createDataFrame([(start,)], "node_id string"), depth, deleted)
        assert ask(f"SELECT * FROM t_neighbours(:n, {depth})", n=start) == rows(want)
        assert ask(f"SELECT * FROM t_neighbourhood(:n, {depth})", n=start) == rows(R.neighbourhood(source, start, depth, deleted=deleted))
    for depth in (0, 2):
        assert ask(f"SELECT * FROM t_query_graph('a uses STEP', {depth})") == rows(R.query_graph(source, "a uses STEP", depth, deleted=deleted))
    assert ask("SELECT assertion_id, round(bm25_score, 6) FROM t_search('c d', 2)") == rows(R.bm25(source, "c d", 2, deleted=deleted).select("assertion_id", F.round("bm25_score", 6)))
    for wanted in ("x0", "x2", "x6", "none"):
        assert ask("SELECT * FROM t_explain_path(:w)", w=wanted) == rows(R.explain(source, wanted, deleted=deleted))
        assert ask("SELECT * FROM t_assertion_by_id(:w)", w=wanted) == rows(R.lookup(source, wanted, deleted))


def test_odd_arguments(spark, source):
    sqltools.register(source, "t_")
    count = lambda call: spark.sql(f"SELECT * FROM {call}").count()
    assert count("t_neighbours(NULL, 2)") == 0
    assert count("t_neighbours('unknown', 2)") == 1
    assert count("t_neighbours('unknown', -1)") == 1
    assert count("t_neighbourhood('unknown', 2)") == 0
    assert count("t_search('', 5)") == 0 and count("t_search(NULL, 5)") == 0 and count("t_search('a', 0)") == 0
    assert count("t_explain_path(NULL)") == 0 and count("t_assertion_by_id(NULL)") == 0


def test_empty_graph(spark, facts):
    sqltools.register(facts.limit(0), "e_")
    assert spark.sql("SELECT * FROM e_query_graph('a', 2)").count() == 0
    assert spark.sql("SELECT * FROM e_neighbours('n', 2)").collect() == [("n", 0)]


def test_called_for_each_row_of_a_table(spark, facts):
    Graph(spark, facts, facts.select("document_id").distinct()).functions("g_")
    names = spark.createDataFrame([(n, node(spark, n)) for n in "aef"], "name string, node_id string")
    got = spark.sql("SELECT s.name, n.node_id, n.hop FROM {names} s, LATERAL g_neighbours(s.node_id, 2) n", names=names)
    want = [(n, r["node_id"], r["hop"]) for n in "aef" for r in R.neighbours(facts, names.where(F.col("name") == n).select("node_id"), 2).collect()]
    assert rows(got) == sorted(map(str, want))


def test_constants_leave_hops_and_buckets_out(spark, facts):
    sqltools.register(I.build(facts, scratch(spark, "index"), 3), "t_")
    plan = lambda depth: spark.sql(f"SELECT * FROM t_neighbours('n', {depth})")._jdf.queryExecution().executedPlan().toString()
    assert "/links" not in plan(0)
    assert plan(1).count("FileScan parquet") == 1
    assert "(bucket" in plan(1).split("PartitionFilters:")[1].split("PushedFilters")[0]
