"""What steps shuffle and write for each assertion: names, not the hashes that are made of them."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from factgraph.functions import predicates as P
from factgraph.functions import text as T
from factgraph.operators import curation as C
from factgraph.operators import deltas as D
from factgraph.operators import graph as G
from factgraph.operators import index as I
from factgraph.operators import retrieve as R
from factgraph.operators import segments as S
from factgraph.operators import validate as V
from factgraph.session import scratch
from jobs import monthly_graph

N = 20_000


@pytest.fixture(scope="module")
def facts(spark):
    rows = spark.range(N).select(F.lit("d").alias("document_id"), F.col("id").alias("seq"), F.concat(F.lit("Order_"), F.col("id").cast("string")).alias("subject"), F.lit("HAS").alias("predicate"), F.concat(F.lit("Part_"), (F.col("id") % 5000).cast("string")).alias("object"))
    return rows.withColumn("raw_text", F.concat_ws(" ", "subject", F.lower("predicate"), "object"))


def moved(spark, work) -> float:
    """Bytes for each assertion that ``work`` shuffles, spills and writes."""

    def total() -> int:
        time.sleep(1)  # the status store follows the events
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in map(stages.apply, range(stages.size())))

    before = total()
    work()
    return (total() - before) / N


def ran(df):
    return lambda: df.write.format("noop").mode("overwrite").save()


def _delta(facts):
    before, after = facts.where("seq % 3 != 0"), facts.where("seq % 5 != 0")
    state = D.build(before)
    return D.edges(D.replace(state, D.advance(state, D.changes(before, after, "document_id", "seq", "subject", "predicate", "object"), after)))


@pytest.mark.parametrize(
    "made, most",
    [
        (lambda f: G.edges(G.identify(f)), 90),
        (lambda f: G.nodes(G.identify(f)), 90),
        (lambda f: G.delete_document(G.identify(f), "d")["orphan_edges"], 60),
        (lambda f: G.delete_document(G.identify(f), "d")["orphan_nodes"], 60),
        (lambda f: G.document_counts(G.identify(f)), 120),
        (_delta, 300),
    ],
    ids=["edges", "nodes", "orphan_edges", "orphan_nodes", "document_counts", "delta"],
)
def test_shuffles_names(spark, facts, made, most):
    assert moved(spark, ran(made(facts))) < most


@pytest.mark.parametrize("build, most", [(I.build, 400), (S.build, 600)], ids=["index", "segments"])
def test_an_index_holds_names(spark, facts, build, most):
    made = []
    assert moved(spark, lambda: made.append(build(facts.repartition(4), scratch(spark, "disk")))) < most
    postings = made[0].postings(["order_7", "has"])
    want = {r[0] for r in G.identify(facts).select("assertion_id").collect()}
    assert {r["assertion_id"] for r in postings.where("term = 'has'").collect()} == want and postings.where("term = 'order_7'").count() == 1


def test_monthly_graph_deals_names(spark, tmp_path):
    orders = spark.range(5000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 500).alias("o_custkey"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("o_orderdate"))
    lines = spark.range(N // 2).select((F.col("id") % 5000).alias("l_orderkey"), F.floor(F.col("id") / 5000).cast("int").alias("l_linenumber"), F.col("id").alias("l_partkey"), (F.col("id") % 100).alias("l_suppkey"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert moved(spark, lambda: monthly_graph.build(spark, str(tmp_path), f"{tmp_path}/out")) < 900  # of which about 300 are the output


def test_long_and_odd_names(spark):
    """Names of any length keep their identifiers, whether their key is the normal form or its digest."""
    names = ["a" * n for n in (1, 30, 31, 32, 33, 64, 500)] + ["é" * 16, "é" * 15 + "x", "", " _-", None, "Ab C"]
    rows = G.identify(spark.createDataFrame([("d", i, n, "HAS", names[-i]) for i, n in enumerate(names)], "document_id string, seq long, subject string, predicate string, object string"))
    want = {r[0] for r in rows.select(F.explode(F.array("subject_node_id", "object_node_id"))).collect()}
    assert {r["node_id"] for r in G.nodes(rows).collect()} == want
    ends = ("edge_id", "from_node_id", "to_node_id")
    assert {tuple(r[c] for c in ends) for r in G.edges(rows).collect()} == {(r["edge_id"], r["subject_node_id"], r["object_node_id"]) for r in rows.collect()}
    assert {r["edge_id"] for r in G.delete_document(rows, "d")["orphan_edges"].collect()} == {r["edge_id"] for r in rows.collect()}
    assert {r["node_id"] for r in G.delete_document(rows, "d")["orphan_nodes"].collect()} == want


def test_state_of_names_is_that_of_identifiers(spark, facts):
    ids = G.identify(facts.limit(500))
    for f in (D.edges, D.nodes):
        assert sorted(map(tuple, f(D.build(ids)).collect())) == sorted(map(tuple, f(D.build(facts.limit(500))).collect()))


def test_touching_takes_an_assertion_once(spark, facts):
    few = facts.limit(10)
    wanted = G.identify(few).select(F.explode(F.array("subject_node_id", "object_node_id", "subject_node_id")).alias("node_id")).limit(7)
    ids = {r[0] for r in wanted.collect()}
    want = sorted(r["seq"] for r in G.identify(few).collect() if {r["subject_node_id"], r["object_node_id"]} & ids)
    assert sorted(r["seq"] for r in G.touching(few, wanted).collect()) == want


def test_an_index_shuffles_nothing(spark, facts):
    """All tables of an index together: rows are written where they are."""
    rows = facts.repartition(4).cache()
    rows.count()
    made = []

    def work():
        made.append(I.build(rows, scratch(spark, "disk")))
        made[0].postings(), made[0]._rows("ends")

    assert moved(spark, work) < 110
    assert made[0].n == N and made[0].mean_length == 3.0
    rows.unpersist()


def test_an_index_writes_what_is_asked_for(spark, facts):
    index = I.build(facts.limit(100), scratch(spark, "disk"))
    R.lookup(index, "x").collect()
    assert set(index.schemas) == {"assertions"}
    R.neighbours(index, G.identify(facts.limit(1)).select(F.col("subject_node_id").alias("node_id"))).collect()
    assert set(index.schemas) == {"assertions", "ends"}


@pytest.mark.parametrize("deleted", [None, "gone"])
def test_best_without_reading_frequent_terms_whole(spark, facts, monkeypatch, deleted):
    """The best assertions by rare terms and bounds are those of a scan; where the bound does not hold, all postings are read."""
    odd = spark.createDataFrame([("gone", 1, "Order_7", "HAS", "Part_7", "order_7 has has part_7"), (None, 2, "Order_7", "HAS", None, "order_7 has"), ("e", 3, "order_7", "HAS", "X", "order_7 order_7 has has")], "document_id string, seq long, subject string, predicate string, object string, raw_text string")
    rows = facts.limit(2000).unionByName(odd)
    gone = deleted and spark.createDataFrame([(deleted,)], "document_id string")
    monkeypatch.setattr(I, "PRUNED_FRONTIER", 100)
    index, plain, few = I.build(rows, scratch(spark, "best"), 3), R.Plain(G.identify(rows)), []
    real = I.SearchIndex.candidates
    monkeypatch.setattr(I.SearchIndex, "candidates", lambda *a, **k: (few.append(real(*a, **k)), few[-1])[1])
    for text, k, pruned in (("order_7 has part_7", 2, True), ("order_7 has", 2, True), ("order_7 has", 50, False), ("has", 3, False), ("order_7", 3, False)):
        listed = [[(r[0], round(r[1], 9)) for r in R.bm25(source, text, k, deleted=gone).collect()] for source in (index, plain)]
        assert listed[0] == listed[1] and (few.pop() is not None) == pruned


def test_a_question_shuffles_keys(spark, facts, monkeypatch):
    """Hits are grouped and joined with their texts by what assertions say."""
    monkeypatch.setattr(I, "SENT_FRONTIER", 100)
    monkeypatch.setattr(I, "SENT_HITS", 100)
    index = I.build(facts.withColumn("object", F.lit("Part_1")), scratch(spark, "asked"), 4)
    index.postings(), index._rows("ends")
    asked = lambda: R.query_graph(index, "order_7 has part_1", 2)
    assert moved(spark, ran(asked())) < 150
    assert asked().select("assertion_id").distinct().count() == N


def test_records_are_not_dealt_by_the_few_names_they_have(spark, facts):
    """Names and decisions are sent to the records: validating and curating shuffle none of them."""
    names = F.element_at(F.array(*map(F.lit, ("CONTAINS", "CLICK", "UNKNOWNVERB"))), (F.col("seq") % 3 + 1).cast("int"))
    records = facts.select("document_id", "seq", names.alias("predicate"), F.col("subject").alias("subject_text"), F.col("object").alias("object_text"), "raw_text", F.col("raw_text").alias("normalized_text"), F.col("raw_text").alias("chunk_text"))
    aliases = spark.createDataFrame([], "source string, target string")
    actions = spark.createDataFrame([("approve", "CLICK", None)], "action string, name string, target string")

    def work():
        done = V.validate(records.repartition(4), P.seed(spark), aliases)
        pending = done.where("outcome = 'queued'").select("document_id", "seq", "predicate", "raw_text")
        ran(C.curate(C.State(P.seed(spark), aliases, pending), actions)["promoted"])()

    dealt = moved(spark, lambda: ran(records.repartition(4).select("predicate"))()) + moved(spark, lambda: ran(records.repartition(4))())
    assert moved(spark, work) < dealt + 10
    done = V.validate(records, P.seed(spark), aliases)
    assert {r["predicate"]: r["n"] for r in done.groupBy("predicate").agg(F.count(F.lit(1)).alias("n")).collect()} == {"CONTAINS": 6667, "CLICK": 6667, "UNKNOWNVERB": 6666}


def test_a_question_without_hops_writes_no_ends(spark, facts):
    index = I.build(facts, scratch(spark, "disk"))
    assert R.query_graph(index, "Order_7 has", 0).count() == R.TOP_K
    assert "ends" not in index.schemas


def test_texts_of_many_hits_shuffle_what_may_be_hit(spark, facts, monkeypatch):
    """Hits that are too many to be sent, a hundredth of the assertions: the others' texts are not shuffled."""
    index = I.build(facts, scratch(spark, "disk"))
    few = facts.where("seq % 100 = 0").unionByName(facts.limit(1).withColumn("document_id", F.lit(None).cast("string")))
    found = few.select(*T.assertion_key(*map(F.col, I._FACT)), F.lit(1).alias("depth")).localCheckpoint()
    want = {(r["seq"], r["raw_text"]) for r in facts.where("seq % 100 = 0").collect()}
    monkeypatch.setattr(I, "SENT_HITS", 10)
    got = index.texts(found)
    assert {(int(r["place"].split("|")[1]), r["raw_text"]) for r in got.collect()} == want and got.count() == len(want)
    assert moved(spark, ran(got)) < 10


def test_few_nodes_are_told_where_rows_are_read(spark, facts):
    """What is not at a wanted node does not reach a shuffle that comes before."""
    wanted = spark.range(1).select(T.node_id(F.lit("Order_7")).alias("node_id"))
    assert moved(spark, ran(G.touching(facts.distinct(), wanted))) < 5
    assert [r["seq"] for r in G.touching(facts.distinct(), wanted).collect()] == [7]
    assert G.touching(facts, wanted.limit(0)).count() == 0


@pytest.mark.parametrize("listed", [G.LISTED, 10])
def test_revoking_few_assertions_reads_their_nodes(spark, facts, monkeypatch, listed):
    """A predicate of few assertions: the others are shuffled only at its nodes; by the list of nodes and without one the rows are the same."""
    monkeypatch.setattr(G, "LISTED", listed)
    few = facts.limit(40).select("document_id", (F.col("seq") + N).alias("seq"), F.concat("subject", F.when(F.col("seq") % 2 == 0, "_new").otherwise("")).alias("subject"), F.lit("PART_OF").alias("predicate"), "object", "raw_text")
    rows = facts.unionByName(few)
    made = []
    cost = moved(spark, lambda: made.append(sorted(r["node_id"] for r in C.revoke(rows, P.seed(spark), "part_of")["orphan_nodes"].collect())))
    assert made[0] == sorted(r[0] for r in few.where("subject like '%_new'").select(T.node_id(F.col("subject"))).distinct().collect())
    assert cost < 10 or listed == 10


def test_an_index_that_is_written_later_holds_what_was_asked_for(spark, facts):
    few = facts.limit(100)
    index, start = I.build(few, scratch(spark, "disk"), later=True), G.identify(few.limit(1)).select(F.col("subject_node_id").alias("node_id"))
    assert not index.schemas
    got = {tuple(r) for r in R.neighbours(index, start, 2).collect()}
    assert set(index.schemas) == {"ends"} and got == {tuple(r) for r in R.neighbours(R.Plain(G.identify(few)), start, 2).collect()}
    assert index.n == 100 and index.mean_length == 3.0


def test_a_segment_shuffles_hot_terms_alone(spark, facts):
    """Terms with their counts, and the postings of terms that all texts have, are shuffled; all else is written where it is."""
    rows = facts.repartition(4).cache()
    rows.count()
    assert moved(spark, lambda: S.build(rows, scratch(spark, "disk"))) < 290
    rows.unpersist()


def test_monthly_graph_deals_rows_once(spark, tmp_path):
    """An edge of two lines, and months whose rows are dealt over files: grouped where they are written, and packed."""
    orders = spark.range(5000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 500).alias("o_custkey"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("o_orderdate"))
    lines = spark.range(N // 2).select((F.col("id") % 5000).alias("l_orderkey"), F.floor(F.col("id") / 5000).cast("int").alias("l_linenumber"), (F.col("id") % 5000).alias("l_partkey"), (F.col("id") % 100).alias("l_suppkey"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert moved(spark, lambda: monthly_graph.build(spark, str(tmp_path), f"{tmp_path}/out")) < 200
    edges = monthly_graph.read_table(spark, f"{tmp_path}/out", "edges")
    assert {r["support"]: r["n"] for r in edges.groupBy("support").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 5000, 2: 10_000}
    assert monthly_graph.read_table(spark, f"{tmp_path}/out", "nodes").agg(F.sum("degree")).first()[0] == 30_000


def test_hops_in_sql_shuffle_keys(spark, facts):
    """A hop joins what names nodes, not their identifiers, also where no side is small."""
    from factgraph.operators import sqltools

    index = I.build(facts, scratch(spark, "disk"), 4)
    sqltools.register(index, "disk_")
    root = G.identify(facts.where("seq = 7")).first()["subject_node_id"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.sql("SELECT * FROM disk_neighbours(:root, 2)", {"root": root})
        assert moved(spark, ran(asked)) < 150
        assert {r["hop"]: r["n"] for r in asked.groupBy("hop").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 1, 1: 1, 2: 3}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_nodes_shuffle_what_may_be_at_them(spark, facts, monkeypatch):
    """A frontier that is too large to be sent, at a twelfth of the ends: the others are not shuffled, and the rows are the same."""
    index = I.build(facts, scratch(spark, "disk"), 4)
    index._rows("ends")
    nodes = facts.where("seq < 400").select(T.node_id(F.col("object")).alias("node_id")).localCheckpoint()
    asked = lambda: (index.ends(nodes), index.links(nodes), index.assertions(G.identify(facts.where("seq < 400")).select("assertion_id")))
    want = [sorted(str(r) for r in df.select(*sorted(df.columns)).collect()) for df in asked()]
    assert [len(w) for w in want] == [1600, 1600, 400]
    monkeypatch.setattr(I, "SENT_FRONTIER", 100)
    monkeypatch.setattr(I, "PRUNED_FRONTIER", 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [sorted(str(r) for r in df.select(*sorted(df.columns)).collect()) for df in asked()] == want
        assert moved(spark, lambda: [ran(df)() for df in asked()]) < 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_index_is_written_by_small_tasks(spark, facts, tmp_path, monkeypatch):
    """A task sorts what it writes, so files are read in small parts; the session's settings are as before afterwards."""
    facts.coalesce(1).write.option("parquet.block.size", 1 << 16).option("parquet.block.size.row.check.min", 10).parquet(str(tmp_path / "facts"))
    monkeypatch.setattr(I, "SMALL_TASKS", {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1"})
    given = {k: spark.conf.get(k) for k in I.SMALL_TASKS}
    index = I.build(spark.read.parquet(str(tmp_path / "facts")), scratch(spark, "disk"), 1, later=True)
    assert index._rows("postings").select(F.input_file_name()).distinct().count() > 4
    assert {k: spark.conf.get(k) for k in I.SMALL_TASKS} == given and index.postings().count() == 3 * N


def test_many_nodes_of_segments_shuffle_what_may_be_at_them(spark, facts, monkeypatch):
    index = S.build(facts, scratch(spark, "disk"))
    nodes = facts.where("seq < 400").select(T.node_id(F.col("object")).alias("node_id")).localCheckpoint()
    want = sorted(str(r) for r in index.ends(nodes).collect())
    monkeypatch.setattr(S, "PRUNED_FRONTIER", 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(str(r) for r in index.ends(nodes).collect()) == want and len(want) == 1600
        assert moved(spark, ran(index.ends(nodes))) < 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
