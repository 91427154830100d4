"""Graph build, retrieval, traces and deletion.

Questions are asked of a search index of the facts, which the first of them builds and the others of an application share.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curation as C
from ..operators import deltas as D
from ..operators import graph as G
from ..operators import index as I
from ..operators import retrieve as R
from ..operators import segments as S
from ..operators import sqltools
from ..session import hadoop, scratch, table
from .fixtures import FACTS, assertions, facts
from .registry import SQL, query

_INDEXES: dict[tuple, I.SearchIndex] = {}
_TABLES = ("customer", "orders", "lineitem", "nation", "region")


def _index_key(spark, sf) -> tuple:
    """The application and the tables' files as they are now: a table that is written again gets another index."""
    files = []
    for name in _TABLES:
        path, fs = hadoop(spark, f"{sf}/{name}.parquet")
        files += [(f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)]
    return spark.sparkContext.applicationId, sf, tuple(files)


def index(spark, sf) -> I.SearchIndex:
    key = _index_key(spark, sf)
    if key not in _INDEXES:
        # Each line states at most two facts; files tell their rows without being read.
        most = sum(k * table(spark, sf, name).count() for name, k in (("lineitem", 2), ("orders", 1), ("customer", 1)))
        _INDEXES[key] = I.build(facts(spark, sf), scratch(spark, "index"), I.buckets_for(most), later=True)
    return _INDEXES[key]

TEXT = "Supplier_3 provides Part_7"
NODE_SQL = "sha256('supplier3')"


def with_facts(sql: str) -> str:
    return f"WITH {FACTS} {sql}"


def bm25_sql(k: int | None) -> str:
    """BM25 in SQL over ``assertions``, as further tables; ``seeds`` has the result."""
    limit = f"ORDER BY round(bm25_score, 9) DESC, assertion_id LIMIT {k}" if k else ""
    return f""",
qt AS (SELECT DISTINCT unnest(regexp_extract_all(lower('{TEXT}'), '[\\p{{L}}\\p{{N}}_]+')) AS term),
tok AS (SELECT assertion_id, regexp_extract_all(lower(raw_text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM assertions),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
tf AS (SELECT assertion_id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM tok, qt WHERE list_contains(w, term)),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
hits AS (SELECT assertion_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25_score FROM tf JOIN df USING (term), stats GROUP BY assertion_id),
seeds AS (SELECT * FROM hits {limit})"""


@query(with_facts(", tok AS (SELECT row_number() OVER () AS r, assertion_id, regexp_extract_all(lower(raw_text), '[\\p{L}\\p{N}_]+') AS w FROM assertions), e AS (SELECT r, assertion_id, len(w) AS dl, unnest(w) AS term FROM tok) SELECT term, assertion_id, CAST(count(*) AS INT) AS tf, CAST(dl AS INT) AS dl FROM e GROUP BY r, term, assertion_id, dl"))
def search_postings(spark, sf):
    """Builds the index, if no query before has."""
    return index(spark, sf).postings().select("term", "assertion_id", "tf", "dl")


def graph_sql(depth: int) -> str:
    """``query_graph`` in SQL, hop by hop."""
    parts = ["n0 AS (SELECT DISTINCT node_id FROM ends JOIN seeds USING (assertion_id))", "seen0 AS (SELECT node_id, 0 AS hop FROM n0)"]
    for d in range(1, depth + 1):
        parts.append(f"n{d} AS (SELECT DISTINCT b AS node_id FROM links JOIN n{d - 1} ON a = node_id WHERE b NOT IN (SELECT node_id FROM seen{d - 1}))")
        parts.append(f"seen{d} AS (SELECT * FROM seen{d - 1} UNION ALL SELECT node_id, {d} FROM n{d})")
    return f"""{bm25_sql(20)}, {', '.join(parts)},
touched AS (SELECT assertion_id, min(hop) AS depth FROM ends JOIN seen{depth} USING (node_id) WHERE hop > 0 AND assertion_id NOT IN (SELECT assertion_id FROM seeds) GROUP BY 1),
cand AS (SELECT assertion_id, 0 AS depth, bm25_score FROM seeds UNION ALL SELECT assertion_id, depth, 0.0 FROM touched)
SELECT assertion_id, raw_text, CAST(depth AS INT) AS depth, round(bm25_score, 6) AS bm25_score, round(1.0 / (1 + depth), 6) AS graph_score,
  round(bm25_score * exp(-1.0 * depth) + 0.3 / (1 + depth), 6) AS final_score FROM cand JOIN assertions USING (assertion_id)"""


@query(with_facts("SELECT assertion_id, round(bm25_score, 6) AS bm25_score FROM (SELECT * FROM seeds)").replace(" SELECT assertion_id, round", bm25_sql(20) + " SELECT assertion_id, round", 1))
def bm25_topk(spark, sf):
    return R.bm25(index(spark, sf), TEXT).select("assertion_id", F.round("bm25_score", 6).alias("bm25_score"))


_SEGMENTS: dict[tuple, S.SegmentIndex] = {}


def segments(spark, sf) -> S.SegmentIndex:
    """An index that grew: two thirds of the facts, then the rest; both additions merged; then without one document."""
    key = _index_key(spark, sf)
    if key not in _SEGMENTS:
        rows = facts(spark, sf)
        grown = S.build(rows.where("seq % 3 != 0"), scratch(spark, "segments")).append(rows.where("seq % 3 = 0"))
        _SEGMENTS[key] = grown.merge().delete(spark.createDataFrame([("provides",)], "document_id string"))
    return _SEGMENTS[key]


#: The facts that are left, in place of all of them, for questions in SQL.
REST = FACTS.replace("FROM facts),", "FROM facts WHERE document_id <> 'provides'),", 1)
ASKED = "Customer_3 submits Order_7"


@query(f"WITH {REST} {bm25_sql(20).replace(TEXT, ASKED)} SELECT assertion_id, round(bm25_score, 6) AS bm25_score FROM seeds")
def segments_topk(spark, sf):
    """The best assertions of an index of segments, by bounds of blocks: as of an index built afresh."""
    return R.bm25(segments(spark, sf), ASKED).select("assertion_id", F.round("bm25_score", 6).alias("bm25_score"))


@query(f"WITH {REST}, tok AS (SELECT row_number() OVER () AS r, assertion_id, regexp_extract_all(lower(raw_text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM assertions), e AS (SELECT r, assertion_id, len(w) AS dl, unnest(w) AS term FROM tok) SELECT term, assertion_id, CAST(count(*) AS INT) AS tf, CAST(dl AS INT) AS dl FROM e GROUP BY r, term, assertion_id, dl")
def segments_postings(spark, sf):
    return segments(spark, sf).postings().select("term", "assertion_id", "tf", "dl")


@query(f"WITH {REST} {graph_sql(1).replace(TEXT, ASKED)}")
def segments_query_graph(spark, sf):
    """A question with one hop over an index of segments."""
    return R.query_graph(segments(spark, sf), ASKED, 1)


@query(f"WITH {FACTS} {graph_sql(0)}")
def query_graph_d0(spark, sf):
    return R.query_graph(index(spark, sf), TEXT, 0)


@query(f"WITH {FACTS} {graph_sql(1)}")
def query_graph_d1(spark, sf):
    return R.query_graph(index(spark, sf), TEXT, 1)


@query(f"WITH {FACTS} {graph_sql(2)}")
def query_graph_d2(spark, sf):
    return R.query_graph(index(spark, sf), TEXT, 2)


def capped_sql(cap: int, edge_cap: int) -> str:
    """``query_graph`` of depth 2 in SQL with at most so many assertions and edges a hop, smallest identifiers first."""
    parts = ["n0 AS (SELECT DISTINCT node_id FROM ends JOIN seeds USING (assertion_id))", "seen0 AS (SELECT node_id, 0 AS hop FROM n0)"]
    for d in (1, 2):
        parts.append(f"e{d} AS (SELECT DISTINCT edge_id FROM links JOIN n{d - 1} ON a = node_id ORDER BY edge_id LIMIT {edge_cap})")
        parts.append(f"n{d} AS (SELECT DISTINCT b AS node_id FROM links JOIN n{d - 1} ON a = node_id WHERE edge_id IN (SELECT edge_id FROM e{d}) AND b NOT IN (SELECT node_id FROM seen{d - 1}))")
        parts.append(f"seen{d} AS (SELECT * FROM seen{d - 1} UNION ALL SELECT node_id, {d} FROM n{d})")
    return f"""{bm25_sql(20)}, {', '.join(parts)},
t0 AS (SELECT assertion_id, min(hop) AS depth FROM ends JOIN seen2 USING (node_id) WHERE hop > 0 AND assertion_id NOT IN (SELECT assertion_id FROM seeds) GROUP BY 1),
touched AS (SELECT assertion_id, depth FROM t0 QUALIFY row_number() OVER (PARTITION BY depth ORDER BY assertion_id) <= {cap})
SELECT assertion_id, CAST(depth AS INT) AS depth FROM (SELECT assertion_id, 0 AS depth FROM seeds UNION ALL SELECT * FROM touched) JOIN assertions USING (assertion_id)"""


@query(f"WITH {FACTS} {capped_sql(50, 7)}")
def query_graph_capped(spark, sf):
    return R.query_graph(index(spark, sf), TEXT, 2, cap=50, edge_cap=7).select("assertion_id", "depth")


LIVE = "live AS (SELECT * FROM assertions WHERE document_id <> 'provides'), lends AS (SELECT assertion_id, subject_node_id AS node_id FROM live UNION SELECT assertion_id, object_node_id FROM live), llinks AS (SELECT DISTINCT subject_node_id AS a, object_node_id AS b FROM live UNION SELECT object_node_id, subject_node_id FROM live)"


@query(f"""WITH {FACTS} {bm25_sql(None)}, {LIVE}, top AS (SELECT hits.* FROM hits JOIN live USING (assertion_id) ORDER BY round(bm25_score, 9) DESC, assertion_id LIMIT 20),
n0 AS (SELECT DISTINCT node_id FROM lends JOIN top USING (assertion_id)), n1 AS (SELECT DISTINCT b AS node_id FROM llinks JOIN n0 ON a = node_id WHERE b NOT IN (SELECT node_id FROM n0)),
t AS (SELECT DISTINCT assertion_id FROM lends JOIN n1 USING (node_id) WHERE assertion_id NOT IN (SELECT assertion_id FROM top))
SELECT c.* FROM (SELECT assertion_id, 0 AS depth, round(bm25_score, 6) AS bm25_score FROM top UNION ALL SELECT assertion_id, 1, 0.0 FROM t) c JOIN live USING (assertion_id)""")
def query_graph_deleted(spark, sf):
    """Assertions of a deleted document are not found, and links that only they support are not followed."""
    deleted = spark.createDataFrame([("provides",)], "document_id string")
    return R.query_graph(index(spark, sf), TEXT, 1, deleted=deleted).select("assertion_id", "depth", "bm25_score")


NAMES = ", w AS (SELECT document_id, seq, 0 AS side, subject AS name, subject_node_id AS node_id FROM assertions UNION ALL SELECT document_id, seq, 1, object, object_node_id FROM assertions)"


@query(f"WITH {FACTS} {NAMES} SELECT node_id, arg_max(name, (document_id, seq, side)) AS canonical_name, regexp_replace(lower(arg_max(name, (document_id, seq, side))), '[\\s_-]+', '', 'g') AS normalized_name FROM w GROUP BY node_id")
def graph_nodes(spark, sf):
    return G.nodes(assertions(spark, sf))


@query(with_facts("SELECT * FROM edges"))
def graph_edges(spark, sf):
    return G.edges(assertions(spark, sf))


@query(f"WITH {FACTS} {NAMES}, n AS (SELECT node_id, arg_max(name, (document_id, seq, side)) AS name FROM w GROUP BY node_id) SELECT assertion_id, s.name AS subject_name, o.name AS object_name, edge_id FROM assertions JOIN n s ON subject_node_id = s.node_id JOIN n o ON object_node_id = o.node_id")
def graph_backlinks(spark, sf):
    """The names that nodes have, found from their assertions: identifiers are hashes, so a back-link is a projection."""
    rows, names = G.keyed(facts(spark, sf)), G.node_rows(facts(spark, sf))
    subject = names.select(F.col("key").alias("from_key"), F.col("canonical_name").alias("subject_name"))
    obj = names.select(F.col("key").alias("to_key"), F.col("canonical_name").alias("object_name"))
    return G.identify(rows.join(subject, "from_key").join(obj, "to_key")).select("assertion_id", "subject_name", "object_name", "edge_id")


@query(with_facts("SELECT DISTINCT sha256(regexp_replace(lower(CASE seq % 3 WHEN 0 THEN upper(subject) WHEN 1 THEN replace(subject, '_', ' - ') ELSE subject END), '[\\s_-]+', '', 'g')) AS node_id FROM facts"))
def entity_merge(spark, sf):
    name = F.when(F.col("seq") % 3 == 0, F.upper("subject")).when(F.col("seq") % 3 == 1, F.replace("subject", F.lit("_"), F.lit(" - "))).otherwise(F.col("subject"))
    return facts(spark, sf).select(T.node_id(name).alias("node_id")).distinct()


@query(with_facts(", old AS (SELECT edge_id, arg_min(document_id, (document_id, seq)) AS document_id, count(*) AS support FROM assertions WHERE seq % 3 <> 0 GROUP BY edge_id) SELECT * FROM old UNION ALL SELECT edge_id, document_id, support FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM old)"))
def graph_merge(spark, sf):
    """Building over an existing graph adds what it lacks and leaves the rest as it was."""
    rows = facts(spark, sf)
    merged = G.merge(G.edge_rows(rows.where("seq % 3 != 0")), G.edge_rows(rows), *G.EDGE_KEY)
    return G.with_edge_ids(merged).select("edge_id", "document_id", "support")


@query(with_facts(", old AS (SELECT subject_node_id AS n FROM assertions WHERE seq % 3 <> 0 UNION SELECT object_node_id FROM assertions WHERE seq % 3 <> 0) SELECT node_id, node_id IN (SELECT n FROM old) AS known FROM (SELECT DISTINCT node_id FROM ends)"))
def graph_merge_nodes(spark, sf):
    rows = facts(spark, sf)
    old = G.node_rows(rows.where("seq % 3 != 0")).withColumn("known", F.lit(True))
    return G.with_node_ids(G.merge(old, G.node_rows(rows), *G.NODE_KEY)).select("node_id", F.coalesce("known", F.lit(False)).alias("known"))


def _moved(spark, sf):
    """The state of two thirds of the facts, and what changes when another set of documents and facts takes their place."""
    rows = facts(spark, sf)
    before, after = rows.where("seq % 3 != 0"), rows.where("seq % 5 != 0 and (document_id != 'provides' or seq % 7 = 0)")
    state = D.build(before)
    return state, D.advance(state, D.changes(before, after, "document_id", "seq", "subject", "predicate", "object"), after)


AFTER = "after AS (SELECT * FROM assertions WHERE seq % 5 <> 0 AND (document_id <> 'provides' OR seq % 7 = 0)), before AS (SELECT * FROM assertions WHERE seq % 3 <> 0)"
BOTH_ENDS = "SELECT document_id, seq, 0 AS side, subject AS name, subject_node_id AS node_id FROM {0} UNION ALL SELECT document_id, seq, 1, object, object_node_id FROM {0}"


@query(with_facts(f", {AFTER} SELECT edge_id, subject_node_id AS from_node_id, predicate, object_node_id AS to_node_id, arg_min(document_id, (document_id, seq)) AS document_id, count(*) AS support FROM after GROUP BY ALL"))
def graph_delta_edges(spark, sf):
    """Edges after signed changes: as if built from scratch, first writers included."""
    return D.edges(D.replace(*_moved(spark, sf)))


@query(with_facts(f", {AFTER}, w AS ({BOTH_ENDS.format('after')}) SELECT node_id, arg_max(name, (document_id, seq, side)) AS canonical_name, regexp_replace(lower(arg_max(name, (document_id, seq, side))), '[\\s_-]+', '', 'g') AS normalized_name, count(*) AS support FROM w GROUP BY node_id"))
def graph_delta_nodes(spark, sf):
    return D.nodes(D.replace(*_moved(spark, sf)))


@query(with_facts(f", {AFTER}, wb AS ({BOTH_ENDS.format('before')}), wa AS ({BOTH_ENDS.format('after')}) SELECT 'edge' AS kind, edge_id AS id FROM before WHERE edge_id NOT IN (SELECT edge_id FROM after) UNION SELECT 'node', node_id FROM wb WHERE node_id NOT IN (SELECT node_id FROM wa)"))
def graph_delta_orphans(spark, sf):
    """What the changes leave without support."""
    _, moved = _moved(spark, sf)
    return D.orphans(moved, "edges").select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")).union(D.orphans(moved, "nodes").select(F.lit("node"), "node_id"))


@query(with_facts("SELECT a AS node_id, count(*) AS degree FROM links GROUP BY a"))
def node_degree(spark, sf):
    return G.with_node_ids(G.degrees(G.edge_rows(facts(spark, sf))))


BFS = f""", n0 AS (SELECT {NODE_SQL} AS node_id), seen0 AS (SELECT node_id, 0 AS hop FROM n0),
n1 AS (SELECT DISTINCT b AS node_id FROM links JOIN n0 ON a = node_id WHERE b NOT IN (SELECT node_id FROM seen0)), seen1 AS (SELECT * FROM seen0 UNION ALL SELECT node_id, 1 FROM n1),
n2 AS (SELECT DISTINCT b AS node_id FROM links JOIN n1 ON a = node_id WHERE b NOT IN (SELECT node_id FROM seen1)), seen2 AS (SELECT * FROM seen1 UNION ALL SELECT node_id, 2 FROM n2),
n3 AS (SELECT DISTINCT b AS node_id FROM links JOIN n2 ON a = node_id WHERE b NOT IN (SELECT node_id FROM seen2)), seen3 AS (SELECT * FROM seen2 UNION ALL SELECT node_id, 3 FROM n3)"""


def root(spark, name: str = "Supplier_3") -> str:
    return spark.range(1).select(T.node_id(F.lit(name))).first()[0]


@query(f"WITH {FACTS} {BFS} SELECT node_id, CAST(hop AS INT) AS hop FROM seen3")
def node_neighbours(spark, sf):
    start = spark.range(1).select(T.node_id(F.lit("Supplier_3")).alias("node_id"))
    return R.neighbours(index(spark, sf), start, 3)


EDGES_SEEN = "se AS (SELECT edge_id, min(hop) + 1 AS hop FROM links JOIN seen1 ON a = node_id GROUP BY edge_id)"


@query(f"WITH {FACTS} {BFS}, {EDGES_SEEN} SELECT 'node' AS kind, node_id AS id, NULL AS from_node_id, NULL AS to_node_id, CAST(hop AS INT) AS hop FROM seen2 WHERE hop > 0 UNION ALL SELECT 'edge', edge_id, from_node_id, to_node_id, CAST(hop AS INT) FROM se JOIN edges USING (edge_id)")
def node_neighbourhood(spark, sf):
    return R.neighbourhood(index(spark, sf), root(spark), 2)


@query(f"""WITH {FACTS} {BFS}, se AS (SELECT DISTINCT edge_id FROM links JOIN n0 ON a = node_id)
SELECT 0 AS at, '' AS key, 'NODES (' || count(*) || '): ' || string_agg(node_id, ', ' ORDER BY node_id) AS line FROM n1
UNION ALL SELECT 1, '', 'EDGES (' || count(*) || '):' FROM se UNION ALL SELECT 2, edge_id, '  ' || edge_id || ' [' || from_node_id || '->' || to_node_id || ']' FROM se JOIN edges USING (edge_id)""")
def tool_neighbours(spark, sf):
    return R.render_neighbourhood(R.neighbourhood(index(spark, sf), root(spark), 1, R.HOP_CAP * 100))

@query(f"WITH {FACTS} {BFS} SELECT edge_id, from_node_id, to_node_id FROM edges WHERE from_node_id IN (SELECT node_id FROM seen2) AND to_node_id IN (SELECT node_id FROM seen2)")
def level_subgraph(spark, sf):
    return R.subgraph(index(spark, sf), root(spark), 2)


@query(with_facts(f"SELECT DISTINCT edge_id, b AS node_id FROM links WHERE a = {NODE_SQL}"))
def highlight_node(spark, sf):
    wanted = spark.createDataFrame([(root(spark),)], "node_id string")
    return index(spark, sf).links(wanted).select("edge_id", F.col("b").alias("node_id")).distinct()


@query(with_facts("SELECT subject_node_id AS node_id FROM assertions WHERE document_id = 'resides' AND seq = 1 UNION SELECT object_node_id FROM assertions WHERE document_id = 'resides' AND seq = 1"))
def highlight_edge(spark, sf):
    """Both ends of an edge that the table of edges has."""
    edge = assertions(spark, sf).where("document_id = 'resides' and seq = 1").first()["edge_id"]
    return G.edge_ends(G.edges(assertions(spark, sf)), edge)


SEED_SQL = "document_id = 'resides' AND seq = 1"


def seed_id(spark, sf) -> str:
    return assertions(spark, sf).where("document_id = 'resides' and seq = 1").first()["assertion_id"]


@query(with_facts(f""", s AS (SELECT assertion_id AS id FROM assertions WHERE {SEED_SQL}), sn AS (SELECT DISTINCT node_id AS id FROM ends JOIN s ON assertion_id = s.id),
adj AS (SELECT edge_id, b FROM links WHERE a IN (SELECT id FROM sn)), nb AS (SELECT DISTINCT b AS id FROM adj WHERE b NOT IN (SELECT id FROM sn))
SELECT 'seed' AS kind, id FROM s UNION ALL SELECT 'seed_node', id FROM sn UNION ALL SELECT DISTINCT 'edge', edge_id FROM adj UNION ALL SELECT 'neighbour', id FROM nb
UNION ALL SELECT DISTINCT 'related', assertion_id FROM ends WHERE node_id IN (SELECT id FROM nb) AND assertion_id NOT IN (SELECT id FROM s)"""))
def explain_path(spark, sf):
    return R.explain(index(spark, sf), seed_id(spark, sf))


@query(with_facts(f"SELECT assertion_id, document_id, subject, predicate, object, raw_text, subject_node_id, object_node_id, semantic_checksum FROM assertions WHERE {SEED_SQL}"))
def assertion_lookup(spark, sf):
    return R.lookup(index(spark, sf), seed_id(spark, sf))


@query(with_facts(f"SELECT subject || ' | ' || predicate || ' | ' || object || ' | ' || raw_text || ' | doc: ' || document_id AS line FROM assertions WHERE {SEED_SQL}"))
def tool_assertion(spark, sf):
    return R.render_assertion(R.lookup(index(spark, sf), seed_id(spark, sf)))


@query(with_facts(f""", s AS (SELECT * FROM assertions WHERE {SEED_SQL}), sn AS (SELECT DISTINCT node_id AS id FROM ends JOIN s USING (assertion_id)),
adj AS (SELECT edge_id, b FROM links WHERE a IN (SELECT id FROM sn)), nb AS (SELECT DISTINCT b AS id FROM adj WHERE b NOT IN (SELECT id FROM sn)),
rel AS (SELECT DISTINCT assertion_id FROM ends WHERE node_id IN (SELECT id FROM nb) AND assertion_id NOT IN (SELECT assertion_id FROM s))
SELECT 0 AS at, '' AS key, 'SEED: ' || subject || ' | ' || predicate || ' | ' || object AS line FROM s UNION ALL SELECT 1, '', 'TEXT: ' || raw_text FROM s
UNION ALL SELECT 2, '', 'SEED_NODES: ' || string_agg(id, ', ' ORDER BY id) FROM sn UNION ALL SELECT 3, '', 'EDGES (' || count(*) || '): ' || string_agg(edge_id, ', ' ORDER BY edge_id) FROM (SELECT DISTINCT edge_id FROM adj)
UNION ALL SELECT 4, '', 'NEIGHBORS (' || count(*) || '): ' || string_agg(id, ', ' ORDER BY id) FROM nb UNION ALL SELECT 5, '', 'RELATED (' || count(*) || '):' FROM rel UNION ALL SELECT 6, assertion_id, '  ' || raw_text FROM rel JOIN assertions USING (assertion_id)"""))
def tool_explain(spark, sf):
    return R.render_explanation(index(spark, sf), seed_id(spark, sf), None)


def documents(spark):
    return spark.createDataFrame([("submits", "Orders", "/work/shop/docs/orders.md", ""), ("provides", "Supply", "/work/supply/list.md", " "), ("resides", "People", "/work/shop/people.md", "shop")], "document_id string, name string, path string, project_root string")


DOCS = ", docs AS (SELECT * FROM (VALUES ('submits', 'Orders', '/work/shop/docs/orders.md'), ('provides', 'Supply', '/work/supply/list.md'), ('resides', 'People', '/work/shop/people.md')) t(document_id, name, path))"
TRACE = "assertion_id, document_id, coalesce(name, 'Unknown') AS document_name, coalesce(path, '') AS document_path, subject, predicate, object, raw_text FROM assertions LEFT JOIN docs USING (document_id)"


@query(f"WITH {FACTS} {DOCS} SELECT {TRACE} WHERE subject_node_id = sha256('customer7') OR object_node_id = sha256('customer7')")
def node_trace(spark, sf):
    return G.node_trace(assertions(spark, sf), documents(spark), root(spark, "Customer_7"))


@query(f"WITH {FACTS} {DOCS} SELECT {TRACE} WHERE subject_node_id = sha256('supplier3') AND object_node_id = sha256('part7') AND upper(predicate) = 'PROVIDES'")
def edge_trace(spark, sf):
    return G.edge_trace(assertions(spark, sf), documents(spark), root(spark), "provides", root(spark, "Part_7"))


@query(with_facts("SELECT edge_id, from_node_id, to_node_id, CAST(count(*) AS BIGINT) AS support FROM (SELECT edge_id, subject_node_id AS from_node_id, object_node_id AS to_node_id FROM assertions WHERE document_id IN ('submits', 'resides')) GROUP BY ALL"))
def graph_export_project(spark, sf):
    return G.export(assertions(spark, sf), documents(spark), "shop")[1].select("edge_id", "from_node_id", "to_node_id", "support")


@query(with_facts(f", x AS (SELECT * FROM assertions WHERE document_id IN ('submits', 'resides')), w AS (SELECT document_id, seq, 0 AS side, subject AS name, subject_node_id AS node_id FROM x UNION ALL SELECT document_id, seq, 1, object, object_node_id FROM x) SELECT node_id, arg_max(name, (document_id, seq, side)) AS canonical_name FROM w GROUP BY node_id"))
def graph_export_nodes(spark, sf):
    """The nodes of an export are the ends of its links."""
    return G.export(assertions(spark, sf), documents(spark), "shop")[0].select("node_id", "canonical_name")


@query(with_facts("SELECT edge_id, CAST(count(*) AS BIGINT) AS support FROM assertions WHERE document_id = 'provides' OR (document_id = 'contains' AND seq % 7 = 0) GROUP BY edge_id"))
def graph_export_run(spark, sf):
    """A project's edges: by its documents' runs, or by the root that an assertion itself has."""
    rows = assertions(spark, sf).withColumn("project_root", F.when((F.col("document_id") == "contains") & (F.col("seq") % 7 == 0), "supply").when(F.col("document_id") == "provides", "supply"))
    return G.export(rows, documents(spark), "supply")[1].select("edge_id", "support")


@query(with_facts("SELECT d.document_id, CASE WHEN n IS NULL THEN 'DISCOVERED' ELSE 'QUERYABLE' END AS status, n AS indexed_assertions, e AS indexed_edges FROM (VALUES ('submits'), ('provides'), ('resides')) d(document_id) LEFT JOIN (SELECT document_id, count(*) AS n, count(DISTINCT edge_id) AS e FROM assertions WHERE document_id IN ('resides', 'contains') GROUP BY 1) c USING (document_id)"))
def graph_run_status(spark, sf):
    """The graph of one run: its documents become queryable and get their counters."""
    rows = assertions(spark, sf).withColumn("ingestion_run_id", F.when(F.col("document_id").isin("resides", "contains"), "run-1").otherwise("run-2"))
    docs = documents(spark).select("document_id", F.lit("DISCOVERED").alias("status"))
    return G.built(docs, G.build_run(rows, "run-1")["counts"]).select("document_id", "status", "indexed_assertions", "indexed_edges")


@query(with_facts(", x AS (SELECT *, seq % 2 AS r FROM assertions WHERE document_id = 'resides'), old AS (SELECT DISTINCT edge_id FROM assertions WHERE document_id IN ('part', 'submits')) SELECT edge_id FROM old UNION SELECT edge_id FROM x WHERE r = 1"))
def graph_rebuild_document(spark, sf):
    """A document's latest run is built again into a graph that has other documents only."""
    rows = assertions(spark, sf).withColumn("ingestion_run_id", F.concat_ws("-", "document_id", (F.col("seq") % 2).cast("string")))
    old = rows.where("document_id in ('part', 'submits')")
    runs = spark.createDataFrame([("resides-0", "resides", 1), ("resides-1", "resides", 2), ("contains-0", "contains", 3)], "ingestion_run_id string, document_id string, created_at int")
    return G.rebuild_document(rows, runs, "resides", {"nodes": G.nodes(old), "edges": G.edges(old)})["edges"].select("edge_id")


@query(with_facts("SELECT document_id, count(*) AS n FROM assertions WHERE document_id NOT IN ('provides') GROUP BY 1"))
def soft_delete_visibility(spark, sf):
    """A document deleted an hour ago is hidden; one deleted longer ago than the cache keeps is not."""
    gone = spark.createDataFrame([("provides", "2024-01-02 11:00:00"), ("resides", "2024-01-01 00:00:00")], "document_id string, at string").select("document_id", F.to_timestamp_ntz("at").alias("deleted_at"))
    now = F.to_timestamp_ntz(F.lit("2024-01-02 12:00:00"))
    return G.visible(assertions(spark, sf), gone, now).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query(with_facts("SELECT DISTINCT edge_id FROM assertions WHERE document_id = 'provides' AND edge_id NOT IN (SELECT edge_id FROM assertions WHERE document_id <> 'provides')"))
def document_cascade_delete(spark, sf):
    return G.delete_document(assertions(spark, sf), "provides")["orphan_edges"]


@query(with_facts(", left_ AS (SELECT * FROM assertions WHERE document_id <> 'provides'), le AS (SELECT subject_node_id AS n FROM left_ UNION SELECT object_node_id FROM left_) SELECT 'assertions' AS name, count(*) AS n FROM left_ UNION ALL SELECT 'documents', 2 UNION ALL SELECT 'runs', 2 UNION ALL SELECT 'chunks', 3 UNION ALL SELECT 'pending', 1 UNION ALL SELECT 'edges', count(DISTINCT edge_id) FROM left_ UNION ALL SELECT 'nodes', count(*) FROM le UNION ALL SELECT 'orphan_nodes', count(*) FROM (SELECT DISTINCT node_id FROM ends WHERE node_id NOT IN (SELECT n FROM le))"))
def document_delete_tables(spark, sf):
    """What a hard delete leaves in each table."""
    rows = assertions(spark, sf)
    few = lambda *ids: spark.createDataFrame([(i,) for i in ids], "document_id string")
    tables = {"assertions": rows, "documents": documents(spark), "runs": few("submits", "provides", "provides", "resides"), "chunks": few("submits", "submits", "provides", "resides"), "pending": few("provides", "resides"), "nodes": G.node_rows(rows), "edges": G.edge_rows(rows)}
    out = G.hard_delete(tables, few("provides", "provides"))
    del out["orphan_edges"]
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in out.items()]
    result = counts[0]
    for c in counts[1:]:
        result = result.unionByName(c)
    return result


@query(with_facts("SELECT DISTINCT node_id FROM ends JOIN assertions USING (assertion_id) WHERE document_id = 'submits' AND node_id NOT IN (SELECT node_id FROM ends JOIN assertions USING (assertion_id) WHERE document_id <> 'submits')"))
def orphan_nodes(spark, sf):
    return G.delete_document(assertions(spark, sf), "submits")["orphan_nodes"]


@query(with_facts("SELECT DISTINCT node_id FROM ends JOIN assertions USING (assertion_id) WHERE predicate = 'PART_OF' AND node_id NOT IN (SELECT node_id FROM ends JOIN assertions USING (assertion_id) WHERE predicate <> 'PART_OF')"))
def curation_revoke(spark, sf):
    from ..functions.predicates import seed

    return C.revoke(assertions(spark, sf), seed(spark), "part_of")["orphan_nodes"]


@query(f"WITH {FACTS} {graph_sql(1).replace('SELECT assertion_id, raw_text, CAST', 'SELECT printf(chr(37) || chr(46) || chr(49) || chr(102), round(final_score, 1)) || chr(124) || depth || chr(124) || raw_text AS line FROM (SELECT assertion_id, raw_text, CAST', 1)})")
def tool_lines(spark, sf):
    return R.render_hits(R.query_graph(index(spark, sf), TEXT, 1))


@query(with_facts("SELECT predicate, count(*) AS n, count(DISTINCT edge_id) AS n_edges FROM assertions GROUP BY predicate"))
def predicate_usage(spark, sf):
    return assertions(spark, sf).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("edge_id").alias("n_edges"))


@query(with_facts(", e AS (SELECT DISTINCT document_id, node_id FROM ends JOIN assertions USING (assertion_id)) SELECT document_id, a.n AS assertions, a.e AS edges, count(*) AS nodes FROM e JOIN (SELECT document_id, count(*) AS n, count(DISTINCT edge_id) AS e FROM assertions GROUP BY 1) a USING (document_id) GROUP BY ALL"))
def document_counts(spark, sf):
    return G.document_counts(assertions(spark, sf))


@query(with_facts("SELECT DISTINCT edge_id FROM assertions WHERE document_id = 'provides' AND edge_id NOT IN (SELECT edge_id FROM assertions WHERE document_id <> 'provides')"))
def deletion_sweep(spark, sf):
    """Two documents are deleted and one of them is restored before the sweep."""
    docs = documents(spark).withColumn("marked_for_deletion_at", F.lit(None).cast("timestamp_ntz"))
    at = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    docs = G.restore(G.mark_deleted(docs, ["provides", "submits"], at), ["submits"])
    return G.sweep({"documents": docs, "assertions": assertions(spark, sf)}, F.to_timestamp_ntz(F.lit("2024-01-01 00:05:01")))["orphan_edges"]


@query(with_facts(", g AS (SELECT DISTINCT edge_id, predicate FROM assertions) SELECT predicate, count(*) AS n FROM g WHERE edge_id IN (SELECT edge_id FROM assertions WHERE subject_node_id = sha256('customer7') UNION SELECT edge_id FROM assertions WHERE object_node_id = sha256('customer7')) GROUP BY predicate"))
def term_filter(spark, sf):
    """Edges with either end in a set of nodes, made of the assertions there."""
    wanted = spark.range(1).select(T.node_id(F.lit("Customer_7")).alias("node_id"))
    return G.edge_rows(G.touching(facts(spark, sf), wanted)).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


# The tools from SQL -----------------------------------------------------------------------------------------------------
def _sql(spark, sf, text: str, **values: str):
    """A statement over the table functions of the shared index, whose names begin with ``kg_``."""
    sqltools.register(index(spark, sf), "kg_")
    return spark.sql(text, values)


@query(f"WITH {FACTS} {BFS} SELECT node_id, CAST(hop AS INT) AS hop FROM seen3")
def sql_neighbours(spark, sf):
    return _sql(spark, sf, "SELECT * FROM kg_neighbours(:root, 3)", root=root(spark))


@query(f"WITH {FACTS} {BFS}, {EDGES_SEEN} SELECT 'node' AS kind, node_id AS id, NULL AS from_node_id, NULL AS to_node_id, CAST(hop AS INT) AS hop FROM seen2 WHERE hop > 0 UNION ALL SELECT 'edge', edge_id, from_node_id, to_node_id, CAST(hop AS INT) FROM se JOIN edges USING (edge_id)")
def sql_neighbourhood(spark, sf):
    return _sql(spark, sf, "SELECT * FROM kg_neighbourhood(:root, 2)", root=root(spark))


@query(f"WITH {FACTS} {graph_sql(1)}")
def sql_query_graph(spark, sf):
    return _sql(spark, sf, "SELECT * FROM kg_query_graph(:words, 1)", words=TEXT)


@query(SQL["explain_path"])
def sql_explain_path(spark, sf):
    return _sql(spark, sf, "SELECT * FROM kg_explain_path(:wanted)", wanted=seed_id(spark, sf))


@query(with_facts("SELECT r.object_node_id AS place, count(DISTINCT CASE WHEN b <> r.object_node_id THEN b END) AS around FROM (SELECT DISTINCT object_node_id FROM assertions WHERE document_id = 'resides') r JOIN links ON a = r.object_node_id GROUP BY 1"))
def sql_lateral_neighbours(spark, sf):
    """A table function called for each row of a table: how many nodes are next to each place."""
    return _sql(spark, sf, "SELECT r.object_node_id AS place, count(*) AS around FROM (SELECT DISTINCT object_node_id FROM kg_assertions WHERE document_id = 'resides') r, LATERAL kg_neighbours(r.object_node_id, 1) n WHERE n.hop > 0 GROUP BY 1")
