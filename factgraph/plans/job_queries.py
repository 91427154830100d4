"""The jobs over the whole tables, each run twice into one new folder, and what stands there after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobs import ingest_documents, monthly_graph

from ..session import shared_root
from .pipeline_queries import HEADINGS_SQL
from .registry import query


def _folder(spark, name: str) -> str:
    """A new folder in the shared one; it stays."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


VERBS = "|".join(ingest_documents.Config().verbs)
SENTENCE = rf"(?i)^\s*(.+?)\s+({VERBS})\s+(.+?)\s*$"
NODE = r"sha256(regexp_replace(lower({}), '[\s_-]+', '', 'g'))"

INGEST_SQL = rf"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, max((coalesce(text, ''), coalesce(lang, ''))) AS m FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
md AS (SELECT document_id, m[1] AS text, m[2] AS lang FROM d), {HEADINGS_SQL},
c AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY section) AS seq, content, sha256(section_path || normalized_content) AS chunk_checksum FROM n),
c1 AS (SELECT *, row_number() OVER (PARTITION BY chunk_checksum ORDER BY document_id, seq) = 1 AS fresh FROM c),
sent AS (SELECT chunk_checksum, unnest(regexp_split_to_array(content, '[.\n]+')) AS s FROM c1 WHERE fresh),
rec AS (SELECT chunk_checksum, regexp_extract(s, '{SENTENCE}', 1) AS subject, upper(regexp_extract(s, '{SENTENCE}', 2)) AS predicate, regexp_extract(s, '{SENTENCE}', 3) AS object FROM sent WHERE regexp_matches(s, '{SENTENCE}')),
f AS (SELECT document_id, seq, subject, predicate, object, {NODE.format('subject')} AS a, {NODE.format('object')} AS b FROM c1 JOIN rec USING (chunk_checksum) WHERE regexp_matches(subject, '\S') AND regexp_matches(object, '\S')),
g AS (SELECT document_id, min(seq) AS seq, any_value(predicate) AS predicate, any_value(a) AS a, any_value(b) AS b FROM f GROUP BY document_id, upper(subject) || '|' || predicate || '|' || upper(object))
SELECT 'document' AS kind, lang AS part, document_id AS id, sha256(text) AS other, CAST(1 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS writer FROM md
UNION ALL SELECT 'chunk', CASE WHEN fresh THEN 'fresh' ELSE 'seen' END, document_id || '#' || seq, chunk_checksum, length(content), NULL FROM c1
UNION ALL SELECT 'edge', predicate, a, b, count(*), arg_min(document_id, (document_id, seq)) FROM g GROUP BY predicate, a, b
UNION ALL SELECT 'node', NULL, node_id, NULL, count(*), NULL FROM (SELECT a AS node_id FROM g UNION ALL SELECT b FROM g) GROUP BY node_id
"""


@query(INGEST_SQL)
def job1_ingest_documents(spark, sf):
    """The documents as a stream of files: versions, chunks and the graph of what sentences state. The second run finds nothing new."""
    here = _folder(spark, "job1")
    for _ in range(2):
        ingest_documents.ingest(spark, f"{sf}/documents.parquet", f"{here}/out", f"{here}/checkpoint")
    t, none = ingest_documents.tables(spark, f"{here}/out"), F.lit(None).cast("string")
    parts = [
        t["documents"].select(F.lit("document").alias("kind"), F.col("lang").alias("part"), F.col("document_id").alias("id"), F.col("checksum").alias("other"), F.col("version").cast("long").alias("n"), none.alias("writer")),
        t["chunks"].select(F.lit("chunk"), F.when(F.col("fresh"), "fresh").otherwise("seen"), F.concat_ws("#", "document_id", "sequence_number"), "chunk_checksum", F.length("content").cast("long"), none),
        t["edges"].select(F.lit("edge"), "predicate", "from_node_id", "to_node_id", "support", "document_id"),
        t["nodes"].select(F.lit("node"), none, "node_id", none, "support", none),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


MONTHLY_SQL = r"""
WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS month, 'order/' || o_orderkey AS document_id FROM orders WHERE o_orderdate IS NOT NULL),
f AS (SELECT month, document_id, 0 AS seq, 'Customer_' || o_custkey AS subject, 'SUBMITS' AS predicate, 'Order_' || o_orderkey AS object FROM o
  UNION ALL SELECT month, document_id, 2 * l_linenumber - 1, 'Order_' || l_orderkey, 'CONTAINS', 'Part_' || l_partkey FROM lineitem JOIN o ON l_orderkey = o_orderkey
  UNION ALL SELECT month, document_id, 2 * l_linenumber, 'Supplier_' || l_suppkey, 'PROVIDES', 'Part_' || l_partkey FROM lineitem JOIN o ON l_orderkey = o_orderkey),
h AS (SELECT *, sha256(replace(lower(subject), '_', '')) AS a, sha256(replace(lower(object), '_', '')) AS b FROM f),
e AS (SELECT month, a, predicate, b, count(*) AS support, arg_min(document_id, (document_id, seq)) AS document_id FROM h GROUP BY ALL),
n AS (SELECT month, node_id, count(*) AS degree FROM (SELECT month, a AS node_id FROM e UNION ALL SELECT month, b FROM e) GROUP BY ALL),
x AS (SELECT month, count(*) AS edges, sum(support) AS assertions FROM e GROUP BY month), y AS (SELECT month, count(*) AS nodes, max(degree) AS most FROM n GROUP BY month), z AS (SELECT month, count(*) AS documents FROM o GROUP BY month)
SELECT month, 'edge' AS kind, a AS id, predicate, b AS other, CAST(support AS BIGINT) AS n, document_id AS document, CAST(NULL AS DOUBLE) AS figure FROM e
UNION ALL SELECT month, 'node', node_id, NULL, NULL, degree, NULL, NULL FROM n
UNION ALL SELECT month, 'degrees', NULL, NULL, NULL, most, NULL, round(2.0 * edges / nodes, 6) FROM x JOIN y USING (month)
UNION ALL SELECT month, 'documents', NULL, NULL, NULL, documents, NULL, round(assertions / documents, 6) FROM x JOIN z USING (month)
"""


@query(MONTHLY_SQL)
def job2_monthly_graph(spark, sf):
    """Edges, nodes and figures of every month of the orders; the second run makes all months again."""
    out = _folder(spark, "job2")
    for _ in range(2):
        monthly_graph.build(spark, sf, out)
    t, none, figure = {n: monthly_graph.read_table(spark, out, n) for n in monthly_graph.SCHEMAS}, F.lit(None).cast("string"), F.lit(None).cast("double")
    parts = [
        t["edges"].select("month", F.lit("edge").alias("kind"), F.col("from_node_id").alias("id"), "predicate", F.col("to_node_id").alias("other"), F.col("support").alias("n"), F.col("document_id").alias("document"), figure.alias("figure")),
        t["nodes"].select("month", F.lit("node"), "node_id", none, none, "degree", none, figure),
        t["metrics"].select("month", F.lit("degrees"), none, none, none, "max_degree", none, "mean_degree"),
        t["metrics"].select("month", F.lit("documents"), none, none, none, "documents", none, "assertions_per_document"),
    ]
    out_rows = parts[0]
    for part in parts[1:]:
        out_rows = out_rows.union(part)
    return out_rows
