"""The graph: nodes, edges and their support from assertions; deletion and curation of what it rests on.

Identifiers are content hashes, so building is idempotent and endpoints are projections, not joins. Equal identifiers are equal
names, which are much shorter: rows are grouped and joined by the keys of names, and identifiers made of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def identify(facts: DataFrame) -> DataFrame:
    """``facts`` (document_id, seq, subject, predicate, object, raw_text, ...) with all their hashes."""
    out = facts.withColumn("semantic_checksum", T.semantic_checksum(F.col("subject"), F.col("predicate"), F.col("object")))
    out = out.withColumn("assertion_id", T.assertion_id(F.col("document_id"), F.col("seq"), F.col("semantic_checksum")))
    out = out.withColumn("subject_node_id", T.node_id(F.col("subject"))).withColumn("object_node_id", T.node_id(F.col("object")))
    return out.withColumn("edge_id", T.edge_id(F.col("subject_node_id"), F.col("predicate"), F.col("object_node_id")))


def endpoints(assertions: DataFrame) -> DataFrame:
    """One row per assertion and end: the equi-join form of ``subject = n or object = n``."""
    ends = F.array_distinct(F.array("subject_node_id", "object_node_id"))
    return assertions.select("assertion_id", F.explode(ends).alias("node_id"))


#: Nodes, or ends of assertions, up to which rows are told by a list of constants, which Spark tests where it reads them.
LISTED = 10_000
#: What edges and nodes are grouped by.
EDGE_KEY, NODE_KEY = ("from_key", "predicate", "to_key"), ("key",)


def keyed(assertions: DataFrame) -> DataFrame:
    """``assertions`` with the keys of their edges: ``from_key``, ``to_key`` beside ``predicate``."""
    return assertions.withColumn("from_key", T.name_key(F.col("subject"))).withColumn("to_key", T.name_key(F.col("object")))


def keys_of(assertions: DataFrame, *by: str) -> DataFrame:
    """``key`` of both ends of each assertion."""
    return assertions.select(*by, F.explode(F.array(T.name_key(F.col("subject")), T.name_key(F.col("object")))).alias("key"))


def node_rows(assertions: DataFrame, *by: str) -> DataFrame:
    """``nodes`` by ``key`` in place of ``node_id``."""
    side = F.explode(F.array(F.struct(F.col("subject").alias("name"), F.lit(0).alias("side")), F.struct(F.col("object").alias("name"), F.lit(1).alias("side"))))
    rows = assertions.select(*by, "document_id", "seq", side.alias("n")).select(*by, T.name_key(F.col("n.name")).alias("key"), F.struct("document_id", "seq", "n.side", "n.name").alias("w"))
    return rows.groupBy(*by, "key").agg(F.max("w").alias("w")).select(*by, "key", F.col("w.name").alias("canonical_name"))


def edge_rows(assertions: DataFrame, *by: str) -> DataFrame:
    """``edges`` by ``from_key``, ``predicate``, ``to_key`` in place of identifiers."""
    rows = keyed(assertions).groupBy(*by, *EDGE_KEY).agg(F.min(F.struct("document_id", "seq")).alias("w"), F.count(F.lit(1)).alias("support"))
    return rows.select(*by, *EDGE_KEY, F.col("w.document_id").alias("document_id"), "support")


def with_node_ids(rows: DataFrame) -> DataFrame:
    """``rows`` by ``key`` with ``node_id`` in its place."""
    return rows.select(T.key_id(F.col("key")).alias("node_id"), *(c for c in rows.columns if c != "key"))


def with_edge_ids(rows: DataFrame) -> DataFrame:
    """``rows`` by the keys of edges with ``edge_id`` and the identifiers of both ends in place of keys."""
    rows = rows.select(T.key_id(F.col("from_key")).alias("from_node_id"), T.key_id(F.col("to_key")).alias("to_node_id"), *(c for c in rows.columns if c not in ("from_key", "to_key")))
    return rows.select(T.edge_id(F.col("from_node_id"), F.col("predicate"), F.col("to_node_id")).alias("edge_id"), *rows.columns)


def nodes(assertions: DataFrame, *by: str) -> DataFrame:
    """``node_id``, ``normalized_name`` and the name of the last writer; apart for each value of the columns ``by``."""
    out = with_node_ids(node_rows(assertions, *by)).withColumn("normalized_name", T.normalize_entity(F.col("canonical_name")))
    return out.select(*by, "node_id", "canonical_name", "normalized_name")


def edges(assertions: DataFrame, *by: str) -> DataFrame:
    """``edge_id``, its ends and predicate, the document of its first writer, and the assertions that support it."""
    return with_edge_ids(edge_rows(assertions, *by)).select(*by, "edge_id", "from_node_id", "predicate", "to_node_id", "document_id", "support")


def merge(existing: DataFrame, built: DataFrame, *key: str) -> DataFrame:
    """``existing`` and what it lacks of ``built``."""
    return existing.unionByName(built.join(existing, list(key), "left_anti"), allowMissingColumns=True)


def undirected(edges: DataFrame, *by: str) -> DataFrame:
    pair = F.explode(F.array(F.struct(F.col("from_node_id").alias("a"), F.col("to_node_id").alias("b")), F.struct(F.col("to_node_id").alias("a"), F.col("from_node_id").alias("b"))))
    return edges.select(*by, "edge_id", pair.alias("p")).select(*by, "edge_id", "p.a", "p.b")


def degrees(edges: DataFrame, *by: str) -> DataFrame:
    """``node_id`` (of ``edge_rows``: ``key``) and the edge ends at it."""
    key, ends = ("key", ("from_key", "to_key")) if "from_key" in edges.columns else ("node_id", ("from_node_id", "to_node_id"))
    return edges.select(*by, F.explode(F.array(*ends)).alias(key)).groupBy(*by, key).agg(F.count(F.lit(1)).alias("degree"))


def touching(assertions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Assertions with either end in a set of nodes (node_id): all those of the edges there, which can be made of them alone."""
    out, mine = assertions, wanted.where("node_id is not null").select(F.col("node_id").alias("_id")).distinct()
    few = mine.limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        ids = [r["_id"] for r in few]
        return out.where(T.node_id(F.col("subject")).isin(ids) | T.node_id(F.col("object")).isin(ids))
    for side in ("subject", "object"):
        out = out.withColumn("_id", T.node_id(F.col(side))).join(mine.withColumn(f"_at_{side}", F.lit(True)), "_id", "left").drop("_id")
    return out.where("_at_subject or _at_object").drop("_at_subject", "_at_object")


def node_trace(source, docs: DataFrame, node: str) -> DataFrame:
    """Assertions about a node, with the document they come from; of assertions by a scan, of an index from the node's buckets."""
    return _with_document(_at(source, node).where((F.col("subject_node_id") == node) | (F.col("object_node_id") == node)), docs)


def edge_trace(source, docs: DataFrame, from_node: str, predicate: str, to_node: str) -> DataFrame:
    """The same for an edge; an index is asked for the node it starts from."""
    rows = _at(source, from_node).where((F.col("subject_node_id") == from_node) & (F.col("object_node_id") == to_node) & (F.upper("predicate") == predicate.upper()))
    return _with_document(rows, docs)


def _at(source, node: str) -> DataFrame:
    """Assertions that may be at a node: all of a table, those at the node of an index."""
    if isinstance(source, DataFrame):
        return source
    return source.assertions(source.ends(source.spark.range(1).select(F.lit(node).alias("node_id"))))


def _with_document(rows: DataFrame, docs: DataFrame) -> DataFrame:
    out = rows.join(docs.select("document_id", "name", "path"), "document_id", "left")
    return out.select("assertion_id", "document_id", F.coalesce("name", F.lit("Unknown")).alias("document_name"), F.coalesce("path", F.lit("")).alias("document_path"), "subject", "predicate", "object", "raw_text")


def visible(rows: DataFrame, deletions: DataFrame, now, hours: int = 8) -> DataFrame:
    """``rows`` without those of documents deleted and not older than the cache keeps deletions."""
    live = deletions.where(F.col("deleted_at") >= now - F.expr(f"interval {hours} hours")).select("document_id").distinct()
    return rows.join(live, "document_id", "left_anti")


def of_project(docs: DataFrame, project: str) -> DataFrame:
    """``document_id`` of a project's documents; a blank root is derived from the path."""
    root = F.coalesce(F.nullif(F.trim("project_root"), F.lit("")), T.project_root(F.col("path")))
    return docs.where(root == project).select("document_id").distinct()


def in_project(assertions: DataFrame, docs: DataFrame, project: str) -> DataFrame:
    """Assertions of a project: their own root, or their run, is one of the project's.

    Runs belong to documents, so the run side is a semi-join on the documents. An assertion that both sides take is one row.
    """
    ours = assertions.join(of_project(docs, project), "document_id", "left_semi")
    if "project_root" not in assertions.columns:
        return ours
    return ours.unionByName(assertions.where(F.col("project_root") == project).join(of_project(docs, project), "document_id", "left_anti"))


def export(assertions: DataFrame, docs: DataFrame, project: str | None = None, deletions: DataFrame | None = None, now=None) -> tuple[DataFrame, DataFrame]:
    """Nodes and links that documents of a project and not deleted support; nodes are the ends of these links."""
    if deletions is not None:
        assertions = visible(assertions, deletions, now)
    if project is not None:
        assertions = in_project(assertions, docs, project)
    return nodes(assertions), edges(assertions)


def edge_ends(edge_rows: DataFrame, edge: str) -> DataFrame:
    """``node_id`` of both ends of an edge."""
    return edge_rows.where(F.col("edge_id") == edge).select(F.explode(F.array_distinct(F.array("from_node_id", "to_node_id"))).alias("node_id"))


def build_run(assertions: DataFrame, run: str) -> dict[str, DataFrame]:
    """The graph of one ingestion run: its nodes and edges, and how many assertions and edges each of its documents has."""
    own = assertions.where(F.col("ingestion_run_id") == run)
    counts = own.groupBy("document_id").agg(F.count(F.lit(1)).alias("indexed_assertions"), F.countDistinct("edge_id").alias("indexed_edges"))
    return {"nodes": nodes(own), "edges": edges(own), "counts": counts}


def built(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``docs`` with the counters of a build; the documents in it are queryable."""
    old = docs.select(*(c for c in docs.columns if c not in ("indexed_assertions", "indexed_edges")))
    out = old.join(counts, "document_id", "left")
    return out.withColumn("status", F.when(F.col("indexed_assertions").isNotNull(), "QUERYABLE").otherwise(F.col("status")))


def rebuild_document(assertions: DataFrame, runs: DataFrame, document: str, existing: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The graph with that of a document's latest run merged in; building again what is there changes nothing."""
    latest = runs.where(F.col("document_id") == document).groupBy("document_id").agg(F.max_by("ingestion_run_id", F.struct("created_at", "ingestion_run_id")).alias("ingestion_run_id"))
    own = assertions.join(latest.select("ingestion_run_id"), "ingestion_run_id", "left_semi")
    return {"nodes": merge(existing["nodes"], nodes(own), "node_id"), "edges": merge(existing["edges"], edges(own), "edge_id")}


def runs_of(runs: DataFrame, document: str) -> DataFrame:
    """The ingestion runs of a document, oldest first."""
    return runs.where(F.col("document_id") == document).orderBy("created_at", "ingestion_run_id")


#: Seconds between a document's deletion and the sweep that removes it for good.
GRACE_SECONDS = 300


def mark_deleted(docs: DataFrame, ids: list[str], now) -> DataFrame:
    """Soft-delete documents: they are due for removal after the grace period. Marked ones keep their time."""
    at = F.timestamp_micros(F.unix_micros(now.cast("timestamp")) + GRACE_SECONDS * 1_000_000).cast("timestamp_ntz")
    return docs.withColumn("marked_for_deletion_at", F.when(F.col("document_id").isin(*ids), F.coalesce("marked_for_deletion_at", at)).otherwise(F.col("marked_for_deletion_at")))


def restore(docs: DataFrame, ids: list[str]) -> DataFrame:
    return docs.withColumn("marked_for_deletion_at", F.when(~F.col("document_id").isin(*ids), F.col("marked_for_deletion_at")))


def hard_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without documents (``gone``: document_id): assertions, pending, chunks, runs, documents; and what they alone held.

    Tables that are not given are left out of the answer. ``nodes`` and ``edges``, where given (by identifiers, or as ``node_rows``
    and ``edge_rows`` by keys), lose what no assertion that is left supports; an edge that other documents support stays, whoever
    wrote it first.
    """
    gone = gone.select("document_id").distinct()
    out = {name: rows.join(gone, "document_id", "left_anti") for name, rows in tables.items() if name in ("assertions", "pending", "chunks", "runs", "documents")}
    marked = tables["assertions"].join(gone.withColumn("_gone", F.lit(True)), "document_id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    lost_edges, lost_nodes = unsupported(marked)
    out["orphan_edges"] = with_edge_ids(lost_edges).select("edge_id")
    out["orphan_nodes"] = with_node_ids(lost_nodes)
    if "edges" in tables:
        of_keys = "from_key" in tables["edges"].columns
        out["edges"] = tables["edges"].join(lost_edges if of_keys else out["orphan_edges"], list(EDGE_KEY) if of_keys else "edge_id", "left_anti")
    if "nodes" in tables:
        of_keys = "key" in tables["nodes"].columns
        out["nodes"] = tables["nodes"].join(lost_nodes if of_keys else out["orphan_nodes"], "key" if of_keys else "node_id", "left_anti")
    return out


def unsupported(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes, by their keys, all of whose assertions are ``_gone``; one aggregation each."""
    def all_gone(rows: DataFrame, *key: str) -> DataFrame:
        return rows.groupBy(*key).agg(F.bool_and("_gone").alias("_gone")).where("_gone").select(*key)

    return all_gone(keyed(marked), *EDGE_KEY), all_gone(keys_of(marked, "_gone"), *NODE_KEY)


def lost_nodes(assertions: DataFrame, gone: Column) -> DataFrame:
    """``key`` of the nodes all of whose assertions are ``gone``; if these are few, the others are read at their ends only."""
    few = keys_of(assertions.where(gone)).limit(LISTED + 1).collect()
    keys = None if len(few) > LISTED else sorted({bytes(r["key"]) for r in few})
    if keys is not None:
        assertions = assertions.where(T.name_key(F.col("subject")).isin(keys) | T.name_key(F.col("object")).isin(keys))
    ends = keys_of(assertions.withColumn("_gone", gone), "_gone")
    return (ends if keys is None else ends.where(F.col("key").isin(keys))).groupBy(*NODE_KEY).agg(F.bool_and("_gone").alias("_gone")).where("_gone").select(*NODE_KEY)


def delete_document(assertions: DataFrame, document: str) -> dict[str, DataFrame]:
    """What is left without a document, and which nodes and edges lose their last support."""
    return hard_delete({"assertions": assertions}, assertions.sparkSession.createDataFrame([(document,)], "document_id string"))


def sweep(tables: dict[str, DataFrame], now) -> dict[str, DataFrame]:
    """``hard_delete`` of the documents whose time has come."""
    return hard_delete(tables, tables["documents"].where(F.col("marked_for_deletion_at") < now))


def document_counts(assertions: DataFrame) -> DataFrame:
    """Assertions, nodes and edges of each document."""
    edges = keyed(assertions).groupBy("document_id", *EDGE_KEY).agg(F.count(F.lit(1)).alias("n"))
    counts = edges.groupBy("document_id").agg(F.sum("n").alias("assertions"), F.count("predicate").alias("edges"))
    ends = keys_of(assertions, "document_id").distinct()
    return counts.join(ends.groupBy("document_id").agg(F.count(F.lit(1)).alias("nodes")), "document_id")
