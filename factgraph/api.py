"""The tools and dashboard operations as functions that return DataFrames, and the whole ingestion as one plan.

``Graph`` answers questions about a built graph. ``Documents``, ``Predicates`` and ``Bulk`` are the operations on what a ``Store``
holds: they read its tables, apply a function of the operators and write the new snapshots.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import predicates as P
from .functions import text as T
from .operators import curation as C
from .operators import graph as G
from .operators import index as I
from .operators import markdown, stages, validate
from .operators import metrics as X
from .operators import retrieve as R
from .operators import sqltools
from .sources import extractors
from .sources.files import Config, Store, scan, upload


@dataclass
class Graph:
    """A built graph; with an index, questions read what they touch. ``views`` makes its tables visible to SQL."""

    spark: SparkSession
    assertions: DataFrame
    documents: DataFrame
    index: I.SearchIndex | None = None
    deleted: DataFrame | None = None

    @property
    def source(self) -> R.Source:
        return R.over(self.assertions) if self.index is None else self.index

    def indexed(self, folder: str) -> Graph:
        """The same graph with a search index in ``folder``."""
        return Graph(self.spark, self.assertions, self.documents, I.build(self.assertions, folder), self.deleted)

    def views(self) -> None:
        self.assertions.createOrReplaceTempView("assertions")
        G.nodes(self.assertions).createOrReplaceTempView("nodes")
        G.edges(self.assertions).createOrReplaceTempView("edges")

    def functions(self, prefix: str = "") -> list[str]:
        """Make the tools table functions of SQL, without caps; returns their names."""
        return sqltools.register(self.index or self.assertions, prefix, self.deleted)

    # Tools: hops and explanations are capped, as what answers a tool must stay readable; None takes the caps off.
    def query_graph(self, text: str, depth: int = 1, cap: int | None = R.HOP_CAP, edge_cap: int | None = R.HOP_CAP) -> DataFrame:
        return R.ranked(R.query_graph(self.source, text, depth, cap=cap, edge_cap=edge_cap, deleted=self.deleted))

    def explain_path_by_assertion_id(self, assertion_id: str, cap: int | None = R.EXPLAIN_CAP) -> DataFrame:
        return R.explain(self.source, assertion_id, cap, self.deleted)

    def get_node_neighbour(self, node_id: str, depth: int = 1, edge_cap: int | None = R.HOP_CAP) -> DataFrame:
        return R.neighbourhood(self.source, node_id, depth, edge_cap, self.deleted)

    def get_assertion_by_id(self, assertion_id: str) -> DataFrame:
        return R.lookup(self.source, assertion_id, self.deleted)

    # The same as text.
    def render(self, lines: DataFrame) -> str:
        """A tool's whole answer: what the tool's caps left of it."""
        return "\n".join(r["line"] for r in lines.collect()) or "(no results)"

    def render_query(self, text: str, depth: int = 1) -> str:
        return self.render(R.render_hits(self.query_graph(text, depth)))

    def render_explanation(self, assertion_id: str) -> str:
        return self.render(R.render_explanation(self.source, assertion_id, deleted=self.deleted))

    def render_neighbours(self, node_id: str, depth: int = 1) -> str:
        return self.render(R.render_neighbourhood(self.get_node_neighbour(node_id, depth)))

    def render_assertion(self, assertion_id: str) -> str:
        return self.render(R.render_assertion(self.get_assertion_by_id(assertion_id)))

    # Dashboard.
    def node_trace(self, node_id: str) -> DataFrame:
        return G.node_trace(self.index or self.assertions, self.documents, node_id)

    def edge_trace(self, from_node: str, predicate: str, to_node: str) -> DataFrame:
        return G.edge_trace(self.index or self.assertions, self.documents, from_node, predicate, to_node)

    def level(self, node_id: str, level: int) -> DataFrame:
        return R.subgraph(self.source, node_id, level)

    def highlight(self, node_id: str) -> DataFrame:
        return R.neighbours(self.source, self.spark.createDataFrame([(node_id,)], "node_id string"), 1)

    def export(self, project: str | None = None) -> tuple[DataFrame, DataFrame]:
        return G.export(I.hidden(self.assertions, self.deleted), self.documents, project)

    def metrics(self) -> DataFrame:
        return X.summary({"assertions": self.assertions, "documents": self.documents, "nodes": G.nodes(self.assertions), "edges": G.edges(self.assertions)})


@dataclass
class Documents:
    """Documents of a store: tables ``documents``, ``assertions``, ``pending``, ``chunks``, ``runs``, ``nodes``, ``edges`` as far as they are there."""

    store: Store
    landing: str

    def _tables(self) -> dict[str, DataFrame]:
        return {n: self.store.read(n) for n in ("documents", "assertions", "pending", "chunks", "runs", "nodes", "edges") if self.store.exists(n)}

    def list(self) -> DataFrame:
        root = F.coalesce(F.nullif(F.trim("project_root"), F.lit("")), T.project_root(F.col("path")))
        docs = self.store.read("documents")
        return docs.select("document_id", "name", F.coalesce("status", F.lit("UNKNOWN")).alias("status"), "version", root.alias("project_root"), "marked_for_deletion_at").orderBy("path")

    def upload(self, content: bytes, name: str) -> str:
        return upload(self.store.spark, content, name, self.landing)

    def found(self) -> DataFrame:
        """What a scan of the landing folder sees."""
        return scan(self.store.spark, self.landing)

    def runs(self, document_id: str) -> DataFrame:
        return G.runs_of(self.store.read("runs"), document_id)

    def delete(self, document_id: str, now) -> None:
        self.store.write("documents", G.mark_deleted(self.store.read("documents"), [document_id], now))

    def restore(self, document_id: str) -> None:
        self.store.write("documents", G.restore(self.store.read("documents"), [document_id]))

    def _apply(self, out: dict[str, DataFrame]) -> None:
        self.store.write_all({name: out[name] for name in self._tables()})

    def hard_delete(self, document_id: str) -> None:
        self._apply(G.hard_delete(self._tables(), self.store.spark.createDataFrame([(document_id,)], "document_id string")))

    def sweep(self, now) -> None:
        self._apply(G.sweep(self._tables(), now))


@dataclass
class Predicates:
    """The taxonomy of a store: tables ``active``, ``aliases``, ``pending``, ``failed``, ``assertions``, ``documents``, ``nodes``, ``edges``."""

    store: Store

    def active(self) -> DataFrame:
        return P.grouped(P.backfill_groups(self.store.read("active")))

    def failed(self) -> DataFrame:
        return P.ordered_failed(self.store.read("failed"))

    def aliases(self) -> DataFrame:
        return self.store.read("aliases").orderBy("source")

    def suggestions(self) -> DataFrame:
        return P.suggestions(self.store.read("failed"), self.store.read("active"))

    def _state(self) -> C.State:
        return C.State(*(self.store.read(n) for n in ("active", "aliases", "pending", "failed", "assertions", "documents")))

    def act(self, actions: DataFrame) -> None:
        """Apply actions, bump the documents' counters and merge the graphs of the runs that changed."""
        out = C.curate(self._state(), actions)
        rows = out["assertions"]
        if "seq" not in rows.columns:
            rows = rows.withColumn("seq", F.xxhash64("raw_text"))
        out["assertions"] = G.identify(rows)  # what was promoted gets its nodes and edge
        graph = C.rebuild(out["assertions"], out["runs"], {n: self.store.read(n) for n in ("nodes", "edges")})
        self.store.write_all(graph | {n: out[n] for n in ("active", "aliases", "pending", "failed", "documents", "assertions")})

    def _one(self, action: str, name: str, target: str | None = None) -> None:
        self.act(self.store.spark.createDataFrame([(action, name, target)], "action string, name string, target string"))

    def approve(self, name: str) -> None:
        self._one("approve", name)

    def reject(self, name: str) -> None:
        self._one("reject", name)

    def map(self, name: str, target: str) -> None:
        self._one("map", name, target)

    def auto_approve(self, least: int = 3) -> int:
        """How many were approved."""
        actions = C.auto_approve(self.store.read("failed"), least).persist()
        n = actions.count()
        if n:
            self.act(actions)
        actions.unpersist()
        return n

    def revoke(self, name: str) -> None:
        out = C.revoke(self.store.read("assertions"), self.store.read("active"), name)
        nodes = self.store.read("nodes").join(out["orphan_nodes"], "node_id", "left_anti")
        edges = self.store.read("edges").where(F.upper("predicate") != name.upper())
        self.store.write_all({"nodes": nodes, "edges": edges, "active": out["active"], "assertions": out["assertions"]})


@dataclass
class Bulk:
    """Bulk jobs: mode, workers, progress, and what deduplication remembers (table ``dedup``: checksum, accepted_at)."""

    store: Store
    mode: stages.Mode = field(default_factory=stages.Mode)

    def workers(self, beats: DataFrame, now) -> DataFrame:
        return X.workers(beats, now)

    def progress(self, snapshots: DataFrame) -> DataFrame:
        return X.progress(snapshots)

    def fresh(self, files: DataFrame, now: datetime, hours: int = 168) -> DataFrame:
        """``files`` whose checksum was not accepted in the last ``hours``."""
        if not self.store.exists("dedup"):
            return files
        live = self.store.read("dedup").where(F.col("accepted_at") > F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {hours} hours"))
        return files.join(live.select("checksum"), "checksum", "left_anti")

    def accept(self, files: DataFrame, now: datetime) -> None:
        self.store.upsert("dedup", files.select("checksum").distinct().withColumn("accepted_at", F.lit(now).cast("timestamp_ntz")), "checksum", "accepted_at")

    def clear_dedup(self) -> None:
        if self.store.exists("dedup"):
            self.store.write("dedup", self.store.read("dedup").limit(0))


class Settings:
    """The language model's settings in the configuration file; ``put`` merges and saves."""

    def __init__(self, path: str):
        self.path = path

    def get(self) -> dict:
        return Config.load(self.path).llm

    def put(self, **changes) -> dict:
        config = Config.load(self.path)
        config.llm |= {k: v for k, v in changes.items() if v is not None}
        config.save(self.path)
        return config.llm


def ingest(docs: DataFrame, answers: DataFrame | None = None, active: DataFrame | None = None, aliases: DataFrame | None = None, verbs: list[str] | None = None) -> dict[str, DataFrame]:
    """``docs`` (document_id, path, text) to chunks, validated records and a graph; one lazy plan, but distinct predicates are resolved at once.

    Records come from recorded ``answers`` (chunk_id, body), else from sentences with one of ``verbs``. ``unreadable`` has the
    answers that are malformed.
    """
    spark = docs.sparkSession
    active = P.seed(spark) if active is None else active
    aliases = spark.createDataFrame([], "source string, target string") if aliases is None else aliases
    chunks = markdown.chunk(docs).withColumn("chunk_id", T.sha256(F.concat_ws("|", "document_id", "sequence_number", "chunk_checksum")))
    if answers is None:
        verbs = verbs or [n.lower() for n in P.SEED if "_" not in n]
        records, unreadable = extractors.rules(chunks, verbs), None
    else:
        records, unreadable = extractors.replay(chunks, answers), extractors.unreadable(answers)
    checked = validate.validate(records, active, aliases, chunk="content")
    accepted = checked.where(F.col("outcome").isin("accepted", "collapsed"))
    order = F.xxhash64("chunk_id", "raw_text", "subject_text", "object_text", "resolved")
    facts = accepted.select("document_id", order.alias("seq"), F.col("subject_text").alias("subject"), F.col("resolved").alias("predicate"), F.col("object_text").alias("object"), "raw_text", "chunk_id")
    assertions = G.identify(facts).dropDuplicates(["document_id", "semantic_checksum"])
    queued = checked.where("outcome = 'queued'").withColumn("seq", F.col("sequence_number"))
    out = {"chunks": chunks, "records": checked, "assertions": assertions, "nodes": G.nodes(assertions), "edges": G.edges(assertions), "failed": P.failed_queue(queued), "pending": queued.drop("seq")}
    return out if unreadable is None else out | {"unreadable": unreadable}
