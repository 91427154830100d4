"""Curation: what happens to the taxonomy, the review queue and the graph when predicates are approved, mapped or rejected.

Everything is a function from a state to a new one, for all actions at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.predicates import classify, insert_ignore
from . import graph as G

ACTIONS = ("approve", "map", "reject")


@dataclass
class State:
    """What curation reads and changes. ``pending`` has subject, predicate, object, raw_text, document_id and the run; ``documents`` counters."""

    active: DataFrame
    aliases: DataFrame
    pending: DataFrame
    failed: DataFrame | None = None
    assertions: DataFrame | None = None
    documents: DataFrame | None = None


def decided(actions: DataFrame) -> DataFrame:
    """One action for each name (upper case): of several the last by ``seq``; without ``seq``, a mapping before an approval before a rejection.

    Blank names, unknown actions and mappings without a target are left out.
    """
    name, target = F.upper(F.trim("name")), F.upper(F.trim("target"))
    order = F.struct(F.col("seq")) if "seq" in actions.columns else F.struct(F.when(F.col("action") == "map", 2).when(F.col("action") == "approve", 1).otherwise(0).alias("rank"), target.alias("t"))
    good = actions.where(F.col("action").isin(*ACTIONS) & (name != "") & ((F.col("action") != "map") | (F.coalesce(target, F.lit("")) != "")))
    return good.groupBy(name.alias("name")).agg(F.max_by(F.struct("action", target.alias("target")), order).alias("a")).select("name", "a.action", "a.target")


def promoted(pending: DataFrame, acts: DataFrame) -> DataFrame:
    """Pending assertions whose predicate is approved or mapped, under the name that it now has, with their checksums."""
    new = F.when(F.col("_action") == "map", F.col("_target")).otherwise(F.col("_name"))
    chosen = acts.where("action != 'reject'").select(F.col("name").alias("_name"), F.col("action").alias("_action"), F.col("target").alias("_target"))
    rows = pending.withColumn("_name", F.upper("predicate")).join(F.broadcast(chosen), "_name").withColumn("predicate", new).drop("_name", "_action", "_target")
    if {"subject", "object"} <= set(rows.columns):
        rows = rows.withColumn("semantic_checksum", T.semantic_checksum(F.col("subject"), F.col("predicate"), F.col("object"))).withColumn("evidence_checksum", T.sha256(F.col("raw_text")))
    return rows


def curate(state: State, actions: DataFrame) -> dict[str, DataFrame]:
    """Apply ``actions`` (action, name, target and, where order matters, seq).

    ``approve`` activates a name, ``map`` activates its target and keeps an alias, which replaces an older one; both promote what
    was pending under the name. ``reject`` drops it. The names leave the review queue, whatever is done with them. The answer has
    ``active``, ``aliases``, ``pending``, ``promoted`` and, as far as the state has them, ``failed``; ``assertions`` with what was
    promoted and is not among them yet; ``documents`` with their counters bumped; and the ``runs`` whose graph is to be rebuilt.
    """
    acts = F.broadcast(decided(actions))  # people's decisions; by a shuffle, all that is pending under a name would meet at it
    names = acts.where("action != 'reject'").select(F.when(F.col("action") == "map", F.col("target")).otherwise(F.col("name")).alias("name")).distinct()
    mapped = acts.where("action = 'map'").select(F.col("name").alias("source"), "target")
    out = {
        "active": insert_ignore(state.active, names.withColumn("predicate_group", classify(F.col("name")))),
        "aliases": state.aliases.join(mapped, "source", "left_anti").unionByName(mapped, allowMissingColumns=True),
        "pending": state.pending.join(acts, F.upper(state.pending["predicate"]) == acts["name"], "left_anti"),
        "promoted": promoted(state.pending, acts),
    }
    if state.failed is not None:
        out["failed"] = state.failed.join(acts, "name", "left_anti")
    if state.assertions is not None:
        key = [c for c in ("document_id", "document_version", "semantic_checksum") if c in out["promoted"].columns]
        new = out["promoted"].dropDuplicates(key).join(state.assertions, key, "left_anti")
        out["promoted"] = new
        out["assertions"] = state.assertions.unionByName(new, allowMissingColumns=True)
        if "ingestion_run_id" in new.columns:
            out["runs"] = new.select("ingestion_run_id").distinct()
    if state.documents is not None:
        out["documents"] = bumped(state.documents, out["promoted"])
    return out


def bumped(documents: DataFrame, new: DataFrame, counter: str = "total_assertions") -> DataFrame:
    """``documents`` with the number of ``new`` assertions of each added to its counter."""
    more = new.groupBy("document_id").agg(F.count(F.lit(1)).alias("_more"))
    return documents.join(more, "document_id", "left").withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("_more", F.lit(0))).drop("_more")


def rebuild(assertions: DataFrame, runs: DataFrame, existing: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The graph with that of ``runs`` (ingestion_run_id) merged in. Finished documents are rebuilt too; what is there stays."""
    own = assertions.join(runs, "ingestion_run_id", "left_semi")
    return {"nodes": G.merge(existing["nodes"], G.nodes(own), "node_id"), "edges": G.merge(existing["edges"], G.edges(own), "edge_id")}


def auto_approve(failed: DataFrame, least: int = 3) -> DataFrame:
    """Actions that approve each failed predicate seen often enough; none with ``least`` 0."""
    return failed.where((F.lit(least) > 0) & (F.col("occurrence_count") >= least)).select(F.lit("approve").alias("action"), "name", F.lit(None).cast("string").alias("target"))


def revoke(assertions: DataFrame, active: DataFrame, predicate: str) -> dict[str, DataFrame]:
    """The taxonomy and assertions without a predicate, and the nodes that only it held."""
    name = F.upper("predicate") == predicate.upper()
    gone = F.coalesce(name, F.lit(False))
    left, orphans = assertions.where(~gone), G.with_node_ids(G.lost_nodes(assertions, gone))
    return {"active": active.where(F.col("name") != predicate.upper()), "assertions": left, "orphan_nodes": orphans}
