"""The graph kept up by signed changes: what is added counts +1 on an edge and on its nodes, what is removed -1.

A state has one row per edge or node: its support, and its first writer (edges) or last writer (nodes) with what that one wrote.
Additions merge into it: support adds up, of two writers the earlier or later one stays. A removal takes its support; only where
it takes the writer itself is the row made again, from the assertions that are left at that edge or node. Support 0 is an orphan.
``advance`` returns the rows that changed, so that a caller writes these alone.

Assertions with identifiers (``edge_id`` and those of nodes) give a state by ``edge_id`` and ``node_id``; facts without, one by the
keys of their names, which are shorter in joins. ``edges`` and ``nodes`` make the same tables of either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph as G

#: What tells assertions apart in a log.
KEY = ("document_id", "semantic_checksum")


def changes(before: DataFrame, after: DataFrame, *key: str) -> DataFrame:
    """The signed rows that lead from one set of assertions to another: ``sign`` is 1 or -1."""
    ids = list(key or KEY)
    added = after.join(before.select(*ids), ids, "left_anti").withColumn("sign", F.lit(1))
    return added.unionByName(before.join(after.select(*ids), ids, "left_anti").withColumn("sign", F.lit(-1)))


def net(log: DataFrame, *key: str, order: str | None = None) -> DataFrame:
    """The assertions that a log of signed rows leaves; of several additions as the last by ``order`` has it."""
    key = key or KEY
    rest = [c for c in log.columns if c not in (*key, "sign", order)]
    added = F.when(F.col("sign") > 0, F.struct(*rest))
    last = F.max_by(added, F.when(F.col("sign") > 0, F.col(order))) if order else F.max(added)
    out = log.groupBy(*key).agg(F.sum("sign").alias("_n"), last.alias("_r"))
    return out.where("_n > 0").select(*key, "_r.*")


def of_edges(assertions: DataFrame) -> DataFrame:
    """A row an assertion: the edge, its ``writer``, and as ``value`` what the edge's key does not say; with ``sign`` where there is one."""
    writer = F.struct(F.col("document_id").cast("string").alias("document_id"), F.col("seq").cast("long").alias("seq")).alias("writer")
    if "edge_id" not in assertions.columns:
        return G.keyed(assertions).select(*G.EDGE_KEY, writer, F.lit(True).alias("value"), _sign(assertions))
    value = F.struct(F.col("subject_node_id").alias("from_node_id"), "predicate", F.col("object_node_id").alias("to_node_id"))
    return assertions.select("edge_id", writer, value.alias("value"), _sign(assertions))


def of_nodes(assertions: DataFrame) -> DataFrame:
    """Two rows an assertion, one for each end: the node, ``writer``, and as ``value`` the name."""
    known = "subject_node_id" in assertions.columns

    def end(name: str, side: int) -> Column:
        node = F.col(f"{name}_node_id").alias("node_id") if known else T.name_key(F.col(name)).alias("key")
        return F.struct(node, F.struct(F.col("document_id").cast("string").alias("document_id"), F.col("seq").cast("long").alias("seq"), F.lit(side).alias("side")).alias("writer"), F.struct(F.col(name).alias("canonical_name")).alias("value"))

    return assertions.select(F.explode(F.array(end("subject", 0), end("object", 1))).alias("e"), _sign(assertions)).select("e.*", "sign")


def _key(rows: DataFrame) -> list[str]:
    """The columns of a state, or of rows for one, that tell its rows apart."""
    return next(list(k) for k in (("edge_id",), ("node_id",), G.EDGE_KEY, G.NODE_KEY) if k[0] in rows.columns)


def _best(key: list[str]):
    """Edges keep their first writer, nodes their last."""
    return (F.min, F.least) if key[0] in ("edge_id", "from_key") else (F.max, F.greatest)


def _sign(rows: DataFrame) -> Column:
    return (F.col("sign") if "sign" in rows.columns else F.lit(1)).cast("long").alias("sign")


def _state(rows: DataFrame) -> DataFrame:
    key = _key(rows)
    best = _best(key)[0]
    return rows.groupBy(*key).agg(F.sum("sign").alias("support"), best(F.struct("writer", "value")).alias("b")).select(*key, "support", "b.writer", "b.value")


def build(assertions: DataFrame) -> dict[str, DataFrame]:
    """The state of a set of assertions, made from scratch."""
    return {"edges": _state(of_edges(assertions)), "nodes": _state(of_nodes(assertions))}


def _advance(state: DataFrame, signed: DataFrame, left: DataFrame) -> DataFrame:
    key = _key(state)
    best, better = _best(key)
    written = F.struct("writer", "value")
    moved = signed.groupBy(*key).agg(
        F.sum("sign").alias("_d"), best(F.when(F.col("sign") > 0, written)).alias("_new"), best(F.when(F.col("sign") < 0, F.col("writer"))).alias("_gone"), F.any_value("value").alias("_any")
    )
    both = moved.join(state, key, "left")
    # Whatever is removed supported the edge or node before, so the writer went if and only if it is the best of what went.
    lost = F.coalesce(F.col("_gone") == F.col("writer"), F.lit(False))
    support = F.greatest(F.coalesce("support", F.lit(0)) + F.col("_d"), F.lit(0))
    held = F.when(F.col("writer").isNotNull(), written)
    stays = better(held, F.col("_new"))
    rows = both.select(*key, support.alias("support"), stays.alias("b"), "_any", lost.alias("_l"))
    rows = rows.select(*key, "support", "b.writer", F.coalesce("b.value", "_any").alias("value"), (F.col("_l") & (F.col("support") > 0)).alias("_lost"))
    again = _state(left.join(rows.where("_lost").select(*key), key, "left_semi"))
    return rows.where("not _lost").drop("_lost").unionByName(again)


def advance(state: dict[str, DataFrame], signed: DataFrame, left: DataFrame) -> dict[str, DataFrame]:
    """The rows of ``edges`` and ``nodes`` that ``signed`` assertions change, as they are after it; support 0 where nothing is left.

    ``left``: all assertions after the change, of which those are read that share an edge or node with a lost writer. Each
    assertion is added or removed once in ``signed``, as ``changes`` has it; what is removed must be in ``state``.
    """
    return {
        "edges": _advance(state["edges"], of_edges(signed), of_edges(left)),
        "nodes": _advance(state["nodes"], of_nodes(signed), of_nodes(left)),
    }


def replace(state: dict[str, DataFrame], moved: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The state with the rows that ``advance`` returned; orphans are gone."""
    return {n: state[n].join(moved[n].select(*_key(state[n])), _key(state[n]), "left_anti").unionByName(moved[n].where("support > 0")) for n in ("edges", "nodes")}


def orphans(moved: dict[str, DataFrame], name: str) -> DataFrame:
    """The edges or nodes that a change left without support."""
    return _identified(moved[name].where("support = 0")).select("edge_id" if name == "edges" else "node_id")


def _identified(rows: DataFrame) -> DataFrame:
    """Rows of a state with identifiers in place of keys."""
    if "key" in rows.columns:
        return G.with_node_ids(rows)
    if "from_key" in rows.columns:
        return G.with_edge_ids(rows).withColumn("value", F.struct("from_node_id", "predicate", "to_node_id")).drop("from_node_id", "predicate", "to_node_id")
    return rows


def edges(state: dict[str, DataFrame]) -> DataFrame:
    """``edges`` as ``graph.edges`` has them."""
    return _identified(state["edges"]).select("edge_id", "value.*", F.col("writer.document_id").alias("document_id"), "support")


def nodes(state: dict[str, DataFrame]) -> DataFrame:
    """``nodes`` as ``graph.nodes`` has them, and the number of assertion ends that support each."""
    return _identified(state["nodes"]).select("node_id", "value.canonical_name", T.normalize_entity(F.col("value.canonical_name")).alias("normalized_name"), "support")
