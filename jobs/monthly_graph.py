"""Graphs of trade by month: facts of orders and their lines, as edges, nodes and figures of each month.

    python jobs/monthly_graph.py --config jobs/monthly_graph.json --tables FOLDER --out PATH

``FOLDER`` has ``orders`` and ``lineitem`` (NAME.parquet). A customer submits an order, an order contains parts, a supplier
provides a part; an order is a document. Written are ``edges``, ``nodes`` and ``metrics`` by ``month``; a run replaces the months
that it makes, whether it makes them for the first time or again, and leaves all others. ``whole`` merges months into one graph:
support adds up, and of all first writers the first stays.

Orders without a date belong to no month and are left out; lines without an order too. The numbers of both are logged.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from dataclasses import asdict, dataclass
from pathlib import Path

if __package__ in (None, ""):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from factgraph.functions import text as T  # noqa: E402
from factgraph.operators import graph as G  # noqa: E402
from factgraph.operators import metrics as X  # noqa: E402
from factgraph.session import get_session, prepare  # noqa: E402

LOG = logging.getLogger("monthly_graph")

#: The tables of the output, each by ``month``.
SCHEMAS = {
    "edges": "edge_id string, from_node_id string, predicate string, to_node_id string, document_id string, support bigint, month string",
    "nodes": "node_id string, canonical_name string, normalized_name string, degree bigint, month string",
    "metrics": "documents bigint, edges bigint, assertions bigint, nodes bigint, max_degree bigint, assertions_per_document double, mean_degree double, month string",
}


@dataclass
class Config:
    """The first and last month to make (``2024-01``; all, where not given), and files that each month's tables are dealt to."""

    first: str | None = None
    last: str | None = None
    files_per_month: int = 4


def facts(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """``month``, ``document_id``, ``seq``, ``subject``, ``predicate``, ``object``, ``raw_text`` of orders and their lines.

    Lines meet their orders' months once; what both state is made of the joined rows.
    """
    def name(kind: str, key: str) -> Column:
        return F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"))

    def fact(seq: Column, subject: Column, predicate: str, obj: Column) -> Column:
        return F.struct(seq.cast("long").alias("seq"), subject.alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"))

    document = F.concat(F.lit("order/"), F.col("o_orderkey").cast("string"))
    submitted = orders.select("month", document.alias("document_id"), fact(F.lit(0), name("Customer", "o_custkey"), "SUBMITS", name("Order", "o_orderkey")).alias("f"))
    both = lines.join(orders.select("o_orderkey", "month"), lines["l_orderkey"] == orders["o_orderkey"])
    number = F.col("l_linenumber")
    held = both.select("month", document.alias("document_id"), F.explode(F.array(
        fact(2 * number - 1, name("Order", "l_orderkey"), "CONTAINS", name("Part", "l_partkey")),
        fact(2 * number, name("Supplier", "l_suppkey"), "PROVIDES", name("Part", "l_partkey")),
    )).alias("f"))
    out = submitted.unionByName(held).select("month", "document_id", "f.*")
    return out.withColumn("raw_text", F.concat_ws(" ", "subject", F.lower("predicate"), "object"))


def _put(rows: DataFrame, out: str, name: str) -> None:
    """Replace the months of ``rows`` in a table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("month").parquet(f"{out}/{name}")


def _dealt(rows: DataFrame, key: tuple[str, ...], files: int) -> DataFrame:
    """``rows`` with the number (``file``) of the file of their month that their ``key`` is dealt to, and there already.

    What is grouped by ``month``, ``file`` and ``key`` then stays where it is until it is written.
    """
    return rows.withColumn("file", F.pmod(F.xxhash64(*key), F.lit(files))).repartition("month", "file")


def _named(rows: DataFrame) -> DataFrame:
    return G.with_node_ids(rows).withColumn("normalized_name", T.normalize_entity(F.col("canonical_name")))


def build(spark: SparkSession, tables: str, out: str, config: Config | None = None) -> list[str]:
    """Make the months of ``config`` from the tables in a folder; their names."""
    config = config or Config()
    prepare(spark)
    every = spark.read.parquet(f"{tables}/orders.parquet").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    lines = spark.read.parquet(f"{tables}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = every.where("month is not null")
    if config.first:
        orders = orders.where(F.col("month") >= config.first)
    if config.last:
        orders = orders.where(F.col("month") <= config.last)
    read = every.agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("month").isNull()).alias("undated")).first()
    LOG.info("read %d orders of %s, of which %d have no date", read["orders"], tables, read["undated"])

    def made(name: str) -> DataFrame:
        rows = read_table(spark, out, name)
        rows = rows.where(F.col("month") >= config.first) if config.first else rows
        return rows.where(F.col("month") <= config.last) if config.last else rows

    # Each row is dealt once, by names, and grouped where it is to be written; identifiers, which are several times as long, are
    # made while writing. ``facts`` gives each thing one name, so names are its nodes' keys, and an edge's rows name both ends.
    stated = facts(orders, lines).select("month", "document_id", "seq", "subject", "predicate", "object")
    by_names = _dealt(stated, ("subject", "predicate", "object"), config.files_per_month).groupBy("month", "file", "predicate", "subject", "object")
    edges = by_names.agg(F.min("document_id").alias("document_id"), F.count(F.lit(1)).alias("support"))
    _put(G.with_edge_ids(G.keyed(edges).select("month", *G.EDGE_KEY, "document_id", "support")), out, "edges")
    ends = by_names.agg(F.lit(1)).select("month", F.explode(F.array("subject", "object")).alias("canonical_name"))
    nodes = _dealt(ends, ("canonical_name",), config.files_per_month).groupBy("month", "file", "canonical_name").agg(F.count(F.lit(1)).alias("degree"))
    _put(_named(nodes.select("month", T.name_key(F.col("canonical_name")).alias("key"), "canonical_name", "degree")), out, "nodes")
    # The figures are made of the edges and nodes as they are written.
    edges, nodes = made("edges"), made("nodes")
    of_edges = edges.groupBy("month").agg(F.count(F.lit(1)).alias("edges"), F.sum("support").alias("assertions"))
    of_nodes = nodes.groupBy("month").agg(F.count(F.lit(1)).alias("nodes"), F.max("degree").alias("max_degree"))
    of_orders = orders.groupBy("month").agg(F.count(F.lit(1)).alias("documents"))
    figures = of_orders.join(of_edges, "month").join(of_nodes, "month")
    figures = figures.withColumn("assertions_per_document", F.round(X.ratio(F.col("assertions"), F.col("documents")), 6)).withColumn("mean_degree", F.round(X.ratio(2 * F.col("edges"), F.col("nodes")), 6))
    _put(figures.repartition("month"), out, "metrics")
    months = sorted(r["month"] for r in orders.select("month").distinct().collect())  # as many as months
    for row in made("metrics").where(F.col("month").isin(months)).orderBy("month").collect():
        LOG.info("wrote %s of %s: %d documents, %d edges, %d nodes", row["month"], out, row["documents"], row["edges"], row["nodes"])
    return months


def read_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{out}/{name}")


def whole(spark: SparkSession, out: str) -> DataFrame:
    """The edges of all months as one graph, as ``graph.edges`` has them."""
    first = F.min(F.struct("month", "document_id"))
    return read_table(spark, out, "edges").groupBy("edge_id", "from_node_id", "predicate", "to_node_id").agg(first["document_id"].alias("document_id"), F.sum("support").alias("support"))


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("tables", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="JSON: " + ", ".join(asdict(Config())))
    parser.add_argument("--master")
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = Config(**json.loads(Path(given.config).read_text())) if given.config else Config()
    spark = get_session("monthly_graph", given.master)
    try:
        build(spark, given.tables, given.out, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
