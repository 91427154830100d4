"""Retrieval: BM25 seeds, bounded undirected traversal, explanations; over a search index, or over plain tables by a scan.

Both ways give the same rows. ``Plain`` answers what ``SearchIndex`` answers from tables that are at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.times import decay
from ..session import cut
from . import graph as G
from .index import SearchIndex, ends_of, hidden, links_of, postings_of
from .segments import SegmentIndex

K1, B, BOOST, TOP_K, MAX_DEPTH = 1.2, 0.75, 2.2, 20, 10
#: What the tools return of a hop at most: edges, assertions; and of an explanation.
HOP_CAP, EXPLAIN_CAP = 1000, 100


class Plain:
    """The questions of ``SearchIndex``, answered from assertions by scans."""

    def __init__(self, assertions: DataFrame):
        self.spark: SparkSession = assertions.sparkSession
        self.rows = assertions

    def assertions(self, wanted: DataFrame | list[str] | None = None) -> DataFrame:
        if wanted is None:
            return self.rows
        return self.rows.where(F.col("assertion_id").isin(wanted)) if isinstance(wanted, list) else self.rows.join(wanted.select("assertion_id").distinct(), "assertion_id", "left_semi")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        found = postings_of(self.rows)
        return found if terms is None else found.where(F.col("term").isin(terms))

    def statistics(self) -> tuple[int, float]:
        row = self.rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(T.search_tokens(F.col("raw_text")))).alias("mean")).first()
        return row["n"], row["mean"] or 1.0

    def ends(self, nodes: DataFrame) -> DataFrame:
        return ends_of(self.rows).join(nodes.select("node_id").distinct(), "node_id", "left_semi")

    def links(self, nodes: DataFrame) -> DataFrame:
        return links_of(self.rows).join(nodes.select(F.col("node_id").alias("a")).distinct(), "a", "left_semi").distinct()


Source = SearchIndex | SegmentIndex | Plain


def over(source: Source | DataFrame) -> Source:
    return Plain(source) if isinstance(source, DataFrame) else source


def bm25(source: Source | DataFrame, query: str, k: int | None = TOP_K, boost: float = BOOST, deleted: DataFrame | None = None) -> DataFrame:
    """``assertion_id``, ``bm25_score`` of the best ``k`` assertions; ties by id. Hidden documents keep their part in the statistics."""
    source = over(source)
    spark = source.spark
    terms = [r["t"] for r in spark.range(1).select(F.explode(F.array_distinct(T.search_tokens(F.lit(query)))).alias("t")).collect()]
    if not terms:
        return source.assertions().select("assertion_id", F.lit(0.0).alias("bm25_score")).limit(0)
    n, mean = source.statistics() if isinstance(source, Plain) else (source.n, source.mean_length)

    def score(df: Column, tf: Column, dl: Column) -> Column:
        """A term's part, by the number of assertions that have it, its occurrences and the length of the text."""
        idf = F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))
        return idf * F.lit(boost) * tf / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / F.lit(mean)))

    if isinstance(source, SegmentIndex) and k is not None and deleted is None:
        return source.topk(terms, k, score)
    scored = source.candidates(terms, k, score, deleted) if isinstance(source, SearchIndex) and k else None
    if scored is None:
        found = source.postings(terms)
        df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a term of the query
        scored = found.join(F.broadcast(df), "term")
    hits = hidden(scored, deleted).groupBy("assertion_id").agg(F.sum(score(F.col("df"), F.col("tf"), F.col("dl"))).alias("bm25_score"))
    return hits if k is None else hits.orderBy(F.desc(F.round("bm25_score", 9)), "assertion_id").limit(k)


def _few(rows: DataFrame, k: int | None) -> DataFrame:
    """A table that later steps read several times: at most ``k`` rows by value, else by a checkpoint."""
    return cut(rows, 2) if k is None or k > 1000 else rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def capped(rows: DataFrame, cap: int | None, *order: str) -> DataFrame:
    return rows if cap is None else rows.orderBy(*order).limit(cap)


def spread(source: Source | DataFrame, start: DataFrame, depth: int, edge_cap: int | None = None, deleted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``node_id``, ``hop`` of all nodes within ``depth`` of ``start`` (node_id), undirected, at their least hop; and the edges seen.

    Edges are ``edge_id``, ``from_node_id``, ``to_node_id``, ``hop``, each at the hop that first saw it. ``edge_cap`` limits the
    edges of a hop, smallest identifiers first. A hop reads the links of its frontier only, and is cut off from those before.
    """
    source = over(source)
    seen = start.select("node_id").distinct().withColumn("hop", F.lit(0))
    frontier, edges = seen, None
    for hop in range(1, min(depth, MAX_DEPTH) + 1):
        links = hidden(source.links(frontier), deleted)
        at = links.select("edge_id", F.when(F.col("forward"), F.col("a")).otherwise(F.col("b")).alias("from_node_id"), F.when(F.col("forward"), F.col("b")).otherwise(F.col("a")).alias("to_node_id")).distinct()
        at = capped(at, edge_cap, "edge_id")
        if edge_cap is not None:
            links = links.join(at.select("edge_id"), "edge_id", "left_semi")
        reached = links.select(F.col("b").alias("node_id")).distinct().join(seen, "node_id", "left_anti").withColumn("hop", F.lit(hop))
        frontier = cut(reached, 2)
        edges = at.withColumn("hop", F.lit(hop)) if edges is None else edges.unionByName(at.withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    if edges is None:
        edges = source.spark.createDataFrame([], "edge_id string, from_node_id string, to_node_id string, hop int")
    return seen, edges.groupBy("edge_id", "from_node_id", "to_node_id").agg(F.min("hop").alias("hop"))


def neighbours(source: Source | DataFrame, start: DataFrame, depth: int = 1, deleted: DataFrame | None = None) -> DataFrame:
    """``node_id``, ``hop`` of all nodes within ``depth`` of ``start``."""
    return spread(source, start, depth, deleted=deleted)[0]


def neighbourhood(source: Source | DataFrame, node: str, depth: int = 1, edge_cap: int | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """``kind`` (node or edge), ``id``, ``from_node_id``, ``to_node_id``, ``hop``: the nodes reached from a node and the edges seen."""
    source = over(source)
    nodes, edges = spread(source, source.spark.createDataFrame([(node,)], "node_id string"), depth, edge_cap, deleted)
    none = F.lit(None).cast("string")
    rows = nodes.where("hop > 0").select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), none.alias("from_node_id"), none.alias("to_node_id"), "hop")
    return rows.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), "from_node_id", "to_node_id", "hop"))


def _first(touched: DataFrame, cap: int | None) -> DataFrame:
    """At most ``cap`` assertions of each depth, smallest identifiers first."""
    return touched if cap is None else touched.withColumn("_n", F.row_number().over(Window.partitionBy("depth").orderBy("assertion_id"))).where(F.col("_n") <= cap).drop("_n")


def _reached(source: SearchIndex, seeds: DataFrame, hops: DataFrame | None, cap: int | None, deleted: DataFrame | None) -> DataFrame:
    """``place``, ``said``, ``depth``, ``bm25_score`` of seeds and of assertions around them: identifiers are made for a cap only.

    Without ``hops`` the ends of assertions are not asked for.
    """
    row = source.assertions(seeds).select("assertion_id", *T.assertion_key(*map(F.col, ("document_id", "seq", "subject", "predicate", "object")))).distinct()
    first = seeds.join(row, "assertion_id").select("place", "said", F.lit(0).alias("depth"), "bm25_score")
    if hops is None:
        return cut(first, 2)
    touched = source.touched(hops, deleted).withColumnRenamed("hop", "depth").alias("t")
    same = F.col("t.place").eqNullSafe(F.col("s.place")) & (F.col("t.said") == F.col("s.said"))
    touched = touched.join(first.alias("s"), same, "left_anti")
    if cap is not None:
        touched = _first(touched.withColumn("assertion_id", T.assertion_key_id(F.col("place"), F.col("said"))), cap)
    return cut(first.unionByName(touched.select("place", "said", "depth", F.lit(0.0).alias("bm25_score"))), 2)


def query_graph(source: Source | DataFrame, text: str, depth: int = 1, k: int = TOP_K, rate: float = 1.0, weight: float = 0.3, cap: int | None = None, edge_cap: int | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """``assertion_id``, ``raw_text``, ``depth`` and three scores of seeds and of assertions around them.

    ``cap`` and ``edge_cap`` limit the assertions and edges of a hop (smallest identifiers first); by default there is no limit.
    Assertions of ``deleted`` documents (document_id) are not found, and links that only they support are not followed.
    """
    source = over(source)
    seeds = _few(bm25(source, text, k, deleted=deleted), k)
    start = _few(source.assertions(seeds).select(F.explode(F.array("subject_node_id", "object_node_id")).alias("node_id")).distinct(), None if k is None else 2 * k)
    hops = spread(source, start, depth, edge_cap, deleted)[0].where("hop > 0")
    if isinstance(source, SearchIndex):
        hits = _reached(source, seeds, hops if depth > 0 else None, cap, deleted)
        out = source.texts(hits).withColumn("assertion_id", T.assertion_key_id(F.col("place"), F.col("said")))
    else:
        touched = hidden(source.ends(hops), deleted).join(hops, "node_id").groupBy("assertion_id").agg(F.min("hop").alias("depth")).join(seeds, "assertion_id", "left_anti").withColumn("bm25_score", F.lit(0.0))
        hits = cut(seeds.select("assertion_id", F.lit(0).alias("depth"), "bm25_score").unionByName(_first(touched, cap).select("assertion_id", "depth", "bm25_score")), 2)
        out = hits.join(source.assertions(hits).select("assertion_id", "raw_text"), "assertion_id")
    graph = 1 / (1 + F.col("depth"))
    return out.select("assertion_id", "raw_text", "depth", F.round("bm25_score", 6).alias("bm25_score"), F.round(graph, 6).alias("graph_score"), F.round(decay(F.col("bm25_score"), F.col("depth"), rate, weight), 6).alias("final_score"))


def ranked(hits: DataFrame) -> DataFrame:
    return hits.orderBy(F.desc("final_score"), "depth", "assertion_id")


def subgraph(source: Source | DataFrame, root: str, level: int) -> DataFrame:
    """``edge_id``, ``from_node_id``, ``to_node_id`` of the edges with both ends within ``level`` hops of ``root``.

    Each such edge is a link of one of the nodes inside, so the links of these are all that is read.
    """
    source = over(source)
    inside = cut(neighbours(source, source.spark.createDataFrame([(root,)], "node_id string"), level).select("node_id"), 2)
    links = source.links(inside).where("forward").join(inside.select(F.col("node_id").alias("b")), "b", "left_semi")
    return links.select("edge_id", F.col("a").alias("from_node_id"), F.col("b").alias("to_node_id")).distinct()


def explain(source: Source | DataFrame, assertion_id: str, cap: int | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """``kind``, ``id``: the seed assertion, its nodes, the edges at them, the nodes at their other ends, and assertions about those.

    ``cap`` limits edges and related assertions, smallest identifiers first. Assertions of ``deleted`` documents are not explained,
    and links that only they support are not followed.
    """
    source = over(source)
    seed = hidden(source.assertions([assertion_id]), deleted)
    start = _few(seed.select(F.explode(F.array_distinct(F.array("subject_node_id", "object_node_id"))).alias("node_id")), 2)
    links = hidden(source.links(start), deleted)
    at = capped(links.select("edge_id").distinct(), cap, "edge_id")
    if cap is not None:
        links = links.join(at, "edge_id", "left_semi")
    around = cut(links.select(F.col("b").alias("node_id")).distinct().join(start, "node_id", "left_anti"), 2)
    related = capped(hidden(source.ends(around), deleted).select("assertion_id").distinct().where(F.col("assertion_id") != assertion_id), cap, "assertion_id")
    parts = (
        seed.select(F.lit("seed").alias("kind"), F.col("assertion_id").alias("id")),
        start.select(F.lit("seed_node"), "node_id"),
        at.select(F.lit("edge"), "edge_id"),
        around.select(F.lit("neighbour"), "node_id"),
        related.select(F.lit("related"), "assertion_id"),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def lookup(source: Source | DataFrame, assertion_id: str, deleted: DataFrame | None = None) -> DataFrame:
    """An assertion by its identifier; none if its document is deleted."""
    found = hidden(over(source).assertions([assertion_id]), deleted)
    return found.select("assertion_id", "document_id", "subject", "predicate", "object", "raw_text", "subject_node_id", "object_node_id", "semantic_checksum")


# Answers of tools as lines ---------------------------------------------------------------------------------------------
def render_hits(hits: DataFrame) -> DataFrame:
    """Lines ``score|depth|text`` for tools."""
    return ranked(hits).select(F.concat_ws("|", F.format_string("%.1f", "final_score"), F.col("depth").cast("string"), T.display_text(F.col("raw_text"))).alias("line"))


#: Identifiers that a line of a tool's answer lists at most; how many more there are stands at its end.
LISTED = 10_000


def _listed(rows: DataFrame, label: str, at: int, most: int = LISTED) -> DataFrame:
    """One line ``LABEL (n): a, b`` of the identifiers of ``rows`` (id), in order; none if there are none."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    ids = rows.select("id").orderBy("id").limit(most).agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("ids"))
    more = F.when(F.col("n") > most, F.concat(F.lit(" and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return n.join(ids).where("n > 0").select(F.lit(at).alias("at"), F.lit("").alias("key"), F.concat(F.lit(f"{label} ("), F.col("n").cast("string"), F.lit("): "), "ids", more).alias("line"))


def render_explanation(source: Source | DataFrame, assertion_id: str, cap: int | None = EXPLAIN_CAP, deleted: DataFrame | None = None) -> DataFrame:
    """The lines of an explanation in order of ``at``, ``key``: seed, text, nodes, edges, neighbours, related texts."""
    source = over(source)
    found = cut(explain(source, assertion_id, cap, deleted), 2)
    seed, none = hidden(source.assertions([assertion_id]), deleted), F.lit("")
    fields = [T.display_text(F.col(c)) for c in ("subject", "predicate", "object")]
    related = source.assertions(found.where("kind = 'related'").select(F.col("id").alias("assertion_id"))).where("raw_text != ''")
    of = lambda kind: found.where(F.col("kind") == kind)
    count = of("related").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    nodes = of("seed_node").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("ids"), F.count(F.lit(1)).alias("n")).where("n > 0")
    parts = [
        seed.select(F.lit(0).alias("at"), none.alias("key"), F.concat(F.lit("SEED: "), F.concat_ws(" | ", *fields)).alias("line")),
        seed.where("raw_text != ''").select(F.lit(1).alias("at"), none.alias("key"), F.concat(F.lit("TEXT: "), T.display_text(F.col("raw_text"))).alias("line")),
        nodes.select(F.lit(2).alias("at"), none.alias("key"), F.concat(F.lit("SEED_NODES: "), "ids").alias("line")),
        _listed(of("edge"), "EDGES", 3),
        _listed(of("neighbour"), "NEIGHBORS", 4),
        count.select(F.lit(5).alias("at"), none.alias("key"), F.concat(F.lit("RELATED ("), F.col("n").cast("string"), F.lit("):")).alias("line")),
        related.select(F.lit(6).alias("at"), F.col("assertion_id").alias("key"), F.concat(F.lit("  "), T.display_text(F.col("raw_text"))).alias("line")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("at", "key")


def render_neighbourhood(rows: DataFrame) -> DataFrame:
    """The lines of ``neighbourhood`` in order of ``at``, ``key``: nodes, then edges with their ends."""
    nodes, edges = rows.where("kind = 'node'"), rows.where("kind = 'edge'")
    empty = lambda label, found, at: found.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(at).alias("at"), F.lit("").alias("key"), F.lit(f"{label}: (none)").alias("line"))
    count = edges.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(1).alias("at"), F.lit("").alias("key"), F.concat(F.lit("EDGES ("), F.col("n").cast("string"), F.lit("):")).alias("line"))
    each = edges.select(F.lit(2).alias("at"), F.col("id").alias("key"), F.concat(F.lit("  "), "id", F.lit(" ["), "from_node_id", F.lit("->"), "to_node_id", F.lit("]")).alias("line"))
    out = _listed(nodes, "NODES", 0)
    for part in (empty("NODES", nodes, 0), empty("EDGES", edges, 1), count, each):
        out = out.unionByName(part)
    return out.orderBy("at", "key")


def render_assertion(found: DataFrame) -> DataFrame:
    """An assertion on one line: triple, text if there is one, and document."""
    fields = [T.display_text(F.col(c)) for c in ("subject", "predicate", "object")]
    text = F.when(F.col("raw_text") != "", T.display_text(F.col("raw_text")))
    return found.select(F.concat_ws(" | ", *fields, text, F.concat(F.lit("doc: "), "document_id")).alias("line"))
