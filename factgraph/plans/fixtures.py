"""Inputs of the queries, derived from the driver tables in Spark and, with the same meaning, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import table


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the star schema: document_id, seq, subject, predicate, object, raw_text."""
    t = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}

    def name(kind: str, key: str):
        return F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"))

    parts = [
        t["orders"].select(F.lit("submits").alias("document_id"), F.col("o_orderkey").cast("long").alias("seq"), name("Customer", "o_custkey").alias("subject"), F.lit("SUBMITS").alias("predicate"), name("Order", "o_orderkey").alias("object")),
        t["lineitem"].select(F.lit("contains"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("long"), name("Order", "l_orderkey"), F.lit("CONTAINS"), name("Part", "l_partkey")),
        t["lineitem"].select("l_suppkey", "l_partkey").distinct().select(F.lit("provides"), (F.col("l_suppkey") * 10_000_000 + F.col("l_partkey")).cast("long").alias("seq"), name("Supplier", "l_suppkey"), F.lit("PROVIDES"), name("Part", "l_partkey")),
        t["customer"].join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("resides"), F.col("c_custkey").cast("long"), name("Customer", "c_custkey"), F.lit("RESIDES_IN"), F.col("n_name")),
        t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("part"), F.col("n_nationkey").cast("long"), F.col("n_name"), F.lit("PART_OF"), F.col("r_name")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.withColumn("raw_text", F.concat_ws(" ", F.col("subject"), F.lower("predicate"), F.col("object")))


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.identify(facts(spark, sf_dir))


def small_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts without the order lines, whose ids are spread over the documents of the sources."""
    return assertions(spark, sf_dir).where("document_id != 'contains'")


FACTS = """
facts0 AS (
  SELECT 'submits' AS document_id, CAST(o_orderkey AS BIGINT) AS seq, 'Customer_' || o_custkey AS subject, 'SUBMITS' AS predicate, 'Order_' || o_orderkey AS object FROM orders
  UNION ALL SELECT 'contains', CAST(l_orderkey * 100 + l_linenumber AS BIGINT), 'Order_' || l_orderkey, 'CONTAINS', 'Part_' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'provides', CAST(l_suppkey * 10000000 + l_partkey AS BIGINT), 'Supplier_' || l_suppkey, 'PROVIDES', 'Part_' || l_partkey FROM lineitem
  UNION ALL SELECT 'resides', CAST(c_custkey AS BIGINT), 'Customer_' || c_custkey, 'RESIDES_IN', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'part', CAST(n_nationkey AS BIGINT), n_name, 'PART_OF', r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
facts AS (SELECT *, subject || ' ' || lower(predicate) || ' ' || object AS raw_text FROM facts0),
a0 AS (SELECT *, sha256(upper(subject) || '|' || upper(predicate) || '|' || upper(object)) AS semantic_checksum,
  sha256(regexp_replace(lower(subject), '[\\s_-]+', '', 'g')) AS subject_node_id, sha256(regexp_replace(lower(object), '[\\s_-]+', '', 'g')) AS object_node_id FROM facts),
assertions AS (SELECT *, sha256(document_id || '|' || seq || '|' || semantic_checksum) AS assertion_id, sha256(subject_node_id || predicate || object_node_id) AS edge_id FROM a0),
edges AS (SELECT edge_id, min(subject_node_id) AS from_node_id, min(predicate) AS predicate, min(object_node_id) AS to_node_id, arg_min(document_id, (document_id, seq)) AS document_id, count(*) AS support FROM assertions GROUP BY edge_id),
links AS (SELECT edge_id, from_node_id AS a, to_node_id AS b FROM edges UNION ALL SELECT edge_id, to_node_id, from_node_id FROM edges),
ends AS (SELECT assertion_id, subject_node_id AS node_id FROM assertions UNION SELECT assertion_id, object_node_id FROM assertions)
""".replace("\\\\", "\\")


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown: a heading each, and one for every turn."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    body = F.array_join(F.transform("t", lambda x: F.concat(F.lit("## turn "), x["turn"].cast("string"), F.lit(" "), x["role"], F.lit("\n\n"), F.coalesce(x["text"], F.lit("")))), "\n\n")
    return turns.select(F.col("conv_id").alias("document_id"), F.concat(F.lit("# conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), body).alias("text"))


MD_DOCS = """
md AS (SELECT conv_id AS document_id, '# conversation ' || conv_id || chr(10) || chr(10) ||
  string_agg('## turn ' || turn || ' ' || role || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id)
"""


def chunk_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks of two versions; every third document's text changes."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("sequence_number", "line"))
    one = docs.select("document_id", F.lit(1).alias("version"), "sequence_number", F.sha2("line", 256).alias("chunk_checksum"))
    changed = F.when((F.col("document_id") % 3 == 0) & (F.col("sequence_number") % 2 == 0), F.concat("line", F.lit("!"))).otherwise(F.col("line"))
    return one.unionByName(docs.select("document_id", F.lit(2).alias("version"), "sequence_number", F.sha2(changed, 256).alias("chunk_checksum")))


CHUNK_VERSIONS = """
lines AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS sequence_number FROM documents),
cv AS (SELECT document_id, 1 AS version, sequence_number, sha256(line) AS chunk_checksum FROM lines
  UNION ALL SELECT document_id, 2, sequence_number, sha256(CASE WHEN document_id % 3 = 0 AND sequence_number % 2 = 0 THEN line || '!' ELSE line END) FROM lines),
prev AS (SELECT document_id, version + 1 AS version, chunk_checksum, min(sequence_number) AS previous_sequence FROM cv GROUP BY ALL)
"""


def raw_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of orders and parts with variants of their predicate, good and bad quotes, and the text they come from."""
    n = F.col("l_orderkey") + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("doc"), (F.col("l_orderkey") % 50).cast("string")).alias("document_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), n.alias("n"), F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("subject_text"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("object_text"))
    variants = F.array(*map(F.lit, VARIANTS))
    rows = rows.withColumn("predicate", F.get(variants, (F.col("n") % len(VARIANTS)).cast("int")))
    plain = F.concat_ws(" ", F.col("subject_text"), F.lit("holds, as we know, the item"), F.col("object_text"))
    raw = F.when(F.col("n") % 7 == 0, F.concat_ws(" ", F.lit("the well known"), plain)).when(F.col("n") % 7 == 1, F.concat_ws(" ", F.col("subject_text"), F.col("object_text"))).when(F.col("n") % 7 == 2, F.lit("nothing of the kind")).when(F.col("n") % 7 == 3, F.lit(" ")).otherwise(F.upper(plain))
    rows = rows.withColumn("raw_text", raw).withColumn("chunk_text", F.concat(F.lit("In short: "), plain, F.lit(". That is all.")))
    return rows.withColumn("normalized_text", F.when(F.col("n") % 11 == 0, F.lit("")).otherwise(F.lower("raw_text")))


VARIANTS = ("CONTAINS", "contained", "CONTAINING", "CONTAIN", "CONTANS", "CLICK", "HOLDED", "MAPPING", "RELATES_TO", "ENCLOSES", "UNKNOWNVERB", "STORED", "IMPLEMENTES")
ALIASES = (("ENCLOSES", "CONTAINS"), ("RELATES_TO", "DEPENDS_ON"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


RAW = f"""
raw0 AS (SELECT 'doc' || (l_orderkey % 50) AS document_id, l_orderkey * 100 + l_linenumber AS seq, l_orderkey + l_linenumber AS n, 'Order ' || l_orderkey AS subject_text, 'Part ' || l_partkey AS object_text FROM lineitem),
raw1 AS (SELECT *, {_list(VARIANTS)}[1 + n % {len(VARIANTS)}] AS predicate, subject_text || ' holds, as we know, the item ' || object_text AS plain FROM raw0),
raw2 AS (SELECT *, CASE n % 7 WHEN 0 THEN 'the well known ' || plain WHEN 1 THEN subject_text || ' ' || object_text WHEN 2 THEN 'nothing of the kind' WHEN 3 THEN ' ' ELSE upper(plain) END AS raw_text, 'In short: ' || plain || '. That is all.' AS chunk_text FROM raw1),
raw AS (SELECT *, CASE WHEN n % 11 = 0 THEN '' ELSE lower(raw_text) END AS normalized_text FROM raw2)
"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' states folded from events: status from the last event, retries from errors."""
    e = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("docs/u"), F.col("user_id").cast("string"), F.lit(".md")).alias("path")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("total_chunks"), F.max("ts").alias("updated_at"),
        F.count_if(F.col("event_type") == "click").alias("clicks"))
    status = F.when(F.col("last") == "signup", "DISCOVERED").when(F.col("last") == "view", "PROCESSING_ASSERTIONS").when(F.col("last") == "click", "QUERYABLE").when(F.col("last") == "error", "RETRYING").otherwise("FAILED_RETRYABLE")
    return e.select("path", status.alias("status"), F.when(F.col("errors") % 2 == 0, "CHUNKING").otherwise("ASSERTIONS").alias("current_stage"), (F.col("errors") % 8).cast("int").alias("retry_count"), "total_chunks", "updated_at", F.array_join(F.transform(F.sequence(F.lit(1), F.col("clicks") + 1), lambda k: k.cast("string")), ",").alias("completed_chunks"))


STATES = """
st AS (SELECT 'docs/u' || user_id || '.md' AS path, arg_max(event_type, (ts, event_id)) AS last, count(*) FILTER (event_type = 'error') AS errors, count(*) AS total_chunks, max(ts) AS updated_at, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY user_id),
states AS (SELECT path, CASE last WHEN 'signup' THEN 'DISCOVERED' WHEN 'view' THEN 'PROCESSING_ASSERTIONS' WHEN 'click' THEN 'QUERYABLE' WHEN 'error' THEN 'RETRYING' ELSE 'FAILED_RETRYABLE' END AS status,
  CASE WHEN errors % 2 = 0 THEN 'CHUNKING' ELSE 'ASSERTIONS' END AS current_stage, CAST(errors % 8 AS INT) AS retry_count, total_chunks, updated_at, clicks FROM st)
"""
