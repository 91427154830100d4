"""Text, paths, JSON and display functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonio as J
from ..functions import text as T
from ..functions import times
from ..session import table
from ..sources import files
from .registry import query


def docs(spark, sf):
    return table(spark, sf, "documents")


NORMAL_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '(?m)^#+[\t\n\x0B\f\r ]*(.*)$', '\1', 'g'), '(?s)```.*?\n(.*?)```', '\1', 'g'), '[*`_~>\-\[\],.?!;:''"]', '', 'g'), '[\t\n\x0B\f\r ]+', ' ', 'g'), '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '')"""


@query(f"SELECT doc_id, {NORMAL_SQL} AS normalized FROM documents")
def chunk_normalize(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize_chunk(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, sha256(source || {NORMAL_SQL}) AS chunk_checksum FROM documents")
def chunk_checksum(spark, sf):
    return docs(spark, sf).select("doc_id", T.chunk_checksum(F.col("source"), T.normalize_chunk(F.col("text"))).alias("chunk_checksum"))


@query("SELECT o_orderkey, sha256(upper('c' || o_custkey) || '|' || upper(o_orderpriority) || '|' || upper('o' || o_orderkey)) AS checksum FROM orders")
def assertion_semantic_checksum(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", T.semantic_checksum(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("o_orderpriority"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))).alias("checksum"))


@query(r"SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\w\s]', '', 'g'))) AS normalized FROM documents")
def grounding_normalize(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize_grounding(F.col("text")).alias("normalized"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '^[\\x00-\\x20]+', ''), '[\\x00-\\x20]+$', '') AS content FROM (SELECT doc_id, ' ' || chr(9) || text || chr(10) AS text FROM documents)")
def content_trim(spark, sf):
    return docs(spark, sf).select("doc_id", T.trim_control(F.concat(F.lit(" \t"), "text", F.lit("\n"))).alias("content"))


PATHS = "p AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '/work/p' || o_orderkey % 7 || '/docs/f.md' WHEN 1 THEN 'c:\\work\\p1\\Documentation\\f.md' WHEN 2 THEN 'f.md' WHEN 3 THEN '/work/node_modules/x/f.md' ELSE 'docs/f' || o_orderkey % 9 || '.md' END AS path FROM orders)"


def paths(spark, sf):
    k = F.col("o_orderkey")
    path = F.when(k % 5 == 0, F.concat(F.lit("/work/p"), (k % 7).cast("string"), F.lit("/docs/f.md"))).when(k % 5 == 1, "c:\\work\\p1\\Documentation\\f.md").when(k % 5 == 2, "f.md").when(k % 5 == 3, "/work/node_modules/x/f.md").otherwise(F.concat(F.lit("docs/f"), (k % 9).cast("string"), F.lit(".md")))
    return table(spark, sf, "orders").select(k.alias("id"), path.alias("path"))


@query(f"WITH {PATHS} SELECT id, CASE id % 5 WHEN 0 THEN 'p' || id % 7 WHEN 1 THEN 'p1' WHEN 2 THEN '' WHEN 3 THEN 'x' ELSE '' END AS project_root FROM p")
def project_root(spark, sf):
    return paths(spark, sf).select("id", T.project_root(F.col("path")).alias("project_root"))


@query(f"WITH {PATHS} SELECT id, CASE id % 5 WHEN 1 THEN 'C:/work/p1/Documentation/f.md' WHEN 0 THEN substr(path, 7) WHEN 3 THEN substr(path, 7) ELSE path END AS relative FROM p")
def path_normalize(spark, sf):
    return paths(spark, sf).select("id", T.normalize_path(F.col("path"), F.lit("/work/")).alias("relative"))


@query(f"WITH {PATHS} SELECT id, id % 5 IN (0, 1, 4) AS indexed, md5(path) AS lock_key FROM p")
def glob_index(spark, sf):
    config = files.Config(watch_directories=["/work", "c:/work"])
    return paths(spark, sf).select("id", files.should_index(F.col("path"), config, "/none").alias("indexed"), F.md5("path").alias("lock_key"))


@query("SELECT event_id, 'Sure: [{\"subject_text\":\"u' || user_id || '\",\"predicate\":\"' || upper(event_type) || '\"}] as asked' AS body, '[{\"subject_text\":\"u' || user_id || '\",\"predicate\":\"' || upper(event_type) || '\"}]' AS array_text, 'u' || user_id AS subject, upper(event_type) AS predicate FROM events")
def json_extract_array(spark, sf):
    body = F.concat(F.lit('Sure: [{"subject_text":"u'), F.col("user_id").cast("string"), F.lit('","predicate":"'), F.upper("event_type"), F.lit('"}] as asked'))
    rows = table(spark, sf, "events").select("event_id", body.alias("body"))
    r = J.records(F.col("body"))[0]
    return rows.select("event_id", "body", J.extract_array(F.col("body")).alias("array_text"), r["subject_text"].alias("subject"), r["predicate"].alias("predicate"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.nothing[0].here') AS nothing FROM events")
def json_path(spark, sf):
    return J.parsed(table(spark, sf, "events"), "props").select("event_id", J.at("json", "$.k").alias("k"), J.at("json", "$.nothing[0].here").alias("nothing"))


@query("SELECT event_id, event_type AS answer FROM events")
def provider_unwrap(spark, sf):
    kind, k = F.col("event_type"), F.col("event_id")
    body = F.when(k % 3 == 0, F.concat(F.lit('{"choices":[{"message":{"content":"'), kind, F.lit('"}}]}'))).when(k % 3 == 1, F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":"'), kind, F.lit('"}]}}]}'))).otherwise(F.concat(F.lit('{"response":"'), kind, F.lit('"}')))
    return J.parsed(table(spark, sf, "events").select("event_id", body.alias("body")), "body").select("event_id", J.unwrap_parsed("json").alias("answer"))


@query("SELECT event_id, '{\"model\":\"m\",\"prompt\":\"say ' || chr(92) || '\"' || event_type || chr(92) || '\"' || chr(92) || 'n now\"}' AS request FROM events")
def template_render(spark, sf):
    prompt = F.concat(F.lit('say "'), F.col("event_type"), F.lit('"\n now'))
    return table(spark, sf, "events").select("event_id", J.render(F.lit('{"model":"{{model}}","prompt":"{{prompt}}"}'), F.lit("m"), prompt).alias("request"))


@query("SELECT event_id, '{\"kind\":\"' || event_type || '\"}' AS json, event_type AS kind FROM events")
def attributes_json(spark, sf):
    json = J.attributes_to_json(F.create_map(F.lit("kind"), F.col("event_type")))
    return table(spark, sf, "events").select("event_id", json.alias("json"), J.attributes_from_json(json)["kind"].alias("kind"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS event_type, CAST(event_id % 5 AS INT) AS version, CASE WHEN event_id % 2 = 0 THEN ts ELSE TIMESTAMP '2024-01-01 00:00:00' END AS ts FROM events")
def tolerant_events(spark, sf):
    e = table(spark, sf, "events")
    ts = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise("soon")
    body = F.concat(F.lit('{"eventType":"'), F.col("event_type"), F.lit('","version":"'), (F.col("event_id") % 5).cast("string"), F.lit('.0","timestamp":"'), ts, F.lit('"}'))
    parsed = J.tolerant_event_parsed("json", ["signup", "click", "view", "purchase"], F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return J.parsed(e.select("event_id", body.alias("body")), "body").select("event_id", parsed.alias("p")).select("event_id", "p.event_type", "p.version", F.col("p.ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def epoch_parse(spark, sf):
    e, at = table(spark, sf, "events"), F.date_trunc("second", F.col("ts").cast("timestamp"))
    text = F.when(F.col("event_id") % 3 == 0, F.unix_millis(at).cast("string")).when(F.col("event_id") % 3 == 1, F.unix_seconds(at).cast("string")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", times.parse_time(text).cast("timestamp_ntz").alias("ts"))


@query("SELECT doc_id, list_sort(list_distinct(list_filter(string_split(text, ' '), lambda x: trim(x) <> ''))) AS words FROM (SELECT doc_id, replace(replace(text, ',', ''), chr(10), ' ') AS text FROM documents)")
def csv_sets(spark, sf):
    text = F.translate(F.translate("text", ",", ""), "\n", " ")
    csv = F.translate(text, " ", ",")
    return docs(spark, sf).select("doc_id", F.array_sort(J.csv_to_set(csv)).alias("words"))


#: Answers as models give them: an array in prose, in an object, none, an empty object, broken in two ways, nothing at all.
BODIES = ('Here: [{"subject_text":"a"},{"subject_text":"b"}] done', '{"facts":[{"subject_text":"a"}]}', "[]", "{}", '[{"subject_text":', "no JSON", "")


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 END AS n, o_orderkey % 7 > 3 AS malformed FROM orders")
def json_records(spark, sf):
    body = F.get(F.array(*map(F.lit, BODIES)), (F.col("o_orderkey") % 7).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.size(J.records(body)).alias("n"), J.malformed(body).alias("malformed")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


@query("SELECT o_orderkey, (o_orderkey % 4000) // 60 || ':' || lpad(CAST((o_orderkey % 4000) % 60 AS VARCHAR), 2, '0') AS eta FROM orders")
def duration_format(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.minutes_seconds(F.col("o_orderkey") % 4000).alias("eta"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 50) * 1000 + 1000 WHEN 1 THEN o_orderkey % 900 + 500 END AS delay_ms FROM orders")
def retry_delay(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("Rate limit. Please try again in "), (k % 50).cast("string"), F.lit(".5s."))).when(k % 3 == 1, F.concat(F.lit("try again in "), (k % 900).cast("string"), F.lit("ms"))).otherwise("no hint")
    return table(spark, sf, "orders").select("o_orderkey", T.retry_delay_ms(text).alias("delay_ms"))


@query("SELECT DISTINCT o_orderpriority, replace(replace(o_orderpriority, chr(10), ' '), '|', ',') AS shown FROM orders")
def display_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderpriority", T.display_text(F.col("o_orderpriority")).alias("shown")).distinct()


@query("SELECT * FROM (VALUES ('BUSINESS_RULES', 'Business Rules'), ('SYSTEM_INTEGRATION', 'System Integration')) t(name, friendly)")
def friendly_group(spark, sf):
    names = spark.createDataFrame([("BUSINESS_RULES",), ("SYSTEM_INTEGRATION",)], "name string")
    return names.select("name", T.friendly_group(F.col("name")).alias("friendly"))


@query("SELECT doc_id, 'State the facts of this section as JSON.' || chr(10) || 'Use these predicates: [\"USES\",' || chr(10) || '\"CALLS\"]' || chr(10) || 'Section: ' || source || chr(10) || 'Text:' || chr(10) || text AS prompt FROM documents")
def prompt_assembly(spark, sf):
    return docs(spark, sf).select("doc_id", T.prompt(F.col("source"), F.col("text"), F.lit(["USES", "CALLS"])).alias("prompt"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS t FROM documents)
SELECT doc_id, CAST(sum(CAST(ceil(length(t) / 4.0) AS INT)) AS INT) AS token_estimate FROM w GROUP BY doc_id""")
def token_estimate(spark, sf):
    return docs(spark, sf).select("doc_id", T.token_estimate(F.col("text")).alias("token_estimate"))
