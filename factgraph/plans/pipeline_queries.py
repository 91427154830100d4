"""Ingestion and operations: versions, differences, ownership, retries, metrics, outbox, and the streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import markdown as M
from ..operators import metrics as X
from ..operators import versions as V
from ..session import scratch, table
from ..sources import folders
from ..sources.files import scan, table_stream
from ..streaming import jobs
from .fixtures import CHUNK_VERSIONS, MD_DOCS, STATES, chunk_versions, md_docs, states
from .registry import query

NOW = "2024-06-01 12:00:00"


def now():
    return F.to_timestamp_ntz(F.lit(NOW))


@query("SELECT sha256(text) AS checksum, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def doc_checksum_dedup(spark, sf):
    return V.by_checksum(table(spark, sf, "documents"))


@query("""WITH e AS (SELECT '/src/' || CASE WHEN doc_id % 2 = 0 THEN 'docs/' ELSE '' END || source || '.md' AS path, doc_id AS seq, sha256(text) AS checksum FROM documents),
c AS (SELECT *, lag(checksum) OVER (PARTITION BY path ORDER BY seq) AS before FROM e),
v AS (SELECT path, seq, checksum, CAST(row_number() OVER (PARTITION BY path ORDER BY seq) AS INT) AS version FROM c WHERE before IS DISTINCT FROM checksum)
SELECT *, sha256(path || '|' || version) AS ingestion_run_id, 'src' AS project_root FROM v""")
def doc_versions(spark, sf):
    path = F.concat(F.lit("/src/"), F.when(F.col("doc_id") % 2 == 0, "docs/").otherwise(""), F.col("source"), F.lit(".md"))
    return V.versions(table(spark, sf, "documents").select(path.alias("path"), F.col("doc_id").alias("seq"), "text"))


@query("""WITH e AS (SELECT '/src/' || source || '.md' AS path, doc_id AS seq, sha256(text) AS checksum FROM documents),
c AS (SELECT *, lag(checksum) OVER (PARTITION BY path ORDER BY seq) AS before FROM e),
v AS (SELECT path, seq, row_number() OVER (PARTITION BY path ORDER BY seq) AS version, count(*) OVER (PARTITION BY path) AS n FROM c WHERE before IS DISTINCT FROM checksum)
SELECT sha256(path || '|' || version) AS ingestion_run_id, path AS document_id, CASE WHEN version < n THEN 'SUPERSEDED' WHEN path < '/src/src2' THEN 'COMPLETED' ELSE 'STARTED' END AS run_status, seq AS created_at FROM v""")
def document_runs(spark, sf):
    """A run for each version of a path; the last one's status follows from the document's."""
    rows = V.versions(table(spark, sf, "documents").select(F.concat(F.lit("/src/"), "source", F.lit(".md")).alias("path"), F.col("doc_id").alias("seq"), "text"))
    states_ = rows.select("path").distinct().withColumn("status", F.when(F.col("path") < "/src/src2", "QUERYABLE").otherwise("RETRYING"))
    return V.runs(rows, states_).select("ingestion_run_id", "document_id", "run_status", "created_at")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 3 = 0 AND o.source = d.source AND o.text = d.text)")
def skip_queryable(spark, sf):
    """Files whose path is queryable with the same checksum are left alone."""
    files = table(spark, sf, "documents").select("doc_id", F.col("source").alias("path"), F.sha2("text", 256).alias("checksum"))
    known = files.select("path", "checksum", F.when(F.col("doc_id") % 3 == 0, "QUERYABLE").otherwise("RETRYING").alias("status"))
    return V.skip_unchanged(files, known).select("doc_id")


@query("""WITH f AS (SELECT (['docs', 'build', 'notes/logs', '.git', 'docs/node_modules/x', '_drafts', 'docs/a.b'])[doc_id % 7 + 1] AS folder, (['md', 'TXT', 'Md', 'py', 'xlsx'])[doc_id % 5 + 1] AS extension, doc_id, coalesce(text, '') AS text FROM documents)
SELECT folder || '/' || doc_id || '.' || extension AS rel, sha256(text) AS checksum, CASE WHEN extension <> 'xlsx' THEN length(text) END AS n_chars, extension = 'xlsx' AS quarantined
FROM f WHERE folder IN ('docs', '_drafts', 'docs/a.b') AND extension <> 'py'""")
def folder_scan(spark, sf):
    """The documents as files of a tree, some in folders that scans skip, and the scan of that tree."""
    root = scratch(spark, "tree")
    folder = F.element_at(F.array(*map(F.lit, ("docs", "build", "notes/logs", ".git", "docs/node_modules/x", "_drafts", "docs/a.b"))), (F.col("doc_id") % 7 + 1).cast("int"))
    extension = F.element_at(F.array(*map(F.lit, ("md", "TXT", "Md", "py", "xlsx"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rel = F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), extension)
    folders.put(table(spark, sf, "documents").select(rel.alias("rel"), F.coalesce("text", F.lit("")).cast("binary").alias("content")), root)
    return scan(spark, root).select("rel", "checksum", F.length("text").cast("long").alias("n_chars"), "quarantined")


@query("SELECT doc_id, 'v' || lpad(CAST(doc_id % 90 + 1 AS VARCHAR), 5, '0') || '-' || left(sha256(text), 8) AS tag FROM documents")
def version_tag(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", V.version_tag((F.col("doc_id") % 90 + 1).cast("int"), F.sha2("text", 256)).alias("tag"))


HEADINGS_SQL = r"""
l AS (SELECT document_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS pos FROM md),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^ {0,3}#{1,6}([ \t]|$)') THEN length(regexp_extract(line, '^ {0,3}(#{1,6})', 1)) END AS level,
  trim(regexp_replace(regexp_replace(line, '^ {0,3}#{1,6}[ \t]*', ''), '[ \t]+#+[ \t]*$', '')) AS title FROM l),
s AS (SELECT *, sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY pos) AS section FROM h),
p AS (SELECT document_id, section, string_agg(line, chr(10) ORDER BY pos) AS raw, min(pos) AS at, arg_min(level, pos) AS level, arg_min(title, pos) FILTER (level IS NOT NULL) AS heading FROM s GROUP BY 1, 2),
one AS (SELECT document_id, section, raw, heading, level,
  (SELECT arg_max(o.heading, o.section) FROM p o WHERE o.document_id = p.document_id AND o.section <= p.section AND o.level = 1) AS h1 FROM p),
b AS (SELECT *, regexp_replace(regexp_replace(raw, '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '') AS content, CASE WHEN level IS NULL THEN 'Document' WHEN level = 1 THEN heading ELSE h1 || '>' || heading END AS section_path FROM one),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(raw), '(?m)^#+[\t\n\x0B\f\r ]*(.*)$', '\1', 'g'), '(?s)```.*?\n(.*?)```', '\1', 'g'), '[*`_~>\-\[\],.?!;:''"]', '', 'g'), '[\t\n\x0B\f\r ]+', ' ', 'g'), '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '') AS normalized_content FROM b WHERE content <> '')"""


@query(f"WITH {MD_DOCS}, {HEADINGS_SQL} SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY section) AS INT) AS sequence_number, section_path, nullif(heading, '') AS heading, content, normalized_content, sha256(section_path || normalized_content) AS chunk_checksum FROM n")
def chunk_headings(spark, sf):
    return M.chunk(md_docs(spark, sf)).drop("token_estimate")


@query(f"WITH {CHUNK_VERSIONS} SELECT cv.* , previous_sequence FROM cv JOIN prev USING (document_id, version, chunk_checksum)")
def chunk_diff_unchanged(spark, sf):
    return V.unchanged(chunk_versions(spark, sf))


@query(f"WITH {CHUNK_VERSIONS} SELECT * FROM cv WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.document_id = cv.document_id AND p.version = cv.version AND p.chunk_checksum = cv.chunk_checksum) AND version = 2")
def chunk_diff_changed(spark, sf):
    return V.to_extract(chunk_versions(spark, sf)).where("version = 2")


@query(f"WITH {CHUNK_VERSIONS} SELECT * FROM cv WHERE version = 1 AND NOT (sequence_number % 2 = 1 AND EXISTS (SELECT 1)) AND NOT EXISTS (SELECT 1 FROM cv o WHERE o.document_id = cv.document_id AND o.version = 1 AND o.chunk_checksum = cv.chunk_checksum AND o.sequence_number % 2 = 1)")
def completed_chunk_skip(spark, sf):
    chunks = chunk_versions(spark, sf).where("version = 1")
    return V.to_extract(chunks, chunks.where("sequence_number % 2 = 1"))


@query(f"WITH {CHUNK_VERSIONS} SELECT cv.document_id, cv.version, cv.sequence_number, sha256('fact' || previous_sequence) AS semantic_checksum FROM cv JOIN prev USING (document_id, version, chunk_checksum) WHERE previous_sequence % 3 = 0")
def carry_forward(spark, sf):
    chunks = chunk_versions(spark, sf)
    old = chunks.where("version = 1 and sequence_number % 3 = 0").select("document_id", "version", "sequence_number", F.sha2(F.concat(F.lit("fact"), F.col("sequence_number").cast("string")), 256).alias("semantic_checksum"))
    return V.carry_forward(chunks, old)


@query("""WITH r AS (SELECT source AS document_id, 1 AS version, sha256(text) AS semantic_checksum, doc_id AS seq FROM documents),
x AS (SELECT DISTINCT document_id, version, semantic_checksum FROM r WHERE seq % 10 = 0)
SELECT document_id, version, semantic_checksum, min(seq) AS seq FROM r WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.document_id = r.document_id AND x.semantic_checksum = r.semantic_checksum) GROUP BY ALL""")
def assertion_dedup(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("source").alias("document_id"), F.lit(1).alias("version"), F.sha2("text", 256).alias("semantic_checksum"), F.col("doc_id").alias("seq"))
    return V.new_assertions(rows, rows.where("seq % 10 = 0"))


FILE_EVENTS = "fe AS (SELECT event_id, 'u' || user_id AS path, ts, CASE WHEN event_type = 'signup' THEN 1000 ELSE 2000 END AS delay_s FROM events)"


def file_events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), "ts", F.when(F.col("event_type") == "signup", 1000).otherwise(2000).alias("delay_s"))


@query(f"WITH {FILE_EVENTS}, n AS (SELECT *, lead(ts) OVER (PARTITION BY path ORDER BY ts, event_id) AS nx FROM fe) SELECT event_id, path, ts, delay_s FROM n WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) >= delay_s * 1000000")
def debounce_events(spark, sf):
    return V.debounce(file_events(spark, sf))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS in_window, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) <= 15 AS allowed FROM events")
def rate_window(spark, sf):
    return V.rate_window(table(spark, sf, "events"), "event_type").select("event_id", "in_window", "allowed")


@query("""WITH r AS (SELECT event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n FROM events),
c AS (SELECT *, n % 15 AS chain, n // 15 AS k FROM r)
SELECT event_id, make_timestamp(max(t - k * 60001000) OVER (PARTITION BY event_type, chain ORDER BY k) + k * 60001000) AS admitted_at FROM c""")
def rate_schedule(spark, sf):
    return V.admitted(table(spark, sf, "events"), "event_type").select("event_id", "admitted_at")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts FROM events), a(user_id, ts) AS (
  SELECT user_id, min(ts) FROM e GROUP BY user_id
  UNION ALL SELECT a.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL 168 HOURS) FROM a WHERE a.ts IS NOT NULL)
SELECT user_id, ts FROM a WHERE ts IS NOT NULL""")
def dedup_ttl(spark, sf):
    return V.dedup_ttl(table(spark, sf, "events"), "user_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts FROM events), a(user_id, ts) AS (
  SELECT user_id, min(ts) FROM e GROUP BY user_id
  UNION ALL SELECT a.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL 168 HOURS) FROM a WHERE a.ts IS NOT NULL)
SELECT user_id, ts FROM a WHERE ts IS NOT NULL""")
def stream_dedup_ttl(spark, sf):
    """``dedup_ttl`` of a stream: a key's term begins when one of its events is accepted."""
    checkpoint, out = _places(spark)
    accepted = jobs.collected(spark, jobs.dedup_ttl(_stream(spark, sf, "events").select("user_id", "ts"), "user_id"), checkpoint, out)
    return accepted.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"""WITH {FILE_EVENTS}, n AS (SELECT *, lead(ts) OVER (PARTITION BY path ORDER BY ts, event_id) AS nx, max(epoch_us(ts)) OVER () AS newest FROM fe)
SELECT event_id, path, ts, CAST(delay_s AS BIGINT) AS delay_s FROM n
WHERE epoch_us(nx) - epoch_us(ts) >= delay_s * 1000000 OR nx IS NULL AND (epoch_us(ts) + delay_s * 1000000 + 999) // 1000 < newest // 1000""")
def stream_debounce_kinds(spark, sf):
    """``debounce_events`` of a stream, with the delay of each kind; what waits when the stream ends is not out yet."""
    checkpoint, out = _places(spark)
    e = _stream(spark, sf, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), "ts", F.when(F.col("event_type") == "signup", 1000).otherwise(2000).alias("delay_s"))
    return jobs.collected(spark, jobs.debounce(e), checkpoint, out).select("event_id", "path", F.col("ts").cast("timestamp_ntz").alias("ts"), "delay_s")


@query("""WITH e AS (SELECT 'u' || user_id AS path, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) AS INT) AS attempt, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx, max(epoch_us(ts)) OVER () AS newest FROM events WHERE event_type = 'error'),
r AS (SELECT *, CASE WHEN attempt <= 5 THEN ts + INTERVAL (15 * CAST(pow(2, attempt - 1) AS INT)) SECONDS END AS retry_at FROM e)
SELECT path, attempt, CASE WHEN attempt > 5 THEN 'FAILED_FATAL' ELSE 'RETRYING' END AS status, retry_at FROM r
UNION ALL SELECT path, attempt, 'DUE', retry_at FROM r WHERE nx IS NULL AND attempt <= 5 AND epoch_us(retry_at) // 1000 < newest // 1000""")
def stream_retry_due(spark, sf):
    """Failures with their attempts and times, and what the timers woke by the time of the newest failure."""
    checkpoint, out = _places(spark)
    fails = _stream(spark, sf, "events").where("event_type = 'error'").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), "ts")
    return jobs.collected(spark, jobs.retries(fails), checkpoint, out).withColumn("retry_at", F.col("retry_at").cast("timestamp_ntz"))


WORKERS = ("w1", "w2", "w3", "w4")


@query("""WITH w AS (SELECT unnest(['w1', 'w2', 'w3', 'w4']) AS worker), p AS (SELECT o_orderkey, 'docs/order' || o_orderkey || '.md' AS path FROM orders),
s AS (SELECT o_orderkey, path, worker, CAST('0x' || substr('01234567', CAST('0x' || substr(md5(worker || ':' || path), 1, 1) AS INT) % 8 + 1, 1) || substr(md5(worker || ':' || path), 2, 15) AS BIGINT) AS weight FROM p, w)
SELECT path, arg_min(worker, (-weight, worker)) AS owner FROM s GROUP BY path""")
def hrw_ownership(spark, sf):
    paths = table(spark, sf, "orders").select(F.concat(F.lit("docs/order"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"))
    return V.owners(paths, spark.createDataFrame([(w,) for w in WORKERS], "worker_id string"))


@query(f"WITH {STATES} SELECT path, retry_count, CASE WHEN retry_count < 5 THEN 'RETRYING' ELSE 'FAILED_FATAL' END AS next_status, CASE WHEN retry_count < 5 THEN TIMESTAMP '{NOW}' + INTERVAL (15 * CAST(pow(2, retry_count) AS INT)) SECONDS END AS next_retry_at FROM states")
def retry_schedule(spark, sf):
    return X.schedule_retries(states(spark, sf), now()).select("path", "retry_count", "next_status", "next_retry_at")


@query(f"WITH {STATES} SELECT path FROM states WHERE status = 'RETRYING' AND updated_at <= TIMESTAMP '2024-01-30 12:00:00'")
def retry_due(spark, sf):
    rows = states(spark, sf).withColumn("next_retry_at", F.col("updated_at"))
    return X.due(rows, F.to_timestamp_ntz(F.lit("2024-01-30 12:00:00"))).select("path")


@query(f"WITH {STATES} SELECT path, status, CASE WHEN status = 'QUERYABLE' THEN 'NONE' WHEN status = 'RETRYING' THEN CASE WHEN current_stage = 'CHUNKING' THEN 'CHUNKING' ELSE 'ASSERTIONS' END WHEN status = 'DISCOVERED' THEN 'CHUNKING' WHEN total_chunks > 0 THEN 'ASSERTIONS' ELSE 'CHUNKING' END AS next_stage FROM states")
def recovery_next_stage(spark, sf):
    return X.recover(states(spark, sf)).select("path", "status", "next_stage")


@query("WITH b AS (SELECT user_id AS worker_id, max(ts) AS last_beat FROM events GROUP BY 1), n AS (SELECT max(ts) AS t FROM events) SELECT worker_id, last_beat FROM b, n WHERE epoch_us(t) - epoch_us(last_beat) > 15000000")
def stale_workers(spark, sf):
    e = table(spark, sf, "events")
    return X.stale_workers(e.select(F.col("user_id").alias("worker_id"), "ts"), F.lit(e.agg(F.max("ts")).first()[0]))


@query("WITH b AS (SELECT 'w' || user_id AS worker_id, max(ts) AS last_beat FROM events GROUP BY 1), n AS (SELECT max(ts) AS t FROM events) SELECT worker_id, last_beat FROM b, n WHERE epoch_us(t) - epoch_us(last_beat) <= 3600000000")
def live_workers(spark, sf):
    e = table(spark, sf, "events")
    return X.workers(e.select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("worker_id"), "ts"), F.lit(e.agg(F.max("ts")).first()[0]), 3600)


@query(f"WITH {STATES} SELECT path, retry_count + 1 AS retry_count, CASE WHEN retry_count < 5 THEN 'RETRYING' ELSE 'FAILED_FATAL' END AS status, CASE WHEN retry_count < 5 THEN total_chunks ELSE 0 END AS total_chunks FROM states")
def failed_states(spark, sf):
    return X.failed_states(states(spark, sf), now()).select("path", "retry_count", "status", "total_chunks")


@query(" UNION ALL ".join(f"SELECT '{n}' AS metric, count(*) AS value FROM {n}" for n in ("documents", "conversations", "orders", "lineitem", "events")))
def metrics_summary(spark, sf):
    return X.summary({n: table(spark, sf, n) for n in ("documents", "conversations", "orders", "lineitem", "events")})


@query("SELECT source, count(*) AS docs, coalesce(sum(len(regexp_extract_all(text, '\\S+'))), 0)::BIGINT AS words, round(CASE WHEN count(DISTINCT lang) > 0 THEN count(*) / count(DISTINCT lang)::DOUBLE ELSE 0 END, 6) AS docs_per_lang FROM documents GROUP BY source".replace("\\\\", "\\"))
def metrics_ratios(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))), F.lit(0)).alias("words"), F.countDistinct("lang").alias("langs"))
    return d.select("source", "docs", "words", F.round(X.ratio(F.col("docs"), F.col("langs")), 6).alias("docs_per_lang"))


@query("SELECT coalesce(CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END, 'UNKNOWN') AS event_type, count(*) AS n FROM events GROUP BY 1")
def event_type_counts(spark, sf):
    e = table(spark, sf, "events")
    return X.event_counts(e.withColumn("event_type", F.when(F.col("event_id") % 10 != 0, F.col("event_type"))))


@query("SELECT count(*) FILTER (event_type = 'error') AS failed, round(avg(value) FILTER (value > 0), 6) AS mean_latency FROM events")
def failures_and_latency(spark, sf):
    return X.failures(table(spark, sf, "events")).select("failed", F.round("mean_latency", 6).alias("mean_latency"))


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS t FROM documents) SELECT CAST(sum(CAST(ceil(length(t) / 4.0) AS INT)) AS BIGINT) AS total_tokens FROM w""")
def total_tokens(spark, sf):
    return X.total_tokens(table(spark, sf, "documents").select(T.token_estimate(F.col("text")).alias("token_estimate")))


@query("SELECT count(*) AS n, round(avg(epoch_us(ts + INTERVAL 3 SECONDS) - epoch_us(ts) + (event_id % 5 - 2) * 2000000) / 1000.0, 6) AS mean_latency_ms FROM events WHERE event_type = 'purchase' AND 3000000 + (event_id % 5 - 2) * 2000000 > 0")
def graph_ready_latency(spark, sf):
    e = table(spark, sf, "events").withColumn("handled", F.col("ts") + F.expr("make_dt_interval(0, 0, 0, 3 + (event_id % 5 - 2) * 2)"))
    return X.latency(e, F.col("handled"), "purchase").select("n", F.round("mean_latency_ms", 6).alias("mean_latency_ms"))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_events(spark, sf):
    return X.recent(table(spark, sf, "events").select("event_id", "ts", "event_type"))


@query("SELECT time_bucket(INTERVAL 10 SECONDS, ts) AS window_start, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 60")
def throughput_history(spark, sf):
    return X.throughput(table(spark, sf, "events"))


@query("WITH d AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT *, round((n - lag(n) OVER w) / ((epoch_us(day) - epoch_us(lag(day) OVER w)) / 1000000.0), 6) AS rate FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)")
def growth_rates(spark, sf):
    d = table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return X.growth(d, at="day", group="event_type").withColumn("rate", F.when(F.row_number().over(Window.partitionBy("event_type").orderBy("day")) > 1, F.col("rate")))


@query("""WITH s AS (SELECT event_type AS job, date_trunc('day', ts) AS day, count(*) AS c FROM events GROUP BY 1, 2),
p AS (SELECT job, day, CAST(sum(c) OVER (PARTITION BY job ORDER BY day) AS BIGINT) AS processed, CAST(sum(c) OVER (PARTITION BY job) AS BIGINT) AS total FROM s),
q AS (SELECT *, (processed - lag(processed) OVER w) / ((epoch_us(day) - epoch_us(lag(day) OVER w)) / 1000000.0) AS speed FROM p WINDOW w AS (PARTITION BY job ORDER BY day))
SELECT job, day, processed, total, least(100, CAST(round(processed * 100.0 / total) AS BIGINT)) AS percent, round(speed, 6) AS throughput, CASE WHEN speed > 0 THEN CAST(floor((total - processed) / speed) AS BIGINT) END AS eta_s FROM q""")
def progress_eta(spark, sf):
    s = table(spark, sf, "events").groupBy(F.col("event_type").alias("job"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("c"))
    s = s.withColumn("processed", F.sum("c").over(Window.partitionBy("job").orderBy("day"))).withColumn("total", F.sum("c").over(Window.partitionBy("job"))).drop("c")
    return X.progress(s, at="day")


@query(f"WITH {STATES} SELECT path, status, CASE WHEN status = 'QUERYABLE' THEN 'ok' WHEN status LIKE 'FAILED%' THEN 'failed' WHEN status = 'RETRYING' THEN 'retrying' ELSE 'running' END AS bucket, clicks + 1 AS done, total_chunks, round((clicks + 1) / total_chunks::DOUBLE, 6) AS progress FROM states")
def status_progress(spark, sf):
    return X.status_list(states(spark, sf))


@query(f"WITH {STATES} SELECT path, status FROM states WHERE path = 'docs/u3.md'")
def status_lookup(spark, sf):
    return X.find_state(states(spark, sf), "somewhere/else/u3.md").select("path", "status")


@query("SELECT event_id AS id, ts AS created_at FROM events WHERE event_type <> 'view' ORDER BY ts, event_id LIMIT 100")
def outbox_batch(spark, sf):
    box = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "view", F.col("ts")).alias("published_at"))
    return X.outbox_batch(box).select("id", "created_at")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def state_upsert(spark, sf):
    e = table(spark, sf, "events").withColumn("o", F.struct("ts", "event_id"))
    return X.latest(e, "user_id", "o").select("user_id", "event_type", "event_id")


@query("SELECT DISTINCT event_type, CASE WHEN contains(upper(event_type) || x, 'FAILED') THEN 'error' WHEN contains(upper(event_type) || x, 'COMPLETED') OR contains(upper(event_type) || x, 'READY') OR contains(upper(event_type) || x, 'CREATED') THEN 'success' ELSE 'info' END AS severity, x FROM events, (VALUES ('_FAILED'), ('_COMPLETED'), ('_QUEUED')) t(x)")
def event_severity(spark, sf):
    e = table(spark, sf, "events").select("event_type").distinct().withColumn("x", F.explode(F.array(*map(F.lit, ("_FAILED", "_COMPLETED", "_QUEUED")))))
    return e.select("event_type", X.severity(F.concat(F.upper("event_type"), F.col("x"))).alias("severity"), "x")


def _places(spark) -> tuple[str, str]:
    """A checkpoint and an output folder in the shared folder."""
    here = scratch(spark, "stream")
    return f"{here}/checkpoint", f"{here}/out"


def _stream(spark, sf, name):
    return table_stream(spark, f"{sf}/{name}.parquet")


@query("SELECT coalesce(event_type, 'UNKNOWN') AS event_type, count(*) AS n FROM events GROUP BY 1")
def stream_ingest_available_now(spark, sf):
    """Micro-batches into a sink that overwrites repeated batches, then the batch query over what came."""
    checkpoint, out = _places(spark)
    jobs.run_available(_stream(spark, sf, "events"), jobs.append_parquet(out), checkpoint).awaitTermination()
    return X.event_counts(spark.read.parquet(out))


@query("SELECT DISTINCT sha256(text) AS checksum FROM documents")
def stream_dedup(spark, sf):
    checkpoint, out = _places(spark)
    docs = _stream(spark, sf, "documents").select(F.sha2("text", 256).alias("checksum"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    return jobs.collected(spark, jobs.dedup(docs), checkpoint, out).select("checksum")


@query("""WITH e AS (SELECT 'u' || user_id AS path, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS attempt FROM events WHERE event_type = 'error')
SELECT path, CAST(attempt AS INT) AS attempt, CASE WHEN attempt > 5 THEN 'FAILED_FATAL' ELSE 'RETRYING' END AS status FROM e""")
def stream_retry(spark, sf):
    checkpoint, out = _places(spark)
    fails = _stream(spark, sf, "events").where("event_type = 'error'").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), "ts")
    return jobs.collected(spark, jobs.retries(fails), checkpoint, out).where("status != 'DUE'").select("path", "attempt", "status")


@query("""WITH g AS (SELECT 'u' || user_id AS path, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 3600000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT path, max(ts) AS ts, count(*) AS merged FROM s GROUP BY path, session""")
def stream_debounce(spark, sf):
    """The last event of each run of a path's events that follow each other within an hour."""
    checkpoint, out = _places(spark)
    e = _stream(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    jobs.sessions(e, gap="1 hour").writeStream.outputMode("complete").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("path", F.col("ts").cast("timestamp_ntz").alias("ts"), "merged")


@query("SELECT time_bucket(INTERVAL 10 SECONDS, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_metrics(spark, sf):
    checkpoint, out = _places(spark)
    found = []
    stream = jobs.counts(_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), late="0 seconds")
    stream.writeStream.outputMode("complete").foreachBatch(lambda df, k: found.append(df.write.mode("overwrite").parquet(out))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
