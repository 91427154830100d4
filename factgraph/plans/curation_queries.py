"""Predicates: classification, resolution, validation, review queue and curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import curation as C
from ..operators import graph as G
from ..operators import validate as V
from ..session import cut, scratch
from .fixtures import ALIASES, RAW, raw_predicates
from .registry import query

ACTIVE_SQL = f"active AS (SELECT name, {P.classify_sql('name')} AS predicate_group FROM (VALUES {P.seed_sql()}) t(name))"
ALIASES_SQL = "aliases AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ALIASES) + ") t(source, target))"


def aliases(spark):
    return spark.createDataFrame(list(ALIASES), "source string, target string")


#: The candidates of a predicate in SQL, each with its place; written apart from the expressions in Spark.
RESOLVE_SQL = f"""
names AS (SELECT DISTINCT predicate AS raw, upper(predicate) AS u FROM raw),
cand AS (
  SELECT raw, 0 AS pos, u AS c FROM names
  UNION ALL SELECT raw, 10, CASE WHEN u LIKE '%S' AND u NOT LIKE '%SS' THEN left(u, -1) ELSE u || 'S' END FROM names WHERE u NOT LIKE '%\\_%' ESCAPE '\\'
  UNION ALL SELECT raw, 20 + i, left(u, -2) || e FROM names, (VALUES (0, ''), (1, 'S'), (2, 'ES')) x(i, e) WHERE u LIKE '%ED' AND length(u) > 3 AND u NOT LIKE '%\\_%' ESCAPE '\\'
  UNION ALL SELECT raw, 30 + i, left(u, -3) || e FROM names, (VALUES (0, ''), (1, 'S'), (2, 'ES')) x(i, e) WHERE u LIKE '%ING' AND length(u) > 4 AND u NOT LIKE '%\\_%' ESCAPE '\\'
  UNION ALL SELECT raw, 40 + i, left(u, -4) || e FROM names, (VALUES (0, ''), (1, 'S')) x(i, e) WHERE u LIKE '%ING' AND length(u) > 4 AND substr(u, -4, 1) = substr(u, -5, 1) AND u NOT LIKE '%\\_%' ESCAPE '\\'
  UNION ALL SELECT raw, 50, left(u, -2) FROM names WHERE u LIKE '%ES' AND u NOT LIKE '%SS' AND length(u) > 3 AND u NOT LIKE '%\\_%' ESCAPE '\\'),
hit AS (SELECT raw, arg_min(c, pos) AS c, min(pos) AS pos FROM cand JOIN active ON c = name GROUP BY raw),
resolved AS (SELECT names.raw, CASE WHEN hit.pos = 0 THEN hit.c ELSE coalesce(target, hit.c) END AS resolved FROM names LEFT JOIN hit USING (raw) LEFT JOIN aliases ON u = source)"""
BASE = f"WITH {RAW}, {ACTIVE_SQL}, {ALIASES_SQL}, {RESOLVE_SQL}"

#: Grounding in SQL.
GROUND_SQL = """
g0 AS (SELECT *, lower(trim(regexp_replace(regexp_replace(raw_text, '\\s+', ' ', 'g'), '[^\\w\\s]', '', 'g'))) AS r, lower(trim(regexp_replace(regexp_replace(chunk_text, '\\s+', ' ', 'g'), '[^\\w\\s]', '', 'g'))) AS c FROM raw),
g1 AS (SELECT *, list_filter(string_split(r, ' '), lambda w: w <> '') AS w FROM g0),
ground AS (SELECT *, contains(c, r) OR (len(w) > 4 AND contains(c, array_to_string(w[1 + least(3, len(w) - 3):], ' '))) OR regexp_matches(c, array_to_string(w, '.*')) AS grounded FROM g1)"""
REASON_SQL = f"""{GROUND_SQL},
v0 AS (SELECT ground.*, resolved, CASE WHEN NOT regexp_matches(subject_text, '\\S') THEN 'SUBJECT' WHEN NOT regexp_matches(object_text, '\\S') THEN 'OBJECT' WHEN NOT regexp_matches(normalized_text, '\\S') THEN 'NORMALIZED_TEXT'
  WHEN resolved IS NULL THEN 'PREDICATE' WHEN NOT regexp_matches(raw_text, '\\S') THEN 'RAW_TEXT' WHEN NOT grounded THEN 'GROUNDING' END AS reject_reason FROM ground JOIN resolved ON predicate = resolved.raw),
near AS (SELECT u, arg_min(name, (levenshtein(u, name), length(name), name)) AS nearest, min(levenshtein(u, name)) AS distance FROM names, active WHERE abs(length(u) - length(name)) <= 2 AND levenshtein(u, name) <= 2 GROUP BY u),
v1 AS (SELECT v0.*, reject_reason = 'PREDICATE' AND regexp_matches(raw_text, '\\S') AND grounded AS only_predicate, nearest FROM v0 LEFT JOIN near ON upper(predicate) = u),
v AS (SELECT document_id, seq, predicate, raw_text, reject_reason, CASE WHEN reject_reason IS NULL THEN 'accepted' WHEN only_predicate AND nearest IS NOT NULL THEN 'collapsed' WHEN only_predicate THEN 'queued' ELSE 'rejected' END AS outcome,
  coalesce(resolved, CASE WHEN only_predicate THEN nearest END) AS resolved FROM v1)"""


@query(f"SELECT name, {P.classify_sql('name')} AS predicate_group FROM (VALUES {P.seed_sql()}) t(name)")
def predicate_classify(spark, sf):
    return P.seed(spark)


@query(f"{BASE} SELECT raw AS predicate, resolved FROM resolved")
def predicate_resolve(spark, sf):
    names = raw_predicates(spark, sf).select("predicate").distinct()
    return P.resolve(names, P.seed(spark), aliases(spark))


@query(f"{BASE} SELECT seq, resolved FROM raw JOIN resolved ON predicate = resolved.raw WHERE predicate IN ('ENCLOSES', 'RELATES_TO')")
def predicate_alias(spark, sf):
    rows = raw_predicates(spark, sf).where(F.col("predicate").isin("ENCLOSES", "RELATES_TO"))
    return P.resolve(rows, P.seed(spark), aliases(spark)).select("seq", "resolved")


@query(f"{BASE} SELECT u AS predicate, arg_min(name, (levenshtein(u, name), length(name), name)) AS nearest, CAST(min(levenshtein(u, name)) AS INT) AS distance FROM names, active WHERE abs(length(u) - length(name)) <= 2 AND levenshtein(u, name) <= 2 GROUP BY u")
def predicate_nearest(spark, sf):
    return P.nearest(raw_predicates(spark, sf), P.seed(spark))


@query(f"{BASE}, {GROUND_SQL} SELECT seq, grounded FROM ground")
def grounding(spark, sf):
    return raw_predicates(spark, sf).select("seq", T.grounded(F.col("raw_text"), F.col("chunk_text")).alias("grounded"))


@query(f"{BASE}, {REASON_SQL} SELECT seq, reject_reason, outcome, resolved FROM v")
def validation_reasons(spark, sf):
    return V.validate(raw_predicates(spark, sf), P.seed(spark), aliases(spark)).select("seq", "reject_reason", "outcome", "resolved")


QUEUE = f"{BASE}, {REASON_SQL}, failed AS (SELECT upper(predicate) AS name, count(*) AS occurrence_count, arg_max(document_id, seq) AS last_seen_document, arg_max(raw_text, seq) AS sample_raw_text, {P.classify_sql('upper(predicate)')} AS predicate_group FROM v WHERE outcome = 'queued' GROUP BY 1, 5)"


def queue(spark, sf):
    done = V.validate(raw_predicates(spark, sf), P.seed(spark), aliases(spark))
    return P.failed_queue(done.where("outcome = 'queued'"))


@query(f"{QUEUE} SELECT * FROM failed ORDER BY occurrence_count DESC, name")
def failed_predicate_queue(spark, sf):
    return P.ordered_failed(queue(spark, sf))


@query(f"{QUEUE} SELECT 'approve' AS action, name, CAST(NULL AS VARCHAR) AS target FROM failed WHERE occurrence_count >= 100")
def auto_approve(spark, sf):
    return C.auto_approve(queue(spark, sf), 100)


@query(f"{QUEUE} SELECT name, predicate_group, coalesce((SELECT min(a.name) FROM active a WHERE a.predicate_group = failed.predicate_group), '') AS suggestion FROM failed")
def mapping_suggestion(spark, sf):
    return P.suggestions(queue(spark, sf), P.seed(spark))


@query(f"WITH {ACTIVE_SQL} SELECT predicate_group, string_agg(name, ',' ORDER BY name) AS names, count(*) AS n, CASE WHEN predicate_group = 'BUSINESS_RULES' THEN 0 ELSE 1 END AS priority FROM active GROUP BY predicate_group")
def predicate_groups(spark, sf):
    return P.grouped(P.seed(spark))


@query(f"WITH {ACTIVE_SQL} SELECT name, predicate_group FROM active UNION ALL SELECT 'CLICKS', 'BUSINESS_RULES'")
def seed_insert_ignore(spark, sf):
    more = spark.createDataFrame([("CLICKS", "BUSINESS_RULES"), ("USES", "OTHER")], "name string, predicate_group string")
    return P.insert_ignore(P.seed(spark), more)


@query(f"WITH {ACTIVE_SQL} SELECT * FROM active")
def group_backfill(spark, sf):
    blank = F.when(F.length("name") % 2 == 0, F.lit(" ")).when(F.length("name") % 3 == 0, F.lit(None)).otherwise(F.col("predicate_group"))
    return P.backfill_groups(P.seed(spark).withColumn("predicate_group", blank))


def actions(spark, *rows):
    rows = rows or (("approve", "CLICK", None), ("map", "UNKNOWNVERB", "CONTAINS"), ("reject", "MAPPING", None))
    return spark.createDataFrame(list(rows), "action string, name string, target string")


PENDING = f"{QUEUE}, pending AS (SELECT * FROM v WHERE outcome = 'queued')"


def kept(spark, sf):
    """Validated records, written once for a query that takes what is accepted and what is pending of them."""
    rows, folder = V.validate(raw_predicates(spark, sf), P.seed(spark), aliases(spark)), scratch(spark, "validated")
    rows.where("outcome != 'rejected'").select("document_id", "seq", "predicate", "resolved", "outcome", "subject_text", "object_text", "raw_text").write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def pending(spark, sf, validated=None):
    rows = (V.validate(raw_predicates(spark, sf), P.seed(spark), aliases(spark)) if validated is None else validated).where("outcome = 'queued'")
    return rows.select("document_id", "seq", "predicate", "raw_text", F.col("subject_text").alias("subject"), F.col("object_text").alias("object"), F.concat(F.lit("run-"), "document_id").alias("ingestion_run_id"))


def state(spark, sf, validated=None, **more):
    return C.State(P.seed(spark), aliases(spark), pending(spark, sf, validated), **more)


@query(f"{PENDING} SELECT seq, CASE upper(predicate) WHEN 'CLICK' THEN 'CLICK' ELSE 'CONTAINS' END AS predicate FROM pending WHERE upper(predicate) IN ('CLICK', 'UNKNOWNVERB')")
def curation_promote(spark, sf):
    return C.curate(state(spark, sf), actions(spark))["promoted"].select("seq", "predicate")


@query(f"{PENDING} SELECT predicate, count(*) AS n FROM pending WHERE upper(predicate) <> 'CLICK' GROUP BY 1")
def curation_pending(spark, sf):
    """What nobody has decided about stays pending."""
    return C.curate(state(spark, sf), actions(spark, ("approve", "click", None)))["pending"].groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


@query(f"{PENDING} SELECT predicate, count(*) AS n, 'pending' AS what FROM pending WHERE upper(predicate) <> 'UNKNOWNVERB' GROUP BY 1 UNION ALL SELECT name, occurrence_count, 'failed' FROM failed WHERE name <> 'UNKNOWNVERB'")
def curation_reject(spark, sf):
    out = C.curate(state(spark, sf, failed=queue(spark, sf)), actions(spark, ("reject", "UnknownVerb", None)))
    left = out["pending"].groupBy("predicate").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("pending"))
    return left.unionByName(out["failed"].select(F.col("name").alias("predicate"), F.col("occurrence_count").alias("n"), F.lit("failed").alias("what")))


@query(f"{PENDING} SELECT seq, 'USES' AS predicate FROM pending WHERE upper(predicate) = 'CLICK'")
def curation_conflict(spark, sf):
    """Two actions for a name: the last holds, and nothing is promoted twice."""
    both = spark.createDataFrame([(1, "approve", "CLICK", None), (2, "map", "click ", "uses"), (3, "map", "CLICK", " ")], "seq int, action string, name string, target string")
    return C.curate(state(spark, sf), both)["promoted"].select("seq", "predicate")


@query(f"WITH {ACTIVE_SQL}, {ALIASES_SQL} SELECT name AS key, predicate_group AS value FROM active UNION ALL SELECT 'CLICK', 'BUSINESS_RULES' UNION ALL SELECT source, target FROM aliases WHERE source <> 'ENCLOSES' UNION ALL SELECT 'UNKNOWNVERB', 'CONTAINS' UNION ALL SELECT 'ENCLOSES', 'HOLDS'")
def curation_taxonomy(spark, sf):
    """An alias that is mapped again replaces the older one."""
    out = C.curate(state(spark, sf), actions(spark, ("approve", "CLICK", None), ("map", "UNKNOWNVERB", "CONTAINS"), ("map", "ENCLOSES", "HOLDS")))
    return out["active"].select(F.col("name").alias("key"), F.col("predicate_group").alias("value")).union(out["aliases"].select("source", "target"))


#: Promoted assertions in SQL: one for each document and semantic checksum, unless it was accepted before.
PROMOTED = f"""{PENDING}, p AS (SELECT document_id, seq, subject_text AS subject, CASE upper(predicate) WHEN 'CLICK' THEN 'CLICK' ELSE 'CONTAINS' END AS predicate, object_text AS object FROM pending JOIN raw USING (document_id, seq, predicate)),
pc AS (SELECT *, sha256(upper(subject) || '|' || predicate || '|' || upper(object)) AS c FROM p),
ok AS (SELECT DISTINCT v.document_id, sha256(upper(subject_text) || '|' || resolved || '|' || upper(object_text)) AS c FROM v JOIN raw USING (document_id, seq, predicate) WHERE outcome IN ('accepted', 'collapsed')),
new AS (SELECT DISTINCT document_id, subject, predicate, object, c FROM pc WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.document_id = pc.document_id AND ok.c = pc.c))"""


def accepted(validated):
    rows = validated.where("outcome in ('accepted', 'collapsed')")
    facts = rows.select("document_id", "seq", F.col("subject_text").alias("subject"), F.col("resolved").alias("predicate"), F.col("object_text").alias("object"), "raw_text", F.concat(F.lit("run-"), "document_id").alias("ingestion_run_id"))
    said = T.assertion_key(*map(F.col, ("document_id", "seq", "subject", "predicate", "object")))[1]  # as the checksum, and shorter
    return G.identify(facts.withColumn("_said", said).dropDuplicates(["document_id", "_said"]).drop("_said"))


@query(f"{PROMOTED} SELECT document_id, (SELECT count(*) FROM ok WHERE ok.document_id = d.document_id) + (SELECT count(*) FROM new WHERE new.document_id = d.document_id) AS total_assertions FROM (SELECT DISTINCT document_id FROM raw) d")
def curation_counts(spark, sf):
    """What is promoted counts for its document."""
    validated = kept(spark, sf)
    known = accepted(validated)
    docs = raw_predicates(spark, sf).select("document_id").distinct().join(known.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_assertions")), "document_id", "left")
    out = C.curate(state(spark, sf, validated, assertions=known, documents=docs), actions(spark))
    return out["documents"].select("document_id", "total_assertions")


@query(f"{PROMOTED}, e AS (SELECT DISTINCT sha256(lower(regexp_replace(subject, '[\\s_-]+', '', 'g'))) AS s, predicate, sha256(lower(regexp_replace(object, '[\\s_-]+', '', 'g'))) AS o FROM new WHERE predicate = 'CLICK') SELECT sha256(s || predicate || o) AS edge_id FROM e".replace("\\\\", "\\"))
def curation_rebuild(spark, sf):
    """The graph after a predicate is approved: the runs of what was promoted are built again."""
    validated = kept(spark, sf)
    known = accepted(validated)
    out = C.curate(state(spark, sf, validated, assertions=known), actions(spark))
    rows = G.identify(out["assertions"])
    graph = C.rebuild(rows, out["runs"], {"nodes": G.nodes(known), "edges": G.edges(known)})
    return graph["edges"].where("predicate = 'CLICK'").select("edge_id")


@query(f"{QUEUE} SELECT name, occurrence_count * 2 AS occurrence_count, last_seen_document, sample_raw_text, 2 AS updated_at FROM failed UNION ALL SELECT 'OLDVERB', 7, 'docX', 'an old sample', 1")
def failed_queue_merge(spark, sf):
    """Two rounds of findings and an older entry."""
    new = cut(queue(spark, sf), 2)  # a row a name, merged twice
    old = spark.createDataFrame([("OLDVERB", 7, "docX", "an old sample", "BUSINESS_RULES", 1)], "name string, occurrence_count long, last_seen_document string, sample_raw_text string, predicate_group string, updated_at int")
    first = P.merge_failed(old, new.withColumn("last_seen_document", F.lit("before")).withColumn("updated_at", F.lit(1)))
    return P.merge_failed(first, new.withColumn("updated_at", F.lit(2))).drop("predicate_group")


@query("SELECT a.n AS a, b.n AS b, CAST(levenshtein(a.n, b.n) AS INT) AS distance FROM (SELECT DISTINCT p_brand AS n FROM part) a, (SELECT DISTINCT event_type AS n FROM events) b")
def edit_distance(spark, sf):
    from ..session import table

    a = table(spark, sf, "part").select(F.col("p_brand").alias("a")).distinct()
    kinds = table(spark, sf, "events").select(F.col("event_type").alias("b")).distinct()
    return a.crossJoin(F.broadcast(kinds)).withColumn("distance", F.levenshtein("a", "b"))
