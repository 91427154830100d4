"""The predicate taxonomy: classification, resolution of variants, and the nearest active name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The groups in order of priority with the stems that a name of the group contains, and the seed taxonomy.
GROUPS = {
    "DATA_LIFECYCLE": "WRITE SAVE STORE PERSIST DELETE REMOVE CREATE ADD UPDATE READ LOAD GET FETCH RETRIEVE RECORD KEEP HOLD CONTAIN INCLUDE INGEST",
    "COMMUNICATION": "SEND RECEIVE PUBLISH CONSUME DELIVER TRANSMIT NOTIFY ALERT MAIL POST CONTACT SIGNAL SUBSCRIBE",
    "EXECUTION_FLOW": "RUN EXECUTE START STOP LAUNCH PROCESS TRIGGER PERFORM DELEGATE ORCHESTRATE COORDINATE CALL INVOKE ROUTE FORWARD",
    "SECURITY_AUDIT": "SECURE ENCRYPT DECRYPT VALIDATE CHECK VERIFY AUTHENTICATE AUTHORIZE LOG MONITOR TRACK AUDIT",
    "DATA_PROCESSING": "PARSE TRANSFORM CONVERT EXTRACT INDEX NORMALISE NORMALIZE MAP FORMAT GENERATE PRODUCE FILTER AGGREGATE SPLIT BUILD DEDUPLICATE CORRELATE ANALYZE DETECT EVALUATE PROPAGATE VISUALIZE RENDER SCRAPE",
    "SYSTEM_INTEGRATION": "INHERIT DEPEND EXTEND IMPLEMENT IMPORT EXPORT LINK ATTACH MOUNT BIND CONNECT INTEGRATE SUPPORT USE PART_OF ASSIGNED_TO BASED_ON",
}
DEFAULT_GROUP = "BUSINESS_RULES"
SEED = """
ACCEPTS ADDS AGGREGATES ALERTS ALLOWS ANALYZES ANSWERS APPLIES ARCHIVES ARCHIVES_TO ASSIGNED_TO ATTACHES AUTHENTICATES
AUTHORIZES BASED_ON BECOMES BUILDS CACHES CALCULATES CALLS CARRIES CHECKS COLLECTS CONFIGURED_BY CONFIGURES CONSISTS_OF
CONSUMED_ALONGSIDE CONSUMES CONTACTS CONTAINS COORDINATES CORRELATES COVERS CREATES DECRYPTS DEDUPLICATES DEFINES DELEGATES
DELETES DELIVERS DEPENDS_ON DETECTS DISTINGUISHES DRIVES ENABLES ENCRYPTS ENRICHES ENSURES ESTABLISHES EVALUATES EXECUTES
EXPOSES EXTENDS EXTRACTS FAILS_OVER FEEDS FETCHES FILTERS FLOW FOLLOWS FORWARDS GENERATES GUARANTEES HANDLES HOLDS IDENTIFIES
IMPLEMENTS INCLUDES INDEXES INGESTS INITIALIZES INSTRUMENTS INTEGRATES INVOKES ISSUES JOINS LOGS MAINTAINED_BY MAINTAINS
MANAGES MANDATES MAPS MATCHES MONITORS NEEDS NEGOTIATES NORMALIZES NOTIFIES OPERATES ORCHESTRATES PARSES PARTITIONS PART_OF
PASSES PERFORMS PERSISTS PROCESSES PRODUCES PROPAGATES PROVIDES PROVISIONS PUBLISHES QUERIES READS REASSIGNS RECALCULATES
RECEIVES RECONSTRUCTS RECORDS REGISTERS RENDERS REPLAYS REPRESENTED_BY REQUIRES RESIDES RESIDES_IN RESPONDS RESPONSIBLE_FOR
RETRIEVES RETURNS ROUTES RUNS SCALES SCHEDULES SCRAPES SENDS SEPARATES SERVES SHARED_ACROSS SHARED_BY SHARED_WITH SHARES
SPECIFIES SPLITS STARTS STOPS STORES SUBMITS SUBSCRIBES SUPPORTS SYNCHRONIZES TRACKS TRANSFORMS TRANSITIONS TRANSITIONS_TO
TRANSMITS TRIGGERS UNDER UPDATES USES VALIDATES VISUALIZES WRITES
""".split()
MAX_DISTANCE = 2


def classify(name: Column) -> Column:
    """The first group with a stem inside the upper-cased name; blank and other names follow the business rules group."""
    upper = F.upper(F.coalesce(name, F.lit("")))
    rule = F.when(F.trim(upper) == "", DEFAULT_GROUP)
    for group, stems in GROUPS.items():
        rule = rule.when(F.regexp_like(upper, F.lit("|".join(stems.split()))), group)
    return rule.otherwise(DEFAULT_GROUP)


def seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in SEED], "name string").withColumn("predicate_group", classify(F.col("name")))


def insert_ignore(table: DataFrame, rows: DataFrame, key: str = "name") -> DataFrame:
    """``table`` and those of ``rows`` whose key it lacks."""
    return table.unionByName(rows.dropDuplicates([key]).join(table, key, "left_anti"), allowMissingColumns=True)


def backfill_groups(active: DataFrame) -> DataFrame:
    return active.withColumn("predicate_group", F.coalesce(F.nullif(F.trim("predicate_group"), F.lit("")), classify(F.col("name"))))


def candidates(name: Column) -> Column:
    """Names that a predicate may stand for, in order of preference: itself, then (without ``_``) forms of its verb."""
    n = F.upper(name)
    length = F.length(n)

    def cut(k: int) -> Column:
        return F.substring(n, F.lit(1), length - k)

    def forms(stem: Column, *ends: str) -> list[Column]:
        return [F.concat(stem, F.lit(e)) for e in ends]

    none = F.array().cast("array<string>")
    plural = F.when(n.endswith("S") & ~n.endswith("SS"), F.array(cut(1))).otherwise(F.array(*forms(n, "S")))
    past = F.when(n.endswith("ED") & (length > 3), F.array(*forms(cut(2), "", "S", "ES"))).otherwise(none)
    stem = cut(3)
    doubled = (F.length(stem) > 1) & (F.substring(stem, -1, 1) == F.substring(stem, F.length(stem) - 1, F.lit(1)))
    single = F.substring(stem, F.lit(1), F.length(stem) - 1)
    running = F.when(n.endswith("ING") & (length > 4), F.concat(F.array(*forms(stem, "", "S", "ES")), F.when(doubled, F.array(*forms(single, "", "S"))).otherwise(none))).otherwise(none)
    es = F.when(n.endswith("ES") & ~n.endswith("SS") & (length > 3), F.array(cut(2))).otherwise(none)
    return F.when(n.contains("_"), F.array(n)).otherwise(F.concat(F.array(n), plural, past, running, es))


def resolve(names: DataFrame, active: DataFrame, aliases: DataFrame, name: str = "predicate") -> DataFrame:
    """``resolved`` for each row of ``names``: exact name, alias, then variants; null if none is active.

    Distinct names are resolved once and joined back, so the taxonomy meets a few thousand names, not every assertion. The
    taxonomy and the aliases are curated by hand; they go through ordinary joins, which broadcast them while they are small.
    A source has one alias; curation keeps it so.
    """
    distinct = names.select(F.col(name).alias("_raw")).where(F.col(name).isNotNull()).distinct()
    tried = distinct.select("_raw", F.posexplode(candidates(F.col("_raw"))).alias("_pos", "_try"))
    hits = tried.join(active.select(F.col("name").alias("_try")).distinct(), "_try").groupBy("_raw").agg(F.min_by("_try", "_pos").alias("_hit"), F.min("_pos").alias("_at"))
    alias = aliases.groupBy(F.upper("source").alias("_source")).agg(F.min("target").alias("_target"))
    found = distinct.join(hits, "_raw", "left").join(alias, F.upper("_raw") == F.col("_source"), "left")
    found = found.select("_raw", F.when(F.col("_at") == 0, F.col("_hit")).otherwise(F.coalesce("_target", "_hit")).alias("resolved"))
    return names.join(found, names[name] == found["_raw"], "left").drop("_raw")


def shortened(name: Column, deletions: int) -> Column:
    """A name and all that is left of it when up to so many characters are deleted."""
    def less(n: Column) -> Column:
        return F.when(F.length(n) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(n), F.lit(1))), lambda k: F.concat(F.substring(n, F.lit(1), k - 1), F.substring(n, k + 1, F.length(n))))).otherwise(F.array().cast("array<string>"))

    out = level = F.array(name)
    for _ in range(deletions):
        level = F.array_distinct(F.flatten(F.transform(level, less)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def near_pairs(names: DataFrame, active: DataFrame, name: str = "predicate", distance: int = MAX_DISTANCE) -> DataFrame:
    """Distinct pairs of ``name`` and ``_active`` that share a shortened form: every pair within ``distance`` edits, and few others.

    Of two names within d edits, some d deletions of each leave the same; so near names meet by equality, whatever their number.
    """
    left = names.select(F.upper(name).alias(name)).where(F.col(name).isNotNull()).distinct()
    left = left.select(name, F.explode(shortened(F.col(name), distance)).alias("_form"))
    right = active.select(F.col("name").alias("_active")).distinct().select("_active", F.explode(shortened(F.col("_active"), distance)).alias("_form"))
    return left.join(right, "_form").select(name, "_active").distinct()


def nearest(names: DataFrame, active: DataFrame, name: str = "predicate", distance: int = MAX_DISTANCE) -> DataFrame:
    """``nearest`` and ``distance`` for distinct ``names``: the active name within ``distance`` edits; ties by distance, length, name."""
    near = near_pairs(names, active, name, distance).withColumn("distance", F.levenshtein(name, "_active", distance)).where("distance >= 0")
    return near.groupBy(name).agg(F.min(F.struct("distance", F.length("_active").alias("length"), F.col("_active").alias("nearest"))).alias("b")).select(name, "b.nearest", "b.distance")


def failed_queue(rejected: DataFrame) -> DataFrame:
    """The review queue of ``rejected`` (predicate, document_id, raw_text, seq): count, last document and sample, group."""
    return rejected.groupBy(F.upper("predicate").alias("name")).agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.max_by("document_id", "seq").alias("last_seen_document"), F.max_by("raw_text", "seq").alias("sample_raw_text")
    ).withColumn("predicate_group", classify(F.col("name")))


def ordered_failed(queue: DataFrame) -> DataFrame:
    """The review queue as it is shown: most occurrences first, then by name."""
    return queue.orderBy(F.desc("occurrence_count"), "name")


def merge_failed(queue: DataFrame, more: DataFrame, at: str = "updated_at") -> DataFrame:
    """A review queue and later findings in one: counts add up, the last document and sample are those of the latest ``at``."""
    both = queue.unionByName(more)
    latest = F.max_by(F.struct("last_seen_document", "sample_raw_text", "predicate_group"), at)
    out = both.groupBy("name").agg(F.sum("occurrence_count").alias("occurrence_count"), latest.alias("last"), F.max(at).alias(at))
    return out.select("name", "occurrence_count", "last.last_seen_document", "last.sample_raw_text", "last.predicate_group", at)


def suggestions(failed: DataFrame, active: DataFrame) -> DataFrame:
    """For each failed predicate the first active one of its group, or an empty string."""
    first = active.groupBy("predicate_group").agg(F.min("name").alias("suggestion"))
    return failed.join(first, "predicate_group", "left").select("name", "predicate_group", F.coalesce("suggestion", F.lit("")).alias("suggestion"))


def grouped(active: DataFrame, priority: str = DEFAULT_GROUP) -> DataFrame:
    """Groups with their names, the priority group first, then by name of the group."""
    out = active.groupBy("predicate_group").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("priority", F.when(F.col("predicate_group") == priority, 0).otherwise(1)).orderBy("priority", "predicate_group")


def classify_sql(column: str) -> str:
    """``classify`` as SQL, from the same table."""
    cases = [f"WHEN regexp_matches(upper({column}), '{'|'.join(stems.split())}') THEN '{group}'" for group, stems in GROUPS.items()]
    return f"CASE WHEN trim(coalesce({column}, '')) = '' THEN '{DEFAULT_GROUP}' {' '.join(cases)} ELSE '{DEFAULT_GROUP}' END"


def seed_sql() -> str:
    return reduce(lambda a, b: f"{a}, {b}", (f"('{n}')" for n in SEED))
