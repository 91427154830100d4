"""Exact deduplication with a log-structured merge index of digests. DataFrame functions only.

Flush: every input partition is a memtable; its digests are sorted and written, Parquet files with minima and maxima of the digest
column. Memtables go into the index in ``BATCHES`` batches, each of which is probed against the runs before it and then becomes a
run itself; a query over a whole table and one batch after another are the same code. Compaction merges runs into one of the next level: a row per digest with the smallest and largest
identifier and the number of rows, combined before the shuffle, so that a text that a third of all rows share is one row per
task. Each run of the index has a filter, a bitmap of the digests; batches are probed run by run, and only what passes a
filter is joined with its run. Digests that a batch has twice, or that an earlier run has, are hits; a bitmap of fixed size lets only their texts through,
and these are grouped by digest *and text*, which compares the bytes. Digests that two different texts share are told apart by
a join on the text itself.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, forget, fresh, names_in, read_text, remove, text_or_empty, workspace, write_text, written

#: Bits of the filter of hit digests: 8 MB to broadcast, whatever the input. More hits only let more texts through.
FILTER_BITS = 1 << 26
#: Runs of a level that are merged into one of the next, and bits of a run's filter for each of its digests.
FAN_IN, RUN_BITS = 4, 16
#: Batches in which a table's memtables go into the index.
BATCHES = 4
_BITS_PER_ROW = 32768  # of bitmap_construct_agg


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``sha`` (32 bytes) of every row; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("sha"))


def flush(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the memtables of ``docs``, sorted, and return them: ``id``, ``sha``, ``batch``."""
    spark, runs = docs.sparkSession, digests(docs, id_col, text_col)
    path = path or workspace(spark, "runs")
    dealt = runs.withColumn("batch", F.pmod(F.spark_partition_id(), F.lit(BATCHES)))
    dealt.sortWithinPartitions("batch", "sha", "id").write.mode("append").partitionBy("batch").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def compact(runs: DataFrame) -> DataFrame:
    """One row per digest: ``digest``, ``low`` and ``high`` identifier, ``size``; of runs that are flushed or compacted."""
    if "id" in runs.columns:
        runs = runs.select("digest", F.col("id").alias("low"), F.col("id").alias("high"), F.lit(1).cast("long").alias("size"))
    return runs.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("size").alias("size"))


def _bit_of(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def _placed(df: DataFrame, key: str, bits: int) -> DataFrame:
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    return df.withColumn("_place", place).withColumn("_bucket", F.expr("bitmap_bucket_number(_place)"))


def key_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A bitmap of ``bits`` bits, in rows of equal size: one bit for each key."""
    return _placed(keys.select(key), key, bits).groupBy("_bucket").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_place))").alias("_map"))


def passing(rows: DataFrame, bitmap: DataFrame, key: str, bits: int) -> DataFrame:
    """The rows whose key may be in a filter; sure to hold all that are. The filter is broadcast: its size is fixed."""
    tested = _placed(rows, key, bits).join(F.broadcast(bitmap), "_bucket")
    return tested.where(_bit_of(F.col("_map"), F.expr("bitmap_bit_position(_place)"))).drop("_place", "_bucket", "_map")


def _through_filter(rows: DataFrame, keys: DataFrame, key: str, bits: int) -> DataFrame:
    return passing(rows, key_filter(keys, key, bits), key, bits)


class DigestIndex:
    """A log-structured merge index of the digests of all batches so far, in a folder that driver and executors share.

    ``add`` makes a batch a run of level 1; ``FAN_IN`` runs of a level become one of the next, so a digest is rewritten once a
    level. ``seen`` probes a batch before it is added. A manifest lists the runs: a new one is written under the next number,
    which only one writer gets; readers take the last. Runs that are merged away go one manifest later, so that who reads the
    one before can end.
    """

    def __init__(self, spark: SparkSession, folder: str, fan_in: int = FAN_IN):
        self.spark, self.folder, self.fan_in = spark, folder.rstrip("/"), fan_in
        self.number = max([int(n[9:-5]) for n in names_in(spark, self.folder) if n.startswith("manifest-") and n.endswith(".json")], default=0)
        listed = json.loads(read_text(spark, self._manifest())) if self.number else {"runs": [], "merged": []}
        self.runs: list[dict] = listed["runs"]
        self.merged: list[dict] = listed["merged"]

    def _manifest(self) -> str:
        return f"{self.folder}/manifest-{self.number:09d}.json"

    def _read(self, run: dict) -> DataFrame:
        return self.spark.read.schema("digest binary, low long, high long, size long").parquet(f"{self.folder}/{run['name']}/rows")

    def _run(self, rows: DataFrame, level: int) -> dict:
        name = f"run-{workspace(self.spark, 'x').rsplit('-', 1)[1]}"
        path = f"{self.folder}/{name}"
        rows.sortWithinPartitions("digest").write.parquet(f"{path}/rows")
        run = {"name": name, "level": level, "digests": self.spark.read.parquet(f"{path}/rows").count()}
        run["bits"] = min(FILTER_BITS, max(1 << 20, 1 << (run["digests"] * RUN_BITS).bit_length()))
        key_filter(self._read(run), "digest", run["bits"]).write.parquet(f"{path}/filter")
        return run

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Flush a batch and merge the levels that are full."""
        path = workspace(self.spark, "runs")
        self.add_run(compact(flush(docs, id_col, text_col, path).withColumnRenamed("sha", "digest")))
        remove(self.spark, path)

    def add_run(self, rows: DataFrame) -> None:
        """Make compacted digests a run and merge the levels that are full."""
        runs, gone = [*self.runs, self._run(rows, 1)], []
        level = 1
        while len(full := [r for r in runs if r["level"] == level]) >= self.fan_in:
            rows = self._read(full[0])
            for run in full[1:]:
                rows = rows.unionByName(self._read(run))
            runs = [*(r for r in runs if r["level"] != level), self._run(compact(rows), level + 1)]
            gone += full
            level += 1
        self.number += 1
        write_text(self.spark, self._manifest(), json.dumps({"runs": runs, "merged": gone}))
        for run in self.merged:
            remove(self.spark, f"{self.folder}/{run['name']}")
        self.runs, self.merged = runs, gone

    def probe(self, rows: DataFrame) -> DataFrame:
        """``digest``, ``low``, ``high``, ``size`` of the digests among ``rows`` (``digest``) that the index has."""
        asked, found = rows.select("digest").distinct(), None
        for run in self.runs:
            bitmap = self.spark.read.parquet(f"{self.folder}/{run['name']}/filter")
            hit = self._read(run).join(passing(asked, bitmap, "digest", run["bits"]), "digest", "left_semi")
            found = hit if found is None else found.unionByName(hit)
        return self.spark.createDataFrame([], "digest binary, low long, high long, size long") if found is None else compact(found)

    def seen(self, docs: DataFrame, earlier: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
        """``id_col``, ``first_id`` of the rows of a batch whose very text one of ``earlier`` has, the rows that the index was made of.

        ``first_id`` is the smallest identifier that has it. Hits are verified by their bytes.
        """
        batch = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
        hits = written(self.probe(batch).select("digest"), "hits")
        old = earlier.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
        old = _through_filter(old, hits, "digest", filter_bits).groupBy("digest", "text").agg(F.min("id").alias("first_id"))
        return _through_filter(batch, hits, "digest", filter_bits).join(old, ["digest", "text"]).select(F.col("id").alias(id_col), "first_id")


def repeated(runs: DataFrame) -> DataFrame:
    """``digest`` of the flushed rows (``digest``, ``id``, ``batch``) that share it with another one, written.

    Batch by batch through an index of their own: what a batch has twice, and what passes the filters of earlier runs and is in
    them.
    """
    spark = runs.sparkSession
    index, found = DigestIndex(spark, workspace(spark, "index")), None
    for k in range(BATCHES):
        own = written(compact(runs.where(F.col("batch") == k).drop("batch")), "batch")
        hits = own.where("size > 1").select("digest")
        if index.runs:
            hits = hits.unionByName(index.probe(own).select("digest"))
        hits = written(hits, "batch-hits")
        found = hits if found is None else found.unionByName(hits)
        if k + 1 < BATCHES:
            index.add_run(own)
        forget(own)
    out = written(found.distinct(), "hits")
    remove(spark, index.folder)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest_bytes: int = 32, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the largest (or, with
    ``keep="smallest"``, smallest) identifier stays. Repeated rows (same identifier and text) are separate rows, all
    counted in ``group_size``; one of them stays. A null identifier is only kept where its group has no other. Texts of any
    length are compared whole. An empty table gives no rows; other columns are ignored. ``digest_bytes`` under 32 is for tests
    of digest collisions.
    """
    top = {"largest": "high", "smallest": "low"}[keep]
    runs = flush(docs, id_col, text_col).withColumn("digest", F.substring("sha", 1, digest_bytes))
    hits = repeated(runs)
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, digest_bytes))
    verified = _through_filter(source, hits, "digest", filter_bits).groupBy("digest", "text").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("size"))
    # The text itself is only needed where a digest has several; its length would do as well as a name for it elsewhere.
    classes = verified.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("size").alias("size"))
    classes = written(classes.where("size > 1"), "classes")
    forget(hits)

    narrow = runs.groupBy("id", "sha", "digest").agg(F.count(F.lit(1)).alias("copies"))
    total = runs.count()
    plain = attach(narrow, classes.select("digest", "texts", F.col(top).alias("keep_id"), "size"), "digest", "size", total)
    out = plain.where("texts is null or texts = 1")
    collided = classes.where("texts > 1").select("digest")
    if not collided.isEmpty():
        same = _through_filter(source, collided, "digest", filter_bits).join(collided, "digest", "left_semi").withColumn("sha", F.unhex(F.sha2("text", 256)))
        groups = same.groupBy("digest", "text").agg(F.max("id").alias("high"), F.min("id").alias("low"), F.count(F.lit(1)).alias("size"))
        rows = same.groupBy("id", "digest", "text", "sha").agg(F.count(F.lit(1)).alias("copies"))
        again = rows.join(groups.select("digest", "text", F.col(top).alias("keep_id"), "size"), ["digest", "text"])
        out = out.select("id", "sha", "copies", "keep_id", "size").unionByName(again.select("id", "sha", "copies", "keep_id", "size"))
    single = F.col("size").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(single, F.col("copies")).otherwise(F.col("size")).cast("long").alias("group_size"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).select(id_col, "keep_id", "group_size", (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; of repeated rows one."""
    decided = written(deduplicate(docs, id_col, text_col, **options), "exact")
    counts = decided.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"), F.count_if("kept").alias("_kept"))
    counts = written(counts.where("_n > 1 or _kept = 0"), "exact-dropped")
    once = docs.join(counts, docs[id_col].eqNullSafe(counts[id_col]), "left_anti")
    repeated = counts.where("_n > 1")
    if repeated.isEmpty():
        return once
    # Rows that share an identifier: keep by text.
    kept = decided.where("kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"))
    again = docs.join(repeated, docs[id_col].eqNullSafe(repeated[id_col]), "left_semi")
    again = again.join(kept, again[id_col].eqNullSafe(kept["_id"]) & (F.sha2(text_or_empty(text_col), 256) == kept["_sha"]), "left_semi")
    sha = fresh(docs, "sha")
    return once.unionByName(again.withColumn(sha, F.sha2(text_or_empty(text_col), 256)).dropDuplicates([id_col, sha]).drop(sha))
