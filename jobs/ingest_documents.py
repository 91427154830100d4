"""Incremental ingestion of a growing table of documents: what is new becomes versions, chunks, facts and changes of the graph.

    python jobs/ingest_documents.py --config jobs/ingest_documents.json --documents PATH --out PATH --checkpoint PATH

The table (``doc_id``, ``text``, ``lang``, ``source``) is read as a file stream: a run takes the files that no run before it took,
in micro-batches, and ends. The stream's checkpoint is all that remembers them. A batch writes these tables, and each of its
writes replaces the folder ``batch=N`` of that table alone, so a batch that is run again after a failure leaves what it would
have left at once, and looks at earlier batches only:

* ``documents`` (by ``lang``): a version for each document whose content changed; an unchanged one is skipped;
* ``chunks``: the chunks of these versions; ``firsts``: of checksums that no chunk had before the first chunk that has them;
* ``records``: what the extractor found in these first chunks, as far as it is valid; no others are extracted;
* ``facts``: what the new versions state and no longer state, as signed rows;
* ``edges`` (by ``predicate``) and ``nodes``: the rows of the graph that these change, the last batch's row counts.

Rows without ``doc_id`` are left out and counted; of rows of one batch that share it the one with the greatest text counts. A
document's facts are those of its last version. Chunks that are unchanged keep their records, whichever document had them first.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from dataclasses import asdict, dataclass, field
from pathlib import Path

if __package__ in (None, ""):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from factgraph.functions import text as T  # noqa: E402
from factgraph.operators import deltas, markdown, validate  # noqa: E402
from factgraph.operators import graph as G  # noqa: E402
from factgraph.session import get_session, prepare  # noqa: E402
from factgraph.sources import extractors  # noqa: E402
from factgraph.sources.files import table_stream  # noqa: E402
from factgraph.streaming.jobs import run_available  # noqa: E402

LOG = logging.getLogger("ingest_documents")

_WRITER, _SIGNED = "struct<document_id: string, seq: bigint", "sign int, subject string, predicate string, object string, raw_text string, seq bigint, subject_node_id string, object_node_id string, edge_id string"
#: The tables of the output. ``batch`` is a partition of each.
SCHEMAS = {
    "documents": "document_id string, source string, checksum string, version int, batch int, lang string",
    "chunks": "document_id string, sequence_number int, section_path string, content string, chunk_checksum string, token_estimate int, batch int",
    "firsts": "chunk_checksum string, document_id string, sequence_number int, batch int",
    "records": "chunk_checksum string, subject string, predicate string, object string, raw_text string, batch int",
    "facts": f"document_id string, semantic_checksum string, {_SIGNED}, batch int",
    "edges": f"edge_id string, support bigint, writer {_WRITER}>, value struct<from_node_id: string, predicate: string, to_node_id: string>, batch int, predicate string",
    "nodes": f"node_id string, support bigint, writer {_WRITER}, side: int>, value struct<canonical_name: string>, batch int",
}
_PARTITIONS = {"documents": ["batch", "lang"], "edges": ["batch", "predicate"]}


@dataclass
class Config:
    """``verbs`` of the sentences that state facts, ``aliases`` of predicates, files a micro-batch, and how long a file counts as new."""

    verbs: list[str] = field(default_factory=lambda: ["is", "are", "was", "ist", "est"])
    aliases: dict[str, str] = field(default_factory=dict)
    files_per_batch: int = 1000
    max_file_age: str = "3650d"


def _read(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{out}/{name}")


def _before(spark: SparkSession, out: str, name: str, batch: int) -> DataFrame:
    """What batches before this one left in a table."""
    return spark.createDataFrame([], SCHEMAS[name]) if batch == 0 else _read(spark, out, name).where(F.col("batch") < batch)


def _put(rows: DataFrame, out: str, name: str, batch: int) -> DataFrame:
    """The batch's part of a table, in place of what an earlier attempt at this batch left of it; read back."""
    spark = rows.sparkSession
    columns = [c for c in spark.createDataFrame([], SCHEMAS[name]).columns if c != "batch"]
    part, by = f"{out}/{name}/batch={batch}", [c for c in _PARTITIONS.get(name, []) if c != "batch"]
    writer = rows.select(*columns).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(part)
    done = _read(spark, out, name).where(F.col("batch") == batch)
    LOG.info("batch %d wrote %d rows to %s", batch, done.count(), part)
    return done


def _last(rows: DataFrame, key: str) -> DataFrame:
    """Each key's row of the last batch."""
    rest = F.struct(*(c for c in rows.columns if c not in (key, "batch")))
    return rows.groupBy(key).agg(F.max_by(rest, "batch").alias("r")).select(key, "r.*")


def _batch(new: DataFrame, batch: int, out: str, config: Config) -> None:
    spark = new.sparkSession
    seen = new.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nameless")).first()
    LOG.info("batch %d read %d rows, of which %d have no identifier", batch, seen["rows"], seen["nameless"])

    def put(rows: DataFrame, name: str) -> DataFrame:
        return _put(rows, out, name, batch)

    def before(name: str) -> DataFrame:
        return _before(spark, out, name, batch)

    row = F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))).alias("d")
    docs = new.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("document_id")).agg(row).select("document_id", "d.*").withColumn("checksum", T.sha256(F.col("text")))
    known = _last(before("documents").select("document_id", F.col("checksum").alias("old"), F.col("version").alias("last"), "batch"), "document_id")
    changed = docs.join(known, "document_id", "left").where(~F.col("checksum").eqNullSafe(F.col("old"))).withColumn("version", (F.coalesce("last", F.lit(0)) + 1).cast("int"))
    put(changed, "documents")

    own = put(markdown.chunk(changed.select("document_id", "text")), "chunks")
    # Identifiers and checksums alone are compared with earlier chunks.
    first = own.groupBy("chunk_checksum").agg(F.min(F.struct("document_id", "sequence_number")).alias("f"))
    firsts = put(first.join(before("firsts").select("chunk_checksum"), "chunk_checksum", "left_anti").select("chunk_checksum", "f.*"), "firsts")

    active = spark.createDataFrame([(v.upper(),) for v in config.verbs], "name string")
    aliases = spark.createDataFrame(list(config.aliases.items()), "source string, target string")
    found = extractors.rules(own.join(firsts, ["document_id", "sequence_number"], "left_semi").select("chunk_checksum", "content"), config.verbs)
    valid = validate.validate(found, active, aliases, chunk="content").where(F.col("outcome").isin("accepted", "collapsed"))
    put(valid.select("chunk_checksum", F.col("subject_text").alias("subject"), F.col("resolved").alias("predicate"), F.col("object_text").alias("object"), "raw_text"), "records")

    stated = own.select("document_id", "chunk_checksum", F.col("sequence_number").cast("long").alias("seq")).join(_read(spark, out, "records").where(F.col("batch") <= batch).drop("batch"), "chunk_checksum")
    rows = G.identify(stated)
    keep = F.min(F.struct("seq", "subject", "predicate", "object", "raw_text", "subject_node_id", "object_node_id", "edge_id")).alias("r")
    after = rows.groupBy(*deltas.KEY).agg(keep).select(*deltas.KEY, "r.*")
    touched = _read(spark, out, "documents").where(F.col("batch") == batch).select("document_id")
    prior = deltas.net(before("facts").join(touched, "document_id", "left_semi"), order="batch")
    signed = put(deltas.changes(prior, after), "facts")

    state = {n: _last(before(n).select(k, "support", "writer", "value", "batch"), k).where("support > 0") for n, k in (("edges", "edge_id"), ("nodes", "node_id"))}
    left = deltas.net(_read(spark, out, "facts").where(F.col("batch") <= batch), order="batch")
    moved = deltas.advance(state, signed, left)
    put(moved["edges"].withColumn("predicate", F.col("value.predicate")), "edges")
    put(moved["nodes"], "nodes")


def ingest(spark: SparkSession, documents: str, out: str, checkpoint: str, config: Config | None = None) -> int:
    """Take what is new in ``documents`` and end; the number of micro-batches. Running again with nothing new changes nothing."""
    config = config or Config()
    done = []

    def work(new: DataFrame, batch: int) -> None:
        _batch(new, batch, out, config)
        done.append(batch)

    LOG.info("reading %s as far as %s has not; writing %s", documents, checkpoint, out)
    stream = table_stream(prepare(spark), documents, maxFilesPerTrigger=str(config.files_per_batch), maxFileAge=config.max_file_age)
    run_available(stream, work, checkpoint).awaitTermination()
    LOG.info("%d batches", len(done))
    return len(done)


def tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The output as it stands: the last version of each document with its chunks and facts, and the graph."""
    docs = _last(_read(spark, out, "documents"), "document_id")
    version = _read(spark, out, "documents").groupBy("document_id").agg(F.max("batch").alias("batch"))
    firsts = _read(spark, out, "firsts").select("document_id", "sequence_number", "batch", F.lit(True).alias("fresh"))
    chunks = _read(spark, out, "chunks").join(version, ["document_id", "batch"], "left_semi").join(firsts, ["document_id", "sequence_number", "batch"], "left").drop("batch")
    state = {n: _last(_read(spark, out, n).select(k, "support", "writer", "value", "batch"), k).where("support > 0") for n, k in (("edges", "edge_id"), ("nodes", "node_id"))}
    return {
        "documents": docs,
        "chunks": chunks.withColumn("fresh", F.coalesce("fresh", F.lit(False))),
        "facts": deltas.net(_read(spark, out, "facts"), order="batch"),
        "edges": deltas.edges(state),
        "nodes": deltas.nodes(state),
    }


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="JSON: " + ", ".join(asdict(Config())))
    parser.add_argument("--master")
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = Config(**json.loads(Path(given.config).read_text())) if given.config else Config()
    spark = get_session("ingest_documents", given.master)
    try:
        ingest(spark, given.documents, given.out, given.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
