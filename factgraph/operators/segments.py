"""A search index that grows: each addition is a segment of its own, and top-k questions read the blocks that can matter.

A segment is a partition of the index's tables, written once by Spark's writer; its row in ``stats`` is written last, and what has
no such row is not read. Deleting documents is a segment that names them and takes their part of the statistics away: rows of
segments up to it are hidden. ``merge`` makes one segment of several; the row of the new one names those that it replaces. So
documents, lengths and frequencies are at any time those of an index built afresh from what is there.

Within a segment rows lie in buckets by the hash of their key, sorted by it; each task writes its part of every bucket, so that
nothing is shuffled for that. Hot keys (a node with ``HOT`` ends or more, a term that is in more texts than there are classes) are
apart from the others and dealt over all buckets.

Postings lie in blocks: a term's assertions in one of ``slots`` classes of their identifiers' hash, the same classes for all
terms, with the block's largest count and least length, from which no score in it can be larger than can be told. A hot term's
blocks are gathered by a shuffle; of another term, which has less than one assertion a class, each posting is a block.

As in ``index``, tables hold what assertions say, and identifiers are made of the rows that are read.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..session import SMALL_TASKS, hadoop, settings
from . import graph as G
from .index import _FACT, MAP_BITS, PRUNED_FRONTIER, _among, _assertion_id, _count_of, _end, bucket_of, postings_of

#: Rows of a segment for each bucket up to ``BUCKETS`` of them, beyond which they grow with the root of its rows; postings of a term
#: in a block on average where all texts have it; ends from which a node is hot, and classes of nodes by which ends are counted.
PER_BUCKET, BUCKETS, PER_BLOCK, HOT, CLASSES = 125_000, 16, 128, 250_000, 1 << 16
#: So much above what is needed a bound must be for its rows to be passed over; scores are ordered by nine digits.
SLACK = 1e-6
#: Identifiers whose classes a question names in its filter; more are joined.
NAMED_SLOTS = 2_000

_PLACE = "hot boolean, bucket int, segment int"
_SAID = "document_id string, seq bigint, subject string, predicate string, object string"
SCHEMAS = {
    "assertions": f"{_SAID}, raw_text string, {_PLACE}",
    "postings": f"term string, slot int, n bigint, max_tf int, min_dl int, postings array<struct<document_id: string, seq: bigint, subject: string, predicate: string, object: string, tf: int, dl: int>>, {_PLACE}",
    "terms": f"term string, df bigint, max_tf int, min_dl int, {_PLACE}",
    "ends": f"{_SAID}, side int, {_PLACE}",
    "deleted": "document_id string, segment int",
    "stats": "n bigint, length bigint, buckets int, slots int, replaces array<int>, segment int",
}


def _at() -> Column:
    """The name at the end that a row of ``ends`` stands for."""
    return F.when(F.col("side") == 0, F.col("subject")).otherwise(F.col("object"))


def _key(name: str) -> Column:
    """The key of a table's rows, made of what is written."""
    return _assertion_id() if name == "assertions" else T.node_id(_at()) if name == "ends" else F.col("term")


def _columns(name: str) -> list[str]:
    """A table's own columns."""
    return [c for c in StructType.fromDDL(SCHEMAS[name]).names if c not in ("hot", "bucket", "segment")]


def slot_of(assertion: Column | str, slots: int) -> Column:
    return F.pmod(F.xxhash64(assertion, F.lit(7)), F.lit(slots)).cast("int")


@dataclass
class SegmentIndex:
    """The index in a folder as it is now; ``open`` and what changes it return one.

    ``segments``: numbers of those that count, with their buckets and slots; ``counts``: the assertions that each adds, less than
    0 for deletions. ``n`` assertions with ``length`` words in all.
    """

    spark: SparkSession
    folder: str
    segments: dict[int, tuple[int, int]] = field(default_factory=dict)
    n: int = 0
    length: int = 0
    last: int = -1
    tombstones: bool = False
    counts: dict[int, int] = field(default_factory=dict)

    # Reading ---------------------------------------------------------------------------------------------------------
    @property
    def mean_length(self) -> float:
        return self.length / self.n if self.n and self.length else 1.0

    def _table(self, name: str) -> DataFrame:
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")
        return rows.where(F.col("segment").isin(list(self.segments)))

    def _live(self, rows: DataFrame) -> DataFrame:
        """``rows`` (document_id, segment) that no later segment hides."""
        if self.tombstones:
            gone = self.spark.read.schema(SCHEMAS["deleted"]).parquet(f"{self.folder}/deleted")
            gone = gone.where(F.col("segment").isin(list(self.segments))).groupBy("document_id").agg(F.max("segment").alias("until"))
            rows = rows.join(gone, (rows["document_id"] == gone["document_id"]) & (rows["segment"] <= gone["until"]), "left_anti")
        return rows.drop("hot", "bucket", "segment")

    def _in_buckets(self, names: list[str]) -> Column:
        """Whether a row's bucket is one that a key may be in, for all segments."""
        by_size: dict[int, list[int]] = {}
        for segment, (buckets, _) in self.segments.items():
            by_size.setdefault(buckets, []).append(segment)
        found = F.col("hot")
        keys = self.spark.createDataFrame([(k,) for k in names], "k string")
        row = keys.agg(*(F.collect_set(bucket_of("k", b)).alias(str(b)) for b in by_size)).first()
        for buckets, segments in by_size.items():
            found = found | (F.col("segment").isin(segments) & F.col("bucket").isin(row[str(buckets)]))
        return found

    def _of(self, name: str, wanted: DataFrame | list[str], column: str) -> DataFrame:
        """Rows of a table by key, from the buckets that may have it and from what is apart."""
        key, rows = _key(name), self._table(name)
        if isinstance(wanted, list):
            return rows.where(self._in_buckets(wanted) & key.isin(wanted)) if wanted else rows.limit(0)
        few = [r[0] for r in wanted.select(column).distinct().limit(PRUNED_FRONTIER + 1).collect()]  # a bounded frontier
        if len(few) <= PRUNED_FRONTIER:
            rows = rows.where(self._in_buckets(few)) if few else rows.limit(0)
        keys, rows = wanted.select(F.col(column).alias("_key")).distinct(), rows.withColumn("_key", key)
        if len(few) <= PRUNED_FRONTIER:
            return rows.join(F.broadcast(keys), "_key", "left_semi").drop("_key")
        n = keys.count()
        if n > MAP_BITS // 4:
            return rows.join(keys, "_key", "left_semi").drop("_key")
        # Only what may be at a key is shuffled; keys are distinct, and a semi-join would be pushed below the bitmap.
        return _among(rows, keys, "_key", n).join(keys, "_key").drop("_key")

    def assertions(self, wanted: DataFrame | list[str] | None = None) -> DataFrame:
        return G.identify(self._live(self._table("assertions") if wanted is None else self._of("assertions", wanted, "assertion_id")))

    def ends(self, nodes: DataFrame) -> DataFrame:
        rows = G.identify(self._live(self._of("ends", nodes, "node_id")))
        once = (F.col("side") == 0) | (F.col("subject_node_id") != F.col("object_node_id"))
        return rows.where(once).select(_end("side").alias("node_id"), "assertion_id", "document_id")

    def links(self, nodes: DataFrame) -> DataFrame:
        rows = G.identify(self._live(self._of("ends", nodes, "node_id")))
        return rows.select(_end("side").alias("a"), _end(1 - F.col("side")).alias("b"), "edge_id", (F.col("side") == 0).alias("forward"), "document_id").distinct()

    def _opened(self, blocks: DataFrame) -> DataFrame:
        rows = self._live(blocks.select("term", "segment", F.explode("postings").alias("p")).select("term", "segment", "p.*"))
        return rows.select("term", _assertion_id().alias("assertion_id"), "document_id", "tf", "dl")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        return self._opened(self._table("postings") if terms is None else self._of("postings", terms, "term"))

    def topk(self, terms: list[str], k: int, score) -> DataFrame:
        """``assertion_id``, ``bm25_score`` of the ``k`` best assertions for distinct terms, as all postings would give them.

        ``score(df, tf, dl)`` is a term's part of the score; it grows with ``tf`` and falls with ``dl``. Rare terms are read first,
        until the bounds of all others together are below the k-th score seen: what has none of the terms read cannot be among
        the best, so of the others only the blocks in which candidates can be are read.
        """
        stats = self._of("terms", terms, "term").groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("tf"), F.min("min_dl").alias("dl")).where("df > 0")
        known = stats.withColumn("bound", score(F.col("df"), F.col("tf"), F.col("dl"))).orderBy("df", "term").collect()  # a row a term of the question
        parts, held, read, least = None, None, 0, 0.0
        while read < len(known) and sum(r["bound"] for r in known[read:]) + SLACK >= least:
            r = known[read]
            read += 1
            own = self.postings([r["term"]]).select("assertion_id", score(F.lit(r["df"]), F.col("tf"), F.col("dl")).alias("part"))
            parts = own if parts is None else parts.unionByName(own)
            if read < len(known):
                held = parts.groupBy("assertion_id").agg(F.sum("part").alias("part"))
                row = held.orderBy(F.desc("part")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("least")).first()
                least = row["least"] if row["n"] == k else 0.0
        if parts is None:
            return self._table("assertions").select(_assertion_id().alias("assertion_id"), F.lit(0.0).alias("bm25_score")).limit(0)
        rest = known[read:]
        if rest:
            may = held.where(F.col("part") + F.lit(sum(r["bound"] for r in rest) + SLACK) >= least).select("assertion_id")
            blocks = self._blocks([r["term"] for r in rest], may)
            df = functools.reduce(lambda c, r: F.when(F.col("term") == r["term"], r["df"]).otherwise(c), rest, F.lit(None).cast("long"))
            more = self._opened(blocks).join(may, "assertion_id", "left_semi").select("assertion_id", score(df, F.col("tf"), F.col("dl")).alias("part"))
            parts = parts.join(may, "assertion_id", "left_semi").unionByName(more)
        scores = parts.groupBy("assertion_id").agg(F.sum("part").alias("bm25_score"))
        return scores.orderBy(F.desc(F.round("bm25_score", 9)), "assertion_id").limit(k)

    def _blocks(self, terms: list[str], candidates: DataFrame) -> DataFrame:
        """Blocks of terms in which candidates can be; named in the filter where they are few, so that the rest is not read."""
        few = [r[0] for r in candidates.limit(NAMED_SLOTS + 1).collect()]
        rows = self._of("postings", terms, "term")
        sizes = {s for _, s in self.segments.values()}
        if len(few) <= NAMED_SLOTS:
            if not few:
                return rows.limit(0)
            keys = self.spark.createDataFrame([(c,) for c in few], "c string")
            row = keys.agg(*(F.collect_set(slot_of("c", s)).alias(str(s)) for s in sizes)).first()
            return rows.where(functools.reduce(lambda a, b: a | b, (F.col("segment").isin([i for i, (_, x) in self.segments.items() if x == s]) & F.col("slot").isin(sorted(row[str(s)])) for s in sizes)))
        at = functools.reduce(lambda a, b: a.unionByName(b), (candidates.select(F.lit(i).alias("segment"), slot_of("assertion_id", s).alias("slot")).distinct() for i, (_, s) in self.segments.items()))
        return rows.join(at, ["segment", "slot"], "left_semi")

    # Writing ---------------------------------------------------------------------------------------------------------
    def _put(self, rows: DataFrame, name: str, segment: int, buckets: int, *within: str) -> None:
        """A table's part of a segment: ``rows``, which may say that they are ``hot``; such are over all buckets by the hash of whole rows."""
        if "hot" not in rows.columns:
            rows = rows.withColumn("hot", F.lit(False))
        anywhere = bucket_of(F.concat_ws("|", *(F.col(c).cast("string") for c in within)) if within else _key(name), buckets)
        dealt = rows.withColumn("bucket", F.when(F.col("hot"), anywhere).otherwise(bucket_of(_key(name), buckets))).select(*_columns(name), "hot", "bucket")
        dealt = dealt.sortWithinPartitions("hot", "bucket", *(("term",) if "term" in dealt.columns else ()), *within)
        with settings(self.spark, SMALL_TASKS):  # so that sorts need no disk
            dealt.write.mode("overwrite").partitionBy("hot", "bucket").option("compression", "zstd").parquet(f"{self.folder}/{name}/segment={segment}")

    def _written(self, name: str, segment: int) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}").where(F.col("segment") == segment)

    def _hot_nodes(self, rows: DataFrame, n: int) -> Column:
        """Whether the node of a row of ``ends`` is hot: in a class of nodes with at least so many ends, and far more than others."""
        def of(name: Column) -> Column:
            return F.pmod(F.xxhash64(T.name_key(name)), F.lit(CLASSES))

        both = rows.select(F.explode(F.array(of(F.col("subject")), of(F.col("object")))).alias("c"))
        least = max(HOT, 8 * n // CLASSES)
        hot = [r["c"] for r in both.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("c").collect()]  # few by their number
        return of(_at()).isin(hot)

    def _settle(self, segment: int, n: int, length: int, buckets: int, slots: int, replaces: list[int]) -> SegmentIndex:
        row = self.spark.createDataFrame([(n, length, buckets, slots, replaces)], "n bigint, length bigint, buckets int, slots int, replaces array<int>")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/stats/segment={segment}")
        return open_index(self.spark, self.folder)

    def append(self, assertions: DataFrame, replaces: list[int] = [], n: int | None = None) -> SegmentIndex:  # noqa: B006
        """The index with identified ``assertions`` in a new segment, ``n`` if that is known; nothing else is written or read."""
        segment = self.last + 1
        for table in ("postings", "terms", "ends", "assertions"):
            _forget(self.spark, f"{self.folder}/{table}/segment={segment}")  # of an attempt that was not settled
        given = assertions.select(*(F.col(c) if c in assertions.columns else F.lit(None).alias(c) for c in _columns("assertions")))
        n = given.count() if n is None else n
        buckets, slots = buckets_for(n), max(1, n // PER_BLOCK)
        self._put(given, "assertions", segment, buckets, "document_id", "seq")
        rows = self._written("assertions", segment).drop("hot", "bucket", "segment")
        words = rows.select(*_FACT, T.search_tokens(F.col("raw_text")).alias("words"))
        each = words.select("words", F.explode(F.array_distinct("words")).alias("term")).select("term", _count_of("term").alias("tf"), F.size("words").alias("dl"))
        self._put(each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl")), "terms", segment, buckets)
        # As many terms are in so many texts as texts have words of them at most.
        hot = [r["term"] for r in self._written("terms", segment).where(F.col("df") > slots).select("term").collect()]
        own, posting = F.array(*map(F.lit, hot)).cast("array<string>"), F.struct(*_FACT, "tf", "dl")
        slotted = words.withColumn("slot", slot_of(_assertion_id(), slots))

        def of(terms: Column) -> DataFrame:
            listed = slotted.withColumn("term", F.explode(terms))
            return listed.select("term", "slot", *_FACT, _count_of("term").alias("tf"), F.size("words").alias("dl"))

        rare = of(F.array_except("words", own)).select("term", "slot", F.lit(1).cast("long").alias("n"), F.col("tf").alias("max_tf"), F.col("dl").alias("min_dl"), F.array(posting).alias("postings"), F.lit(False).alias("hot"))
        blocks = of(F.array_intersect("words", own)).groupBy("term", "slot").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.collect_list(posting).alias("postings"))
        self._put(rare.unionByName(blocks.withColumn("hot", F.lit(True))), "postings", segment, buckets, "slot")
        ends = rows.select(*_FACT, F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
        self._put(ends.withColumn("hot", self._hot_nodes(rows, n)), "ends", segment, buckets, "subject", "object", "document_id", "seq")
        length = self._written("postings", segment).select(F.explode("postings.tf").alias("tf")).agg(F.sum("tf")).first()[0] or 0
        return self._settle(segment, n, length, buckets, slots, list(replaces))

    def delete(self, documents: DataFrame) -> SegmentIndex:
        """The index without documents (``document_id``): their names, and what they take away of each term's documents."""
        segment, gone = self.last + 1, documents.select("document_id").distinct()
        lost = self.assertions().join(gone, "document_id", "left_semi").select("assertion_id", "document_id", "raw_text")
        words = lost.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(T.search_tokens(F.col("raw_text")))).cast("long").alias("length")).first()
        terms = postings_of(lost).groupBy("term").agg((-F.count(F.lit(1))).alias("df")).select("term", "df", F.lit(None).cast("int").alias("max_tf"), F.lit(None).cast("int").alias("min_dl"))
        buckets = buckets_for(words["n"])
        self._put(terms, "terms", segment, buckets)
        gone.write.mode("overwrite").parquet(f"{self.folder}/deleted/segment={segment}")
        return self._settle(segment, -words["n"], -(words["length"] or 0), buckets, 1, [])

    def merge(self, segments: list[int] | None = None) -> SegmentIndex:
        """One segment instead of some (all, where none are named), without what is deleted.

        Additions can be merged among themselves, a few small ones as well as many. A deletion goes with all that it deletes
        from: those before it must be merged too, and none may follow that is not.
        """
        chosen = sorted(self.segments) if segments is None else sorted(segments)
        deletions = [s for s, n in self.counts.items() if n < 0]
        within = [s for s in deletions if s in chosen]
        if any(s > chosen[0] for s in deletions if s not in chosen) or within and any(s not in chosen for s in self.segments if s < within[-1]):
            raise ValueError("a deletion cannot be merged apart from what it deletes from")
        part = SegmentIndex(self.spark, self.folder, {s: self.segments[s] for s in chosen}, tombstones=self.tombstones)
        said = part._live(part._table("assertions"))
        return self.append(said, chosen, None if part.tombstones else sum(self.counts[s] for s in chosen))


def buckets_for(n: int) -> int:
    """The buckets of a segment of ``n`` assertions."""
    k = max(1, n / PER_BUCKET)
    return math.ceil(k if k <= BUCKETS else (BUCKETS * k) ** 0.5)


def _forget(spark: SparkSession, path: str) -> None:
    place, fs = hadoop(spark, path)
    fs.delete(place, True)


def open_index(spark: SparkSession, folder: str) -> SegmentIndex:
    """The index in a folder, or an empty one where there is none yet."""
    place, fs = hadoop(spark, f"{folder}/stats")
    if not fs.exists(place):
        return SegmentIndex(spark, folder)
    rows = spark.read.schema(SCHEMAS["stats"]).parquet(f"{folder}/stats").collect()  # a row a segment
    replaced = {s for r in rows for s in r["replaces"]}
    live = [r for r in rows if r["segment"] not in replaced]
    there, _ = hadoop(spark, f"{folder}/deleted")
    return SegmentIndex(
        spark, folder, {r["segment"]: (r["buckets"], r["slots"]) for r in live}, sum(r["n"] for r in live), sum(r["length"] for r in live), max((r["segment"] for r in rows), default=-1), fs.exists(there), {r["segment"]: r["n"] for r in live}
    )


def build(assertions: DataFrame, folder: str) -> SegmentIndex:
    """An index of identified ``assertions`` in a folder that has none yet."""
    return open_index(assertions.sparkSession, folder).append(assertions)
