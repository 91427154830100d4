"""Ranked lexical search: WAND over shards of documents, whose heaps are merged.

``build`` reads every document once and writes one row per shard: for each term that some item asks for, the shard's documents
with it, in the order of their identifiers, and how often each has it. Shards are bounded by documents and by postings, so a
task holds one at a time however its rows are dealt. Corpus statistics (N, L, df) are sums over all shards.

``search`` walks the shards: each task turns occurrences into impacts, takes the largest of every term, and selects pivots: the
first document at which the largest impacts of the terms met so far exceed the threshold; all before it are skipped. A first
wave over a few shards gives every item a score that ten documents reach, from which the other shards start. Skipping is exact
in both waves: a document is passed over only if it cannot be among the best.

Nulls and odd rows: a null text has no terms and an item with a null text, or without terms, no rows. Rows that repeat an
identifier are documents, or items, of their own. A null ``doc_id`` comes last of equal scores. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import forget, frugal, small_batches, written

#: Documents and postings of a shard at most; the last document of a shard may exceed the second by its own terms.
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 20
#: Distinct terms of the items, counted once an item, that one pass over the documents answers; more items take more passes.
BLOCK_TERMS = 250_000
#: One shard of so many belongs to the first wave.
FIRST_WAVE = 16
#: Bytes of a text that are cut into terms at once.
SLICE = 1 << 20

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
_SHARD = "ids array<bigint>, lengths array<bigint>, total bigint, terms array<int>, dfs array<int>, docs binary, tfs binary"


def slices(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in order, a stretch of it at a time: runs of ASCII letters, digits and all beyond ASCII.

    Of UTF-8 bytes ``lower`` changes A-Z alone, and those of other code points are all beyond ASCII.
    """
    data, at = (text or "").encode().lower(), 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            found = _BREAK.search(data, end)
            end = found.start() if found else len(data)
        yield _TERM.findall(data, at, end)
        at = end


def _items(items: DataFrame, item: str, text: str) -> DataFrame:
    """``key``, ``item_id``, ``terms``, ``counts``: what each item with terms asks for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [Counter(t for part in slices(x) for t in part) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([list(c) for c in counted], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int64()))],
                names=["key", "item_id", "terms", "counts"],
            )

    asked = items.select(F.monotonically_increasing_id().alias("key"), F.col(item).alias("item_id"), F.col(text).alias("text"))
    schema = StructType([*asked.drop("text").schema.fields, StructField("terms", ArrayType(BinaryType())), StructField("counts", ArrayType(LongType()))])
    return written(asked.mapInArrow(frugal(cut), schema).where(F.size("terms") > 0), "search-items")


def build(docs: DataFrame, vocabulary: list[bytes], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The shards of ``docs`` for the terms of ``vocabulary``, whose places in the list are their numbers.

    A row per shard: identifiers and lengths of its documents in ascending order (null last), all their terms, and for each term
    that occurs the number of documents, and in ``docs`` and ``tfs`` (32-bit integers, term after term) their places and counts.
    """
    number = {t: k for k, t in enumerate(vocabulary)}

    def shard(ids: list, lengths: list, terms: array, places: array, tfs: array) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        term, at, tf = np.asarray(terms, np.int32), place[np.asarray(places, np.int32)], np.asarray(tfs, np.int32)
        by = np.lexsort((at, term))
        distinct, dfs = np.unique(term, return_counts=True)
        row = [[ids[k] for k in order], [lengths[k] for k in order], sum(lengths), distinct, dfs.astype(np.int32), at[by].tobytes(), tf[by].tobytes()]
        types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["ids", "lengths", "total", "terms", "dfs", "docs", "tfs"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, terms, places, tfs = [], [], array("i"), array("i"), array("i")
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, found = 0, Counter()
                for part in slices(body.as_py()):
                    n += len(part)
                    found.update(map(number.get, part))
                if not n:
                    continue
                found.pop(None, None)
                terms.extend(found)
                tfs.extend(found.values())
                places.extend([len(ids)] * len(found))
                ids.append(name)
                lengths.append(n)
                if len(ids) >= SHARD_DOCS or len(terms) >= SHARD_POSTINGS:
                    yield shard(ids, lengths, terms, places, tfs)
                    ids, lengths, terms, places, tfs = [], [], array("i"), array("i"), array("i")
        if ids:
            yield shard(ids, lengths, terms, places, tfs)

    small_batches(docs.sparkSession)
    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text != ''").mapInArrow(frugal(cut), _SHARD)


def weights(n: int, df: dict[int, int]) -> dict[int, int]:
    """The weight of each term: floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What occurrences in documents of given lengths count, before the weight of their term; 64-bit integers throughout."""
    tf, m = tf.astype(np.int64), 25 + 75 * length * n // total
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def wand(lists: list[tuple[array, array, int, int]], k: int, floor: int) -> list[tuple[int, int]]:
    """The ``k`` best (score, place) with a score above ``floor``; of equal scores the first places.

    ``lists``: of each term the ascending places of its documents, their impacts, the largest of these, and how often the term
    is asked for. Cursors are numbers, place times terms plus term, so that they sort as they are.
    """
    n = len(lists)
    largest = [most * asked for _, _, most, asked in lists]
    at = [0] * n
    live = sorted(places[0] * n + i for i, (places, *_) in enumerate(lists))
    heap: list[tuple[int, int]] = []
    while live:
        bound = 0
        for j, cursor in enumerate(live):
            bound += largest[cursor % n]
            if bound > floor:
                break
        else:
            break
        pivot = live[j] // n
        if live[0] // n == pivot:
            end = bisect_left(live, (pivot + 1) * n)
            score, moved = 0, []
            for cursor in live[:end]:
                i = cursor % n
                places, scores, _, asked = lists[i]
                score += scores[at[i]] * asked
                at[i] += 1
                if at[i] < len(places):
                    moved.append(places[at[i]] * n + i)
            if score > floor:
                (heapq.heappush if len(heap) < k else heapq.heapreplace)(heap, (score, -pivot))
                if len(heap) == k:
                    floor = max(floor, heap[0][0])
        else:
            end = bisect_left(live, pivot * n)
            moved = []
            for cursor in live[:end]:
                i = cursor % n
                places = lists[i][0]
                at[i] = bisect_left(places, pivot, at[i])
                if at[i] < len(places):
                    moved.append(places[at[i]] * n + i)
        live[:end] = moved
        live.sort()
    return [(score, -place) for score, place in sorted(heap, key=lambda h: (-h[0], -h[1]))]


def _heaps(shards: DataFrame, asked: list[tuple[int, list[tuple[int, int]]]], n: int, total: int, weight: dict[int, int], k: int, floors: dict[int, int]) -> DataFrame:
    """``key``, ``doc_id``, ``score``: the best of every shard for every item (``asked``: key, terms with their repeats)."""
    answerable = frozenset(weight)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.asarray(row["lengths"], np.int64)
                docs, tfs = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int32)
                scores = impacts(tfs, lengths[docs], n, total)
                postings, start = {}, 0
                for term, df in zip(row["terms"], row["dfs"]):
                    if term in answerable and weight[term] > 0:
                        own = scores[start : start + df] * weight[term]
                        postings[term] = (array("i", docs[start : start + df].tobytes()), array("q", own.tobytes()), int(own.max()))
                    start += df
                keys, ids, best = [], [], []
                for key, terms in asked:
                    lists = [(*postings[t], q) for t, q in terms if t in postings]
                    for score, place in wand(lists, k, floors.get(key, 0)) if lists else ():
                        keys.append(key)
                        ids.append(row["ids"][place])
                        best.append(score)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(best, pa.int64())], names=["key", "doc_id", "score"])

    return shards.mapInArrow(frugal(rank), "key long, doc_id long, score long")


def _best(heaps: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _answer(docs: DataFrame, rows: list, k: int, doc: str, text: str) -> DataFrame:
    """The best documents of a block of items, written."""
    vocabulary = sorted({t for r in rows for t in r["terms"]})
    number = {t: i for i, t in enumerate(vocabulary)}
    asked = [(r["key"], sorted((number[t], c) for t, c in zip(r["terms"], r["counts"]))) for r in rows]
    index = written(build(docs, vocabulary, doc, text), "search-shards", **{"parquet.block.size": str(8 << 20)})
    whole = index.agg(F.sum(F.size("ids").cast("long")).alias("n"), F.sum("total").alias("l")).first()
    n, total = whole["n"] or 0, whole["l"] or 0
    counts = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).groupBy("p.terms").agg(F.sum("p.dfs").alias("df"))
    weight = weights(n, {r["terms"]: r["df"] for r in counts.collect()})  # as many rows as the vocabulary at most
    # Shards have numbers by what they hold, so that a wave is the same whenever it is asked for.
    wave = F.pmod(F.xxhash64("ids", "lengths"), F.lit(FIRST_WAVE)) == 0
    first = written(_heaps(index.where(wave), asked, n, total, weight, k, {}), "search-first")
    reached = _best(first, k).groupBy("key").agg(F.max("rank").alias("n"), F.min("score").alias("score")).where(F.col("n") == k)
    floors = {r["key"]: r["score"] - 1 for r in reached.collect()}  # a row an item of the block at most
    rest = _heaps(index.where(~wave), asked, n, total, weight, k, floors)
    out = written(_best(first.unionByName(rest), k), "search-best")
    forget(index, first)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents of every item with a score above 0.

    Items are answered in blocks of about ``BLOCK_TERMS`` terms, which are all that the driver and the tasks hold of them at
    once; most tables of items are one block. Each block reads the documents once.
    """
    asked = _items(items, item, item_text)
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0) // BLOCK_TERMS))
    out = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).select("key", "terms", "counts").collect()
        best = _answer(docs, rows, k, doc, text)
        out = best if out is None else out.unionByName(best)
    return out.join(asked.select("key", "item_id"), "key").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
