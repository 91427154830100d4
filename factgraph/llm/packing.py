"""Bounded-space online best-fit packing of token pieces into sequences.

Each task keeps a fixed number of open bins in a bitset keyed by their free space. A piece goes to the open bin with the
least space that holds it; when a new bin is needed and none may be opened, the fullest closes. Pieces of bins still open
at a task's end go on to a next round of fewer tasks, where the longest come first, until one task has the last of them.
A task passes on at most its open bins, so each round is small, and the last one, which gets those of ``FAN_IN`` tasks,
keeps as many open as these had together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches, written
from .tokens import encoder, release, slices

CAPACITY, OPEN_BINS, FAN_IN = 2048, 256, 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Characters that a task encodes at once; as a stage among others packing shares its executor's memory with what these left.
RUN_CHARS = 2_000_000


class BestFit:
    """Open bins by free space; ``place`` returns (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.count, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
        self.closed: list[int] = []  # since last asked

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.count == self.open_bins:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, number, self.made = self.capacity, self.made, self.made + 1
        left = free - length
        if left:
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.count += 1
        else:
            self.closed.append(number)
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return number


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut each document's ids (and the end id) into pieces of ``capacity``, of which the first may be shorter.

    Null texts count as empty: one piece, the end id. Rows without an identifier or with the same one as others are cut like
    any other. Very long texts are encoded whole. ``with_ids`` adds the ids themselves (binary, little-endian 32-bit).
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for part, texts in slices(batches, "text", RUN_CHARS):
            out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, ids in zip(part.column("doc_id").to_pylist(), encode(texts)):
                ids += end
                n = len(ids) // 4
                at, size = 0, (n - 1) % capacity + 1
                for k in range(-(-n // capacity)):
                    own = ids[4 * at : 4 * (at + size)]
                    for c, v in zip(out, (doc, k, at, size, zlib.crc32(own), own if with_ids else None)):
                        out[c].append(v)
                    at, size = at + size, capacity
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(out.values())[: 5 + with_ids], types)], list(out)[: 5 + with_ids])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(cut), PIECES + ", ids binary" * with_ids)


def _round(rows: DataFrame, tasks: int, level: int, capacity: int, open_bins: int, last: bool) -> DataFrame:
    names = [f.split()[0] for f in PIECES.split(", ")]

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        fit, base = BestFit(capacity, open_bins), (level << 56) | (TaskContext.get().partitionId() << 32)
        waiting: dict[int, list[tuple]] = {}  # the rows of open bins
        for frame in frames:
            done: list[tuple] = []
            for row in frame[names].itertuples(index=False, name=None):
                number, offset = fit.place(row[3])
                waiting.setdefault(number, []).append((*row, base + number, offset))
                while fit.closed:
                    done += waiting.pop(fit.closed.pop())
            yield pd.DataFrame(done, columns=[*names, "sequence_id", "offset"])
        rest = [row for rows in waiting.values() for row in rows]
        if rest:
            out = pd.DataFrame(rest, columns=[*names, "sequence_id", "offset"])
            if not last:
                out["sequence_id"] = out["offset"] = None
            yield out.astype({"sequence_id": "Int64", "offset": "Int64"})

    dealt = rows.select(*names).repartition(tasks, F.xxhash64("doc_id", "piece")) if tasks > 1 else rows.select(*names).coalesce(1)
    order = ["doc_id", "piece"] if level == 0 else [F.desc("length"), "doc_id", "piece"]
    return dealt.sortWithinPartitions(*order).mapInPandas(frugal(fill), PIECES + ", sequence_id long, offset long")


def pack(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tasks: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """``sequence_id`` and ``offset`` for every row of ``cut`` (columns of ``PIECES``; others are dropped).

    Repeated rows are separate pieces. An empty table gives an empty result. Each length must be 1 to ``capacity``.
    """
    spark = cut.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, rest, level = [], cut, 0
    while True:
        last = tasks == 1
        filled = written(_round(rest, tasks, level, capacity, fan_in * open_bins if last else open_bins, last), f"packed-{level}")
        parts.append(filled.where("sequence_id is not null"))
        if last:
            break
        rest, tasks, level = filled.where("sequence_id is null"), -(-tasks // fan_in), level + 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sequences(packed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id`` and ``ids``, from ``pack`` and ``pieces(..., with_ids=True)``.

    Pieces are known by ``doc_id`` and ``piece``: identifiers must be there and differ.
    """
    joined = packed.join(with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    joined = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return joined.select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))
