"""Token-id files: canonical length-limited Huffman codes from global counts, in blocks that decode alone.

A file is ``MAGIC``, blocks, a footer and the footer's length. Each block has up to ``BLOCK`` ids as a bit string, most
significant bit first, and the bit offset of every ``STEP``-th id, so that all stretches decode side by side by table.
The footer (zlib) holds the code lengths, the block index and the documents' identifiers and lengths; canonical codes follow
from the lengths. Tasks write files under names of their attempt; the manifest of those that counted is what commits them.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import commit_files, filesystem, frugal, range_bounds, remove, workspace, written
from .tokens import encoder, release, slices

#: Ids of a block at least, ids between two bit offsets, and bits of the longest code (more for vocabularies that need them).
MAGIC, BLOCK, STEP, MAX_BITS = b"HUFTOK1\n", 1 << 18, 128, 18
#: Coded bytes of a file before the next begins.
ROLL_BYTES = 32 << 20
#: Ids that are coded together.
_GROUP = 1 << 18


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << max_bits:
        raise ValueError("more ids than codes")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(max_bits):
        merged = np.concatenate([leaves, packages])
        at = np.argsort(merged, kind="stable")
        levels.append(at < len(leaves))
        merged = merged[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, got = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        got[:n] += 1
        take = 2 * (take - n)
    lengths[order] = got
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id)."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


class Coder:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.bits = max(1, int(lengths.max(initial=1)))
        #: Codes from the left of 64 bits.
        self.codes = canonical(lengths) << ((64 - self.lengths) & 63).astype(np.uint64)
        # An entry for each window of bits: the id, and the code's length in the last five bits.
        self.table = np.ones(1 << self.bits, np.uint32)
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        spans = np.left_shift(1, self.bits - self.lengths[used])
        self.table[: int(spans.sum())] = np.repeat((used << 5 | self.lengths[used]).astype(np.uint32), spans)

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The bit strings of ``counts`` ids each, all filled up to 32 bits; their bytes; the bit offset in each of every ``STEP``-th id; how many."""
        size = self.lengths[ids]
        stops = np.cumsum(size)
        first = np.cumsum(counts) - counts
        before = stops[first] - size[first]
        words = (stops[first + counts - 1] - before + 31) >> 5
        word_begin = np.cumsum(words) - words
        at = stops - size + np.repeat(32 * word_begin - before, counts)
        # Codes that begin in one 32-bit word don't overlap in the 64 bits from there on: their sum holds them all.
        shifted, word = self.codes[ids] >> (at & 31).astype(np.uint64), at >> 5
        runs = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        pairs = np.zeros(int(words.sum()) + 1, np.uint64)
        pairs[word[runs]] = np.add.reduceat(shifted, runs)
        out = pairs[:-1] >> np.uint64(32)
        out[1:] |= pairs[:-2] & np.uint64(0xFFFFFFFF)
        marks = -(-counts // STEP)
        each = np.arange(int(marks.sum())) - np.repeat(np.cumsum(marks) - marks, marks)
        offsets = at[np.repeat(first, marks) + STEP * each] - np.repeat(32 * word_begin, marks)
        return out.astype(">u4").tobytes(), 4 * words, offsets.astype("<u4"), marks

    def decode(self, data: bytes, counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """All ids of a block: ``offsets`` of its stretches in bits, ``counts`` of ids in each (``STEP`` at most)."""
        words = np.concatenate([np.frombuffer(data, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at, out = offsets.astype(np.int64), np.empty((STEP, len(offsets)), np.uint32)
        top, shift = len(pairs) - 1, np.uint64(64 - self.bits)
        for k in range(int(counts.max(initial=0))):
            entry = self.table[(pairs[np.minimum(at >> 5, top)] << (at & 31).astype(np.uint64)) >> shift]
            out[k] = entry >> np.uint32(5)
            at += entry & np.uint32(31)
        return out.T[np.arange(STEP) < counts[:, None]]


class FileWriter:
    """One file of coded documents; ``add`` them, then ``close``."""

    def __init__(self, folder: str, name: str, lengths: np.ndarray):
        self.fs, root = filesystem(folder)
        attempt = f"{name}-{TaskContext.get().taskAttemptId()}"
        self.name, self.temporary = name, f"{folder}/{attempt}"
        self.fs.create_dir(root, recursive=True)
        self.out = self.fs.open_output_stream(f"{root}/{attempt}", compression=None)
        self.out.write(MAGIC)
        self.lengths, self.size, self.index = lengths, len(MAGIC), []
        self.docs, self.counts = [], []
        self._begin()

    def _begin(self) -> None:
        self.data, self.marks, self.held, self.bits = [], [], 0, 0

    def add(self, doc: int | None, n: int, data: bytes, offsets: bytes) -> None:
        self.docs.append(doc)
        self.counts.append(n)
        self.marks.append(np.frombuffer(offsets, "<u4").astype(np.int64) + self.bits)
        self.data.append(data)
        self.held += n
        self.bits += 8 * len(data)
        if self.held >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        marks = np.concatenate(self.marks).astype("<i8").tobytes()
        marks = zlib.compress(marks, 1)
        body = marks + b"".join(self.data)
        self.index.append((self.size, len(self.data), len(marks), len(body), zlib.crc32(body)))
        self.out.write(body)
        self.size += len(body)
        self._begin()

    def close(self) -> dict:
        if self.data:
            self._flush()
        known = np.array([d is not None for d in self.docs], bool)
        parts = [self.lengths.tobytes(), np.array(self.index, "<i8").tobytes(), np.array([d or 0 for d in self.docs], "<i8").tobytes(), known.tobytes(), np.array(self.counts, "<i8").tobytes()]
        footer = zlib.compress(json.dumps([len(p) for p in parts]).encode() + b"\n" + b"".join(parts))
        self.out.write(footer + struct.pack("<Q", len(footer)))
        self.out.close()
        return {"file": self.name, "temporary": self.temporary, "first_id": self.docs[0], "docs": len(self.docs), "tokens": sum(self.counts), "bytes": self.size + len(footer) + 8}


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a file in order, block by block."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        end = f.size()
        f.seek(end - 8)
        n = struct.unpack("<Q", f.read(8))[0]
        f.seek(end - 8 - n)
        head, _, rest = zlib.decompress(f.read(n)).partition(b"\n")
        cuts = np.cumsum([0, *json.loads(head)])
        lengths, index, docs, known, counts = (rest[a:b] for a, b in zip(cuts, cuts[1:]))
        coder = Coder(np.frombuffer(lengths, np.uint8))
        ids, there, counts = np.frombuffer(docs, "<i8").tolist(), np.frombuffer(known, bool).tolist(), np.frombuffer(counts, "<i8")
        first = 0
        for at, ndocs, nmarks, nbytes, crc in np.frombuffer(index, "<i8").reshape(-1, 5).tolist():
            f.seek(at)
            body = f.read(nbytes)
            if zlib.crc32(body) != crc:
                raise ValueError(f"{uri}: a block is damaged")
            own = counts[first : first + ndocs]
            lanes = -(-own // STEP)
            sizes = np.full(int(lanes.sum()), STEP)
            sizes[np.cumsum(lanes) - 1] = own - (lanes - 1) * STEP
            found = coder.decode(body[nmarks:], sizes, np.frombuffer(zlib.decompress(body[:nmarks]), "<i8"))
            stops = np.cumsum(own).tolist()
            for k, (a, b) in enumerate(zip([0, *stops], stops), first):
                yield (ids[k] if there[k] else None), found[a:b]
            first += ndocs


def _resting(ids: np.ndarray) -> bytes:
    """Ids by byte position and compressed, as they rest between counting and coding; two bytes each where that is enough."""
    width = 2 if int(ids.max(initial=0)) < 1 << 16 else 4
    return bytes([width]) + zstandard.ZstdCompressor(1).compress(ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def _awake(rest: bytes) -> np.ndarray:
    width = rest[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(rest)[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}")[:, 0]


ENCODED = "doc_ids array<long>, counts array<long>, rest binary, id long, count long"


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Rows of two kinds: ``doc_ids``, ``counts`` and all ids of a run of documents of bounded length, and each task's counts of ``id``."""
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("rest", pa.binary()), ("id", pa.int64()), ("count", pa.int64())])

    def rows(**given) -> pa.RecordBatch:
        n = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for part, texts in slices(batches, "text"):
            found = [ids + end for ids in encoder(tokenizer).encode(texts)]
            ids = np.frombuffer(b"".join(found), "<u4")
            own = np.bincount(ids, minlength=len(total))
            own[: len(total)] += total
            total = own
            yield rows(doc_ids=[part.column("doc_id").to_pylist()], counts=[[len(x) // 4 for x in found]], rest=[_resting(ids)])
        used = np.flatnonzero(total)
        yield rows(id=used, count=total[used])

    return docs.mapInArrow(frugal(encode), ENCODED)


def write_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", tasks: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write all documents in ascending ``id_col`` order and return the manifest: ``file``, ``part``, ``number``, ``first_id``, ``docs``, ``tokens``, ``bytes``.

    Files are in order by (``part``, ``number``). Null texts count as empty (only the end id); a null identifier comes first;
    repeated rows are repeated in the files. An empty table gives an empty manifest and no file. Texts are encoded once: the
    ids wait in the shared folder until the counts of all are known, are coded where they lie, and only codes are shuffled
    into order. Codes have ``MAX_BITS`` at most, or two more than tell all ids in use apart.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    waiting = workspace(spark, "ids")
    encoded(rows, tokenizer, end_id).write.parquet(waiting)
    ids = spark.read.schema(ENCODED).parquet(waiting)
    found = ids.where("id is not null").groupBy("id").agg(F.sum("count").alias("count")).collect()  # one row for each id of the vocabulary at most
    counts = np.zeros(max([r["id"] for r in found], default=end_id) + 1, np.int64)
    for r in found:
        counts[r["id"]] = r["count"]
    lengths = spark.sparkContext.broadcast(code_lengths(counts, longest_code(len(found))))
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    there = ids.where("rest is not null").select("doc_ids", "counts", "rest")
    # Bounds from the identifiers alone: a range partitioner's sample would code everything twice.
    bounds = np.array(range_bounds(there.select(F.explode("doc_ids").alias("doc_id")), "doc_id", tasks), np.int64)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        coder = Coder(lengths.value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

        def coded(docs_: list, n: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            data, sizes, offsets, marks = coder.encode(own, n)
            stops, ends = np.cumsum(sizes).tolist(), (4 * np.cumsum(marks)).tolist()
            parts = np.searchsorted(bounds, [np.iinfo(np.int64).min if d is None else d for d in docs_], "right")
            offsets = offsets.tobytes()
            columns = parts, docs_, n, [data[a:b] for a, b in zip([0, *stops], stops)], [offsets[a:b] for a, b in zip([0, *ends], ends)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "doc_id", "n", "data", "offsets"])

        for batch in batches:
            for docs_, counts, rest in zip(batch.column("doc_ids").to_pylist(), batch.column("counts"), batch.column("rest")):
                own, n = _awake(rest.as_py()), counts.values.to_numpy()
                stops, first = np.cumsum(n), 0
                while first < len(n):  # so many documents that their ids are _GROUP, or one
                    before = int(stops[first] - n[first])
                    last = max(first + 1, int(np.searchsorted(stops, before + _GROUP, "right")))
                    yield coded(docs_[first:last], n[first:last], own[before : int(stops[last - 1])])
                    first = last

    temporary = f"{folder}/_temporary-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, last, number = None, -1, 0
        done: list[dict] = []
        for batch in batches:
            for part, doc, n, data, offsets in zip(*(c.to_pylist() for c in batch.columns)):
                if writer and (part != last or writer.size >= roll_bytes):
                    done.append(writer.close() | {"part": last, "number": number})
                    writer, number = None, number + 1
                number = number if part == last else 0
                last = part
                writer = writer or FileWriter(temporary, f"ids-{part:06d}-{number:04d}.huf", lengths.value)
                writer.add(doc, n, data, offsets)
        if writer:
            done.append(writer.close() | {"part": last, "number": number})
        yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], t) for c, t in zip(_MANIFEST, _MANIFEST.values())], list(_MANIFEST))

    coded_rows = there.mapInArrow(frugal(code), "part long, doc_id long, n long, data binary, offsets binary")
    dealt = coded_rows.repartitionById(tasks, F.col("part").cast("int")).sortWithinPartitions("part", "doc_id", "data")
    written_files = written(dealt.mapInArrow(frugal(write), "file string, temporary string, part long, number long, first_id long, docs long, tokens long, bytes long"), "token-files-of-tasks")
    remove(spark, waiting)
    return commit_files(spark, written_files, folder, temporary)


_MANIFEST = {"file": pa.string(), "temporary": pa.string(), "part": pa.int64(), "number": pa.int64(), "first_id": pa.int64(), "docs": pa.int64(), "tokens": pa.int64(), "bytes": pa.int64()}


def longest_code(ids: int) -> int:
    """Bits of the longest code for so many ids in use."""
    return max(MAX_BITS, ids.bit_length() + 2)


def file_starts(manifest: DataFrame) -> DataFrame:
    """``file``, ``part``, ``number`` and ``start``, the ids of all files before, in order of the pair."""
    # Parts are as many as tasks wrote them: their sums are few rows. The files of one are numbered within it.
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("_within", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(parts, "part")
    return files.select("file", "part", "number", (F.col("before") + F.col("_within")).alias("start"))


def read_back(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for frame in frames:
            for name, start in zip(frame["file"], frame["start"]):
                out: list[tuple] = []
                for doc, ids in read_file(f"{folder}/{name}"):
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield _frame(out)
                        out = []
                yield _frame(out)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return file_starts(manifest).repartition(n, "part", "number").mapInPandas(frugal(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    folder = workspace(docs.sparkSession, "token-files")
    return read_back(docs.sparkSession, folder, write_files(docs, tokenizer, folder, **options))
