"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by identifier and written to files that roll over by compressed size, one gzip member a record.
Digests and headers are made anew from the payload; nothing depends on time or host, so the same input gives the same bytes.
Tasks write files under temporary names of their attempt; the manifest of those that counted, with sizes and digests, commits
them, and only then they get their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, commit_files, filesystem, frugal, range_bounds, workspace, written

ROLL_BYTES, DATE = 32 << 20, "2000-01-01T00:00:00Z"
#: Payloads of fewer bytes are always written in full.
MIN_REVISIT_BYTES = 0
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:factgraph:warc")
#: Columns of the manifest.
MANIFEST = "file string, part long, number long, records long, bytes long, sha256 string"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def _base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of 20 bytes: eight groups of 20 bits, each four characters."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.conv(F.substring(sha1_hex, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    return F.concat(*(F.substring(F.lit(digits), (F.shiftright(g, s).bitwiseAND(31) + 1), F.lit(1)) for g in groups for s in (15, 10, 5, 0)))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One record as a gzip member. ``refers_to`` makes it a revisit, which has the payload's digest and length only."""
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {length}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url:
        lines.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if revisit else http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def read_records(uri: str, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record, member by member."""
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as f:
        rest = b""
        while rest or (rest := f.read(chunk)):
            unpacker, parts = zlib.decompressobj(31), []
            while not unpacker.eof:
                if not rest and not (rest := f.read(chunk)):
                    raise ValueError(f"{uri}: a record is cut off")
                parts.append(unpacker.decompress(rest))
                rest = unpacker.unused_data
            head, _, body = b"".join(parts).partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield headers, body[: int(headers["Content-Length"])]


class Shard:
    def __init__(self, folder: str, name: str):
        self.fs, root = filesystem(folder)
        attempt = f"{name}-{TaskContext.get().taskAttemptId()}"
        self.name, self.temporary = name, f"{folder}/{attempt}"
        self.fs.create_dir(root, recursive=True)
        self.out, self.size, self.records, self.digest = self.fs.open_output_stream(f"{root}/{attempt}", compression=None), 0, 0, hashlib.sha256()

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)
        self.records += 1

    def close(self, part: int, number: int) -> tuple:
        self.out.close()
        return self.name, part, number, self.records, self.size, self.digest.hexdigest(), self.temporary


def revisits(pages: DataFrame, id_col: str, payload: Column, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id``, ``sha1``, ``length`` and, for revisits, ``refers_to``: of equal payloads the largest identifier is the response."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("length"), F.unhex(F.sha2(payload, 256)).alias("same"))
    rows = written(rows, "digests")
    groups = rows.where(F.col("length") >= min_bytes).groupBy("same").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("size"))
    groups = written(groups.where("size > 1"), "payloads")
    found = attach(rows, groups, "same", "size", rows.count())
    again = (F.col("length") >= min_bytes) & (F.col("last") != F.coalesce("page_id", F.lit(-(1 << 62))))
    return found.select("page_id", "sha1", "length", F.when(again, F.col("last")).alias("refers_to"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, tasks: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write every row as a record in ascending ``id_col`` order and return the manifest (``MANIFEST``).

    A null html is an empty payload, a null url leaves the header out. Of repeated rows (same identifier) with equal payloads
    all are responses, as none is larger. A row without identifier is a revisit where an equal payload has one. An empty table
    gives no file.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit(""))
    decided = revisits(pages, id_col, payload, min_bytes).where("refers_to is not null").select("page_id", _base32(F.col("sha1")).alias("digest"), "refers_to").distinct()
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("html"))
    rows = rows.select("*", _base32(F.sha1("html")).alias("digest"), F.octet_length("html").cast("long").alias("length"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"))
    # Decisions travel as rows before the page they are about, so payloads are shuffled once.
    rows = rows.unionByName(decided.select("*", F.lit(0).alias("kind")), allowMissingColumns=True)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(pages.select(F.col(id_col).cast("long").alias("page_id")), "page_id", tasks)
    below = F.filter(F.lit(bounds), lambda b: b <= F.coalesce("page_id", F.lit(-(1 << 62)))) if bounds else F.array()
    rows = rows.withColumn("part", F.size(below))
    temporary = f"{folder}/_temporary-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last, number, done, decision = None, -1, 0, [], (None, None, None)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for page, url, html, digest, length, kind, refers, own in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns)):
                    if kind == 0:
                        decision = page, digest, refers
                        continue
                    refers = decision[2] if decision[:2] == (page, digest) else None
                    if shard and (own != last or shard.size >= roll_bytes):
                        done.append(shard.close(last, number))
                        shard, number = None, number + 1
                    number = number if own == last else 0
                    last = own
                    shard = shard or Shard(temporary, f"part-{own:06d}-{number:04d}.warc.gz")
                    shard.add(record(page, url, html.encode("utf-8", "surrogatepass"), digest, length, refers))
        if shard:
            done.append(shard.close(last, number))
        names = [*(f.split()[0] for f in MANIFEST.split(", ")), "temporary"]
        types = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names)

    rows = rows.select("page_id", "url", "html", "digest", "length", "kind", "refers_to", "part")
    dealt = rows.repartitionById(tasks, F.col("part")).sortWithinPartitions("part", "page_id", "digest", "kind", "url")
    return commit_files(spark, written(dealt.mapInArrow(frugal(run), MANIFEST + ", temporary string"), "warc-of-tasks"), folder, temporary)


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per record: ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    A response's digest and length are taken from its payload; they must agree with its headers.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, records in zip(frame["file"], frame["records"]):
                out = []
                for headers, block in read_records(f"{folder}/{name}"):
                    kind, digest, length = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if (base32_sha1(payload), len(payload)) != (digest, length):
                            raise ValueError(f"{name}: the payload of {headers['WARC-Record-ID']} is damaged")
                    page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                    out.append((page and int(page), headers.get("WARC-Target-URI"), length, digest, kind, refers and int(refers)))
                if len(out) != records:
                    raise ValueError(f"{name}: {len(out)} of {records} records")
                yield pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("file", "records").repartition(n, "file")
    return files.mapInPandas(frugal(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    folder = workspace(pages.sparkSession, "warc")
    return read(pages.sparkSession, folder, write(pages, folder, **options))
