"""Shared folders, cut lineage and skew-proof joins for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WS = " \t\n\x0b\x0c\r"


@functools.lru_cache(maxsize=None)
def _own_root(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='factgraph-shared-')}"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and all executors are threads of the driver, as in tests, a local folder of our own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own_root(spark.sparkContext.applicationId)
    return root.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


#: Bytes of a batch on its way to a Python worker, unless the application's own setting says otherwise. Documents are long:
#: batches by number of rows alone would not be bounded.
BATCH_BYTES = 5 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """Make this session's batches small, for good, if the application has not set their size."""
    if not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


#: Folders of applications that go when they end.
_MARKED: set[str] = set()


def workspace(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses, for what lies between steps; it goes when the application ends."""
    own = f"{shared_root(small_batches(spark))}/factgraph-{spark.sparkContext.applicationId}"
    if own not in _MARKED:
        jpath, fs = _hadoop(spark, own)
        fs.mkdirs(jpath)
        fs.deleteOnExit(jpath)
        _MARKED.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that later steps don't depend on its lineage."""
    path = workspace(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no plan reads any more."""
    for table in tables:
        remove(table.sparkSession, table._written_to)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a step has finished with."""
    jpath, fs = _hadoop(spark, path)
    fs.delete(jpath, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all, and that must not be there yet."""
    target, fs = _hadoop(spark, path)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(temporary, target):
        fs.delete(temporary, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    source, fs = _hadoop(spark, path)
    stream = fs.open(source)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    folder, fs = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def trim() -> None:
    """Give freed memory of this process back to the system; allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the C library that has it


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An iterator function for Python workers that leaves no freed memory behind in them: Spark keeps workers for other tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def commit_files(spark: SparkSession, manifest: DataFrame, folder: str, temporary: str) -> DataFrame:
    """Move the files of ``manifest`` (``temporary``: path of the attempt whose row it is, ``file``: final name) to their names.

    Tasks write under names of their attempt, so those that are run again or twice don't meet; only attempts in the manifest
    become visible. A move that is run again finds its work done. What lost attempts left goes with the temporary folder.
    """
    columns = [c for c in manifest.columns if c != "temporary"]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for source, name in zip(batch.column("temporary").to_pylist(), batch.column("file").to_pylist()):
                _, path = filesystem(source)
                there = [i.type != pafs.FileType.NotFound for i in fs.get_file_info([path, f"{root}/{name}"])]
                if there == [True, True]:
                    fs.delete_file(f"{root}/{name}")
                if there[0]:
                    fs.move(path, f"{root}/{name}")
                elif not there[1]:
                    raise FileNotFoundError(source)
            yield batch.select(columns)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = written(manifest.repartition(n, "file").mapInArrow(frugal(move), manifest.drop("temporary").schema), "manifest")
    remove(spark, temporary)
    return done


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, for Python workers that write or read files of their own format."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return pafs.LocalFileSystem(), uri


def attach(left: DataFrame, right: DataFrame, key: str, size: str, rows: int, heavy_keys: int = 2000, how: str = "left") -> DataFrame:
    """Left (or inner) join of narrow rows with one row per key, where a key may hold a large share of ``left``.

    ``size`` is a column of ``right`` with the key's number of rows in ``left``, ``rows`` the rows of ``left``. At most
    ``heavy_keys`` keys can have ``rows / heavy_keys`` rows or more: these are broadcast, so their rows never meet in one
    task. The other keys are joined by a shuffle; none of them is large.
    """
    limit = max(2, rows // heavy_keys)
    light, heavy = right.where(F.col(size) < limit), right.where(F.col(size) >= limit)
    shared = left.join(F.broadcast(heavy), key, "inner")
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how)
    return shared.unionByName(rest)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def range_bounds(keys: DataFrame, key: str, tasks: int) -> list:
    """At most ``tasks - 1`` ascending bounds that deal the keys out evenly; a sketch that tasks merge, not a sort."""
    if tasks < 2:
        return []
    parts = [k / tasks for k in range(1, tasks)]
    row = keys.agg(F.percentile_approx(key, parts, 20_000).alias("b")).first()
    return sorted(set(row["b"] or []))
