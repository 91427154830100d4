"""Folders as a data source: trees are pruned while they are listed, folders dealt to tasks, filters tested on names alone."""

from __future__ import annotations

import operator
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from ..session import hadoop

# Folders that are skipped by default (with our own state directory), beside all whose names begin with a dot.
PRUNED = (".git", "node_modules", "build", "logs", ".factgraph")

SCHEMA = "path string, rel string, extension string, modified_at timestamp, n_bytes long"
COLUMNS = ("path", "rel", "extension", "modified_at", "n_bytes")
#: Filters that names and sizes alone answer.
TESTS = {EqualTo: operator.eq, In: lambda value, values: value in values, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: operator.contains}
#: Contents are handed on when they reach so many bytes.
BATCH_BYTES = 16 << 20


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it, whatever kind it is."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


@dataclass
class Folders(InputPartition):
    """Folders that one task lists: (path below the root, whether with all that is below)."""

    work: list[tuple[str, bool]]


class FolderReader(DataSourceReader):
    """Planning lists levels from the root down until there are ``tasks`` folders, and keeps their names only; tasks list the rest."""

    def __init__(self, options: dict):
        self.root, self.tasks = options["path"].rstrip("/") or "/", int(options.get("tasks", "64"))
        self.skipped = set(options.get("pruned", ",".join(PRUNED)).split(","))
        self.filters: list[Filter] = []

    def _below(self, rel: str) -> bool:
        """Whether files in or below a folder can pass the filters."""
        for f in self.filters:
            if f.attribute == ("rel",) and isinstance(f, EqualTo | StringStartsWith) and not (f.value.startswith(f"{rel}/") or isinstance(f, StringStartsWith) and rel.startswith(f.value)):
                return False
        return True

    def _list(self, rel: str) -> tuple[list[str], list[tuple]]:
        """The folders in a folder that count, and its files that pass; both in order of their names."""
        store, base = _open(self.root)
        here = posixpath.join(base, rel) if rel else base
        folders, files = [], []
        for info in sorted(store.get_file_info(pafs.FileSelector(here, allow_not_found=bool(rel))), key=lambda i: i.base_name):
            name, below = info.base_name, f"{rel}/{info.base_name}" if rel else info.base_name
            if info.type == pafs.FileType.Directory:
                linked = store.type_name == "local" and os.path.islink(info.path)
                if not linked and not name.startswith(".") and name not in self.skipped and self._below(below):
                    folders.append(below)
            elif info.type == pafs.FileType.File:
                row = (f"{self.root.rstrip('/')}/{below}", below, name.rpartition(".")[2].lower() if "." in name else "", info.mtime, info.size)
                if all(TESTS[type(f)](row[COLUMNS.index(f.attribute[0])], f.value) for f in self.filters):
                    files.append(row)
        return folders, files

    def partitions(self) -> list[InputPartition]:
        shallow, pending = [], [""]
        while pending and len(pending) < self.tasks:
            shallow += pending
            pending = [below for rel in pending for below in self._list(rel)[0]]
        work = [(rel, False) for rel in shallow] + [(rel, True) for rel in pending]
        return [Folders(work[k :: self.tasks]) for k in range(min(self.tasks, len(work)))]

    def read(self, partition: Folders) -> Iterator[tuple]:
        stack = list(reversed(partition.work))
        while stack:
            rel, deep = stack.pop()
            folders, files = self._list(rel)
            yield from files
            if deep:
                stack += [(below, True) for below in reversed(folders)]


class FilteringFolderReader(FolderReader):
    """A reader that takes over Spark's filters; for sessions in which Spark hands them over."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            # Spark compares times itself: what it hands over has no time zone of its own.
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in COLUMNS and f.attribute != ("modified_at",) and (f.value is not None):
                self.filters.append(f)
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    n_files: int


class FolderWriter(DataSourceWriter):
    """A file for each row. It is written aside and renamed, so that no scan reads half of it and a task may run twice."""

    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator) -> Written:
        store, base = _open(self.root)
        n, made = 0, set()
        for row in rows:
            if not (row["rel"] or "").strip() or row["rel"].startswith("/") or ".." in row["rel"].replace("\\", "/").split("/"):
                raise ValueError(f"no file name: {row['rel']!r}")
            target = posixpath.join(base, row["rel"])
            folder = posixpath.dirname(target)
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            aside = posixpath.join(folder, f".put-{uuid.uuid4().hex}")
            with store.open_output_stream(aside) as out:
                out.write(bytes(row["content"] or b""))
            store.move(aside, target)
            n += 1
        return Written(n)


class FolderSource(DataSource):
    """``spark.read.format("folder")``: one row a file. ``write`` takes ``rel``, ``content`` and puts files below the path.

    Options: ``tasks`` (64), ``pruned`` (names of folders, by commas), ``pushdown`` (whether Spark hands filters over).
    """

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (FilteringFolderReader if self.options.get("pushdown", "false") == "true" else FolderReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FolderWriter(self.options["path"])


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as the session's file systems understand it."""
    place, store = hadoop(spark, path)
    return store.makeQualified(place).toString()


def listed(spark: SparkSession, root: str, tasks: int = 64, pruned: tuple[str, ...] = PRUNED) -> DataFrame:
    """``path``, ``rel``, ``extension`` (small letters), ``modified_at``, ``n_bytes`` of the files below ``root``; nothing is opened.

    Folders that ``pruned`` names, hidden ones and links to folders are never listed, nor those that a filter on the beginning of
    ``rel`` rules out where ``spark.sql.python.filterPushdown.enabled`` is on. A subtree below the level at which there are
    ``tasks`` folders is listed by one task. A root that is missing is an error, an empty one gives no rows.
    """
    spark.dataSource.register(FolderSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("folder").options(tasks=str(tasks), pruned=",".join(pruned), pushdown=pushdown).load(qualified(spark, root))


def contents(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows of files with their ``content``. Names are dealt over ``tasks`` first, so a folder that has most files is many tasks' work.

    Files that went away since they were listed are left out, as though the scan had come later.
    """
    tasks = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = files.columns

    def read(batches):
        kept, size = [], 0
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):
                store, place = _open(path)
                try:
                    with store.open_input_stream(place) as f:
                        body = f.read()
                except FileNotFoundError:
                    continue
                kept.append(pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([body], pa.binary())], [*names, "content"]))
                size += len(body)
                if size >= BATCH_BYTES:
                    yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
                    kept, size = [], 0
        if kept:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()

    schema = files.withColumn("content", F.lit(None).cast("binary")).schema
    return files.repartition(tasks, "path").mapInArrow(read, schema)


def put(rows: DataFrame, root: str) -> None:
    """Write ``rel``, ``content`` of each row as a file below ``root``, in place of an older one; of two rows of a name one stays."""
    rows.sparkSession.dataSource.register(FolderSource)
    rows.select("rel", "content").write.format("folder").mode("append").save(qualified(rows.sparkSession, root))
