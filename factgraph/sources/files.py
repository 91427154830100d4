"""Files: discovery with pruning and globs, whole-text reading, configuration, tables and their latest-wins stores."""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hadoop
from . import folders
from .folders import PRUNED

# What is read by default.
EXTENSIONS = ("md", "txt", "xlsx")
INCLUDE = ("**/*.md", "docs/**/*.md", "README.md")
EXCLUDE = ("node_modules/**", ".git/**", "dist/**", "build/**", ".factgraph/**", "**/.*/**")


@dataclass
class Config:
    """Settings that queries and streams read; ``load`` merges a JSON file over the defaults."""

    include: list[str] = field(default_factory=lambda: list(INCLUDE))
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDE))
    watch_directories: list[str] = field(default_factory=list)
    llm: dict = field(default_factory=lambda: {"provider": "ollama", "rate_limit": 5, "rate_limit_enabled": False, "timeout_s": 120})

    @classmethod
    def load(cls, path: str) -> Config:
        out = cls()
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                given = json.load(f)
            for key in ("include", "exclude", "watch_directories"):
                if given.get(key):
                    setattr(out, key, list(given[key]))
            out.llm |= {k: v for k, v in given.get("llm", {}).items() if v is not None}
        return out

    def save(self, path: str) -> None:
        temporary = f"{path}.{uuid.uuid4().hex}"
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)
        os.replace(temporary, path)


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression: ``*`` within a name, ``**`` across names, ``?``, ``[...]`` and ``{a,b}``."""
    out, k, depth = "", 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "[" and "]" in glob[k + 1 :]:
            end = glob.index("]", k + 1)
            body = glob[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + body[1:] if body.startswith("!") else body) + "]", end + 1
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        k += 1
    return f"^{out}$"


def relative(path: Column, roots: list[str], default: str) -> Column:
    """``path`` below the first root that holds it, or below ``default``."""
    clean = F.translate(path, "\\", "/")
    rule = None
    for root in [*roots, default]:
        base = root.replace("\\", "/").rstrip("/") + "/"
        inside, rest = F.startswith(clean, F.lit(base)), F.substring(clean, F.lit(len(base) + 1), F.length(clean))
        rule = F.when(inside, rest) if rule is None else rule.when(inside, rest)
    return rule.otherwise(clean)


def should_index(path: Column, config: Config, default_root: str = "/") -> Column:
    """Whether the globs take a file: no exclusion may match its relative path, and an inclusion must."""
    rel = relative(path, config.watch_directories, default_root)
    def any_of(globs: list[str]) -> Column:
        return F.regexp_like(rel, F.lit("|".join(map(glob_regex, globs)))) if globs else F.lit(False)

    return ~any_of(config.exclude) & any_of(config.include)


def pruned(path: Column) -> Column:
    """Whether a directory of a relative path is one that scans skip."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(parts, lambda p: p.startswith(".") | p.isin(*PRUNED))


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``path``, ``rel``, ``modified_at``, ``checksum``, ``text``, ``quarantined`` of all files below ``root`` that count.

    Pruned folders are not listed, and names are filtered before contents are read. Files whose own names begin with a dot or an
    underscore count too. Spreadsheets, and what is no UTF-8, are quarantined: their text is null.
    """
    extension = F.col("extension")
    files = folders.contents(folders.listed(spark, root).where(extension.isin(*extensions)))
    text = F.when(extension != "xlsx", F.try_validate_utf8(F.col("content").cast("string")))
    return files.select("path", "rel", "modified_at", F.sha2("content", 256).alias("checksum"), text.alias("text"), text.isNull().alias("quarantined"))


def watch(spark: SparkSession, root: str, glob: str = "*.md", config: Config | None = None, debounce: str | None = None, late: str = "10 seconds") -> DataFrame:
    """A stream of whole texts that appear or change below ``root``: ``path``, ``modified_at``, ``checksum``, ``text``.

    Pruned directories are left out, and what the globs of ``config`` don't take. With ``debounce`` (a gap) a path's changes that
    follow each other closer are one row: the last of them. It is out when the watermark, ``late`` behind, has passed the gap.
    """
    options = {"wholetext": "true", "recursiveFileLookup": "true", "pathGlobFilter": glob}
    base = root.removeprefix("file:").rstrip("/")
    files = spark.readStream.format("text").options(**options).load(root).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified_at"), F.col("value").alias("text"))
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^/*{re.escape(base.lstrip('/'))}/?", "")
    files = files.where(~pruned(below))
    if config is not None:
        files = files.where(should_index(F.regexp_replace("path", r"^[a-z]+:/*", "/"), config, "/" + base.lstrip("/")))
    files = files.withColumn("checksum", F.sha2("text", 256))
    if debounce is None:
        return files
    last = F.max_by(F.struct("modified_at", "checksum", "text"), "modified_at").alias("last")
    return files.withWatermark("modified_at", late).groupBy(F.session_window("modified_at", debounce), "path").agg(last).select("path", "last.*")


def table_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A Parquet table as a stream of the files that it gets; a table that is one file is picked out of its folder."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).options(**options)
    place, fs = hadoop(spark, path)
    if fs.getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def upload(spark: SparkSession, content: bytes, name: str, landing: str) -> str:
    """Put a file into the landing folder under its own name, in place of an older one, and return its path; scans find it there.

    The file is written aside and renamed, so that no scan reads half of it. Names that leave the folder are refused.
    """
    if not name.strip() or name.startswith("/") or ".." in name.replace("\\", "/").split("/"):
        raise ValueError("no file name")
    target, fs = hadoop(spark, f"{landing.rstrip('/')}/{name}")
    aside, _ = hadoop(spark, f"{landing.rstrip('/')}/.upload-{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(aside, True)
    out.write(bytearray(content))
    out.close()
    fs.delete(target, False)
    if not fs.rename(aside, target):
        raise OSError(f"cannot write {target}")
    return target.toString()


def kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A stream from Kafka; needs the connector's jar on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load().select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table by JDBC; needs the driver's jar on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def jdbc_write(rows: DataFrame, url: str, table: str, mode: str = "append", batch: int = 50, **options: str) -> None:
    """Rows into a table by JDBC, ``batch`` a statement; needs the driver's jar on the class path."""
    rows.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode(mode).save()


class Conflict(Exception):
    """Another writer was first; read again and repeat."""


class Store:
    """Tables as versioned Parquet snapshots: a write makes a new directory, then a pointer with the next number.

    A pointer is written aside and renamed to a name that must not be there yet. Readers take the last one, whole or not at all;
    of two writers that saw the same one, the second gets ``Conflict`` instead of losing the first one's rows.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self, name: str) -> list[int]:
        path, fs = hadoop(self.spark, f"{self.root}/{name}")
        if not fs.exists(path):
            return []
        found = (f.getPath().getName() for f in fs.listStatus(path))
        return sorted(int(n[8:]) for n in found if re.fullmatch(r"pointer-\d+", n))

    def last(self, name: str) -> int:
        """The number of the table's last pointer, 0 if there is none."""
        return max(self._pointers(name), default=0)

    def current(self, name: str, number: int | None = None) -> str | None:
        number = self.last(name) if number is None else number
        if not number:
            return None
        path, fs = hadoop(self.spark, f"{self.root}/{name}/pointer-{number:09d}")
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self.last(name) > 0

    def read(self, name: str) -> DataFrame:
        version = self.current(name)
        if version is None:
            raise FileNotFoundError(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, df: DataFrame, after: int | None = None) -> str:
        """A new snapshot that follows pointer ``after`` (the last one by default); ``Conflict`` if that one has a follower already."""
        return self._point(name, *self._snapshot(name, df, after))

    def write_all(self, tables: dict[str, DataFrame]) -> None:
        """New snapshots of several tables, which may be plans over their old ones.

        All rows are written before the first pointer, so what can fail or take long leaves every table as it was; and if a
        table has a follower by then, none gets a new pointer.
        """
        written = {name: self._snapshot(name, df) for name, df in tables.items()}
        for name, (after, _) in written.items():
            if self.last(name) != after:
                raise Conflict(name)
        for name, (after, version) in written.items():
            self._point(name, after, version)

    def _snapshot(self, name: str, df: DataFrame, after: int | None = None) -> tuple[int, str]:
        after = self.last(name) if after is None else after
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{version}")
        return after, version

    def _point(self, name: str, after: int, version: str) -> str:
        target, fs = hadoop(self.spark, f"{self.root}/{name}/pointer-{after + 1:09d}")
        aside, _ = hadoop(self.spark, f"{self.root}/{name}/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(version.encode()))
        out.close()
        if fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            raise Conflict(name)
        return version

    def upsert(self, name: str, rows: DataFrame, key: str, order: str) -> str:
        """Latest-wins merge of ``rows`` into the table."""
        from ..operators.metrics import latest

        after = self.last(name)
        merged = rows if not after else self.spark.read.parquet(f"{self.root}/{name}/{self.current(name, after)}").unionByName(rows, allowMissingColumns=True)
        return self.write(name, latest(merged, key, order).select(*rows.columns), after)

    def append(self, name: str, rows: DataFrame) -> str:
        after = self.last(name)
        return self.write(name, rows if not after else self.spark.read.parquet(f"{self.root}/{name}/{self.current(name, after)}").unionByName(rows, allowMissingColumns=True), after)

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Delete all but the last ``keep`` snapshots."""
        for number in self._pointers(name)[:-keep]:
            version = self.current(name, number)
            for path in (f"{self.root}/{name}/pointer-{number:09d}", f"{self.root}/{name}/{version}"):
                target, fs = hadoop(self.spark, path)
                fs.delete(target, True)
