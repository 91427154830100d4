"""Session defaults and helpers shared by the operators."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that every result relies on (time zone) or that plans expect (AQE).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def get_session(app: str = "factgraph", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Make an existing session usable: UTC, and this package importable in Python workers."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(maxsize=None)
def _own_root(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='factgraph-checkpoints-')}"


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


def hadoop(spark: SparkSession, path: str):
    """A path and its file system, whatever kind it is."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


#: Folders of applications that go when they end.
_MARKED: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses; it goes when the application ends."""
    own = f"{shared_root(spark)}/factgraph-core-{spark.sparkContext.applicationId}"
    if own not in _MARKED:
        path, fs = hadoop(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MARKED.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


#: What a task takes of files and of shuffles where its rows are sorted before they are written: a million rows or so of names.
SMALL_TASKS = {"spark.sql.files.maxPartitionBytes": "16m", "spark.sql.files.openCostInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings for what runs within; they are as before afterwards."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cut(df: DataFrame, hop: int) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder at every second hop, so that long loops stay short."""
    if hop < 2 or hop % 2:
        return df
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()
