"""Windows over keys that may hold most rows: by slices of time first, then over what is left of each slice.

A key's rows of one slice are in one task, not all of a key's. What a row needs of earlier slices comes from a table of one row
per key and slice. Null keys are a key, null times a slice of their own before all others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a slice; a day.
SLICE = 86_400


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def slice_of(ts: str, seconds: int = SLICE) -> Column:
    return F.floor(micros(ts) / (seconds * 1_000_000))


def attach(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what ``small`` has for their ``keys``, nulls being equal."""
    other = small.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *(c for c in small.columns if c not in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    return rows.join(other, same, "left").drop(*(f"_of_{k}" for k in keys))


def numbered(rows: DataFrame, key: str, ts: str, *order: str, seconds: int = SLICE) -> DataFrame:
    """``rows`` with ``_n``, their number within their key from 0 by ``ts`` and ``order``."""
    cut = rows.withColumn("_slice", slice_of(ts, seconds))
    counts = cut.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy(key).orderBy("_slice")) - F.col("_c")).drop("_c")
    within = F.row_number().over(Window.partitionBy(key, "_slice").orderBy(ts, *order)) - 1
    out = attach(cut.withColumn("_r", within), before, [key, "_slice"])
    return out.withColumn("_n", F.col("_before") + F.col("_r")).drop("_slice", "_before", "_r")


def previous(rows: DataFrame, keys: list[str], at: str, values: list[str], seconds: int = SLICE) -> DataFrame:
    """``rows`` with ``_previous``: ``at`` and ``values`` of the row before by ``at``, of the same keys; null for the first."""
    row = F.struct(at, *values)
    cut = rows.withColumn("_slice", slice_of(at, seconds))
    last = cut.groupBy(*keys, "_slice").agg(F.max_by(row, F.struct(at)).alias("_last"))
    before = last.withColumn("_earlier", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice"))).drop("_last")
    out = attach(cut.withColumn("_own", F.lag(row).over(Window.partitionBy(*keys, "_slice").orderBy(at))), before, [*keys, "_slice"])
    return out.withColumn("_previous", F.coalesce("_own", "_earlier")).drop("_slice", "_own", "_earlier")


def running_max(rows: DataFrame, keys: list[str], place: str, value: Column, name: str, block: int = 4096) -> DataFrame:
    """``rows`` with the largest ``value`` up to their ``place`` (from 0, without gaps) among their keys."""
    cut = rows.withColumn("_v", value).withColumn("_block", F.floor(F.col(place) / block))
    tops = cut.groupBy(*keys, "_block").agg(F.max("_v").alias("_top"))
    before = tops.withColumn("_above", F.max("_top").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    own = F.max("_v").over(Window.partitionBy(*keys, "_block").orderBy(place))
    out = attach(cut.withColumn("_own", own), before, [*keys, "_block"])
    return out.withColumn(name, F.greatest("_own", "_above")).drop("_v", "_block", "_own", "_above")


def counted_back(rows: DataFrame, key: str, ts: str, seconds: int, name: str) -> DataFrame:
    """``rows`` with the number of rows of their key in the ``seconds`` up to them, themselves and equal times included.

    A slice is as long as that, so a row counts in its own slice and in the next one; each is a task's share.
    """
    own = rows.withColumn("_own", slice_of(ts, seconds)).withColumn("_us", micros(ts))
    both = own.withColumn("_slice", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy(key, "_slice").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    out = both.withColumn(name, F.count(F.lit(1)).over(w))
    return out.where(F.col("_slice").eqNullSafe(F.col("_own"))).drop("_own", "_us", "_slice")
