"""Validation of extracted records: required fields, grounding, predicate resolution, and what goes to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..session import cut

#: So many distinct names are sent to the records; joined by a shuffle, all records would meet at the few names that they have.
SENT_NAMES = 200_000


def blank(c: str) -> Column:
    return ~F.coalesce(F.regexp_like(F.col(c), F.lit(r"\S")), F.lit(False))


def reject_reason(resolved: str = "resolved", grounded: str = "_grounded") -> Column:
    """The first rule that a record breaks, in the order in which the rules are checked; null if it is valid."""
    return (
        F.when(blank("subject_text"), "SUBJECT").when(blank("object_text"), "OBJECT").when(blank("normalized_text"), "NORMALIZED_TEXT")
        .when(F.col(resolved).isNull(), "PREDICATE").when(blank("raw_text"), "RAW_TEXT").when(~F.col(grounded), "GROUNDING")
    )


def validate(records: DataFrame, active: DataFrame, aliases: DataFrame, chunk: str = "chunk_text") -> DataFrame:
    """``records`` with ``resolved``, ``reject_reason`` and ``outcome``: accepted, collapsed, queued or rejected.

    A record whose only fault is its predicate is collapsed to the nearest active name within two edits, else queued.
    """
    # Names are few and are resolved by themselves, the nearest of all that are not known too; so the records, whose grounding is
    # by far the dearest rule, are gone through once.
    names = P.resolve(records.select("predicate").distinct(), active, aliases)
    near = P.nearest(names.where("resolved is null"), active).select(F.col("predicate").alias("_near_of"), "nearest")
    names = names.join(near, F.upper("predicate") == F.col("_near_of"), "left").select(F.col("predicate").alias("_name"), "resolved", "nearest")
    if not records.isStreaming:
        names = cut(names, 2)
        names = F.broadcast(names) if names.limit(SENT_NAMES + 1).count() <= SENT_NAMES else names
    known = T.with_grounded(records, "raw_text", chunk, "_grounded")
    known = known.join(names, known["predicate"] == names["_name"], "left").drop("_name").withColumn("reject_reason", reject_reason())
    only = (F.col("reject_reason") == "PREDICATE") & ~blank("raw_text") & ~blank("predicate") & F.col("_grounded")
    out = known.withColumn("_only", F.coalesce(only, F.lit(False)))
    outcome = F.when(F.col("reject_reason").isNull(), "accepted").when(F.col("_only") & F.col("nearest").isNotNull(), "collapsed").when(F.col("_only"), "queued").otherwise("rejected")
    return out.withColumn("outcome", outcome).withColumn("resolved", F.coalesce("resolved", F.when(F.col("_only"), F.col("nearest")))).drop("_only", "_grounded", "nearest")
