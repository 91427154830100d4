"""URL filters: a temporal join of captures with dated list entries.

A list is a log of dated entries (key, date, action). Entries of a key become validity intervals ``[from, to)``, each
ending where the key's next one begins. A capture asks for every key that can match its URL, from the exact URL over path
prefixes to the parent domains of its host, and each asked key is joined with the one interval that holds at fetch time, to
the microsecond. The most specific match decides. Keys and URLs are normalised by one function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

#: Bytes of intervals (as estimated: 200 a row) up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 200
#: A key that at least so many captures ask for, and one in so many of all that are asked, is joined without a shuffle.
HEAVY_ROWS, HEAVY_KEYS = 1000, 2000


def normalised(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without user, port, trailing dot or leading ``www.``) and path (without query and fragment)."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"[?#].*$", "")
    authority = F.regexp_extract(rest, r"^([^/]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r":[0-9]*$", ""), r"\.$", ""), r"^www\.", "")
    return host, F.regexp_replace(F.substring(rest, F.length(authority) + 1, F.length(rest)), r"/+$", "")


def keys(host: Column, path: Column) -> Column:
    """All keys that match, most specific first: host and every path prefix (``host/a/b``), then the host and every parent."""
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts)
    down = F.when(n > 0, F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))).otherwise(F.array().cast("array<string>"))
    last = F.greatest(F.size(labels) - 2, F.lit(0))  # no bare top-level domain
    up = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    return F.filter(F.concat(down, up), lambda k: k != "")


def one_key(key: Column) -> Column:
    """A list's key in the form that captures ask for: its host and path as of a URL."""
    host, path = normalised(key)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.concat(host, F.lit("/"), F.array_join(parts, "/"))).otherwise(host)


def intervals(entries: DataFrame, key_col: str = "key", date_col: str = "date", action_col: str = "action") -> DataFrame:
    """``key``, ``action``, ``valid_from``, ``valid_to`` (null: still valid) from a log of entries.

    A date is valid from its midnight (UTC) on, a time from that very moment. Of entries of one key and time, ``block`` holds
    before ``allow`` before ``remove``. ``remove`` ends what was valid and makes no interval; entries with a null key, or no or
    a malformed date, don't count. Keys are host names, or hosts and paths; a scheme, user, port, leading ``www.``, query,
    fragment or trailing slash is left off and the host lower-cased, as with URLs. Repeated entries count once.
    """
    rank = F.when(F.col(action_col) == "block", 0).when(F.col(action_col) == "allow", 1).otherwise(2)
    log = entries.select(one_key(F.col(key_col)).alias("key"), F.col(date_col).try_cast("timestamp_ntz").alias("valid_from"), F.struct(rank.alias("rank"), F.col(action_col).alias("action")).alias("a"))
    log = log.where("key != '' and valid_from is not null").groupBy("key", "valid_from").agg(F.min("a").alias("a"))
    log = log.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("key").orderBy("valid_from")))
    return log.where("a.action in ('block', 'allow')").select("key", "a.action", "valid_from", "valid_to")


def _holding(asked: DataFrame, spans: DataFrame, broadcast_bytes: int, heavy_rows: int) -> DataFrame:
    """Asked keys with the interval that holds. A list too large to broadcast is shuffled, but for the keys that many ask for."""
    holds = (F.col("a.key") == F.col("s.key")) & (F.col("s.valid_from") <= F.col("a.fetched")) & (F.col("s.valid_to").isNull() | (F.col("a.fetched") < F.col("s.valid_to")))

    def held(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.alias("a").join(right.alias("s"), holds).select("a._id", "a._what", F.struct("a._rank", "s.key", "s.action", "s.valid_from").alias("hit"))

    if spans.count() * ROW_BYTES <= broadcast_bytes:
        return held(asked, F.broadcast(spans))
    often = written(asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "asked-keys")
    least = max(heavy_rows, (often.agg(F.sum("n")).first()[0] or 0) // HEAVY_KEYS)
    heavy = written(often.where(F.col("n") >= least).select("key"), "heavy-keys")  # at most HEAVY_KEYS, or all are light
    forget(often)
    few = spans.join(F.broadcast(heavy), "key", "left_semi")
    if few.count() * ROW_BYTES > broadcast_bytes:  # adaptive execution splits what is left of the skew
        return held(asked, spans)
    rest = asked.join(F.broadcast(heavy), "key", "left_anti")
    return held(asked.join(F.broadcast(heavy), "key", "left_semi"), F.broadcast(few)).unionByName(held(rest, spans))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched", broadcast_bytes: int = BROADCAST_BYTES, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """One row per capture: ``id_col``, ``host``, ``fetched``, ``verdict``, ``matched_key``, ``valid_from``.

    ``verdict`` is ``block``, ``allow`` or ``none`` (no entry held, or url or time is null). Repeated rows, and rows without an
    identifier, are evaluated each for itself. Paths of any depth and hosts of any length ask for all their prefixes and
    parents. Other columns, whatever their names, are left out. An empty list gives ``none`` throughout, an empty table no rows.
    """
    spans = written(intervals(entries), "intervals")
    host, path = normalised(F.col(url_col))
    rows = captures.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("_path"), F.col(time_col).try_cast("timestamp_ntz").alias("fetched"))
    rows = rows.withColumn("_what", F.xxhash64("host", "_path", "fetched"))
    asked = rows.where("fetched is not null").select("_id", "_what", "fetched", F.posexplode(keys(F.col("host"), F.col("_path"))).alias("_rank", "key"))
    found = _holding(asked, spans, broadcast_bytes, heavy_rows).groupBy("_id", "_what").agg(F.min("hit").alias("best"))
    found = found.select(F.col("_id").alias("_fid"), F.col("_what").alias("_fwhat"), "best")
    out = rows.join(found, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_what") == F.col("_fwhat")), "left")
    return out.select(F.col("_id").alias(id_col), "host", "fetched", F.coalesce("best.action", F.lit("none")).alias("verdict"), F.col("best.key").alias("matched_key"), F.col("best.valid_from").alias("valid_from"))
