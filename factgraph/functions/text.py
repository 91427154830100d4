"""Text functions as Catalyst expressions: normal forms that feed checksums, grounding, paths and display."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Directories whose parent names the project, and punctuation that chunk normalisation deletes.
DOC_DIRECTORIES = ("docs", "doc", "documentation")
_MARKDOWN_PUNCTUATION = r"[*`_~>\-\[\],.?!;:'\"]"


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def trim_control(c: Column) -> Column:
    """Trim characters up to U+0020 at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+", ""), r"[\x00-\x20]+$", "")


def normalize_chunk(c: Column) -> Column:
    """Lower case, without heading marks, code fences and Markdown punctuation, white space as one space."""
    c = F.regexp_replace(F.lower(c), r"(?m)^#+\s*(.*)$", "$1")
    c = F.regexp_replace(c, r"(?s)```.*?\n(.*?)```", "$1")
    c = F.regexp_replace(c, _MARKDOWN_PUNCTUATION, "")
    return trim_control(F.regexp_replace(c, r"\s+", " "))


def chunk_checksum(section_path: Column, normalized: Column) -> Column:
    return sha256(F.concat(section_path, normalized))


def semantic_checksum(subject: Column, predicate: Column, obj: Column) -> Column:
    return sha256(F.concat_ws("|", F.upper(subject), F.upper(predicate), F.upper(obj)))


def normalize_grounding(c: Column) -> Column:
    """White space as one space, then only ASCII word characters and spaces, trimmed, lower case (in this order)."""
    return F.lower(trim_control(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"[^\w\s]", "")))


def in_order(words: Column, text: Column) -> Column:
    """Whether each of ``words`` (ASCII word characters) is found in a one-line text after the one before.

    Each search is an atomic group: it takes the first place and never goes back, so the cost is one pass over the text.
    """
    pattern = F.array_join(F.transform(words, lambda w: F.concat(F.lit("(?>.*?"), w, F.lit(")"))), "")
    return F.regexp_like(text, F.concat(F.lit("^"), pattern))


def grounded(raw: Column, chunk: Column) -> Column:
    """Whether a chunk supports a quoted text: whole, from its fourth word on, or its words in order."""
    return grounded_in(normalize_grounding(raw), normalize_grounding(chunk))


def grounded_in(raw: Column, chunk: Column) -> Column:
    """``grounded`` of texts that are in normal form; both are read several times, so they should be columns."""
    words = F.filter(F.split(raw, " "), lambda w: w != "")
    n = F.size(words)
    whole = chunk.contains(raw)
    tail = chunk.contains(F.array_join(F.slice(words, F.least(F.lit(3), n - 3) + 1, n), " "))
    return F.when(whole, True).otherwise(F.when((n > 4) & tail, True).otherwise(in_order(words, chunk)))


def with_grounded(records: DataFrame, raw: str, chunk: str, name: str) -> DataFrame:
    """``records`` with whether their chunk supports them; each text is brought to its normal form once. Null texts support nothing."""
    out = records.withColumn("_raw_form", normalize_grounding(F.col(raw))).withColumn("_chunk_form", normalize_grounding(F.col(chunk)))
    return out.withColumn(name, F.coalesce(grounded_in(F.col("_raw_form"), F.col("_chunk_form")), F.lit(False))).drop("_raw_form", "_chunk_form")


def normalize_entity(c: Column) -> Column:
    """Lower case without white space, ``_`` and ``-``; null becomes empty."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s_-]+", "")


def node_id(name: Column) -> Column:
    return sha256(normalize_entity(name))


def name_key(name: Column) -> Column:
    """What a node is known by in joins and groups: its normal form, or the digest of one that is not shorter than a digest."""
    form = normalize_entity(name)
    return F.when(F.octet_length(form) < 32, form.cast("binary")).otherwise(F.unhex(sha256(form)))


def key_id(key: Column) -> Column:
    """The ``node_id`` of a ``name_key``."""
    return F.when(F.octet_length(key) < 32, F.sha2(key, 256)).otherwise(F.lower(F.hex(key)))


def assertion_id(document: Column, seq: Column, checksum: Column) -> Column:
    return sha256(F.concat_ws("|", document, seq, checksum))


def assertion_key(document: Column, seq: Column, subject: Column, predicate: Column, obj: Column) -> tuple[Column, Column]:
    """What an assertion is known by in joins and groups, as ``assertion_id`` and shorter: ``place``, and what is ``said`` there."""
    form = F.concat_ws("|", F.upper(subject), F.upper(predicate), F.upper(obj))
    place = F.when(document.isNotNull() | seq.isNotNull(), F.concat_ws("|", document, seq.cast("string")))
    return place.alias("place"), F.when(F.octet_length(form) < 32, form.cast("binary")).otherwise(F.unhex(sha256(form))).alias("said")


def assertion_key_id(place: Column, said: Column) -> Column:
    """The ``assertion_id`` of an ``assertion_key``."""
    return sha256(F.concat_ws("|", place, key_id(said)))


def edge_id(from_node: Column, predicate: Column, to_node: Column) -> Column:
    return sha256(F.concat(from_node, predicate, to_node))


def project_root(path: Column) -> Column:
    """The parent directory's name, or the one above if that is a documentation directory; empty without a parent."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != "")
    parent = F.get(parts, F.size(parts) - 2)
    above = F.get(parts, F.size(parts) - 3)
    inside = F.lower(parent).isin(*DOC_DIRECTORIES)
    return F.coalesce(F.when(F.size(parts) < 2, F.lit("")).when(inside, above).otherwise(parent), F.lit(""))


def normalize_path(path: Column, root: Column) -> Column:
    """Forward slashes, upper-case drive letter, relative to ``root`` where it is below it."""
    def clean(p: Column) -> Column:
        p = F.translate(p, "\\", "/")
        drive = F.regexp_extract(p, r"^([A-Za-z]):", 1)
        return F.when(drive != "", F.concat(F.upper(drive), F.substring(p, 2, 1 << 20))).otherwise(p)

    p, r = clean(path), F.regexp_replace(clean(root), r"/+$", "")
    below = F.startswith(p, F.concat(r, F.lit("/")))
    return F.when(below, F.substring(p, F.length(r) + 2, F.lit(1 << 20))).otherwise(p)


def search_tokens(c: Column) -> Column:
    """Words of the search index: lower-case runs of letters, digits and ``_``."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def token_estimate(c: Column) -> Column:
    """Tokens of a text without a vocabulary: one for each four characters of a word, at least one, and one a mark."""
    words = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.ceil(F.length(w) / 4).cast("int"))


@functools.lru_cache(maxsize=4)
def _vocabulary(ranks: str, pattern: str):
    """An encoder a worker process."""
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_counter(ranks: str, pattern: str):
    """A function of a text column: its tokens by a byte-pair vocabulary, a file of base64 tokens and their ranks.

    The file must be at that path on every executor, and ``pattern`` is the vocabulary's own. Null texts have no tokens.
    """

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(x) for x in _vocabulary(ranks, pattern).encode_ordinary_batch([t or "" for t in texts], num_threads=1)], dtype="int32")

    return count


def display_text(c: Column) -> Column:
    """A text on one line of fields: line ends become spaces, bars commas."""
    return F.translate(c, "\n\r|", "  ,")


def friendly_group(c: Column) -> Column:
    return F.initcap(F.lower(F.translate(c, "_", " ")))


def minutes_seconds(seconds: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int"))


def retry_delay_ms(message: Column) -> Column:
    """Milliseconds from a provider's ``try again in X s`` (or ms), and half a second; null without one."""
    number = F.regexp_extract(message, r"(?i)try again in ([0-9.]+)\s*(ms|s)", 1)
    unit = F.lower(F.regexp_extract(message, r"(?i)try again in ([0-9.]+)\s*(ms|s)", 2))
    ms = number.try_cast("double")
    return F.when(number != "", F.ceil(F.when(unit == "ms", ms).otherwise(ms * 1000)).cast("long") + 500)


def prompt(section: Column, content: Column, predicates: Column) -> Column:
    """A request to an extractor: allowed predicates, where the text stands, and the text."""
    names = F.concat(F.lit('["'), F.array_join(predicates, '",\n"'), F.lit('"]'))
    return F.format_string("State the facts of this section as JSON.\nUse these predicates: %s\nSection: %s\nText:\n%s", names, section, content)
