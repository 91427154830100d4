"""Quality rules: counts of each text, and cross-document line frequency per host.

Lines are normalised (ASCII lower case, digits as 0, white space as one space) and hashed with their host. A line is above
the limits when enough distinct documents of the host have it. A copied or slightly edited document brings all of its lines
along and is no sign of boilerplate: documents that are near copies as a whole, by several least hashes of their word
triples, count together as about one, wherever the line is and whatever stands next to it. ``assess`` counts what is left of each
document without such lines and rejects those of which too little is left; ``clean`` returns the others without the lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import attach, fresh, frugal, written
from .tokens import release, slices

#: Base rules: fewest words, most percent of words in repeated windows, words of a window.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A line is above the limits from so many documents of its host and this share of them, near copies counted together; and
#: if what is so counted is at least this share of the distinct texts that have it.
LINE_DOCS, LINE_SHARE, APART_SHARE = 20, 0.002, 0.1
#: So many documents are enough on any host, however many it has.
LINE_MOST = 200
#: Least hashes of a document, and the rank among their numbers of documents (fewest first) that tells its near copies.
MINIMA, RANK = 8, 3
#: The weight of a document without near copies. Weights are whole numbers, so that sums don't depend on their order.
_WHOLE = 1 << 20
#: A document is depleted with less than this share of its words left, or fewer than so many words.
LEFT_SHARE, MIN_LEFT = 0.1, 5
_SYMBOLS, _SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_SALTS = np.array([xxhash.xxh64_intdigest(bytes([k])) | 1 for k in range(8)], np.uint64)
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside ``WINDOW``-word windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        windows += ids[k : k + n] * _WEIGHTS[k]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.isin(windows, twice)
    running = np.cumsum(np.concatenate([np.zeros(WINDOW, np.int64), starts, np.zeros(WINDOW - 1, np.int64)]))
    return int(np.count_nonzero(running[WINDOW:] - running[:-WINDOW]))


def minima(words: list[bytes], salt: int) -> list[int]:
    """The least hash of three adjacent words, by each of ``MINIMA`` hash functions: near copies mostly agree in most of them."""
    ids = np.fromiter(map(zlib.crc32, [*words, *[b""] * (3 - len(words))]), np.uint64)
    triples = ids[:-2] * _WEIGHTS[0] + ids[1:-1] * _WEIGHTS[1] + ids[2:] * _WEIGHTS[2]
    triples = (triples ^ (triples >> np.uint64(29))) * _WEIGHTS[3]
    triples ^= triples >> np.uint64(32)
    least = [int(((triples * k) >> np.uint64(1)).min()) for k in _SALTS[:MINIMA]]
    return [xxhash.xxh64_intdigest(b"%d %d %d" % (salt, k, x)) - (1 << 63) for k, x in enumerate(least)]


def line_key(host: bytes, words: list[bytes]) -> int:
    """A line's hash with its host, from its normalised words."""
    return _signed(host + b"\0" + b" ".join(words))


def without(text: str, host: bytes, gone: set[int]) -> str:
    """The text without the lines whose keys are in ``gone``; other lines, blank ones too, stay as they are."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    left = [line for line in lines if not (words := line.translate(_FOLD).split()) or line_key(host, words) not in gone]
    return b"\n".join(left).decode("utf-8", "surrogatepass")


def measure(text: str, host: bytes) -> tuple[tuple, list[tuple[int, int]], list[int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), (line, words) of each distinct line, and the minima of the text on its host."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    chars = len(text) - (len(data) - len(data.translate(None, _SPACE)))
    counts = (len(words), chars, len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))
    split = [line.translate(_FOLD).split() for line in lines]
    keys = [line_key(host, s) for s in split]
    found: dict[int, int] = {}
    for key, s in zip(keys, split):
        found[key] = found.get(key, 0) + len(s)
    return counts, list(found.items()), minima([w for s in split for w in s], _signed(host))


def _signed(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


MEASURES = "row long, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, sig long, host_key long, minima array<long>, lines array<struct<line: long, words: int>>"


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per document with its counts, a hash of its text and host, its minima and its distinct lines."""
    names = [f.split()[0] for f in MEASURES.split(", ", 9)[:9]]
    line_type = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        row = TaskContext.get().partitionId() << 36
        for part, texts in slices(batches, "text"):
            heads, lines, least = [], [], []
            for doc, host, text in zip(part.column("doc_id").to_pylist(), part.column("host").to_pylist(), texts):
                name = host.encode("utf-8", "surrogatepass")
                counts, own, small = measure(text, name)
                heads.append((row, doc, *counts, _signed(name + b"\0" + text.encode("utf-8", "surrogatepass")), _signed(name)))
                lines.append([{"line": a, "words": b} for a, b in own])
                least.append(small)
                row += 1
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*heads)), pa.array(least, pa.list_(pa.int64())), pa.array(lines, line_type)], [*names, "minima", "lines"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    return rows.select("doc_id", "host", "text").mapInArrow(frugal(run), MEASURES)


def _weights(heads: DataFrame) -> DataFrame:
    """``sig``, ``weight`` of each text that has near copies on its host: about one over their number, itself counted in."""
    texts = heads.groupBy("sig").agg(F.any_value("minima").alias("minima")).select("sig", F.explode("minima").alias("least"))
    texts = written(texts, "minima")
    crowds = written(texts.groupBy("least").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "crowds")
    met = attach(texts, crowds, "least", "n", texts.count(), how="inner")
    # Minima that no other text has are not in ``met``: they are the least numbers, ones.
    lone = F.lit(MINIMA) - F.size("ns")
    rank = F.when(lone >= RANK, 1).otherwise(F.element_at("ns", F.greatest(F.lit(RANK) - lone, F.lit(1))))
    found = met.groupBy("sig").agg(F.sort_array(F.collect_list("n")).alias("ns"))
    return found.select("sig", F.floor(F.lit(_WHOLE) / rank).alias("weight")).where(F.col("weight") < _WHOLE)


def _judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, apart_share: float = APART_SHARE, line_most: int = LINE_MOST, left_share: float = LEFT_SHARE) -> tuple[DataFrame, DataFrame]:
    """The rows of ``assess``, and ``doc_id``, ``row``, ``line``, ``words`` of each common line of each row."""
    heads = written(measured(docs, id_col, text_col, host_col), "measured")
    rows = heads.select("row", "doc_id", "sig", "host_key", F.explode("lines").alias("l")).select("row", "doc_id", "sig", "host_key", "l.line", "l.words")
    # Copies count once; then texts by line, near copies together. Each step sums up before it shuffles.
    distinct = rows.groupBy("line", "sig").agg(F.count(F.lit(1)).alias("rows"), F.min("host_key").alias("host_key"))
    distinct = distinct.join(written(_weights(heads), "near-weights"), "sig", "left")
    weight = F.coalesce("weight", F.lit(_WHOLE))
    lines = distinct.groupBy("line").agg(F.count(F.lit(1)).alias("texts"), (F.sum(weight) / _WHOLE).alias("docs"), F.sum("rows").alias("rows"), F.min("host_key").alias("host_key"))
    many = lines.where((F.col("docs") >= line_docs) & (F.col("docs") >= F.lit(apart_share) * F.col("texts")))
    hosts = heads.groupBy("host_key").agg(F.count(F.lit(1)).alias("host_docs"))
    common = written(many.join(hosts, "host_key").where(F.col("docs") >= F.least(F.lit(line_share) * F.col("host_docs"), F.lit(float(line_most)))).select("line", "rows", F.lit(True).alias("common")), "common-lines")
    out = attach(rows.select("row", "doc_id", "line", "words"), common, "line", "rows", rows.count(), how="inner")
    gone = out.groupBy("row").agg(F.count(F.lit(1)).alias("n_common_lines"), F.sum("words").alias("gone"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    joined = heads.drop("lines", "minima", "sig", "host_key").join(gone, "row", "left").withColumn("n_words_left", left).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("n_words_left") >= MIN_LEFT) & (F.col("n_words_left") >= F.lit(left_share) * F.col("n_words"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    verdicts = joined.select(F.col("doc_id").alias(id_col), *names, kept.alias("kept"), F.coalesce("n_common_lines", F.lit(0)).cast("long").alias("n_common_lines"), F.col("n_words_left").cast("long").alias("n_words_left"))
    return verdicts, out


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``id_col``, the counts, ``base_failed``, ``kept``, ``n_common_lines``, ``n_words_left``.

    A null or empty text has no words and fails the base rules; a null host counts as the empty host. Copies of a text count
    as one document in line frequencies, and repeated rows are rows of their own in the result. An empty table gives none.
    Options are those of ``_judged``.
    """
    return _judged(docs, id_col, text_col, **options)[0]


def _rejected(verdicts: DataFrame, id_col: str) -> DataFrame:
    return written(verdicts.groupBy(id_col).agg(F.max("kept").alias("kept")).where("not kept").select(id_col), "rejected")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. Rows that share an identifier go only if all of them fail."""
    bad = _rejected(assess(docs, id_col, text_col, **options), id_col)
    return docs.join(bad, docs[id_col].eqNullSafe(bad[id_col]), "left_anti")


@F.pandas_udf(StringType())
def _without(texts: pd.Series, hosts: pd.Series, gone: pd.Series) -> pd.Series:
    return pd.Series([None if g is None else without(t or "", h.encode("utf-8", "surrogatepass"), set(g.tolist())) for t, h, g in zip(texts, hosts, gone)], dtype=object)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars", **options) -> DataFrame:
    """The rows that ``keep_good`` returns, without the common lines of their host in ``text_col``, and with ``chars_col`` to match where there is one.

    Whether a line is common depends on host and line alone, so rows that share an identifier share a list of such lines. Other
    columns, whatever their names, stay as they are.
    """
    verdicts, lines = _judged(docs, id_col, text_col, host_col, **options)
    bad = _rejected(verdicts, id_col)
    id_, gone_, clean_ = (fresh(docs, n) for n in ("id", "gone", "clean"))
    gone = written(lines.groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set("line").alias(gone_)), "lines-gone")
    good = docs.join(bad, docs[id_col].eqNullSafe(bad[id_col]), "left_anti")
    good = good.join(gone, good[id_col].cast("long").eqNullSafe(gone[id_]), "left")
    # Texts without such lines don't travel to Python.
    some = F.col(gone_).isNotNull()
    host = F.when(some, F.coalesce(F.col(host_col).cast("string"), F.lit("")))
    good = good.withColumn(clean_, _without(F.when(some, F.col(text_col)), host, F.col(gone_)))
    text = F.when(some & F.col(text_col).isNotNull(), F.col(clean_)).otherwise(F.col(text_col))
    kinds = dict(docs.dtypes)
    chars = F.when(some, F.length(text)).otherwise(F.col(chars_col)).cast(kinds[chars_col]) if chars_col in kinds else None
    new = {text_col: text} | ({} if chars is None else {chars_col: chars})
    return good.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
