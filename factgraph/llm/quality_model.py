"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of characters.

The model is trained per language on trusted text. Tasks count the 5-grams of their own texts and Spark adds the counts up;
lower orders use continuation counts, and each order's probabilities come from joins with the order below. The result is
written in shards of bounded size by hash of the n-gram, each sorted. A scoring task counts the distinct n-grams of a run of
texts, sends each to the one shard that may have it and merges them with it, so that a run reads a shard once at most.

Texts are dealt to folds by their hash, and each fold is scored by a model of the trusted texts of all others. So every trusted
document is counted and has a score by a model that has not seen it, or a copy of it, and a language's threshold is the plain
quantile of the scores of all its trusted documents. A document is rejected when its log-perplexity is above it.
"""

from __future__ import annotations

import functools
import io
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, forget, frugal, workspace, written
from .tokens import release, slices

ORDER, BITS = 5, 12
#: Classes of characters: 0 fills the beginnings of texts, 1 is any character without a class of its own, the others are the
#: ``CLASSES - 2`` most frequent code points of a language's trusted text.
CLASSES = 1 << BITS
#: Folds; a trusted document is counted in the models of all folds but its own.
FOLDS = 2
#: The threshold: this quantile of the trusted documents' log-perplexity.
QUANTILE = 0.99
#: Entries of a shard (13 bytes each), bytes of shards that a worker keeps during a task, and runs of texts that are scored
#: together where the shards of a model take more, so that each is read once for all of them.
SHARD_ENTRIES, KEPT_BYTES, RUNS = 2_000_000, 104_000_000, 16
#: Languages, times folds, that models may have; an alphabet of each is held by the driver and by every task.
MAX_LANGUAGES = 2_000
#: Trusted identifiers are broadcast up to so many rows; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
#: N-grams that a task holds before it hands on the counts of a language.
HELD_GRAMS = 2_000_000
_SLICE = 1_000_000
_PAD = "\0" * (ORDER - 1)
#: Spreads neighbouring n-grams over shards; a prime.
_SPREAD = 1_000_003


def class_table(alphabet: np.ndarray) -> np.ndarray:
    """The class of each code point up to one beyond the alphabet's last, which stands for all that follow."""
    table = np.ones(int(alphabet[-1]) + 2, np.int16)
    table[alphabet] = np.arange(2, len(alphabet) + 2)
    return table


def grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed 5-gram that ends at each character, and each text's length. Beginnings are filled with class 0."""
    joined = "".join(_PAD + t for t in texts).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(joined, "<u4")
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    real = np.ones(len(points), bool)
    begins = np.cumsum(n + ORDER - 1) - n - (ORDER - 1)
    for k in range(ORDER - 1):
        real[begins + k] = False
    classes = np.where(real, table[np.minimum(points, len(table) - 1)], 0).astype(np.int64)
    packed = classes.copy()
    for k in range(1, ORDER):
        packed[k:] |= classes[:-k] << (BITS * k)
    return packed[real], n


def _by_language(part: pa.RecordBatch, texts: list[str]) -> Iterator[tuple[str, list[int], list[str]]]:
    langs: dict[str, list[int]] = {}
    for i, lang in enumerate(part.column("lang").to_pylist()):
        langs.setdefault(lang, []).append(i)
    for lang, own in sorted(langs.items()):
        yield lang, own, [texts[i] for i in own]


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by n-gram of both."""
    keys, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _summed(texts: DataFrame, count, column: str) -> DataFrame:
    """``lang``, ``column``, ``n``: ``count`` of all texts of a language, added up in each task and then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part, texts in slices(batches, "text", _SLICE):
            for lang, _, own in _by_language(part, texts):
                found = np.unique(count(lang, own), return_counts=True)
                held[lang] = _added(held[lang], found) if lang in held else found
            while sum(len(keys) for keys, _ in held.values()) > HELD_GRAMS:
                lang = max(held, key=lambda x: len(held[x][0]))
                yield batch(lang, *held.pop(lang))
        for lang, found in held.items():
            yield batch(lang, *found)

    def batch(lang: str, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["lang", column, "n"])

    return texts.mapInArrow(frugal(run), f"lang string, {column} long, n long").groupBy("lang", column).agg(F.sum("n").alias("n"))


def alphabets(trusted: DataFrame) -> dict[str, np.ndarray]:
    """Of each language the code points that have a class, ascending: at most ``CLASSES - 2``, ties by code point."""

    def points(_: str, texts: list[str]) -> np.ndarray:
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)

    ranked = _summed(trusted, points, "point").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "point")))
    rows = ranked.where(F.col("rank") <= CLASSES - 2).groupBy("lang").agg(F.sort_array(F.collect_list("point")).alias("points")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"trusted text in more than {MAX_LANGUAGES} languages")
    return {r["lang"]: np.array(r["points"], np.int64) for r in rows}


def counted(docs: DataFrame, alphabet: dict[str, np.ndarray]) -> DataFrame:
    """``lang``, ``gram``, ``n`` of all 5-grams."""
    shared, tables = docs.sparkSession.sparkContext.broadcast(alphabet), {}

    def five(lang: str, texts: list[str]) -> np.ndarray:
        if lang not in tables:  # of this task
            tables[lang] = class_table(shared.value[lang])
        return grams(texts, tables[lang])[0]

    return _summed(docs, five, "gram")


@dataclass
class Model:
    """A trained model: where its shards are, their files by language, and the languages' alphabets."""

    folder: str
    shards: dict[str, list[str]]
    alphabet: dict[str, np.ndarray]


def train(trusted: DataFrame) -> Model:
    """Train on ``lang``, ``text``; texts must not be empty."""
    spark = trusted.sparkSession
    alphabet = alphabets(trusted)
    if not alphabet:
        return Model("", {}, {})
    levels = {ORDER: written(counted(trusted, alphabet), "counts")}
    for k in range(ORDER - 1, 0, -1):  # how many characters come before an n-gram
        mask = (1 << (BITS * k)) - 1
        levels[k] = written(levels[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"counts-{k}")
    even = spark.createDataFrame([(lang, 1.0 / (len(points) + 1)) for lang, points in alphabet.items()], "lang string, low double")
    below, parts, tables = None, [], list(levels.values())
    for k in range(1, ORDER + 1):
        level = levels[k]
        seen = level.groupBy("lang").agg(*(F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)))
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))

        def discount(i: int):
            """Discount of count ``i``, kept within what interpolation allows where counts are few."""
            raw = i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(f"n{i}", F.lit(1.0))
            return F.least(F.greatest(F.when(F.col(f"n{i}") > 0, raw).otherwise(0.5 * i), F.lit(0.1 * i)), F.lit(0.95 * i)).alias(f"d{i}")

        rates = F.broadcast(seen.select("lang", *(discount(i) for i in (1, 2, 3))))  # a row per language
        level = level.join(rates, "lang").withColumn("ctx", F.shiftright("gram", BITS))
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        contexts = level.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum(off).alias("off"))
        contexts = written(contexts.select("lang", "ctx", "total", (F.col("off") / F.col("total")).alias("rest")), f"contexts-{k}")
        rows = level.select("lang", "gram", "ctx", (F.col("n") - off).alias("share")).join(contexts, ["lang", "ctx"])
        if below is None:
            rows = rows.join(F.broadcast(even), "lang")  # a row per language
        else:
            mask = (1 << (BITS * (k - 1))) - 1
            rows = rows.withColumn("low_gram", F.col("gram").bitwiseAND(F.lit(mask))).join(below.select("lang", F.col("gram").alias("low_gram"), F.col("p").alias("low")), ["lang", "low_gram"])
        below = written(rows.select("lang", "gram", (F.col("share") / F.col("total") + F.col("rest") * F.col("low")).alias("p")), f"probabilities-{k}")
        tables += [contexts, below]
        parts.append(below.select("lang", F.lit(k).alias("kind"), F.col("gram").alias("key"), F.log("p").cast("float").alias("value")))
        parts.append(contexts.select("lang", F.lit(-k).alias("kind"), F.col("ctx").alias("key"), F.log("rest").cast("float").alias("value")))
    model = functools.reduce(DataFrame.unionByName, parts)
    sizes = {r["lang"]: r["count"] for r in model.groupBy("lang").count().collect()}  # a row per language
    folder, count = workspace(spark, "model"), F.lit(1)
    for lang, n in sizes.items():
        if n > SHARD_ENTRIES:
            count = F.when(F.col("lang") == lang, -(-n // SHARD_ENTRIES)).otherwise(count)

    def save(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        frame, out = frame.sort_values(["kind", "key"]), io.BytesIO()
        np.savez(out, kind=frame["kind"].to_numpy(np.int8), key=frame["key"].to_numpy(np.int64), value=frame["value"].to_numpy(np.float32))
        name = f"shard-{uuid.uuid4().hex}.npz"  # a shard that is written twice has two names, of which one is returned
        with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
            f.write(out.getvalue())
        return pd.DataFrame({"lang": [key[0]], "shard": [key[1]], "file": [name]})

    dealt = model.withColumn("shard", F.pmod(F.pmod("key", F.lit(_SPREAD)), count).cast("int"))
    files = dealt.groupBy("lang", "shard").applyInPandas(save, "lang string, shard int, file string").collect()  # a row for 2,000,000 entries
    shards = {lang: [""] * -(-n // SHARD_ENTRIES) for lang, n in sizes.items()}
    for r in files:
        shards[r["lang"]][r["shard"]] = r["file"]
    forget(*tables)
    return Model(folder, shards, alphabet)


#: Shards that this worker has read, those used last at the end.
_KEPT: OrderedDict[tuple[str, str], dict[int, tuple[np.ndarray, np.ndarray]]] = OrderedDict()


def _shard(folder: str, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted n-grams and values of a shard, by kind."""
    if not name:
        return {}
    if (folder, name) in _KEPT:
        _KEPT.move_to_end((folder, name))
        return _KEPT[folder, name]
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        data = np.load(io.BytesIO(f.read()))
        kind, key, value = data["kind"], data["key"], data["value"]
    kinds, begins = np.unique(kind, return_index=True)
    read = {int(k): (key[a:b], value[a:b]) for k, a, b in zip(kinds, begins, [*begins[1:], len(kind)])}
    _KEPT[folder, name] = read
    while len(_KEPT) > 1 and sum(key.nbytes + value.nbytes for shard in _KEPT.values() for key, value in shard.values()) > KEPT_BYTES:
        _KEPT.popitem(last=False)
    return read


class _Run:
    """A run of texts of a language: their distinct n-grams of every order and contexts, and what the model says of them."""

    def __init__(self, texts: list[str], table: np.ndarray):
        packed, self.n = grams(texts, table)
        self.keys, self.place = {}, {}
        self.keys[ORDER], self.place[ORDER] = np.unique(packed, return_inverse=True)
        for k in range(ORDER - 1, 0, -1):
            self.keys[k], self.place[k] = np.unique(self.keys[k + 1] & ((1 << (BITS * k)) - 1), return_inverse=True)
        self.contexts = {}
        for k in range(1, ORDER + 1):
            self.keys[-k], self.contexts[k] = np.unique(self.keys[k] >> BITS, return_inverse=True)
        self.values = {kind: np.zeros(len(keys)) for kind, keys in self.keys.items()}
        self.there = {kind: np.zeros(len(keys), bool) for kind, keys in self.keys.items()}

    def ask(self, folder: str, shards: list[str], s: int) -> None:
        """Values of the n-grams that shard ``s`` may have; it is read only if there are any."""
        own = {kind: np.flatnonzero(keys % _SPREAD % len(shards) == s) for kind, keys in self.keys.items()}
        if not any(map(len, own.values())):
            return
        for kind, (there, values) in _shard(folder, shards[s]).items():
            asked = self.keys[kind][own[kind]]
            at = np.minimum(np.searchsorted(there, asked), len(there) - 1)
            hit = there[at] == asked
            self.values[kind][own[kind][hit]], self.there[kind][own[kind][hit]] = values[at[hit]], True

    def log_perplexity(self, letters: int) -> list[float | None]:
        score = -np.log(letters + 1)
        for k in range(1, ORDER + 1):
            below = score if k == 1 else score[self.place[k - 1]]
            score = np.where(self.there[k], self.values[k], self.values[-k][self.contexts[k]] + below)
        sums = np.bincount(np.repeat(np.arange(len(self.n)), self.n), score[self.place[ORDER]], len(self.n))
        return [-float(s) / int(c) if c else None for s, c in zip(sums, self.n)]


def log_perplexity(model: Model, lang: str, *texts: list[str], table: np.ndarray | None = None) -> list[list[float | None]]:
    """Mean negative log-probability of a character, for each text of each run of texts; None for empty texts.

    A shard is read once at most, whatever the number of runs.
    """
    table = class_table(model.alphabet[lang]) if table is None else table
    runs = [_Run(own, table) for own in texts]
    for s in range(len(model.shards[lang])):
        for run in runs:
            run.ask(model.folder, model.shards[lang], s)
    return [run.log_perplexity(len(model.alphabet[lang])) for run in runs]


def scored(docs: DataFrame, model: Model, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``doc_id``, ``lang``, ``n_chars``, ``log_perplexity`` (null for empty texts and languages without a model)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    together = 1 if 13 * SHARD_ENTRIES * sum(map(len, model.shards.values())) <= KEPT_BYTES else RUNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model, tables = shared.value, {}

        def score(held: list[tuple[pa.RecordBatch, list[str]]]) -> Iterator[pa.RecordBatch]:
            out: list[list[float | None]] = [[None] * len(texts) for _, texts in held]
            asked: dict[str, list[tuple[int, list[int], list[str]]]] = {}
            for k, (part, texts) in enumerate(held):
                for lang, at, own in _by_language(part, texts):
                    if lang in model.shards:
                        asked.setdefault(lang, []).append((k, at, own))
            for lang, runs in asked.items():
                if lang not in tables:
                    tables[lang] = class_table(model.alphabet[lang])
                for (k, at, _), values in zip(runs, log_perplexity(model, lang, *(own for *_, own in runs), table=tables[lang])):
                    for i, v in zip(at, values):
                        out[k][i] = v
            for (part, texts), values in zip(held, out):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(map(len, texts), pa.int64()), pa.array(values, pa.float64())], ["doc_id", "lang", "n_chars", "log_perplexity"])

        try:
            held = []
            for part in slices(batches, "text", _SLICE):
                held.append(part)
                if len(held) == together:
                    yield from score(held)
                    held = []
            yield from score(held)
        finally:
            _KEPT.clear()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, lang string, n_chars long, log_perplexity double")


def thresholds(scores: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``lang``, ``threshold``: the least log-perplexity, in thousandths, that the share ``quantile`` of a language's scores does not exceed."""
    bins = scores.where("log_perplexity is not null").groupBy("lang", F.round(F.col("log_perplexity") * 1000).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("lang").orderBy("bin")  # a language's bins are a few thousand
    share = bins.select("lang", "bin", (F.sum("n").over(up_to) / F.sum("n").over(Window.partitionBy("lang"))).alias("share"))
    return share.where(F.col("share") >= quantile - 1e-12).groupBy("lang").agg((F.min("bin") / 1000).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, folds: int = FOLDS) -> DataFrame:
    """One row per input row: ``id_col``, ``lang``, ``n_chars``, ``log_perplexity``, ``threshold``, ``kept``.

    Trusted are the documents whose labels all say quality 1 and none says toxic 1 (where labels have ``toxic``); every one of
    them is counted, in the models of all folds but its own. A null or empty text is rejected. A fold of a language without
    trusted text in other folds has no model, and a language none of whose trusted documents has a score no threshold: their
    documents are kept, with nulls. A null language is the language ``''``. Repeated rows get equal scores, and trusted ones
    count as often as they are there. Texts of any length are scored whole. Other columns of either table don't matter; an empty
    table gives no rows. Trusted text in more than ``MAX_LANGUAGES / folds`` languages is refused (ValueError).
    """
    spark = docs.sparkSession
    fine = F.min("quality") == 1
    if "toxic" in labels.columns:
        fine = fine & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)
    good = written(labels.where("doc_id is not null").groupBy("doc_id").agg(fine.alias("fine")).where("fine").select(F.col("doc_id").cast("long").alias("_trusted")), "trusted")
    ids = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    fold = F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int")
    trusted = given.where(F.length("text") > 0).join(ids, F.col("doc_id") == F.col("_trusted"), "left_semi")
    others = F.explode(F.filter(F.array(*map(F.lit, range(folds))), lambda f: f != F.col("fold"))).alias("fold")
    counts = trusted.select("lang", "text", fold.alias("fold")).select("lang", "text", others).select(F.concat_ws(":", "fold", "lang").alias("lang"), "text")
    model = train(counts)
    scores = scored(given.withColumn("lang", F.concat_ws(":", fold, "lang")), model, "doc_id", "text", "lang")
    scores = written(scores.withColumn("lang", F.substring("lang", F.instr("lang", ":") + 1, F.length("lang"))), "scores")
    own = scores.join(ids, F.col("doc_id") == F.col("_trusted"), "left_semi")
    limits = F.broadcast(written(thresholds(own, quantile), "thresholds"))  # a row per language
    out = scores.join(limits, "lang", "left")
    bad = (F.col("n_chars") == 0) | (F.col("log_perplexity") > F.col("threshold"))
    return out.select(F.col("doc_id").alias(id_col), "lang", "n_chars", "log_perplexity", "threshold", (~F.coalesce(bad, F.lit(False))).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. Rows that share an identifier go only if all of them fail."""
    verdicts = classify(docs, labels, id_col, **options)
    bad = written(verdicts.groupBy(id_col).agg(F.max("kept").alias("kept")).where("not kept").select(id_col), "rejected")
    return docs.join(bad, docs[id_col].eqNullSafe(bad[id_col]), "left_anti")
