"""Exact Jaccard join on word shingles by prefix filters under several global token orders.

Sets that are at least three quarters alike share a token among the first quarter of their tokens in *any* order that all
documents agree on. Here three orders are used: by hash upwards, by hash downwards, and by frequency class (then hash).

1. By hash upwards: every document sends the beginning of its set, and what tokens occur twice comes back: as a bitmap of fixed
   size where they fill an eighth of it at most, by a join where they are more. A document of which too few beginning tokens
   are shared has no partner and ends here. The frequency classes of the second step come back in the same two ways.
2. By frequency class: the tokens of the remaining distinct sets are counted; rare ones come first, so that passages and
   stock phrases are hardly ever among the beginnings. Sets that share a beginning token are candidates. In a few rounds each
   set is compared with one leader of its buckets that it is not joined with yet, another one each time; sets that links
   joined need no further comparison, so a group of copies costs stars, not all its pairs. Then what stands apart from a bucket's largest component is compared with all
   other components of the bucket, by bands of sizes, so that a large bucket is many tasks. Sizes, places of the shared token
   and parity bitmaps must allow enough likeness. Of two components one pair goes first: if it is a link, the rest need not.
3. The filters are intersected: a candidate must also share beginning tokens under both orders by hash, for which only these
   beginnings travel. Whole sets are fetched and intersections counted for the pairs that are left.

Tokens are 64-bit hashes of shingles; within a pair of documents a false match has a chance of about 10**-14.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, forget, frugal, trim, written
from .tokens import release, slices

WORDS, PERCENT = 5, 75
#: Beginnings are longer than the filter asks by this percentage of the set, and so many shared tokens more are asked.
SURPLUS = 8
#: Bits of the bitmap of shared tokens, and of those of the frequency classes: 16 MB and 2 x 2 MB, whatever the input.
MAP_BITS, CLASS_BITS, CLASSES = 1 << 27, 1 << 24, (2, 16, 256)
#: Links that one task may join into components; beyond, rounds of distributed joins do.
LINKS_IN_ONE_TASK = 1_000_000
#: Rounds of stars before all pairs that are left are compared; they only save comparisons, and one that finds fewer links than
#: this share of the sets is the last.
ROUNDS, FEW_LINKS = 4, 0.001
#: Bits of a bitmap for each token in it at least; with fewer it would let too much through.
LOOSE = 8
#: Single pairs of two components that are tried before all of theirs are.
TRIES = 2
#: Rounds in which sets of components that meet as groups are tried against so many members, while all that meet would be more than
#: this many times the sets. Like the stars they only save comparisons.
MEETINGS, TRIED, FEW_MEETINGS = 8, 256, 2
#: A component of which a bucket has at least so many sets, and this share, is met as a whole instead of bucket by bucket.
GROUP, GROUP_SHARE = 8, 0.02
#: Places of a set's parity signature, a multiple of 64.
PARITY = 1024
#: Pairs that are sent to all tasks, so that of the sets only those in a pair are shuffled.
SENT_PAIRS = 1_000_000
_SLICE = 6_000_000
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(8)], np.uint64)
_ROW = 32768  # bits of bitmap_construct_agg


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a text's set; see ``join`` for its definition."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    ids = np.fromiter(map(digest, found), np.uint64, len(found))
    size = min(words, len(ids))
    sums = np.full(len(ids) - size + 1, len(ids) if len(ids) < words else 0, np.uint64)
    for k in range(size):
        sums += ids[k : k + len(sums)] * _WEIGHTS[k]
    sums = (sums ^ (sums >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((sums ^ (sums >> np.uint64(29))).view(np.int64))


def needed(n: np.ndarray | int, percent: int = PERCENT):
    """Tokens of a set of ``n`` that any partner must share."""
    return -(-n * percent // 100)


def begin(n: int, percent: int = PERCENT, extra: int = 1) -> int:
    """Tokens at a set's beginning of which it shares ``extra`` or more with any partner that asks as many."""
    return min(n, n - int(needed(n, percent)) + extra)


def _extra(n: int) -> int:
    return max(1, n * SURPLUS // 100)


def _least(n: int, percent: int) -> int:
    """The shared beginning tokens that a set of ``n`` must have: what its smallest partner asks."""
    return min(_extra(int(needed(n, percent))), _extra(n))


def _bitmap(spark: SparkSession, tokens: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``token`` modulo ``bits``; its size does not depend on the input."""
    place = tokens.select(F.pmod("token", F.lit(bits)).alias("p"))
    rows = place.groupBy(F.floor(F.col("p") / _ROW).alias("b")).agg(F.expr(f"bitmap_construct_agg(p % {_ROW})").alias("m")).collect()
    out = np.zeros((bits // _ROW, _ROW // 8), np.uint8)
    for row in rows:
        out[row["b"]] = np.frombuffer(row["m"], np.uint8)
    return out.reshape(-1)


def _holds(bitmap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    p = tokens & (len(bitmap) * 8 - 1)
    return (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def _counted(tokens: DataFrame, least: int) -> DataFrame:
    """``token`` and ``n`` of tokens that occur ``least`` times or more; every task sees all rows of its tokens, in numpy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, held = [], 0, []
        for batch in batches:
            parts.append(batch.column(0).to_numpy())
            size += batch.num_rows
            if size > 4_000_000:  # sum up as we go, so that a token in every document is one entry
                held.append(_sum(parts))
                parts, size = [], 0
        if parts:
            held.append(_sum(parts))
        if held:
            token, n = _merge(held)
            keep = n >= least
            for at in range(0, int(keep.sum()), 1_000_000):
                yield pa.RecordBatch.from_arrays([pa.array(token[keep][at : at + 1_000_000]), pa.array(n[keep][at : at + 1_000_000])], ["token", "n"])

    return tokens.mapInArrow(frugal(run), "token long, n long")


def _sum(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts), return_counts=True)


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by token; a token may be in several of ``held`` and several times in one."""
    tokens, counts = np.concatenate([t for t, _ in held]), np.concatenate([n for _, n in held])
    order = np.argsort(tokens, kind="stable")
    tokens, counts = tokens[order], counts[order]
    if not len(tokens):
        return tokens, counts
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    return tokens[first], np.add.reduceat(counts, first).astype(np.int64)


def _beginnings(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``token`` of all beginnings by hash; a token at most twice from one run of documents, copies within it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for _, texts in slices(batches, "text", _SLICE):
            own, seen = [], set()
            for text in texts:
                tokens = shingles(text, words)
                if len(tokens) and (mark := xxhash.xxh3_128_digest(tokens.tobytes())) not in seen:
                    seen.add(mark)
                    own.append(tokens[: begin(len(tokens), percent, _extra(len(tokens)))])
            if own:
                token, n = _sum(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([token, token[n > 1]]))], ["token"])

    return docs.mapInArrow(frugal(run), "token long")


def _join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    ends = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array(map(root, ends), pa.int64())], ["sid", "comp"])


def components(links: DataFrame, name: str = "components", in_one_task: int = LINKS_IN_ONE_TASK) -> DataFrame:
    """``sid``, ``comp`` (the smallest of the component) for every end of ``links`` (``a``, ``b``).

    Up to ``in_one_task`` links, one executor task joins them (16 bytes each); more go through alternating stars, rounds of
    joins in which every end moves towards the smallest of its neighbourhood.
    """
    if links.count() <= in_one_task:
        return links.select("a", "b").repartition(1).mapInArrow(frugal(_join_ends), "sid long, comp long")
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{name}-0")
    last, k = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        k += 1
        before, edges = edges, written(small.where("u != v").distinct(), f"{name}-{k}")
        forget(before)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    found = edges.select(F.col("u").alias("sid"), F.col("v").alias("comp"))
    return found.unionByName(edges.select(F.col("v").alias("sid"), F.col("v").alias("comp")).distinct())


def _edges(sets: DataFrame, percent: int) -> DataFrame:
    """``sid``, ``low``, ``high``: of each set the beginnings under both orders by hash, the upper halves of their tokens."""
    size = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")

    def halves(tokens):
        return F.transform(tokens, lambda t: F.shiftright(t, 32).cast("int"))

    return sets.select("sid", halves(F.slice("tokens", F.lit(1), size)).alias("low"), halves(F.slice("tokens", -size, size)).alias("high"))


def _with_ends(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (``a``, ``b``) with the ``columns`` of ``rows`` (``sid``, ...) at both ends, as ``<column>_a`` and ``<column>_b``."""
    left, right = (rows.select(F.col("sid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)) for x in ("a", "b"))
    if pairs.count() <= SENT_PAIRS:
        left, right = left.join(F.broadcast(pairs), "a"), right.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
        return left.join(right, "b")
    return pairs.join(left, "a").join(right, "b")


def _verified(pairs: DataFrame, edges: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (``a``, ``b``) that are alike enough: first by the filters under both orders by hash, then by their sets."""
    asked = written(pairs.select("a", "b"), f"{name}-pairs")
    through = _with_ends(asked, edges, "low", "high").where(F.arrays_overlap("low_a", "low_b") & F.arrays_overlap("high_a", "high_b"))
    through = written(through.select("a", "b"), f"{name}-candidates")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    both = _with_ends(through, sets, "n", "tokens").where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared))
    found = written(both.select("a", "b"), name)
    forget(asked, through)
    return found


def _band(n: str, percent: int):
    """A band of sizes: linked sets are in the same band or in neighbouring ones."""
    return F.floor(F.log(n) / F.lit(math.log(100 / percent) * (1 + 1e-9))).cast("int")


def _near_bands(n: str, percent: int):
    return F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: _band(n, percent) + k))


def _may(x: str, y: str, percent: int, once: bool):
    """Whether two rows of a bucket allow enough likeness if no earlier token of the order is shared.

    Of a linked pair that holds for the first token they share, so each is found in that bucket at least. With
    ``once``, rows with the same token before are left out: they have met in that one's bucket.
    """
    first = F.col(f"{x}.before") != F.col(f"{y}.before") if once else F.lit(True)
    left = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
    return first & ((100 + percent) * left >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n")))


def _signatures(sets: DataFrame) -> DataFrame:
    """``sid``, ``n``, ``s``: of each set the parities of its tokens in ``PARITY`` places, as 64-bit words.

    Two sets differ in at least as many tokens as their parities differ in places.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for tokens in batch.column(2):
                places = np.bincount((tokens.values.to_numpy() >> 20) & (PARITY - 1), minlength=PARITY) & 1
                words.append(np.packbits(places.astype(np.uint8)).view(np.int64))
            if words:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.int64()))], ["sid", "n", "s"])

    return sets.select("sid", "n", "tokens").mapInArrow(frugal(sign), "sid long, n long, s array<long>")


def _apart(s: str, t: str):
    """The places in which two signatures differ."""
    return sum((F.bit_count(F.col(s)[k].bitwiseXOR(F.col(t)[k])) for k in range(1, PARITY // 64)), F.bit_count(F.col(s)[0].bitwiseXOR(F.col(t)[0])))


def _near(s: str, n: str, t: str, m: str, percent: int):
    """Whether two signatures and sizes allow enough likeness. It implies that the sizes alone do."""
    apart = _apart(s, t)
    sizes = (100 + percent) * F.least(n, m) >= percent * (F.col(n) + F.col(m))
    return sizes & ((100 + percent) * apart <= (100 - percent) * (F.col(n) + F.col(m)))


def _open(live: DataFrame, comps: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The rows of buckets that have several components: ``comp``, the bucket's largest (``top``), whether a set is met with its
    component ``as_group``, its signature and its ``band``."""
    rows = live.drop("comp").join(comps, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    sizes = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.groupBy("token").agg(F.max_by("comp", F.struct("size", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1").drop("comps")
    totals = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("total"))
    grouped = sizes.where(F.col("size") >= GROUP).join(totals, "comp").where(F.col("size") >= GROUP_SHARE * F.col("total")).select("token", "comp", F.lit(True).alias("as_group"))
    found = rows.join(top, "token").join(grouped, ["token", "comp"], "left")
    if "s" not in found.columns:
        found = found.join(signs.select("sid", "s"), "sid")
    return written(found.withColumn("band", _band("n", percent)), "open")


def _meets(open_rows: DataFrame) -> DataFrame:
    """``sid``, ``comp``, ``group``: the groups that a set meets, each once, however many tokens they share."""
    groups = open_rows.where("as_group").select("token", F.col("comp").alias("group")).distinct()
    return open_rows.where("comp != top").join(groups, "token").where("comp != group").select("sid", "comp", "group").distinct()


def _moved(found: DataFrame, groups: DataFrame, comps: DataFrame) -> DataFrame:
    """``comp``, ``now``: the components of ``groups`` that links ``found`` since then have joined to others, and those of ``comps`` that they are part of."""
    ends = found.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(groups, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    return ends.join(comps.select("sid", F.col("comp").alias("now")), "sid").where("comp != now").select("comp", "now").distinct()


def _now(rows: DataFrame, moved: DataFrame | None, comp: str, now: str) -> DataFrame:
    """``rows`` with the component that ``comp`` is part of as ``now``."""
    if moved is None:
        return rows.withColumn(now, F.col(comp))
    return rows.join(moved.select(F.col("comp").alias(comp), F.col("now").alias("_now")), comp, "left").withColumn(now, F.coalesce("_now", comp)).drop("_now")


def _tried(meets: DataFrame, comps: DataFrame, totals: DataFrame, signs: DataFrame, percent: int, k: int) -> DataFrame:
    """``a``, ``b``: of each component and a group that it meets, the nearest pair of one set and of about ``TRIED`` members, others for each ``k``."""
    one = meets.groupBy("comp", "with").agg(F.min_by("sid", F.xxhash64("sid", F.lit(k))).alias("sid")).join(signs, "sid").withColumn("band", _near_bands("n", percent))
    part = comps.withColumnRenamed("comp", "with").join(totals, "with").where(F.pmod(F.xxhash64("sid", F.lit(k)), F.ceil(F.col("total") / TRIED)) == 0)
    some = part.select("with", F.col("sid").alias("other")).join(signs.select(F.col("sid").alias("other"), F.col("n").alias("m"), F.col("s").alias("t")), "other").withColumn("band", _band("m", percent))
    share = _apart("s", "t") / (F.col("n") + F.col("m"))
    near = one.join(some, ["with", "band"]).where(_near("s", "n", "t", "m", percent))
    best = near.groupBy(F.least("comp", "with").alias("low"), F.greatest("comp", "with").alias("high")).agg(F.min_by(F.struct("sid", "other"), F.struct(share, "sid", "other")).alias("p"))
    return best.select(F.least("p.sid", "p.other").alias("a"), F.greatest("p.sid", "p.other").alias("b")).distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id``.

    A text's set: lower-case A-Z, words between ASCII white space, distinct runs of ``words`` words; of a shorter text all its
    words as one; of an empty or null text nothing, and it is linked with nothing. Two rows link when ``100 * intersection >=
    percent * union``; ``component_id`` is the smallest identifier reachable by links, the row's own included. Rows with equal
    sets count as linked. A null identifier takes part and is never smallest unless there is no other. Texts of any length are
    taken whole; other columns, whatever their names, are left out. An empty table gives no rows.
    """
    return _joined(docs, id_col, text_col, words, percent).drop("_text")


def _joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``join`` with a hash of each row's text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    started = _beginnings(rows.select("text"), words, percent).repartition(tasks, "token")
    shared = written(_counted(started, 2).select("token"), "shared")
    by_join = shared.count() * LOOSE > MAP_BITS
    alive = None if by_join else spark.sparkContext.broadcast(_bitmap(spark, shared, MAP_BITS))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if alive is None else alive.value
        for part, texts in slices(batches, "text", _SLICE):
            out = []
            for text in texts:
                tokens = shingles(text, words)
                n = len(tokens)
                start = tokens[: begin(n, percent, _extra(n))]
                lives = n and (bitmap is None or int(_holds(bitmap, start).sum()) >= _least(n, percent))
                out.append((n, xxhash.xxh3_128_digest(tokens.tobytes()) if n else None, tokens if lives else None))
            n, marks, tokens = zip(*out)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), pa.array(n, pa.int64()), pa.array(marks, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))], ["doc_id", "hash", "n", "set", "tokens"])

    taken = written(rows.mapInArrow(frugal(take), "doc_id long, hash long, n long, set binary, tokens array<long>"), "taken")
    heads = taken.select("doc_id", "hash", "n", "set")
    living = taken.where("tokens is not null").select("set", "n", "tokens")
    if by_join:
        living = living.join(_living(living, shared, percent), "set", "left_semi")
    else:
        alive.destroy()
        trim()
    classes = written(heads.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")), "sets")
    linked, tables = _linked(living, percent)
    # Of each component the smallest identifier; then every row asks its set.
    together = classes.join(linked, "set", "left")
    lowest = together.where("comp is not null").groupBy("comp").agg(F.min("rep").alias("low"))
    answer = written(together.join(lowest, "comp", "left").select("set", F.coalesce("low", "rep").alias("component_id"), "size"), "answers")
    forget(shared, classes, *tables)
    total = heads.count()
    out = attach(heads, answer, "set", "size", total)
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("hash").alias("_text"))


def _living(sets: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """``set`` of the sets of whose beginnings enough tokens are ``shared``: what the bitmap tells, without false hits."""
    need = lambda c: F.ceil(c * percent / 100)
    extra = lambda c: F.greatest(F.lit(1), F.floor(c * SURPLUS / 100))
    n = F.col("n")
    size = F.least(n, n - need(n) + extra(n)).cast("int")
    least = F.least(extra(need(n)), extra(n))
    asked = sets.dropDuplicates(["set"]).select("set", least.alias("least"), F.explode(F.slice("tokens", F.lit(1), size)).alias("token"))
    return asked.join(shared, "token").groupBy("set").agg(F.count(F.lit(1)).alias("found"), F.first("least").alias("least")).where("found >= least").select("set")


def _ordered(sets: DataFrame, often: DataFrame, percent: int) -> DataFrame:
    """``token``, ``sid``, ``n``, ``pos``, ``before`` of the beginnings by frequency class, the classes found by a join."""
    kind = functools.reduce(lambda a, b: a + b, ((F.col("m") >= least).cast("int") for least in CLASSES))
    rows = sets.select("sid", "n", F.explode("tokens").alias("token")).join(often.select("token", F.col("n").alias("m")), "token", "left")
    size = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    order = rows.groupBy("sid", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(kind, F.lit(0)).alias("kind"), "token"))).alias("all"))  # a set's own tokens
    first = order.select("sid", "n", F.slice("all", F.lit(1), size).alias("first"))
    each = first.select("sid", "n", "first", F.posexplode("first").alias("pos", "x"))
    before = F.when(F.col("pos") == 0, F.col("sid")).otherwise(F.get("first", F.col("pos") - 1)["token"])
    return each.where("x.kind > 0").select("x.token", "sid", "n", F.col("pos").cast("long").alias("pos"), before.alias("before"))


def _linked(taken: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """``set``, ``comp`` of the distinct sets that have a link, and the tables that it reads."""
    spark = taken.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = written(taken.dropDuplicates(["set"]).withColumn("sid", F.monotonically_increasing_id()), "alive")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, n = _sum([batch.column(0).flatten().to_numpy()]) if batch.num_rows else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], ["token", "n"])

    # Tasks sum up first; then a token of all documents is a row per batch.
    counts = sets.select("tokens").mapInArrow(frugal(spread), "token long, n long").repartition(tasks, "token")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > 4_000_000 and len(held) > 1:
                held = [_merge(held)]
                size = len(held[0][0]) // 2
        if held:
            token, n = _merge(held)
            token, n = token[n >= CLASSES[0]], n[n >= CLASSES[0]]
            for at in range(0, len(token), 1_000_000):
                yield pa.RecordBatch.from_arrays([pa.array(token[at : at + 1_000_000]), pa.array(n[at : at + 1_000_000].astype(np.int64))], ["token", "n"])

    often = written(counts.mapInArrow(frugal(total), "token long, n long"), "often")
    wide = often.agg(*(F.count_if(F.col("n") >= least).alias(str(k)) for k, least in enumerate(CLASSES))).first()
    by_join = any(wide[k] * LOOSE > (MAP_BITS if k == 0 else CLASS_BITS) for k in range(len(CLASSES)))
    maps = None if by_join else spark.sparkContext.broadcast([_bitmap(spark, often.where(F.col("n") >= least).select("token"), MAP_BITS if k == 0 else CLASS_BITS) for k, least in enumerate(CLASSES)])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[tuple] = []
            for sid, n, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                tokens = tokens.values.to_numpy()
                kind = sum(_holds(m, tokens).astype(np.int64) for m in maps.value)
                order = np.lexsort((tokens, kind))[: begin(n, percent)]
                shared = kind[order] > 0  # what only one set has finds no partner
                tokens, before = tokens[order], np.concatenate([[sid], tokens[order[:-1]]])
                count = int(shared.sum())
                own.append((tokens[shared], np.full(count, sid), np.full(count, n), np.flatnonzero(shared), before[shared]))
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*own)], ["token", "sid", "n", "pos", "before"])

    if by_join:
        buckets = written(_ordered(sets, often, percent), "buckets")
    else:
        buckets = written(sets.select("sid", "n", "tokens").mapInArrow(frugal(first), "token long, sid long, n long, pos long, before long"), "buckets")
        maps.destroy()
        trim()
    forget(often)
    edges = written(_edges(sets, percent), "edges")
    # Stars: in each round every bucket has another leader, and each set not joined with its buckets' leaders meets one of these;
    # from the second on, when far fewer rows are left, one that the parity bitmaps allow.
    signs = written(_signatures(sets), "signatures")
    live, comps, links, n_sets = buckets, None, [], sets.count()
    for k in range(ROUNDS):
        rows = live if comps is None else live.drop("comp").join(comps, "sid", "left")
        rows = rows.withColumn("comp", F.col("sid") if comps is None else F.coalesce("comp", "sid"))
        several = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("token")
        rows = rows.join(several, "token", "left_semi")
        before, live = live, written(rows.join(signs.select("sid", "s"), "sid") if k == 1 else rows, f"live-{k}")
        forget(before)
        leaders = live.groupBy("token").agg(F.min_by(F.struct(*(c for c in live.columns if c != "token")), F.xxhash64("sid", F.lit(k))).alias("x")).select("token", "x.*")
        may = (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & _may("x", "y", percent, False)
        if k:
            may = may & _near("x.s", "x.n", "y.s", "y.n", percent)
        # By turns of the bucket of the rarest token, and of any: the largest buckets are those of passages that unlike texts share.
        rank = F.struct(F.col("x.pos") + F.col("y.pos"), F.xxhash64("x.sid", F.lit(k))) if k % 2 == 0 else F.xxhash64("x.token", "y.sid", F.lit(k))
        star = live.alias("y").join(leaders.alias("x"), may).groupBy(F.col("y.sid").alias("b")).agg(F.min_by("x.sid", rank).alias("a"))
        found = _verified(star.select("a", "b"), edges, sets, percent, f"links-{k}")
        links.append(found)
        few = found.count()
        if not few:
            break
        comps = written(components(functools.reduce(DataFrame.unionByName, links), f"stars-{k}"), f"comps-{k}")
        if few < FEW_LINKS * n_sets:
            break
    if comps is None:
        comps = written(sets.select("sid", F.col("sid").alias("comp")).limit(0), "comps")
    # Then all that is left: what is outside a bucket's largest component, and all sets of its other components. Large components
    # that are alike would meet with all their sets, so a few pairs of each two are tried first, and those that link are one.
    # Buckets are opened once: what joins since then is told by another column, and is not compared.
    open_rows, groups, joined = _open(live, comps, signs, percent), comps, []
    met_groups, moved = written(_meets(open_rows), "meets"), None
    sizes = groups.groupBy("comp").agg(F.count(F.lit(1)).alias("total"))
    for k in range(MEETINGS):
        meets = _now(_now(met_groups, moved, "group", "with"), moved, "comp", "comp").where("comp != with")
        most = meets.groupBy("group").agg(F.count(F.lit(1)).alias("n")).join(sizes.withColumnRenamed("comp", "group"), "group").agg(F.sum(F.col("n") * F.col("total"))).first()[0] or 0
        if most <= FEW_MEETINGS * n_sets:
            break
        totals = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("total")).withColumnRenamed("comp", "with")
        found = _verified(_tried(meets, comps, totals, signs, percent, k), edges, sets, percent, f"meeting-links-{k}")
        links.append(found)
        joined.append(found)
        some = found.count()
        if not some:
            break
        comps = written(components(functools.reduce(DataFrame.unionByName, links), f"meetings-{k}"), f"comps-{ROUNDS + k}")
        moved = written(_moved(functools.reduce(DataFrame.unionByName, joined), groups, comps), f"moved-{k}")
        if some < FEW_LINKS * n_sets:
            break
    open_table, open_rows = open_rows, _now(open_rows, moved, "comp", "now")
    apart = open_rows.where("comp != top")
    meets = _now(_now(met_groups, moved, "group", "with"), moved, "comp", "comp").where("comp != with").join(signs, "sid").withColumn("band", _near_bands("n", percent))
    members = groups.join(signs, "sid").select(F.col("comp").alias("group"), F.col("sid").alias("other"), F.col("n").alias("m"), F.col("s").alias("t"), _band("n", percent).alias("band"))
    met = meets.join(members, ["group", "band"]).where(_near("s", "n", "t", "m", percent))
    x, y = apart.withColumn("band", _near_bands("n", percent)).alias("x"), open_rows.where("as_group is null").alias("y")
    once = (F.col("y.comp") == F.col("y.top")) | F.col("x.as_group") | (F.col("x.sid") < F.col("y.sid"))
    singly = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.now") != F.col("y.now")) & F.coalesce(once, F.lit(False)) & _may("x", "y", percent, True) & _near("x.s", "x.n", "y.s", "y.n", percent))

    def pair(x: str, y: str, comp_x: str, comp_y: str) -> list:
        ends = [f(x, y).alias(name) for f, name in ((F.least, "a"), (F.greatest, "b"))]
        return [*ends, F.least(comp_x, comp_y).alias("low"), F.greatest(comp_x, comp_y).alias("high")]

    pairs = singly.select(*pair("x.sid", "y.sid", "x.now", "y.now")).unionByName(met.select(*pair("sid", "other", "comp", "with")))
    pairs = written(pairs.distinct(), "pairs")
    # One pair of each two components first: where it is a link, the others need no comparison.
    for k in range(TRIES):
        one = pairs.groupBy("low", "high").agg(F.min_by(F.struct("a", "b"), F.xxhash64("a", "b", F.lit(k))).alias("p"))
        one = written(one.select("low", "high", "p.a", "p.b"), f"pairs-{k}")
        found = _verified(one.select("a", "b"), edges, sets, percent, f"pair-links-{k}")
        links.append(found)
        rest = written(pairs.join(one.join(found, ["a", "b"]).select("low", "high"), ["low", "high"], "left_anti"), "pairs")
        forget(pairs, one)
        pairs = rest
        if pairs.isEmpty():
            break
    more = _verified(pairs.select("a", "b"), edges, sets, percent, "links")
    forget(pairs)
    found = written(components(functools.reduce(DataFrame.unionByName, [*links, more]), "stars"), "comps")
    forget(live, edges, *links, more, comps, groups, signs, open_table, met_groups)
    return sets.select("sid", "set").join(found, "sid").select("set", "comp"), [sets, found]


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of each component the row with the smallest identifier, with all its columns.

    Rows without words stay, each its own; a row without an identifier goes where its component has one. Rows that share the
    smallest identifier all stay.
    """
    found = _joined(docs, id_col, text_col, **options).where(~F.col(id_col).eqNullSafe(F.col("component_id")))
    gone = written(found.select(F.col(id_col).alias("_id"), "_text").distinct(), "near-duplicates")
    same = docs[id_col].cast("long").eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_text"])
    return docs.join(gone, same, "left_anti")
