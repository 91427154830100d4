"""The pipeline stage by stage against brute-force versions, each on what the stage before kept, and odd tables."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import quality_model, quality_rules, queries
from factgraph.llm.common import written

from test_llm_operators import fold_lines, jaccard_truth, kneser_ney, rules_common, rules_truth, sentence  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return {r["doc_id"]: tuple(r) for r in df.collect()}


def classified(rows, labels, folds):
    """Identifiers that the classifier keeps, by definition."""
    good = {i for i, q, t in labels if q == 1 and not t}
    kept = set()
    for lang in {r[2] for r in rows.values()}:
        own = {i: r[1] for i, r in rows.items() if r[2] == lang}
        values = {}
        for fold in range(quality_model.FOLDS):
            trusted = [t for i, t in own.items() if i in good and folds[i] != fold and t]
            score = kneser_ney(trusted)[0] if trusted else None
            values |= {i: score(t) for i, t in own.items() if folds[i] == fold and t and score}
        own_scores = sorted(round(values[i], 3) for i in own if i in good and i in values)
        limit = own_scores[int(np.ceil(0.99 * len(own_scores) - 1e-9)) - 1] if own_scores else np.inf
        kept |= {i for i, t in own.items() if t and values.get(i, -np.inf) <= limit}
    return kept


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = rows_of(docs)
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    folds = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(quality_model.FOLDS)).alias("f")).collect()}

    docs = written(STAGES["quality classifier"](spark, docs, SF), "test-1")
    kept = classified(rows, labels, folds)
    assert rows_of(docs) == {i: r for i, r in rows.items() if i in kept} and len(kept) < len(rows)

    rows = rows_of(docs)
    docs = written(STAGES["quality rules"](spark, docs, SF), "test-2")
    given = [(i, r[1], r[3]) for i, r in rows.items()]
    fine, common = {i for i, ok, _, _ in rules_truth(given) if ok}, rules_common(given)
    want = {}
    for i in fine:
        _, text, lang, source, _ = rows[i]
        clean = "\n".join(x for x in text.split("\n") if (source, fold_lines(x)) not in common)
        want[i] = (i, clean, lang, source, len(clean) if clean != text else rows[i][4])
    assert rows_of(docs) == want and len(want) < len(rows)

    rows = rows_of(docs)
    docs = written(STAGES["exact dedup"](spark, docs, SF), "test-3")
    last = {}
    for i, r in rows.items():
        last[r[1]] = max(last.get(r[1], i), i)
    assert rows_of(docs) == {i: rows[i] for i in last.values()}

    rows = rows_of(docs)
    docs = written(STAGES["n-gram Jaccard join"](spark, docs, SF), "test-4")
    smallest = {i for i, _, c in jaccard_truth([(i, r[1]) for i, r in rows.items()]) if i == c}
    assert rows_of(docs) == {i: rows[i] for i in smallest} and len(smallest) < len(rows)

    check_packed(STAGES["best-fit packing"](spark, docs, SF), rows_of(docs))


def check_packed(packed, rows):
    """Every token of every document once, pieces of the right size, sequences without gaps, and nearly as few as can be."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_file())
    ids = {i: np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for i, r in rows.items()}
    found, bins = defaultdict(list), defaultdict(list)
    for r in packed.collect():
        own = ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert zlib.crc32(own) == r["ids_crc32"]
        found[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, data in ids.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(found[i])):
            assert (piece, start) == (k, at) and (k == 0 or length == 2048)
            at += length
        assert at == len(data) // 4
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(len(x) // 4 for x in ids.values()) // 2048)
    assert len(bins) <= 1.01 * least + 2


def test_packing_of_a_driver_table_is_tight(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packed(STAGES["best-fit packing"](spark, docs, SF), rows_of(docs))


def test_run_is_the_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-run")
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()) == Counter(tuple(r)[:5] for r in docs.collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id int, _gone string, _clean string, size int, low long, kept boolean, token long, _n int, _kept int, sequence_id string"


def odd(spark):
    rng = random.Random(16)
    rows = [(i, sentence(rng, 40), "en", "h", 1) for i in range(20)]
    rows += [(20, None, "en", "h", 0), (21, "", "en", "h", 0), (22, " \n ", None, None, None), (None, sentence(rng, 40), None, None, None), (None, None, None, None, None)]
    rows += [rows[0], (30, rows[1][1], "en", "h", 1), (31, rows[2][1] + " more", "en", "h", 1), (32, sentence(rng, 20_000), "xx", "h", 1)]
    return spark.createDataFrame([(*r, 1, "g", "c", 2, 3, True, 4, 5, 6, "s") for r in rows], SCHEMA)


def test_stages_on_odd_tables(spark):
    """What each stage does with nulls, empty and very long texts, repeated rows and columns of its own names, as its docstring says."""
    docs = odd(spark)
    every = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    given = every(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names, name
        left = every(out)
        assert left <= given, name
        again = stage(spark, docs.limit(0), SF)
        assert again.columns == docs.columns and again.count() == 0, name
        gone = given - left
        if name == "quality classifier":
            assert {(20, None), (21, "")} <= gone.keys() and (32, docs.where("doc_id = 32").first()["text"]) in left
        if name == "quality rules":
            assert {(20, None), (21, ""), (22, " \n ")} <= gone.keys()
        if name == "exact dedup":
            text = docs.where("doc_id = 1").first()["text"]
            assert gone[1, text] == 1 and left[30, text] == 1 and left[21, ""] == 1 and max(left.values()) == 1
        if name == "n-gram Jaccard join":
            assert {i for i, _ in gone} == {30, 31} and left[None, None] == 1
    packed = STAGES["best-fit packing"](spark, docs, SF)
    assert sum(r["piece"] == 0 for r in packed.collect()) == sum(given.values())
    assert STAGES["best-fit packing"](spark, docs.limit(0), SF).count() == 0
