"""Each operator against a brute-force version or an exact round trip, and the odd cases: nulls, empty and very long texts,
ties and repeated rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from datetime import date, datetime
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import exact_dedup, html_extract, jaccard_join, packing, quality_model, quality_rules, sentencepieces, token_files, url_filters, warc
from factgraph.llm import tokens as tokens_module

P = pytest.importorskip("public_tokenizers")
BPE = P.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, kept boolean, digest string, tokens string, row long, part long"


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of", "and", "zeta", "eta", "theta", "iota", "kappa"]) + rng.choice(["", "", "s", "ing"]) for _ in range(n))


def corpus(n=60, seed=1):
    """(doc_id, text): copies, near copies, short, empty, null, very long and repeated rows."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = sentence(rng, rng.randint(1, 120))
        out.append(base if rng.random() < 0.8 else base + "\n" + base)
    out += [out[3], out[3], out[5].upper(), out[7] + " more", " ".join(out[8].split()[1:])]
    out += ["", None, " \n\t ", "word", "word " * 30, "a b c d", "a b c d", "  two  spaces here \x1c x ", "é" * 50, sentence(rng, 20_000)]
    rows = [(i, t) for i, t in enumerate(out)]
    return rows + [rows[3], (1000, None), (None, "no id"), (None, "no id")]


def frame(spark, rows):
    """Rows with all other columns, some of whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", 1, 1, 1, True, "x", "y", 2, 3) for i, t in rows], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def text(t):
    return t or ""


# Exact dedup -----------------------------------------------------------------------------------------------------------
def dedup_truth(rows, pick):
    groups = defaultdict(list)
    for i, t in rows:
        groups[text(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = pick(known) if known else None
        seen = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not seen, hashlib.sha256(t.encode()).hexdigest()))
            seen |= i == keep
    return sorted(out, key=str)


@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
@pytest.mark.parametrize("digest_bytes,bits", [(32, 1 << 20), (1, 1 << 15), (0, 1 << 15)])
def test_exact_dedup(docs, keep, pick, digest_bytes, bits):
    got = exact_dedup.deduplicate(docs, keep=keep, digest_bytes=digest_bytes, filter_bits=bits)
    assert sorted(map(tuple, got.collect()), key=str) == dedup_truth(corpus(), pick)


def test_exact_dedup_keeps_columns(docs, empty):
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, (text(r["text"]) for r in out.collect()))) == sorted({text(t) for _, t in corpus()})
    both = exact_dedup.drop_duplicates(frame(docs.sparkSession, [(1, None), (1, ""), (1, "x"), (2, "x")]))
    assert sorted((r["doc_id"], text(r["text"])) for r in both.collect()) == [(1, ""), (2, "x")]
    assert exact_dedup.drop_duplicates(empty).count() == 0 == exact_dedup.deduplicate(empty).count()


def test_digest_index(spark):
    """Batches against a log-structured index: levels merge, a reopened index knows all, and hits are verified by bytes."""
    from factgraph.llm.common import workspace

    rng = random.Random(12)
    folder = workspace(spark, "index-test")
    index = exact_dedup.DigestIndex(spark, folder, fan_in=2)
    assert index.probe(spark.createDataFrame([(b"x" * 32,)], "digest binary")).count() == 0
    earlier: list[tuple] = []
    for k in range(5):
        batch = [(100 * k + i, rng.choice([f"text {rng.randint(0, 60)}", "", None, "long " * 500])) for i in range(30)]
        docs = frame(spark, batch)
        index = exact_dedup.DigestIndex(spark, folder, fan_in=2)
        first = {}
        for i, t in earlier:
            first[text(t)] = min(first.get(text(t), i), i)
        if earlier:
            got = {(r["doc_id"], r["first_id"]) for r in index.seen(docs, frame(spark, earlier), filter_bits=1 << 15).collect()}
            assert got == {(i, first[text(t)]) for i, t in batch if text(t) in first}
        index.add(docs)
        earlier += batch
    assert sorted(r["level"] for r in index.runs) == [1, 3]  # five batches, two runs of a level make one of the next
    sizes = Counter(text(t) for _, t in earlier)
    found = {bytes(r["digest"]): (r["low"], r["high"], r["size"]) for r in index.probe(exact_dedup.digests(frame(spark, earlier)).withColumnRenamed("sha", "digest")).collect()}
    assert found == {hashlib.sha256(t.encode()).digest(): (min(i for i, x in earlier if text(x) == t), max(i for i, x in earlier if text(x) == t), n) for t, n in sizes.items()}
    with pytest.raises(FileExistsError):  # another writer was first
        late = exact_dedup.DigestIndex(spark, folder, fan_in=2)
        index.add(frame(spark, [(900, "more")]))
        late.add(frame(spark, [(901, "other")]))


# Tokens ----------------------------------------------------------------------------------------------------------------
def odd_texts():
    rng = random.Random(3)
    out = ["", " ", "  ", " a  b \n c", "x\n", "\n", "foo 's bar'll", "a\x1c b \x1f c", "<|endoftext|> a b", "你好 世界  abc", "1 2  3   4\n\n  5", "\x85 b \x0b c", "　 a"]
    out += ["a\nb", "a.\n\nb, c\n\n\n\nd\n", "\n\nx", "a\r\nb", "a\0b c\0", "é, b\u0301 '' '' x' 's', ١٢, Ⅷ. ½, »,«. €. a», ².", "a \xa0b\n\xa0c d\u200b, \u00ad. e"]
    marks = [" ", " ", " ", "\n", "a", "word", "12", "!", ",", ".", "'", "'s", "é", "»", "½", "Ⅷ", "٣", "_", "-", "\u200b", "\xa0", "\0"]
    out += ["".join(rng.choice(marks) for _ in range(40)) for _ in range(1000)]
    return out + ["".join(rng.choice([" ", "  ", "\n", "\t", "a", "B", "1", "!", "'s", "é", "\x1d", "😀"]) for _ in range(30)) for _ in range(400)]


def test_encoder_is_the_library(monkeypatch):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BPE), tokens_module.Encoder(BPE)
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd_texts()]
    assert own.encode(odd_texts()) == want == own.encode(odd_texts())
    assert [own.encode([t])[0] for t in odd_texts()] == want and own.encode([]) == []
    monkeypatch.setattr(tokens_module, "MEMO_ENTRIES", 3)
    for _ in range(3):
        assert own.encode(odd_texts()) == want
        assert own.memo.young.count < 20_000


def ids_of(t):
    return tokens_module.encoder(BPE).encode([text(t)])[0] + b"\0\0\0\0"


def test_packing(docs, empty):
    cut = packing.pieces(docs, BPE, capacity=64)
    rows = packing.pack(cut, capacity=64, open_bins=4, tasks=4, fan_in=2).collect()
    whole = defaultdict(list)
    for i, t in corpus():
        whole[i].append(ids_of(t))
    bins = defaultdict(list)
    for r in rows:
        assert any(zlib.crc32(x[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for x in whole[r["doc_id"]])
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(x) // 4 for xs in whole.values() for x in xs)
    assert sum(r["length"] for r in rows) == total and len(bins) <= 1.1 * total / 64 + 2
    assert {r["doc_id"] for r in rows} == {i for i, _ in corpus()}
    assert packing.pack(packing.pieces(empty, BPE)).count() == 0


def test_best_fit_is_best():
    rng, fit = random.Random(2), packing.BestFit(50, 8)
    state: dict[int, int] = {}
    closed: list[int] = []
    for _ in range(2000):
        n = rng.randint(1, 50)
        options = {b: f for b, f in state.items() if f >= n}
        number, offset = fit.place(n)
        if options:
            assert state[number] == min(options.values()) and offset == 50 - state[number]
        else:
            assert offset == 0 and number not in state
            if len(state) == 8:
                fullest = min(state.values())
                gone = [b for b in fit.closed if b in state]
                assert any(state[b] == fullest for b in gone)
        state[number] = (state.get(number, 50)) - n
        while fit.closed:
            b = fit.closed.pop()
            closed.append(b)
            state.pop(b, None)
        assert len(state) <= 8
    assert len(closed) == len(set(closed))


def test_sequences_hold_the_ids(spark, docs):
    small = docs.where("doc_id < 10").dropDuplicates(["doc_id"])
    cut = packing.pieces(small, BPE, capacity=64, with_ids=True)
    packed = packing.pack(cut, capacity=64)
    found = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed, cut).collect()}
    for r in packed.collect():
        part = found[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert zlib.crc32(part) == r["ids_crc32"]


def test_token_files(docs, empty, tmp_path):
    got = token_files.round_trip(docs, BPE, tasks=3, roll_bytes=2000).collect()
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    at = {}
    n = 0
    want = Counter((i, len(ids_of(t)) // 4, zlib.crc32(ids_of(t))) for i, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == n
        n += r["n_tokens"]
        at[r["start"]] = r["doc_id"]
    order = [at[k] for k in sorted(at)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert token_files.round_trip(empty, BPE).count() == 0


def test_token_files_follow_pairs_of_part_and_number(spark, tmp_path):
    """More files in a part than any fixed number of digits has room for would still be in order."""
    manifest = spark.createDataFrame([(f"f{p}-{n}", p, n, 10 * p + n) for p in range(3) for n in (2, 10, 9, 1)], "file string, part long, number long, tokens long")
    folder = f"file://{tmp_path}"
    starts = {}
    for p in range(3):
        for n in (1, 2, 9, 10):
            starts[f"f{p}-{n}"] = sum(starts_tokens for (q, m), starts_tokens in (((q, m), 10 * q + m) for q in range(3) for m in (1, 2, 9, 10)) if (q, m) < (p, n))
    assert {r["file"]: r["start"] for r in token_files.file_starts(manifest).collect()} == starts and folder


def test_more_ids_than_the_usual_codes(spark):
    counts = np.ones((1 << token_files.MAX_BITS) + 5, np.int64)
    with pytest.raises(ValueError):
        token_files.code_lengths(counts)
    assert token_files.code_lengths(counts, token_files.longest_code(len(counts))).max() <= 32


def test_files_of_lost_attempts_stay_invisible(spark, tmp_path):
    """A commit that is run again, as after a lost executor, finds its work done; other attempts' files go."""
    from factgraph.llm.common import commit_files

    folder, temporary = f"file://{tmp_path}/out", f"file://{tmp_path}/out/_temporary"
    (tmp_path / "out" / "_temporary").mkdir(parents=True)
    for name in ("a-1", "a-2", "b-3"):
        (tmp_path / "out" / "_temporary" / name).write_text(name)
    (tmp_path / "out" / "b").write_text("of an attempt that was lost after its move")
    manifest = spark.createDataFrame([("a", f"{temporary}/a-2"), ("b", f"{temporary}/b-3"), ("b", f"{temporary}/b-0")][:2], "file string, temporary string")
    assert sorted(r["file"] for r in commit_files(spark, manifest, folder, temporary).collect()) == ["a", "b"]
    assert sorted(f.name for f in (tmp_path / "out").iterdir() if not f.name.startswith(".")) == ["a", "b"]
    assert (tmp_path / "out" / "a").read_text() == "a-2" and (tmp_path / "out" / "b").read_text() == "b-3"
    assert commit_files(spark, manifest, folder, temporary).count() == 2


@pytest.mark.parametrize("bits", [4, 6, 18])
def test_huffman_lengths(bits):
    rng = np.random.default_rng(0)
    for counts in ([0, 5, 0, 3, 2, 1], [7], [0, 7], [2**k for k in range(14)], rng.integers(0, 9, 16).tolist()):
        lengths = token_files.code_lengths(np.array(counts), bits)
        used = lengths[lengths > 0].astype(int)
        assert set(np.flatnonzero(lengths)) == set(np.flatnonzero(counts)) and (used <= bits).all() and sum(2.0 ** -used) <= 1
        sizes = np.array([1, 128, 129, 600, 142])
        ids = rng.choice(np.flatnonzero(counts), sizes.sum()).astype(np.uint32)
        coder = token_files.Coder(lengths)
        data, nbytes, offsets, marks = coder.encode(ids, sizes)
        at = first = mark = 0
        for n, size, m in zip(sizes, nbytes, marks):  # each document by itself
            stretch = np.full(m, token_files.STEP)
            stretch[-1] = n - token_files.STEP * (m - 1)
            assert (coder.decode(data[at : at + size], stretch, offsets[mark : mark + m].astype(np.int64)) == ids[first : first + n]).all()
            at, first, mark = at + size, first + n, mark + m
        assert at == len(data) and mark == len(offsets)
    free = token_files.code_lengths(np.array([1, 1, 2, 4, 8]), 18)
    assert free.tolist() == [4, 4, 3, 2, 1]


# SentencePiece ---------------------------------------------------------------------------------------------------------
def test_pieces_are_the_library(docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    own = sentencepieces.Pieces.load(path)
    texts = [t for t in odd_texts() if "▁" not in t]
    got = own.encode(texts)
    assert got == [np.array(library.encode(t), "<u4").tobytes() for t in texts]
    assert own.decode(got) == texts
    rows = sentencepieces.decode(sentencepieces.encode(docs, path), path).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((i, text(t)) for i, t in corpus())


def proto(pieces, kind):
    """A sentencepiece model file by hand: pieces with scores, the kind of model, and no normalisation."""
    def field(number, wire, data):
        return bytes([number << 3 | wire]) + data

    def block(number, data):
        n, out = len(data), b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return field(number, 2, out + bytes([n]) + data)

    rows = [("<unk>", 0.0, 2), *((t, s, 1) for t, s in pieces)]
    out = b"".join(block(1, block(1, t.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for t, s, k in rows)
    return out + block(2, field(3, 0, bytes([kind]))) + block(3, block(1, b"identity") + field(3, 0, b"\1") + field(4, 0, b"\0") + field(5, 0, b"\1"))


def test_unigram_models_are_the_library(spark, tmp_path):
    import sentencepiece

    rng = random.Random(13)
    names = {"▁", "a", "b", "c", "é", "你", "▁▁"} | {"".join(rng.choice("▁abcé你")) + "".join(rng.choice("abcé你") for _ in range(rng.randint(1, 4))) for _ in range(80)}
    path = tmp_path / "unigram.model"
    path.write_bytes(proto([(t, -rng.uniform(1, 12)) for t in sorted(names)], 1))
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepieces.Pieces.load(str(path), unigram=True)
    texts = ["", "a", "  a b", "xyz", "axxb x", "a  b   c "] + ["".join(rng.choice("aabbccé你  xz") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    want = [library.encode(t) for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in own.encode([t])] == want
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in sentencepieces.encode(rows, str(path), unigram=True).collect()} == dict(enumerate(want))


def test_pieces_of_odd_tables(spark, empty):
    path = P.path("piece_bpe_32k.model")
    assert sentencepieces.decode(sentencepieces.encode(empty, path), path).count() == 0
    long = "x" * 5000 + " " + "ab" * 3000
    rows = spark.createDataFrame([(1, long, "t", b"i"), (1, long, "t", b"i"), (None, None, None, None)], "doc_id long, text string, tokens string, ids binary")
    got = sentencepieces.decode(sentencepieces.encode(rows, path), path).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(1, long), (1, long), (None, "")])


def test_unigram_viterbi_is_best():
    words = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -2.5, "ba": -2.6, "aba": -6.0, "▁ab": -5.5}
    own = sentencepieces.Pieces(list(words), list(words.values()), [True] * len(words), {}, 99, True)

    def best(word):
        if not word:
            return 0.0
        return max((words[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in words), default=-1e9)

    rng = random.Random(0)
    marked = ["▁" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 8))) for _ in range(100)]
    ordered, flat, sizes = own.segment(list(set(marked)))
    for word, end, n in zip(ordered, np.cumsum(sizes), sizes):
        pieces = [own.texts[i] for i in flat[end - n : end]]
        assert "".join(pieces) == word and abs(sum(words[p] for p in pieces) - best(word)) < 1e-9


# HTML ------------------------------------------------------------------------------------------------------------------
PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="with-sidebar">
<header><h1>Site</h1><a href=x>Home</a></header><nav><a>1</a></nav><div class="cookie-notice">We use cookies. Accept all of them please, now.</div>
<div id="main"><article><h1>The title</h1><p>First para with <a href=q>a link</a> and t<b>ex</b>t &amp; more   words.<br>Next<p>Unclosed
<div class="ad">Buy now! The best thing you can find on the market today, cheap.</div><ul><li>One<li>two</ul><p>Short.</p><form><label>Mail</label></form>
<p>The last paragraph has some words too, at least ten of them, as it should.</p>
<section id="comments"><article class="comment"><p>I liked this article very much and will come again, thanks a lot!</p></article></section></article>
<aside><p>Related things are here in a long long sentence that looks like content.</p></aside></div><footer>&copy; me</footer></body></html>"""


def test_main_text(spark, empty):
    want = "The title First para with a link and text & more words. Next Unclosed One two Short. The last paragraph has some words too, at least ten of them, as it should."
    assert html_extract.main_text(PAGE) == want
    plain = "<body><div class=menu><a>a</a> <a>b</a></div><div><div>Head line</div><div>This is some long text without an article tag, with many words in it.</div><div>Yes.</div><div>Another long block of text that has many words in it as well.</div></div><div><a>L1</a> | <a>L2</a></div>"
    assert html_extract.main_text(plain) == "Head line This is some long text without an article tag, with many words in it. Yes. Another long block of text that has many words in it as well."
    assert [html_extract.main_text(x) for x in (None, "", "<", "<nav>x</nav>", "&lt;p&gt;")][:4] == ["", "", "", ""]
    rows = spark.createDataFrame([(1, "u", PAGE, 1, "x"), (1, "u", PAGE, 1, "x"), (2, None, None, 1, "x"), (3, "u", "<p>" * 3000, 1, "x"), (None, "u", "<p>Some words of a page that has no identifier.", 1, "x")], "page_id long, url string, html string, text int, n_chars string")
    got = html_extract.extract(rows).collect()
    last = "Some words of a page that has no identifier."
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got] == [(1, want, len(want))] * 2 + [(2, "", 0), (3, "", 0), (None, last, len(last))]
    assert html_extract.extract(rows.limit(0)).count() == 0 and html_extract.fit(rows.limit(0)) == html_extract.START


def test_the_cut_mends_misjudged_blocks():
    """A short line between paragraphs speaks against itself; its neighbours speak for it."""
    page = html_extract.Page("<body><div><p>The first paragraph of the text has a good many words in it, as it should.</p><p>So</p><p>And the last paragraph goes on with as many words as the first one had.</p></div>")
    assert [z > 0 for z in html_extract.scores(page)] == [True, False, True]
    assert html_extract.labelled(page) == ([True, True, True], 1)
    lone = html_extract.Page("<body><div><p>So</p></div>")
    assert html_extract.labelled(lone) == ([False], 0)


ARTICLE = "<h1>The title of it</h1>" + "".join(f"<p>This is paragraph number {k} of the article, which has a good many words in it as paragraphs do.</p>" for k in range(3)) + "<p>Short.</p>"
ARTICLE_TEXT = "The title of it " + " ".join(f"This is paragraph number {k} of the article, which has a good many words in it as paragraphs do." for k in range(3)) + " Short."
COMMENT = "<p>I liked it a lot and will come again with all of my friends, thanks to you!</p><p>Me too.</p>"


@pytest.mark.parametrize("name", "social-issues social legal notice story-share share tags form search related alert discussion cookie-policy-news sidebar promo ad comments with-sidebar no-ads".split())
@pytest.mark.parametrize("tag", ["main", "article"])
def test_a_name_inside_does_not_take_the_article_along(tag, name):
    assert html_extract.main_text(f"<body><nav><a>x</a></nav><{tag}><div class='{name}'>{ARTICLE}</div></{tag}><footer>f</footer></body>") == ARTICLE_TEXT
    whole = html_extract.main_text(f"<body><{tag}>{ARTICLE}<div class='{name}'><p>{'A paragraph that goes on and on about what it says. ' * 3}</p></div></{tag}></body>")
    assert whole.startswith(ARTICLE_TEXT)


@pytest.mark.parametrize("page", [
    "<article>{a}</article><div id='user-responses'>{c}</div>", "<article>{a}</article><div id='xyz'>{c}</div>", "<main><article>{a}</article><div class='zz'>{c}</div></main>",
    "<article>{a}<section id='comments'>{c}{c}{c}{c}{c}{c}</section></article>", "<div class='page with-sidebar'><article>{a}</article><div class='sidebar'>{c}</div></div>",
    "<main>{a}<div class='ad'>Buy now! The best thing on the market today, and cheap.</div><div class='related'><a>One of the other things here</a> <a>Two of them</a></div></main>",
])
def test_what_is_not_the_article_goes(page):
    assert html_extract.main_text(f"<body>{page.format(a=ARTICLE, c=COMMENT)}</body>") == ARTICLE_TEXT


def test_broken_tags_images_and_buttons():
    assert html_extract.main_text('<p title="broken>Some real text that goes on for long enough, it does.') == "Some real text that goes on for long enough, it does."
    assert html_extract.main_text("<p>foo<img>bar is a text that goes on<wbr> long enough here.</p>") == "foobar is a text that goes on long enough here."
    assert html_extract.main_text("<p>Press the <button>OK</button> button in order to go on with it.</p>") == "Press the OK button in order to go on with it."
    assert html_extract.main_text("<p>a < b and c > d, which is to say that they are so.</p>") == "a < b and c > d, which is to say that they are so."


def test_the_cut_decides_doubtful_names():
    """A short line under a doubtful name goes with the paragraphs that it stands between."""
    page = html_extract.Page("<main><p>The first paragraph of the text has a good many words in it, as it should.</p><div class='notice'><p>So be it</p></div><p>And the last paragraph goes on with as many words as the first one had.</p></main>")
    weights = (*html_extract.START[:7], -14.0, 0.0)
    assert [z > 0 for z in html_extract.scores(page, weights)] == [True, False, True]
    assert html_extract.labelled(page, weights) == ([True, True, True], 1)


def test_weights_of_names_are_learned_both_ways(spark):
    """Where articles themselves are full of a name it says nothing against them; where it stands outside it does."""
    body = "".join(f"<p>This is paragraph number {k} and it has some words in it.</p>" for k in range(6))
    inside = [(k, f"<article><div class='notice'>{body}</div></article><nav><p>Menu of the page, which is about nothing.</p></nav>") for k in range(40)]
    outside = [(k, f"<article>{body}</article><div class='notice'>{body}</div>") for k in range(40)]
    doubtful = html_extract.FEATURES.index("doubtful")
    weights = [html_extract.fit(spark.createDataFrame(rows, "page_id long, html string"))[doubtful] for rows in (inside, outside)]
    assert weights[0] > html_extract.START[doubtful] > weights[1]
    many = [(k, f"<article><p>{'word ' * (k % 9 + 1)}</p></article><nav><a>{'x ' * (k % 5 + 1)}</a></nav>") for k in range(60)]
    rows = spark.createDataFrame(many, "page_id long, html string").repartition(5)
    assert html_extract.fit(rows, sample=20) == html_extract.fit(rows.orderBy(F.desc("page_id")), sample=20) == html_extract.fit(spark.createDataFrame(many[:20], "page_id long, html string"))


@pytest.mark.parametrize("kind", ["section class='comments'", "div id=sidebar", "form", "aside", "div class='cookie notice'"])
def test_boilerplate_may_outweigh_the_article(kind):
    much = "<article><p>Somebody writes a long text here that goes on and on and says nothing at all of it.</p></article>" * 30
    page = f"<body><article><h1>Title</h1><p>A short article of only ten words or so, it is.</p></article><{kind}>{much}</{kind.split()[0]}></body>"
    assert html_extract.main_text(page) == "Title A short article of only ten words or so, it is."
    wrapped = "<body><div class='page with-sidebar'><article><h1>Title</h1><p>A short article of only ten words or so, it is.</p></article></div></body>"
    assert html_extract.main_text(wrapped) == "Title A short article of only ten words or so, it is."


@pytest.mark.parametrize("page", ["<div><p>x</p>" * 8000, "<a " * 20_000, '<a "' * 20_000, "<a '\"" * 20_000, "<![CDATA[" * 20_000, "<span>" * 8000 + "<hr>" * 20_000, "<div>" * 8000 + "</x>" * 20_000, "<i><div>" + "<b>" * 8000 + "</i>" * 20_000, "<p>" * 20_000, "<div><p>one two three four five six.</p><a>x</a>" * 8000])
def test_hostile_pages_take_no_longer(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 1


def test_classifier_is_fitted_and_articles_are_exact(spark):
    """On the driver's pages, whose articles are known; also that the fit does not rest on the order of rows."""
    import html as entities

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    weights = html_extract.fit(pages)
    assert weights != html_extract.START and weights == html_extract.fit(pages.orderBy(F.desc("page_id")))
    assert weights[3] < 0 < weights[0]  # links against, words for
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages, weights).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p|br)>", article))
        assert got[r["page_id"]] == " ".join(b for b in blocks if b)


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(1, 7)
        z = [rng.uniform(-3, 3) for _ in range(n)]
        links = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(labels):
            own = sum(max(-s, 0) if x else max(s, 0) for s, x in zip(z, labels))
            return own + sum(w for a, b, w in links if labels[a] != labels[b])

        least = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_extract.minimum_cut(z, links)) - least) < 1e-6


# Quality rules ---------------------------------------------------------------------------------------------------------
def test_base_rules(docs, empty):
    def truth(t):
        words = WORD.findall(t)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed

    got = quality_rules.assess(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((i, *truth(text(t))) for i, t in corpus())
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality_rules.assess(empty).count() == 0


def test_common_lines(spark):
    rng = random.Random(4)
    stock = "This site uses stock lines everywhere"
    own = [(i, "\n".join([sentence(rng, 15), stock, sentence(rng, 15)])) for i in range(40)]
    drained = [(100 + i, "\n".join([stock] * 4 + [f"x{i}"])) for i in range(5)]
    body = [sentence(rng, 12) for _ in range(3)]
    near = [(200 + i, "\n".join([body[0], body[1], body[2] + f" {i}"])) for i in range(60)]
    copies = [(300 + i, own[0][1]) for i in range(50)]
    rows = [(i, t, "h") for i, t in own + drained + near + copies]
    got = {r["doc_id"]: r for r in quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string, source string"), line_share=0.01).collect()}
    assert all(got[i]["kept"] and got[i]["n_common_lines"] == 1 and got[i]["n_words_left"] == 30 for i, _ in own)
    assert not any(got[i]["kept"] for i, _ in drained)
    assert all(got[i]["kept"] and got[i]["n_common_lines"] == 0 for i, _ in near)


def test_common_lines_are_taken_out(spark):
    rng = random.Random(8)
    stock, other = "Stock line 12 of this site", "stock  LINE 99 of this site"  # equal when normalised
    first = {i: sentence(rng, 15) for i in range(40)}
    last = {i: sentence(rng, 15) for i in range(40)}
    texts = {i: f"{first[i]}\n\n{stock if i % 2 else other}\n{last[i]}" for i in range(40)}
    rows = [(i, t, "en", "h", len(t)) for i, t in texts.items()]
    rows += [(50, f"{first[0]}\n{stock}", "en", "elsewhere", 7), (51, None, "en", "h", 0), (None, texts[1], "en", "h", len(texts[1]))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    got = Counter(map(tuple, quality_rules.clean(docs).collect()))
    want = {i: f"{first[i]}\n\n{last[i]}" for i in texts}
    assert got == Counter([*((i, t, "en", "h", len(t)) for i, t in want.items()), rows[40], (None, want[1], "en", "h", len(want[1]))])
    assert quality_rules.clean(docs).schema == docs.schema and quality_rules.clean(docs.limit(0)).count() == 0


@pytest.mark.parametrize("place", ["start", "middle", "end"])
def test_common_blocks(spark, place):
    """Every line of a shared block is common wherever the block is; lines of near copies are not."""
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnprst"]
    line = lambda: " ".join(rng.choice(words) for _ in range(10))
    rows, own = [], {}
    for size in (2, 5, 20):
        block = [line() for _ in range(size)]
        for i in range(60):
            a, b = [line() for _ in range(10)], [line() for _ in range(10)]
            own[f"b{size}", size * 1000 + i] = size
            rows.append((size * 1000 + i, "\n".join({"start": block + a + b, "middle": a + block + b, "end": a + b + block}[place]), f"b{size}"))
    base = [line() for _ in range(20)]
    for i in range(200):
        edited = list(base)
        edited[rng.randrange(20)] = line()
        rows.append((90_000 + i, "\n".join(edited), "near"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["n_common_lines"] for r in quality_rules.assess(docs).collect()}
    assert {(h, i): got[i] for h, i in own} == own
    assert not any(got[90_000 + i] for i in range(200))


def test_share_of_a_large_host_is_bounded(spark):
    rng = random.Random(10)
    rows = [(i, sentence(rng, 30) + ("\nStock line of thirty documents" if i < 30 else ""), "h") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most, n in ((25, 30), (31, 0)):
        assert quality_rules.assess(docs, line_share=0.5, line_most=most).agg({"n_common_lines": "sum"}).first()[0] == n


_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")


def fold_lines(line):
    return " ".join(WORD.findall(line.translate(_FOLD)))


def lines_of(t):
    return [x for x in map(fold_lines, text(t).split("\n")) if x]


def rules_common(rows):
    """(host, line) of common lines of (identifier, text, host), from the definition."""
    lines = {(t, h): lines_of(t) for _, t, h in rows}
    least = {key: quality_rules.minima([w.encode() for x in own for w in x.split(" ")], quality_rules._signed(key[1].encode())) if own else quality_rules.minima([], quality_rules._signed(key[1].encode())) for key, own in lines.items()}
    crowd = Counter(x for own in least.values() for x in set(own))
    weight = {key: Fraction((1 << 20) // sorted(crowd[x] for x in own)[quality_rules.RANK - 1], 1 << 20) for key, own in least.items()}
    docs, texts, hosts = defaultdict(Fraction), Counter(), Counter(h for _, _, h in rows)
    for key, own in lines.items():
        for x in set(own):
            docs[key[1], x] += weight[key]
            texts[key[1], x] += 1
    share = Fraction(quality_rules.LINE_SHARE).limit_denominator(1000)
    return {k for k, n in docs.items() if n >= quality_rules.LINE_DOCS and n >= Fraction(1, 10) * texts[k] and n >= min(share * hosts[k[0]], quality_rules.LINE_MOST)}


def rules_truth(rows):
    """(identifier, kept, common lines, words left) of (identifier, text, host), from the definition."""
    common, out = rules_common(rows), Counter()
    for i, t, h in rows:
        words = WORD.findall(text(t))
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        gone = [x for x in lines_of(t) if (h, x) in common]
        left = len(words) - sum(len(x.split(" ")) for x in gone)
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        out[i, not failed and left >= quality_rules.MIN_LEFT and 10 * left >= len(words), len(set(gone)), left] += 1
    return out


def test_verdicts_against_brute_force(spark):
    """Stock lines, depleted documents, copies, near copies, hosts, nulls and repeated rows."""
    rng = random.Random(14)
    stock = [sentence(rng, 12) for _ in range(4)]
    rows = [(i, "\n".join([*rng.sample(stock, rng.randint(0, 4)), *(sentence(rng, 9) + f" u{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 4)))]), f"h{i % 3}") for i in range(240)]
    base = [sentence(rng, 10) for _ in range(6)]
    rows += [(1000 + i, "\n".join([*base[:5], base[5] + f" v{i % 40}"]), "h0") for i in range(120)]
    rows += [(2000 + i, rows[i][1], "h1") for i in range(40)] + [(3000, None, "h1"), (3001, "", "h1"), (None, rows[0][1], "h0"), rows[1], rows[1], (3002, sentence(rng, 20_000), "h2"), (3003, stock[0], "")]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, source string, line int, kept boolean")
    got = Counter((r["doc_id"], r["kept"], r["n_common_lines"], r["n_words_left"]) for r in quality_rules.assess(docs).collect())
    want = rules_truth(rows)
    assert got == want
    assert any(n for _, _, n, _ in want) and any(not kept and n for _, kept, n, _ in want) and not any(n for i, _, n, _ in want if i and 1000 <= i < 2000)


# Quality model ---------------------------------------------------------------------------------------------------------
def kneser_ney(texts, order=5, classes=quality_model.CLASSES):
    """log p(character | those before), from the definition: interpolated, three discounts an order, continuation counts below."""
    alphabet = {c for c, _ in sorted(Counter("".join(texts)).items(), key=lambda x: (-x[1], x[0]))[: classes - 2]}
    known = lambda c: c if c in alphabet else "?"
    grams = {order: Counter()}
    for t in texts:
        row = [None] * (order - 1) + [known(c) for c in t]
        grams[order].update(tuple(row[i : i + order]) for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    discount, total, off = {}, {}, {}
    for k, counts in grams.items():
        n = Counter(counts.values())
        y = n[1] / max(n[1] + 2 * n[2], 1)
        discount[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i, 0.1 * i), 0.95 * i) for i in (1, 2, 3)]
        total[k], off[k] = Counter(), defaultdict(float)
        for g, c in counts.items():
            total[k][g[:-1]] += c
            off[k][g[:-1]] += discount[k][min(c, 3)]

    @functools.lru_cache(maxsize=None)
    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(alphabet) + 1)
        low, all_ = p(g[1:]), total[k][g[:-1]]
        if not all_:
            return low
        c = grams[k][g]
        return (c - discount[k][min(c, 3)]) / all_ + off[k][g[:-1]] / all_ * low

    def log_perplexity(t):
        row = [None] * (order - 1) + [known(c) for c in t]
        return -sum(math.log(p(tuple(row[i : i + order]))) for i in range(len(t))) / len(t) if t else None

    return log_perplexity, alphabet


@pytest.mark.parametrize("classes,entries", [(quality_model.CLASSES, 2_000_000), (12, 2_000_000), (quality_model.CLASSES, 300)])
def test_model_is_kneser_ney(spark, monkeypatch, classes, entries):
    """Probabilities as by definition, with few classes and with many shards too, in alphabets beyond the basic plane; they add up to one."""
    monkeypatch.setattr(quality_model, "CLASSES", classes)
    monkeypatch.setattr(quality_model, "SHARD_ENTRIES", entries)
    rng = random.Random(6)
    texts = {"en": [sentence(rng, 40) for _ in range(30)] + ["a", "\0\0 nul"], "zh": ["".join(rng.choice("天地玄黄宇宙洪荒日月盈昃😀") for _ in range(60)) for _ in range(20)]}
    model = quality_model.train(spark.createDataFrame([(lang, t) for lang, own in texts.items() for t in own], "lang string, text string"))
    assert (len(model.shards["en"]) > 2) == (entries == 300)
    for lang, own in texts.items():
        truth, alphabet = kneser_ney(own, classes=classes)
        asked = own[:10] + ["", "x", "alphas betas 寒来", "天地 alpha", "zq!xk %%% QW" * 3, sentence(rng, 2000)]
        got = quality_model.log_perplexity(model, lang, asked)[0]
        for t, v in zip(asked, got):
            assert (v is None) if not t else abs(v - truth(t)) < 2e-6 * max(1, abs(v)), (lang, t[:20])
        head = own[0][:9]
        base = quality_model.log_perplexity(model, lang, [head])[0][0] * len(head)
        each = quality_model.log_perplexity(model, lang, [head + c for c in sorted(alphabet) + ["\u0416"]])[0]
        assert abs(sum(math.exp(base - v * (len(head) + 1)) for v in each) - 1) < 1e-4


def test_classifier_separates(spark, empty):
    rng = random.Random(7)
    rows = [(i, sentence(rng, 60), "en") for i in range(200)] + [(500 + i, sentence(rng, 60).upper().replace(" ", "!! "), "en") for i in range(20)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "Text in an unknown tongue", "xx"), (903, sentence(rng, 30), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(500, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_model.classify(docs, labels).collect()}
    assert sum(got[i] for i in range(200)) >= 198 and not any(got[500 + i] for i in range(20))
    assert (got[900], got[901], got[902], got[903]) == (False, False, True, True)
    assert quality_model.keep_good(docs, labels).columns == docs.columns
    assert quality_model.classify(empty, labels).count() == 0
    # Ties, repeated rows, very long texts, columns of the same names, toxic or contradicting labels.
    more = spark.createDataFrame([*rows, rows[3], rows[3], (None, rows[3][1], "en"), (950, sentence(rng, 20_000), "en"), (951, "x", "en")], "doc_id long, text string, lang string")
    more = more.withColumn("threshold", F.lit("t")).withColumn("_trusted", F.lit(1)).withColumn("kept", F.lit(0))
    odd = labels.unionByName(spark.createDataFrame([(500 + i, 1, 1) for i in range(1, 20)] + [(1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")).withColumn("lang", F.lit("zz"))
    again = quality_model.classify(more, odd).collect()
    assert len(again) == len(rows) + 5 and len({r["log_perplexity"] for r in again if r["doc_id"] == 3}) == 1
    assert all(r["kept"] for r in again if r["doc_id"] == 950) and not any(r["kept"] for r in again if r["doc_id"] and 500 <= r["doc_id"] < 520)
    none = quality_model.classify(docs, labels.where("doc_id = 2")).collect()  # its own fold has no model: no threshold
    assert all(r["kept"] and r["threshold"] is None for r in none if r["n_chars"])
    assert all(r["kept"] for r in quality_model.classify(docs.where("doc_id < 5"), labels.limit(0)).collect())


def test_threshold_is_the_quantile(spark):
    rng = random.Random(11)
    scores = [round(rng.expovariate(1) + 1, 3) for _ in range(999)]
    rows = [("big", v) for v in scores] + [("small", v) for v in scores[:20]] + [("one", 2.0), ("none", None)]
    got = {r["lang"]: r["threshold"] for r in quality_model.thresholds(spark.createDataFrame(rows, "lang string, log_perplexity double")).collect()}
    assert got.keys() == {"big", "small", "one"} and got["one"] == 2.0
    assert abs(got["big"] - sorted(scores)[989]) < 1e-9  # the least value with 99% of all up to it
    assert abs(got["small"] - max(scores[:20])) < 1e-9


def test_half_of_the_trusted_documents_give_nearly_the_same_threshold(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, sentence(rng, rng.randint(40, 120)), "en") for i in range(800)], "doc_id long, text string, lang string")
    limits = []
    for labelled in (range(800), range(0, 800, 2), range(1, 800, 2)):
        labels = spark.createDataFrame([(i, 1, 0) for i in labelled], "doc_id long, quality int, toxic int")
        limits.append(quality_model.classify(docs, labels).first()["threshold"])
    assert max(limits) < 1.05 * min(limits)


def test_shards_are_read_once_and_only_where_asked(spark, monkeypatch):
    """Ten shards and more: a shard that no n-gram is dealt to is not read, the others once for all runs, also beyond what is kept."""
    monkeypatch.setattr(quality_model, "SHARD_ENTRIES", 100)
    rng = random.Random(13)
    model = quality_model.train(spark.createDataFrame([("en", sentence(rng, 60)) for _ in range(40)], "lang string, text string"))
    shards = model.shards["en"]
    assert len(shards) >= 10
    read = []
    monkeypatch.setattr(quality_model, "_shard", lambda folder, name, real=quality_model._shard: read.append(name) or real(folder, name))
    monkeypatch.setattr(quality_model, "KEPT_BYTES", 1)
    quality_model._KEPT.clear()
    runs = [[sentence(rng, 30), "x"], [sentence(rng, 30)], ["alpha beta"]]
    together = quality_model.log_perplexity(model, "en", *runs)
    assert len(set(read)) <= len(shards) and len(quality_model._KEPT) == 1
    assert all(read.count(name) <= len(runs) for name in read) and sum(a != b for a, b in zip(read, read[1:])) < len(shards)
    assert together == [quality_model.log_perplexity(model, "en", own)[0] for own in runs]
    read.clear()
    quality_model.log_perplexity(model, "en", ["a"])
    assert 0 < len(read) < len(shards)
    quality_model._KEPT.clear()


# Jaccard join ----------------------------------------------------------------------------------------------------------
def jaccard_truth(rows, words=5, percent=75):
    sets = []
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text(t)))
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(k)
    out = []
    for members in groups.values():
        known = [rows[k][0] for k in members if rows[k][0] is not None]
        out += [(rows[k][0], len(sets[k]), min(known) if known else None) for k in members]
    return Counter(out)


def near_corpus():
    rng = random.Random(8)
    rows = corpus()
    for g in range(6):
        base = sentence(rng, rng.randint(30, 150)).split()
        for k in range(12):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"w{rng.randint(0, 9)}"
            rows.append((2000 + 20 * g + k, " ".join(own)))
    passage = sentence(rng, 60)
    return rows + [(3000 + k, f"{sentence(rng, 10)} {passage} {sentence(rng, 8)}") for k in range(30)]


def test_jaccard_join(spark, empty, monkeypatch):
    rows = near_corpus()
    docs = frame(spark, rows)
    want = jaccard_truth(rows)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs).collect()) == want
    for name, value in (("GROUP", 2), ("ROUNDS", 0), ("ROUNDS", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs).collect()) == want
    left = jaccard_join.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} >= {c for _, n, c in want if n}
    assert jaccard_join.join(empty).count() == 0


def test_jaccard_join_compares_no_more_where_bitmaps_would_be_full(spark, monkeypatch):
    """Bitmaps of 1,024 bits would hold nearly every token; tokens are joined instead, with the same rows and as few pairs."""
    rows = near_corpus()
    compared, real = [], jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or real(pairs, *rest))
    got = []
    for bits in (jaccard_join.MAP_BITS, 1 << 10):
        monkeypatch.setattr(jaccard_join, "MAP_BITS", bits)
        monkeypatch.setattr(jaccard_join, "CLASS_BITS", bits)
        before = len(compared)
        got.append((Counter(tuple(r) for r in jaccard_join.join(frame(spark, rows)).collect()), sum(compared[before:])))
    assert got[0][0] == got[1][0] == jaccard_truth(rows)
    assert got[1][1] <= 1.05 * got[0][1] < 4 * len(rows)


def test_counts_of_a_single_batch_add_up():
    """A task may get one batch only, with a token of several tasks in it."""
    tokens, n = jaccard_join._merge([(np.array([5, 3, 5, 3, 9]), np.array([1, 2, 1, 1, 1]))])
    assert (tokens.tolist(), n.tolist()) == ([3, 5, 9], [3, 2, 1])
    assert [len(x) for x in jaccard_join._merge([(np.empty(0, np.int64), np.empty(0, np.int64))])] == [0, 0]


def test_jaccard_join_tries_a_pair_before_all_sets_of_two_groups_meet(spark, monkeypatch):
    """Two groups of near copies of which few pairs link, and most are nearly as near, do not meet with all their sets."""
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(240):
        words = base[:76] + [f"v{k}" for k in range(9)] + base[85:] if i % 2 else list(base)
        if i > 1:  # the first of either group is near all of the other
            words[(95 if i % 2 else 10) + i % 55] = f"x{i}"
        rows.append((i, " ".join(words)))
    met, real = [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, name, **options: (met.append(df.count()) if name == "pairs" else None) or real(df, name, **options))
    assert Counter(tuple(r) for r in jaccard_join.join(frame(spark, rows)).collect()) == jaccard_truth(rows)
    assert met[0] < 5 * len(rows)


def test_jaccard_join_does_not_depend_on_partitions(spark):
    rows = near_corpus()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = jaccard_join.join(frame(spark, rows).repartition(11)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == jaccard_truth(rows)


def test_components_by_stars(spark):
    rng = random.Random(9)
    pairs = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 240)]
    links = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a long, b long")
    one = {tuple(r) for r in jaccard_join.components(links).collect()}
    many = {tuple(r) for r in jaccard_join.components(links, "test-stars", in_one_task=0).collect()}
    assert one == many and {c for s, c in one if 200 <= s <= 240} == {200}


def test_near_duplicates_by_row(spark):
    """A row without an identifier goes only where its own text is a copy; equal rows of the smallest identifier stay."""
    rng = random.Random(15)
    base = sentence(rng, 60)
    rows = [(5, base), (7, base + " more"), (None, base + " again"), (None, "something else with five words or more"), (None, None), (5, base), (9, ""), (9, "other words that nobody else has here")]
    left = jaccard_join.drop_near_duplicates(frame(spark, rows).withColumn("_text", F.lit(1)).withColumn("_id", F.lit(2)))
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([rows[0], rows[0], rows[3], rows[4], rows[6], rows[7]])


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_bands_hold_all_partners(spark, percent):
    sizes = spark.createDataFrame([(n,) for n in range(1, 400)], "n long")
    near = sizes.select("n", jaccard_join._near_bands("n", percent).alias("band")).alias("x").join(sizes.select(F.col("n").alias("m"), jaccard_join._band("n", percent).alias("band")), "band").select("n", "m")
    got = {tuple(r) for r in near.collect()}
    assert all((a, b) in got for a in range(1, 400) for b in range(1, 400) if 100 * min(a, b) >= percent * max(a, b))


# WARC ------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("least", [0, 10])
def test_warc(spark, least):
    html = ["<p>one</p>" * 20, None, "", "<p>é</p>", "<p>one</p>" * 20, "tiny", "tiny", "x" * 300_000]
    rows = [(i * 3, f"http://h/{i}\r\nX: y" if i else None, h, "q") for i, h in enumerate(html)] + [(None, "u", "tiny", "q"), (21, "v", "x" * 300_000, "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = warc.round_trip(pages, min_bytes=least, tasks=3, roll_bytes=500).collect()
    last = {}
    for i, _, h, _ in rows:
        last[text(h)] = max(last.get(text(h), -1), -1 if i is None else i)
    want = Counter()
    for i, _, h, _ in rows:
        data = text(h).encode()
        again = len(data) >= least and last[text(h)] != i
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", last[text(h)] if again else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_is_deterministic(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i % 5}</p>") for i in range(50)], "page_id long, url string, html string")
    sums = []
    for k in range(2):
        from factgraph.llm.common import workspace

        manifest = warc.write(pages.repartition(3 + k), workspace(spark, "warc-test"), tasks=2, roll_bytes=1000)
        sums.append(sorted((r["file"], r["records"], r["bytes"], r["sha256"]) for r in manifest.collect()))
    assert sums[0] == sums[1] and len(sums[0]) > 2


# URL filters -----------------------------------------------------------------------------------------------------------
def test_url_filters(spark):
    entries = [("Example.com", "2024-01-01", "block"), ("example.com", "2024-03-01", "remove"), ("www2.example.com", "2024-02-01", "allow"), ("example.com/a/b", "2024-01-15", "allow"), ("example.com", "2024-03-01", "allow"), (None, "2024-01-01", "block"), ("x.org", None, "block")]
    log = spark.createDataFrame(entries, "key string, date string, action string")
    cases = [("http://www.example.com/x?q#f", "2024-01-10", "block"), ("https://user@EXAMPLE.com:80/a/b/c", "2024-01-20", "allow"), ("https://example.com/a/b", "2024-01-10", "block"), ("http://sub.www2.example.com", "2024-02-02", "allow"), ("http://example.com", "2023-12-31", "none"), ("http://example.com", "2024-03-02", "allow"), ("http://other.com/example.com", "2024-01-10", "none"), (None, "2024-01-10", "none"), ("http://example.com", None, "none"), ("", "2024-01-10", "none")]
    rows = [(k, u, t and date.fromisoformat(t)) for k, (u, t, _) in enumerate(cases)]
    captures = spark.createDataFrame([*rows, rows[0], (None, *rows[0][1:])], "page_id long, url string, fetched date")
    for size in (1 << 20, 0):
        got = url_filters.evaluate(captures, log, broadcast_bytes=size).collect()
        assert Counter((r["page_id"], r["verdict"]) for r in got) == Counter([*((k, v) for k, (_, _, v) in enumerate(cases)), (0, "block"), (None, "block")])
    assert {r["verdict"] for r in url_filters.evaluate(captures, log.limit(0)).collect()} == {"none"}
    assert url_filters.evaluate(captures.limit(0), log).count() == 0


def test_list_keys_are_normalised_like_urls(spark):
    entries = [("h.com/News", "block"), ("www.w.com", "block"), ("d.com/a/b/c/d/e", "allow"), ("b.c.d.e.f.g.org", "block"), ("HTTP://u@S.com:8080/x//y/?q#f", "block"), (None, "block"), ("", "block"), ("bad.com", "block")]
    log = spark.createDataFrame([(k, None if k == "bad.com" else "2024-01-01", a, 1) for k, a in entries], "key string, date string, action string, host int")
    urls = ["http://h.com/News", "http://www.w.com/", "http://d.com/a/b/c/d/e/f", "http://a.b.c.d.e.f.g.org/", "https://s.com/x/y/z", None, "", "http://bad.com", "http://l.com/" + "p/" * 3000]
    captures = spark.createDataFrame([(k, u, datetime(2024, 2, 1), "k", "v") for k, u in enumerate(urls)] + [(99, urls[0], None, "k", "v")], "page_id long, url string, fetched timestamp_ntz, key string, verdict string")
    want = {0: "block", 1: "block", 2: "allow", 3: "block", 4: "block", 5: "none", 6: "none", 7: "none", 8: "none", 99: "none"}
    for size, heavy in ((1 << 20, 1000), (0, 1000), (3 * url_filters.ROW_BYTES, 1), (0, 1)):  # broadcast, shuffled, heavy keys apart, too many of them
        assert {r["page_id"]: r["verdict"] for r in url_filters.evaluate(captures, log, broadcast_bytes=size, heavy_rows=heavy).collect()} == want


def test_entries_hold_from_their_very_moment(spark):
    log = spark.createDataFrame([("a.com", "2024-01-01 12:00:00", "block"), ("a.com", "2024-01-01 18:00:00", "remove"), ("a.com", "2024-01-03", "allow"), ("a.com", "soon", "block")], "key string, date string, action string")
    times = ["2024-01-01 11:59:59.999999", "2024-01-01 12:00:00", "2024-01-01 17:59:59.999999", "2024-01-01 18:00:00", "2024-01-03", "2024-01-02 23:59:59"]
    captures = spark.createDataFrame([(k, "http://a.com/x", t) for k, t in enumerate(times)], "page_id long, url string, fetched string")
    assert [r["verdict"] for r in url_filters.evaluate(captures, log).orderBy("page_id").collect()] == ["none", "block", "block", "none", "allow", "none"]


def test_url_filters_of_any_depth(spark):
    deep = ".".join("abcdefghij") + ".org"
    entries = [("h.com/a/b/c/d/e", "block"), ("H.com/a/b/c/d/e/f/g", "allow"), (deep[4:], "block"), (f"{deep[2:]}/X/y", "allow"), ("case.com/Docs/", "block")]
    log = spark.createDataFrame([(k, "2024-01-01", a) for k, a in entries], "key string, date string, action string")
    cases = [("http://h.com/a/b/c/d/e/f", "block", entries[0][0]), ("http://h.com/a/b/c/d/e/f/g/h", "allow", "h.com/a/b/c/d/e/f/g"), ("http://h.com/a/b/c/d", "none", None)]
    cases += [(f"http://{deep}/x", "block", deep[4:]), (f"http://{deep[2:]}/X/y/z", "allow", f"{deep[2:]}/X/y"), (f"http://{deep[2:]}/x/y", "block", deep[4:])]
    cases += [("http://CASE.com/Docs/a", "block", "case.com/Docs"), ("http://case.com/docs/a", "none", None)]
    captures = spark.createDataFrame([(k, u, date(2024, 2, 1)) for k, (u, _, _) in enumerate(cases)], "page_id long, url string, fetched date")
    got = {r["page_id"]: (r["verdict"], r["matched_key"]) for r in url_filters.evaluate(captures, log).collect()}
    assert got == {k: (v, m) for k, (_, v, m) in enumerate(cases)}


# Shared folders --------------------------------------------------------------------------------------------------------
def test_machine_local_folders_are_for_local_masters_only(spark, monkeypatch):
    from factgraph.llm import common

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master, applicationId = "spark://host:7077", "app-1"

    with pytest.raises(ValueError):
        common.shared_root(Session())
    Session.sparkContext.master = "local[2]"
    assert common.shared_root(Session()).startswith("file:///")
    table = common.written(spark.range(3), "test")
    assert table.count() == 3
    common.forget(table)
    assert not common.names_in(spark, table._written_to)


def test_jaccard_join_sends_few_pairs_to_the_sets(spark, monkeypatch):
    """Of the sets only those in a pair are shuffled; many pairs give the same."""
    rng = np.random.default_rng(5)
    sets = [(i, 300, sorted(map(int, rng.integers(-(1 << 62), 1 << 62, 300)))) for i in range(400)]
    sets[1] = (1, 300, sorted(sets[0][2][:290] + sets[1][2][:10]))
    sets = jaccard_join.written(spark.createDataFrame(sets, "sid long, n long, tokens array<long>").repartition(4), "sets")
    edges = jaccard_join.written(jaccard_join._edges(sets, 75), "edges")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (5, 6)], "a long, b long")

    def shuffled() -> int:
        time.sleep(1)  # the status store follows the events
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the sets were many
    try:
        before = shuffled()
        assert [tuple(r) for r in jaccard_join._verified(pairs, edges, sets, 75, "found").collect()] == [(0, 1)]
        assert shuffled() - before < 100_000
        monkeypatch.setattr(jaccard_join, "SENT_PAIRS", 0)
        assert [tuple(r) for r in jaccard_join._verified(pairs, edges, sets, 75, "found").collect()] == [(0, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_jaccard_join_opens_buckets_once(spark, monkeypatch):
    """However many rounds join components that meet, the rows of buckets are made once, and the components are right."""
    rows, opened, real = near_corpus(), [], jaccard_join._open
    for name, value in (("GROUP", 2), ("ROUNDS", 1), ("FEW_MEETINGS", -1), ("FEW_LINKS", 0)):
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(jaccard_join, "_open", lambda *a: opened.append(1) or real(*a))
    tried, meeting = [], jaccard_join._tried
    monkeypatch.setattr(jaccard_join, "_tried", lambda *a: tried.append(1) or meeting(*a))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(frame(spark, rows)).collect()) == jaccard_truth(rows)
    assert len(opened) == 1 and tried
