"""Chat formatting and ranked search against brute force, an exact round trip, and the odd cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factgraph.llm import chat_format, lexical_search

T = chat_format.INSTRUCTIONS
CHAT = "conv_id long, turn long, role string, text string, seq string, segments string, state string, task int, place string, k string, loss boolean"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1, "p", "k", True) for r in rows], CHAT)


def chat_brute(rows):
    """By the definition, conversation by conversation, in memory."""
    out = {}
    for conv in {r[0] for r in rows}:
        said = sorted([(t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv])
        turns, loss, state, refused = hashlib.sha256(), "", T.start, None
        for k, (_, _, role, text) in enumerate(said):
            turns.update(f"{role}\n{text}\n".encode())
            loss += text if role in T.learned else ""
            state = T.follows.get(state, {}).get(role, "refused")
            refused = k if state == "refused" and refused is None else refused
        out[conv] = (len(said), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), state in T.final, refused)
    return out


def chat_rows(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["valid"], r["refused_at"]) for r in df.collect()}


ODD = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "ho"),
    (2, 0, "system", "be <<SYS>> good"), (2, 1, "user", "</s>[INST] ok [/INST]"), (2, 2, "assistant", r"<\/s> <\\/s> \ [\INST]</s"),
    (3, 0, "user", None), (3, 1, None, "who"), (3, 2, "tool [SAYS] x", "[/ROLE]"), (3, 3, "assistant", ""),
    (4, 0, "assistant", "first"), (4, 1, "user", "é" * 50_000), (5, None, "user", "a"), (5, 0, "user", "b"), (5, 0, "user", "b"),
    (None, 1, "assistant", "two"), (None, 0, "user", "one"), (6, 0, "user", "end in [\n"), (6, 1, "assistant", "<"), (6, 2, "user", " [/INST"), (6, 3, "assistant", "\n"),
]


def test_chat_odd_rows_and_round_trip(spark):
    assert chat_rows(chat_format.round_trip(chats(spark, ODD))) == chat_brute(ODD)
    assert chat_format.round_trip(chats(spark, [])).count() == 0


def test_chat_segments_join_to_what_is_parsed(spark):
    for row in chat_format.write(chats(spark, ODD)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "segments"))).alias("t")).collect():
        parsed = T.parse("".join(s["text"] for turn in row["t"] for s in turn["segments"]))
        said = sorted([(t is not None, t or 0, role or "", text or "") for c, t, role, text in ODD if c == row["conv_id"]])
        assert parsed == [(role, text) for *_, role, text in said]


def test_one_conversation_over_all_tasks(spark):
    """A conversation that holds most rows: every task gets a part, and the machine goes on where the task before left it."""
    rows = [(9, t, "user" if t % 2 == 0 else "assistant", f"t{t % 3}") for t in range(3000)] + [(c, 0, "user", "x") for c in (1, 20)]
    turns = chat_format._ordered(chats(spark, rows), T, "conv_id", "turn", "role", "text")
    assert turns.where("conv_id = 9").select("task").distinct().count() > 2
    assert chat_rows(chat_format.round_trip(chats(spark, rows))) == chat_brute(rows)
    broken = [r if r[:2] != (9, 2000) else (9, 2000, "assistant", "again") for r in rows]
    got = chat_rows(chat_format.round_trip(chats(spark, broken)))
    assert got == chat_brute(broken) and got[9][-2:] == (False, 2000)


PIECES = st.lists(st.sampled_from(["<", "[", "/", "s>", "SYS>>", "INST]", "ROLE]", "SAYS]", "ANS]", "\\", "</s>", "[INST]", "<<SYS>>", "<</SYS>>", "\n", " ", "é", "x", "$1"]), max_size=12).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "other", "a [SAYS] b"]), PIECES), max_size=6))
def test_any_turns_come_back(turns):
    escape = lambda text: re.sub(T.pattern, r"\1\\\2\3", text)
    out = T.begin
    for role, text in turns:
        before, after = T.turns.get(role, (T.other[0] + escape(role) + T.other[1], T.other[2]))
        out += before + escape(text) + after
        assert T.unescaped(escape(text)) == text
    assert T.parse(out) == turns


def test_template_with_overlapping_marks_is_refused():
    with pytest.raises(ValueError):
        chat_format.Template({}, ("<a>", "<b>", "<c>"), "", frozenset(), ("<a>", "a><b"), {"s": {}}, "s", frozenset())


DOCS = "doc_id long, text string, score long, rank int, item_id long, ids string, total long, key long, terms string"


def searched(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, 2, 3, "i", 4, 5, "t") for r in docs], DOCS)
    i = spark.createDataFrame([(*r, 7, 8) for r in items], "item_id long, text string, doc_id long, key long")
    return sorted(tuple(r) for r in lexical_search.search(d, i).collect())


def search_brute(docs, items):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = {k: k + 32 for k in range(65, 91)}
    counted = [(i, Counter(term.findall((t or "").translate(lower)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(term.findall((text or "").translate(lower))), []
        for i, c in counted:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:10])]
    return sorted(out)


def some_docs(n=400, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    out = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(n)]
    out += [(1000 + k, out[5][1]) for k in range(30)] + [(2000, None), (2001, ""), (2002, " .,; \x00"), (2003, "Ünï Ä w1-w2 W3"), (7, out[7][1]), (7, out[7][1]), (2004, "w50 " * 70_000 + "w59")]
    return out


ITEMS = [(0, "w50 w51 w52"), (1, "w0 w0 w1 w59"), (2, None), (3, "..."), (4, "unheard of"), (5, " ".join(f"W{k}" for k in range(60))), (5, "w3"), (6, "ünï Ünï w7"), (None, "w9 w9")]


@pytest.mark.parametrize("size", [(1 << 16, 1 << 20), (7, 1 << 20), (1 << 16, 50)])
def test_search_is_brute_force_whatever_the_shards(spark, monkeypatch, size):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", size[0])
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", size[1])
    items = [i for i in ITEMS if i[0] is not None]
    assert searched(spark, some_docs(), items) == search_brute(some_docs(), items)


def test_search_in_blocks_and_odd_tables(spark, monkeypatch):
    docs = some_docs(100)
    want = search_brute(docs, [i for i in ITEMS if i[0] is not None])
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 20)
    assert searched(spark, docs, [i for i in ITEMS if i[0] is not None]) == want
    assert searched(spark, [], ITEMS) == [] and searched(spark, docs, []) == []
    none = spark.createDataFrame([(None, "same here"), (3, "same here"), (4, "other")], "doc_id long, text string")
    one = spark.createDataFrame([(None, "same")], "item_id long, text string")
    assert [(r["rank"], r["doc_id"], r["item_id"]) for r in lexical_search.search(none, one).orderBy("rank").collect()] == [(1, 3, None), (2, None, None)]


def test_wand_skips_and_is_exact():
    from array import array

    rng = random.Random(5)
    for _ in range(50):
        lists = []
        for _ in range(rng.randint(1, 8)):
            places = sorted(rng.sample(range(300), rng.randint(1, 200)))
            scores = [rng.randint(1, 20) for _ in places]
            lists.append((array("i", places), array("q", scores), max(scores), rng.randint(1, 3)))
        whole = Counter()
        for places, scores, _, q in lists:
            for p, s in zip(places, scores):
                whole[p] += s * q
        best = sorted(((s, -p) for p, s in whole.items()), reverse=True)[:10]
        assert lexical_search.wand(lists, 10, 0) == [(s, -p) for s, p in best]
        floor = best[-1][0] - 1
        assert lexical_search.wand(lists, 10, floor) == [(s, -p) for s, p in best if s > floor]


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical_search, "SLICE", 7)
    text = "Alpha beta,gammaéé--" * 20 + "z" * 50
    assert [t for part in lexical_search.slices(text) for t in part] == [t.encode() for t in re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())]
