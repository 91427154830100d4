"""Token ids from a tokenizers file, with a memo of words.

A byte-level pre-tokenizer never joins a space to visible characters before it, so a text may be cut before every space
that follows a visible character, and before the line feeds between two lines, and the parts encoded apart. Arrow finds the
distinct parts of a run of texts and cuts the punctuation off their ends; each worker keeps the ids of the heads that are left
in one array, and only pre-tokens it has not met go to the tokenizers library. Texts with other runs of white space are cut by
a regular expression instead, texts with special tokens go to the library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import trim

#: Entries of either half of a worker's memo and the longest key; both only bound memory.
MEMO_ENTRIES, MEMO_KEY = 200_000, 64
#: Characters that are encoded together at most; a batch from Spark is mostly less.
SLICE_CHARS = 6_000_000
#: Pre-tokens that the library gets in one text.
GROUP = 256
#: Fixed value: the published pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S)(?= )")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: By last byte: 0 a letter or digit, 1 white space, 2 other ASCII, 3 part of another character.
_ENDS = np.array([3 if b > 127 else 0 if chr(b).isalnum() else 1 if chr(b).isspace() else 2 for b in range(256)], np.uint8)


def _spelling() -> dict[int, str]:
    """The byte-level alphabet by its rule: visible Latin-1 characters stand for themselves, the other bytes for 256 and up."""
    rest = iter(range(256, 512))
    return {b: chr(b) if chr(b).isprintable() and b != 32 else chr(next(rest)) for b in range(256)}


def strings(parts: pa.LargeStringArray, lead: str = "") -> list[str]:
    """The strings of an array after ``lead``; joined and split again at once, which is faster than one by one."""
    n = len(parts)
    if not n:
        return []
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, n], pa.int64()), parts), pa.scalar("\0" + lead, pa.large_string()))[0].as_py()
    found = (lead + joined).split("\0")
    return found if len(found) == n else [lead + p for p in parts.to_pylist()]


def _last(parts: pa.LargeStringArray) -> np.ndarray:
    """``_ENDS`` of each string's last byte; 2 for empty ones."""
    offsets = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
    data = np.frombuffer(parts.buffers()[2] or b"", np.uint8)
    out = np.full(len(parts), 2, np.uint8)
    some = offsets[1:] > offsets[:-1]
    out[some] = _ENDS[data[offsets[1:][some] - 1]]
    return out


def _cut(parts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, pa.LargeStringArray, pa.LargeStringArray]:
    """Each part as the line feeds it begins with, its head, and the ASCII punctuation at its end."""
    offsets = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
    rest = pc.ascii_ltrim(parts, "\n")
    cuts = np.empty(3 * len(parts) + 1, np.int64)
    cuts[::3] = offsets
    cuts[1::3] = offsets[1:] - pc.binary_length(rest).to_numpy()
    cuts[2::3] = cuts[1::3] + pc.binary_length(pc.ascii_rtrim(rest, _PUNCTUATION)).to_numpy()
    three = pa.LargeStringArray.from_buffers(3 * len(parts), pa.py_buffer(cuts), parts.buffers()[2] or pa.py_buffer(b""))
    places = np.arange(0, 3 * len(parts), 3)
    return tuple(three.take(pa.array(places + k)) for k in range(3))


def gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after another."""
    stops = np.cumsum(sizes)
    at = np.arange(stops[-1] if len(stops) else 0, dtype=np.int32)
    at += np.repeat((begins - stops + sizes).astype(np.int32), sizes)
    return flat[at]


class _Half:
    """Ids of strings, side by side in one array; place 0 is the empty string."""

    def __init__(self):
        self.places: dict[str, int] = {"": 0}
        self.ids, self.begins, self.sizes = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used, self.count = 0, 1


class Memo:
    """What a worker remembers of the ids of strings, in two halves of a bounded number of strings."""

    def __init__(self):
        self.young, self.old = _Half(), _Half()

    def turn(self) -> None:
        """When the younger half is full it becomes the older one, whose strings are forgotten. Places found before are void."""
        if self.young.count > MEMO_ENTRIES:
            self.young, self.old = _Half(), self.young

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray, remember: bool = True) -> np.ndarray:
        """The places of new strings; long ones are not found again."""
        half, n = self.young, len(names)
        while half.used + len(ids) > len(half.ids):
            half.ids = np.concatenate([half.ids, np.empty_like(half.ids)])
        while half.count + n > len(half.begins):
            half.begins, half.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (half.begins, half.sizes))
        half.ids[half.used : half.used + len(ids)] = ids
        half.begins[half.count : half.count + n] = half.used + np.cumsum(sizes) - sizes
        half.sizes[half.count : half.count + n] = sizes
        places = range(half.count, half.count + n)
        half.used, half.count = half.used + len(ids), half.count + n
        if remember:
            if max(map(len, names), default=0) <= MEMO_KEY:
                half.places.update(zip(names, places))
            else:
                half.places.update((t, k) for t, k in zip(names, places) if len(t) <= MEMO_KEY)
        return np.arange(places.start, places.stop)

    def find(self, names: list[str]) -> np.ndarray:
        """Places of what is remembered, else -1. What only the older half holds moves to the younger."""
        old = self.old
        at = np.fromiter(map(self.young.places.get, names, repeat(-1)), np.int64, len(names))
        if old.count > 1 and len(miss := np.flatnonzero(at < 0)):
            asked = [names[i] for i in miss.tolist()]
            there = np.fromiter(map(old.places.get, asked, repeat(-1)), np.int64, len(asked))
            hit = np.flatnonzero(there >= 0)
            from_ = there[hit]
            at[miss[hit]] = self.add([asked[i] for i in hit.tolist()], gathered(old.ids, old.begins[from_], old.sizes[from_]), old.sizes[from_])
        return at

    def sizes(self, places: np.ndarray) -> np.ndarray:
        return self.young.sizes[places]

    def ids(self, places: np.ndarray) -> np.ndarray:
        """The ids at places, one after another."""
        return gathered(self.young.ids, self.young.begins[places], self.young.sizes[places])


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        #: Only with this pre-tokenizer, and nothing before it, may texts be cut.
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.findall = regex.compile(PATTERN).findall
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # the memo makes it useless
        # The same model for pre-tokens that are cut and spelt already: it only takes them apart at line feeds.
        self.model, self.spelling = Tokenizer(model), _spelling()
        self.model.pre_tokenizer = pre_tokenizers.Split(self.spelling[10], "isolated")
        self.memo = Memo()

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, np.uint32) for e in batch(texts, add_special_tokens=False)]

    def _learn(self, tokens: list[str]) -> np.ndarray:
        """The places of pre-tokens that are not in the memo; many in one call, between line feeds, which stay alone."""
        batch = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        groups = ["\n" + "\n".join(tokens[i : i + GROUP]) for i in range(0, len(tokens), GROUP)]
        coded = batch([g.encode().decode("latin-1").translate(self.spelling) for g in groups], add_special_tokens=False)
        ids = np.concatenate([np.empty(0, np.uint32), *(np.array(e.ids, np.uint32) for e in coded)])
        feeds = ids == self.line_feed[0]
        if int(feeds.sum()) == len(tokens):
            begins = np.flatnonzero(feeds)
            return self.memo.add(tokens, ids[~feeds], np.diff(begins, append=len(ids)) - 1)
        found = self._plain(tokens)  # tokens with line feeds, or a vocabulary in which these don't stay alone
        return self.memo.add(tokens, np.concatenate([np.empty(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found)))

    def _places(self, names: list[str]) -> np.ndarray:
        """The places of distinct strings that may be encoded apart."""
        at = self.memo.find(names)
        new = np.flatnonzero(at < 0).tolist()
        if not new:
            return at
        words = [i for i in new if (p := names[i]).isalpha() or p[0] == " " and p[1:].isalpha()]
        at[words] = self._learn([names[i] for i in words])
        if len(words) == len(new):
            return at
        rest = sorted(set(new).difference(words))
        split = [self.findall(names[i]) for i in rest]
        tokens = list(dict.fromkeys(chain.from_iterable(split)))
        known = self.memo.find(tokens)
        for feeds in (False, True):  # apart, as line feeds also part the tokens of a call
            own = [i for i in np.flatnonzero(known < 0).tolist() if ("\n" in tokens[i]) == feeds]
            known[own] = self._learn([tokens[i] for i in own])
        place = dict(zip(tokens, known.tolist()))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        each = np.fromiter((place[t] for s in split for t in s), np.int64, int(counts.sum()))
        sums = np.concatenate([[0], np.cumsum(self.memo.sizes(each))])
        stops = np.cumsum(counts)
        sizes = sums[stops] - sums[stops - counts]
        single = counts == 1
        at[np.array(rest)[single]] = each[(stops - counts)[single]]
        ids = self.memo.ids(each)
        for feeds in (False, True):  # what runs across lines hardly repeats
            own = [k for k, i in enumerate(rest) if not single[k] and ("\n" in names[i]) == feeds]
            begins = (sums[stops - counts])[own]
            at[[rest[k] for k in own]] = self.memo.add([names[rest[k]] for k in own], gathered(ids, begins, sizes[own]), sizes[own], remember=not feeds)
        return at

    def _pieces(self, parts: pa.LargeStringArray, lead: str) -> np.ndarray:
        """Four places for each part after ``lead``: line feeds but the last, the last, the head and the punctuation at its end.

        A head that ends with a letter or digit is encoded apart from what follows, one that begins with visible characters
        from line feeds before it; a part with another one stays whole.
        """
        feeds, heads, marks = (x.dictionary_encode() for x in _cut(parts))
        names = strings(heads.dictionary, lead)
        kind = _last(heads.dictionary)
        for i in np.flatnonzero(kind == 3).tolist():
            last = names[i][-1]
            kind[i] = 0 if last.isalpha() or last.isdecimal() else 2
        if not lead:  # white space goes with the line feeds before it
            kind[[i for i, n in enumerate(names) if n[:1].isspace()]] = 2
        out = np.zeros((len(parts), 4), np.int64)
        own = self._places(list(compress(names, kind == 0)))
        number = np.zeros(len(names), np.int64)
        number[kind == 0] = own
        head_of = heads.indices.to_numpy()
        runs = feeds.dictionary.to_pylist()
        for k, cut in enumerate((slice(1, None), slice(0, 1))):
            out[:, k] = np.array([self._places([r[cut]])[0] for r in runs], np.int64)[feeds.indices.to_numpy()]
        out[:, 2] = number[head_of]
        out[:, 3] = self._places(marks.dictionary.to_pylist())[marks.indices.to_numpy()]
        whole = np.flatnonzero(kind[head_of] != 0)
        if len(whole):
            coded = parts.take(pa.array(whole)).dictionary_encode()
            out[whole] = 0
            out[whole, 2] = self._places(strings(coded.dictionary, lead))[coded.indices.to_numpy()]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        self.memo.turn()
        whole = {i for i, t in enumerate(texts) if not self.cuts or " \n" in t or "\n " in t or any(s in t for s in self.special)}
        # Lines become parts of their own: cut before each run of line feeds.
        given = pc.replace_substring(pa.array(["" if i in whole else t for i, t in enumerate(texts)], pa.large_string()), "\n", " \n")
        for _ in range(3):
            given = pc.replace_substring(given, "\n \n", "\n\n")
        lists = pc.split_pattern(given, " ")
        ends, parts = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
        coded = parts.dictionary_encode()
        codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        # Parts after a space, lines, and the beginnings of texts, before which nothing is cut off.
        begins = pc.take(parts, pa.array(ends[:-1]))
        led = pc.starts_with(distinct, "\n").to_numpy(zero_copy_only=False)
        pieces = np.empty((len(distinct), 4), np.int64)
        other = pa.concat_arrays([distinct.filter(pa.array(led)), begins])
        pieces[~led] = self._pieces(distinct.filter(pa.array(~led)), " ")
        found = self._pieces(other, "")
        pieces[led] = found[: int(led.sum())]
        pieces = np.concatenate([pieces, found[int(led.sum()) :]])
        codes[ends[:-1]] = len(distinct) + np.arange(len(texts))
        # The space after a part that is empty or ends in white space belongs to a run of it, unless the text ends there.
        kind = _last(distinct)
        kind[pc.binary_length(distinct).to_numpy() == 0] = 1
        wide = np.flatnonzero(kind == 3)
        kind[wide] = np.fromiter((p[-1].isspace() for p in strings(distinct.take(pa.array(wide)))), np.uint8, len(wide))
        odd = np.concatenate([kind == 1, [not t or t[-1].isspace() for t in begins.to_pylist()]])
        if odd.any():
            at = odd[codes]
            at[ends[1:] - 1] = False
            whole.update(np.unique(np.searchsorted(ends, np.flatnonzero(at), "right") - 1).tolist())
        each = self.memo.sizes(pieces).sum(1)
        sizes = each[codes]
        ids = gathered(self.memo.ids(pieces.reshape(-1)), (np.cumsum(each) - each)[codes], sizes)
        stops = np.concatenate([[0], np.cumsum(sizes)])[ends].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(stops, stops[1:])]
        for i in whole:
            text = texts[i]
            if self.cuts and not any(s in text for s in self.special):
                own = _CUT.split(text)
                distinct_ = list(dict.fromkeys(own))
                place = dict(zip(distinct_, self._places(distinct_).tolist()))
                out[i] = self.memo.ids(np.fromiter(map(place.__getitem__, own), np.int64, len(own))).tobytes()
            else:
                out[i] = self._plain([text])[0].tobytes()
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path)


def release() -> None:
    """Forget what a worker remembers of words, before another operator's work in the same process."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        trim()


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows of bounded total length, and their texts (null: empty)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        begin = size = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            if size and size + n > chars:
                part = batch.slice(begin, i - begin)
                yield part, [t or "" for t in part.column(column).to_pylist()]
                begin, size = i, 0
            size += n
        if batch.num_rows > begin:
            part = batch.slice(begin)
            yield part, [t or "" for t in part.column(column).to_pylist()]
