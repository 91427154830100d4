"""SentencePiece encoding and decoding over the distinct words of many texts.

Words begin with the space mark. The distinct words of a run of texts are sorted, which is the depth-first order of their
trie, and traversed with a stack of forward states: what is known of a prefix is kept for the next word that shares it. A
state is the best way to cut the prefix into pieces: its score and the piece that it ends with (Viterbi).

For unigram models every piece may follow every other. The pieces of a BPE model are not those of the best score: joining
neighbours by rank gives the library's. But a row of pieces is what the joining ends in exactly if each two neighbours in it
are what their joint text is joined to. So for BPE models neighbours for which that does not hold score minus infinity; of all
ways to cut a prefix one is left. The pass over the trie and the states are the same.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches
from .tokens import Memo, gathered, release, slices, strings

MARK = "▁"
#: Entries of a worker's memo of neighbours; it only bounds memory.
PAIRS = 1_000_000
UNKNOWN_PENALTY = 10.0
_WORD = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")


class Pieces:
    """A vocabulary: piece texts by id, ids of pieces that text may give, byte pieces, and how words are segmented."""

    def __init__(self, texts: list[str], scores: list[float], plain: list[bool], byte_ids: dict[int, int], unknown: int, unigram: bool):
        self.texts, self.scores, self.unigram, self.unknown = texts, scores, unigram, unknown
        self.ids = {t: i for i, (t, p) in enumerate(zip(texts, plain)) if p}
        self.byte_ids = [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None
        #: Words may be encoded apart unless a piece crosses from visible characters to a mark, or a mark may be unknown.
        self.cuts = (MARK in self.ids or self.byte_ids is not None) and not any(re.search(f"[^{MARK}]{MARK}", t) for t in self.ids)
        inverse = {i: b for b, i in byte_ids.items()}
        self.bytes = [bytes([inverse[i]]) if i in inverse else t.replace(MARK, " ").encode() if p else " ⁇ ".encode() if i == unknown else b"" for i, (t, p) in enumerate(zip(texts, plain))]
        self.values = pa.array(self.bytes, pa.binary())
        self.least = min((s for s, p in zip(scores, plain) if p), default=0.0) - UNKNOWN_PENALTY
        #: Pieces by their characters from the last to the first; a piece's id is under the empty string.
        self.backwards: dict = {}
        for text, i in self.ids.items():
            node = self.backwards
            for c in reversed(text):
                node = node.setdefault(c, {})
            node[""] = i
        self.memo = Memo()
        self.pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str, unigram: bool = False) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        reserved = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        texts = [sp.id_to_piece(i) for i in range(n)]
        return cls(texts, [sp.get_score(i) for i in range(n)], [not r for r in reserved], {int(texts[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}, sp.unk_id(), unigram)

    # Neighbours ----------------------------------------------------------------------------------------------------
    def _text(self, piece: int) -> str:
        return self.texts[piece] if piece >= 0 else chr(-1 - piece)

    def merge(self, text: str) -> list[int]:
        """The definition of BPE: join the neighbours of the highest score, the first of equals, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                piece = self.ids.get(parts[k] + parts[k + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], k
            if best is None:
                return [self.ids.get(p, -1 - ord(p[0])) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _goes(self, before: int | None, piece: int) -> bool:
        """Whether ``piece`` may follow ``before`` (None: begin a word) in a BPE model."""
        own = [piece] if before is None else [before, piece]
        known = self.pairs[before, piece] = self.merge("".join(map(self._text, own))) == own
        return known

    # Words ---------------------------------------------------------------------------------------------------------
    def _step(self, word: str, end: int, states: list[tuple[int, int | None, float]]) -> tuple[int, int, float]:
        """The state of ``word[:end]``: where its last piece begins, which one it is (below 0: an unknown character), the score."""
        best, node, begin, known = None, self.backwards, end, None if self.unigram else self.pairs
        while begin:
            begin -= 1
            node = node.get(word[begin])
            piece = None if node is None else node.get("")
            if piece is None and begin == end - 1:
                piece, score = -1 - ord(word[begin]), self.least
            elif piece is not None:
                score = self.scores[piece]
            if piece is not None:
                _, before, so_far = states[begin]
                if known is None:
                    if best is None or so_far + score >= best[2]:  # of equals the longest piece
                        best = begin, piece, so_far + score
                elif (goes := known.get((before, piece))) or goes is None and self._goes(before, piece):
                    return begin, piece, so_far + score  # all others are minus infinity
            if node is None:
                break
        return best

    def segment(self, words: list[str]) -> tuple[list[str], list[int], list[int]]:
        """The words in the order of their trie, their ids one after another, and how many each has."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        step, ordered, flat, sizes = self._step, sorted(words), [], []
        before, states = "", [(0, None, 0.0)]
        for word in ordered:
            n = min(len(before), len(word))
            keep = n if before[:n] == word[:n] else next(i for i in range(n) if before[i] != word[i])
            del states[keep + 1 :]
            for end in range(keep + 1, len(word) + 1):
                states.append(step(word, end, states))
            ids, at = [], len(word)
            while at:
                at, piece, _ = states[at]
                if piece >= 0:
                    ids.append(piece)
                elif self.byte_ids:
                    ids += [self.byte_ids[b] for b in reversed(chr(-1 - piece).encode("utf-8", "surrogatepass"))]
                elif not ids or ids[-1] != self.unknown:  # a run of unknown characters is one
                    ids.append(self.unknown)
            ids.reverse()
            flat += ids
            sizes.append(len(ids))
            before = word
        return ordered, flat, sizes

    def _places(self, words: list[str]) -> np.ndarray:
        """Where the ids of distinct words stand in the memo."""
        at = self.memo.find(words)
        new = np.flatnonzero(at < 0).tolist()
        if new:
            ordered, flat, sizes = self.segment([words[i] for i in new])
            place = dict(zip(ordered, self.memo.add(ordered, np.array(flat, np.uint32), np.array(sizes, np.int64)).tolist()))
            at[new] = [place[words[i]] for i in new]
        return at

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        self.memo.turn()
        slow = {i for i, t in enumerate(texts) if not t or not self.cuts or MARK in t}
        lists = pc.split_pattern(pa.array(["" if i in slow else t for i, t in enumerate(texts)], pa.large_string()), " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        empty = pc.binary_length(distinct).to_numpy() == 0
        if empty.any():  # the next word has several marks, unless the text ends there
            at = empty[codes]
            at[ends[1:] - 1] = False
            slow.update((np.searchsorted(ends, np.flatnonzero(at), "right") - 1).tolist())
        other = {i: _WORD.findall(MARK + texts[i].replace(" ", MARK)) if self.cuts else [MARK + texts[i].replace(" ", MARK)] for i in slow if texts[i]}
        places = self._places(strings(distinct, MARK))
        each = self.memo.sizes(places)[codes]
        ids = self.memo.ids(places[codes])
        stops = np.concatenate([[0], np.cumsum(each)])[ends].tolist()
        out = [b"" if i in slow else ids[a:b].tobytes() for i, (a, b) in enumerate(zip(stops, stops[1:]))]
        words = list(dict.fromkeys(chain.from_iterable(other.values())))
        place = dict(zip(words, self._places(words).tolist()))
        for i, own in other.items():
            out[i] = self.memo.ids(np.fromiter(map(place.__getitem__, own), np.int64, len(own))).tobytes()
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        """The texts of ids: marks are spaces again and the first, which encoding adds, goes. Broken bytes give U+FFFD."""
        ends = np.cumsum([0, *(len(x) >> 2 for x in ids)])
        flat = pc.take(self.values, pa.array(np.frombuffer(b"".join(ids), "<u4")))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), flat), b"")
        return [(x or b"").removeprefix(b" ").decode("utf-8", "replace") for x in joined.to_pylist()]


@functools.lru_cache(maxsize=4)
def pieces(path: str, unigram: bool = False) -> Pieces:
    return Pieces.load(path, unigram)


def encode(docs: DataFrame, model: str, unigram: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (binary, little-endian 32-bit) of every row.

    Null and empty texts have no ids. Repeated rows and rows without an identifier stay as they are; texts of any length are
    encoded whole; other columns, whatever their names, are left out; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pieces(model, unigram).encode(texts), pa.binary())], [id_col, "ids"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), f"`{id_col}` long, ids binary")


def decode(encoded: DataFrame, model: str, unigram: bool = False, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_crc32`` and ``text`` of rows with ``ids``; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [x or b"" for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64()), pa.array(pieces(model, unigram).decode(ids), pa.string())], [id_col, "n_tokens", "ids_crc32", "text"])

    return encoded.select(F.col(id_col), "ids").mapInArrow(frugal(run), f"`{id_col}` long, n_tokens long, ids_crc32 long, text string")


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return decoded.select(id_col, "n_tokens", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))
