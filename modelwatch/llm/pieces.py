"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A model file is read into plain tables: piece bytes, and for each pair of pieces whose
concatenation is a piece, that piece and its rank. No piece of a supported model has a space mark
after another character, so words (space marks, then other characters) never merge with each
other, and every distinct word of a batch is encoded once.

All words of a batch are one flat array of symbols. A round finds the lowest rank among each
word's adjacent pairs and merges its occurrences from the left, in all words at once; words
without a pair leave. Merging several occurrences at once equals merging them one by one unless a
new pair ranks as low as the old one; a word in which that happens merges its first occurrence
only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import pieces as text_pieces

SPACE = "▁"
NO_RANK = np.int64(1) << 40
#: Words remembered by a task, and words encoded at once.
CACHED_WORDS, WORDS_AT_ONCE = 100_000, 40_000
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""

    def varint(i):
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


class PieceModel:
    """Tables of a SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, model: bytes):
        rows, trainer, normalizer = [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                row = dict(_fields(value))
                score = float(np.frombuffer(row.get(2, b"\0\0\0\0"), "<f4")[0])
                rows.append((row[1].decode(), score, row.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        asked = (trainer.get(3, 1), trainer.get(35, 0), trainer.get(24, 0), normalizer.get(2, b""))
        spaces = (normalizer.get(3, 1), normalizer.get(4, 1), normalizer.get(5, 1))
        if asked != (2, 1, 0, b"") or spaces != (1, 0, 1):
            raise ValueError("only BPE models with byte fallback, identity normalisation and a space prefix")
        if {kind for _, _, kind in rows} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.size = len(rows)
        normal = {piece: i for i, (piece, _, kind) in enumerate(rows) if kind == NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or any(c not in normal for c in p) for p in normal):
            raise ValueError("a piece crosses words or holds a character that is no piece")
        self.byte_ids = np.zeros(256, np.int32)
        shown = []
        for i, (piece, _, kind) in enumerate(rows):
            if kind == BYTE:
                self.byte_ids[int(piece[1:-1], 16)] = i
                shown.append(bytes([int(piece[1:-1], 16)]))
            else:
                shown.append({CONTROL: "", UNKNOWN: " ⁇ "}.get(kind, piece).replace(SPACE, " ").encode())
        self.blob = np.frombuffer(b"".join(shown), np.uint8)
        self.lengths = np.array([len(s) for s in shown], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.char_ids = np.full(0x110000, -1, np.int32)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i
        ranks = {s: r for r, s in enumerate(sorted({-s for _, s, kind in rows if kind == NORMAL}))}
        pairs = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = normal.get(piece[:cut]), normal.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = (i, ranks[-rows[i][1]])
        self._index(pairs)

    def _index(self, pairs: dict) -> None:
        """Open-addressing table: at most `self.probes` looks for a key."""
        self.bits = max(4, (16 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.zeros(1 << self.bits, np.int32)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int64)
        self.probes = 1
        names = np.fromiter(pairs, np.int64, len(pairs))
        for key, at, (piece, rank) in zip(names.tolist(), self._slots(names).tolist(), pairs.values(), strict=True):
            looks = 1
            while self.keys[at] >= 0:
                at, looks = (at + 1) % len(self.keys), looks + 1
            self.keys[at], self.merged[at], self.ranks[at] = key, piece, rank
            self.probes = max(self.probes, looks)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of each pair of symbols; negative symbols never merge."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slots(keys)
        found = self.keys[at]
        for _ in range(self.probes - 1):
            miss = np.flatnonzero((found != keys) & (found >= 0))
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) & (len(self.keys) - 1)
            found[miss] = self.keys[at[miss]]
        return np.where(found == keys, self.ranks[at], NO_RANK), self.merged[at]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each non-empty word (spaces already replaced by marks)."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = self.char_ids[chars]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        start = np.arange(len(sym))
        done = []
        while len(sym):
            rank = np.full(len(sym), NO_RANK)
            inner = np.flatnonzero(word[:-1] == word[1:])
            merged = np.zeros(len(sym), np.int32)
            rank[inner], merged[inner] = self._pairs(sym[inner], sym[inner + 1])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[first, len(sym)])
            low = np.minimum.reduceat(rank, first)
            if (low == NO_RANK).any():
                ended = np.repeat(low == NO_RANK, count)
                done.append((word[ended], start[ended], sym[ended]))
                live = ~ended
                sym, word, start, rank, merged = sym[live], word[live], start[live], rank[live], merged[live]
                count, low = count[low < NO_RANK], low[low < NO_RANK]
                if not len(sym):
                    break
                first = np.cumsum(count) - count
            hit = np.flatnonzero(rank == np.repeat(low, count))
            fresh = np.r_[True, (np.diff(hit) > 1) | (word[hit[1:]] != word[hit[:-1]])]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            new, bound = merged[hit], rank[hit]
            # Symbols beside the merged ones: to the left as they are by then, to the right as they were.
            after = sym.copy()
            after[hit + 1] = new
            unsafe = np.zeros(len(hit), bool)
            has = np.flatnonzero((hit > 0) & (word[np.maximum(hit - 1, 0)] == word[hit]))
            unsafe[has] = self._pairs(after[hit[has] - 1], new[has])[0] <= bound[has]
            end = np.minimum(hit + 2, len(sym) - 1)
            has = np.flatnonzero((hit + 2 < len(sym)) & (word[end] == word[hit]))
            unsafe[has] |= self._pairs(new[has], sym[hit[has] + 2])[0] <= bound[has]
            if unsafe.any():
                bad = np.isin(word[hit], word[hit[unsafe]])
                leading = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
                hit, new = hit[~bad | leading], new[~bad | leading]
            sym[hit] = new
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word, start = sym[keep], word[keep], start[keep]
        word, start, sym = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.empty(0, int),) * 3
        by = np.argsort(start, kind="stable")
        word, start, sym = word[by], start[by], sym[by]
        if (sym < 0).any():
            sym, word = self._with_bytes(sym, word, chars[start])
        cuts = np.searchsorted(word, np.arange(1, len(words)))
        return np.split(sym.astype(np.int32), cuts)

    def _with_bytes(self, sym: np.ndarray, word: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their UTF-8 bytes."""
        unknown = np.flatnonzero(sym < 0)
        encoded = [chr(c).encode("utf-8", "surrogatepass") for c in chars[unknown].tolist()]
        times = np.ones(len(sym), np.int64)
        times[unknown] = [len(e) for e in encoded]
        out, word = np.repeat(sym, times), np.repeat(word, times)
        out[out < 0] = self.byte_ids[np.frombuffer(b"".join(encoded), np.uint8)]
        return out, word

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids; bytes that are no UTF-8 become U+FFFD each."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        data = self.blob[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()
        if data[:1] == b" ":  # the space put before every text
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            out = []
            for part in re.split("([\udc80-\udcff])", data.decode("utf-8", "surrogateescape")):
                out.append("�" if re.fullmatch("[\udc80-\udcff]", part) else part)
            return "".join(out)


@lru_cache(maxsize=1)
def _loaded(content: bytes) -> PieceModel:
    """The tables of a model, made once by a Python worker that runs many tasks."""
    return PieceModel(content)


class WordCache:
    """Ids of words met before, as bytes; forgotten when too many."""

    def __init__(self, model: PieceModel):
        self.model, self.ids = model, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        words = [split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list({w for line in words for w in line if w not in self.ids})
        for at in range(0, len(new), WORDS_AT_ONCE):
            some = new[at : at + WORDS_AT_ONCE]
            self.ids.update(zip(some, (x.tobytes() for x in self.model.encode_words(some)), strict=True))
        out = [np.frombuffer(b"".join(map(self.ids.__getitem__, line)), np.int32) for line in words]
        if len(self.ids) > CACHED_WORDS:
            self.ids = {}
        return out


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for every row: the ids of the whole text and the text they decode to.

    `model`: a model file readable on the driver; its tables (bounded by the vocabulary) go to the
    tasks. No begin or end ids, no sampling; strings that look like control pieces are ordinary
    text. Null counts as empty and has no ids. The work is one narrow pass without a shuffle.
    """
    with open(model, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = _loaded(content.value)
        cache = WordCache(tables)
        for frame in text_pieces(batches):
            ids = cache.encode(frame["text"].tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "ids": ids, "decoded": [tables.decode(x) for x in ids]})

    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(run, f"doc_id {kind}, ids array<int>, decoded string")
