"""Alignment of two tokenisations of the same text by merge-path partitioning.

Both tokenisations cut a text's bytes, so each is a sorted list of byte ends. Merging the two lists
visits every overlap once: between two neighbouring ends lies exactly one token of each side. The
lists of all texts of a batch are laid behind each other. Diagonals of equal distance cut the merge
into pieces of equal work; a binary search on each diagonal finds where a piece starts in either list.
Pieces are merged independently and emit their overlaps; what reaches over a piece's border is
stitched with the end before it. Ends that both lists share close a group.

Corpus-wide counts of linked id pairs: tasks put a bounded number of texts into a chunk, with a
dictionary of the distinct groups in it. Only the chunk's distinct id pairs are shuffled, counted and sent
back; a text's sums are then sums over its groups. No link leaves a task as a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from modelwatch.llm.common import pieces
from modelwatch.session import shared_path

#: Steps of a merge piece, and characters of the texts that share a chunk (one long text may exceed it).
PIECE_STEPS, CHUNK_CHARS = 1_024, 6_000_000
CACHED_UNITS, UNITS_AT_ONCE = 200_000, 2_000
MARK = "▁"
#: An id pair is one number: A's id above so many bits of B's.
B_BITS = 24
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def byte_symbols() -> dict[str, int]:
    """Byte-level BPE writes each byte as a character: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """One tokenizer: the bytes that each id shows, and the ids of texts that follow a space."""

    def __init__(self, shown: list[bytes]):
        self.shown = shown
        self.lengths = np.fromiter(map(len, shown), np.int64, len(shown))

    def ids(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def show(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.shown.__getitem__, ids))


class ByteTokens(Side):
    """A byte-level BPE model file; it cuts text by white space, among others, before merging."""

    def __init__(self, content: str):
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True
        symbols = byte_symbols()
        shown = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            known = all(c in symbols for c in piece)
            shown[i] = bytes(symbols[c] for c in piece) if known else piece.encode()
        super().__init__(shown)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceTokens(Side):
    """A SentencePiece model file, read by its own library, which puts the space before a text itself."""

    def __init__(self, content: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=content)
        shown = []
        for i in range(self.processor.get_piece_size()):
            piece = self.processor.id_to_piece(i)
            if regex.search(f"[^{MARK}]{MARK}", piece):
                raise ValueError("a piece crosses words")
            shown.append(bytes([int(piece[1:-1], 16)]) if self.processor.is_byte(i) else piece.replace(MARK, " ").encode())
        super().__init__(shown)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


class Units:
    """Ids of texts, put together from those of their units; a bounded number of units is remembered.

    A unit begins after a space that stands between two characters other than white space. Neither side
    has a token that holds such a space but as its first character, so units are encoded on their own.
    """

    def __init__(self, sides: Sequence[Side]):
        self.sides = sides
        self.known: list[dict[str, bytes]] = [{} for _ in sides]
        self.doubtful: set[str] = set()
        self.cut, self.blanks = regex.compile(r"(?<=\S) (?=\S)").split, regex.compile(r"\s\s|^\s|\s$").search

    def units(self, text: str) -> list[str]:
        if not text or MARK in text:
            return [text] if text else []
        return self.cut(text) if self.blanks(text) else text.split(" ")

    def learn(self, units: list[str]) -> None:
        plain = [u for u in units if MARK not in u and not self.blanks(u)]
        for some in (plain[i : i + UNITS_AT_ONCE] for i in range(0, len(plain), UNITS_AT_ONCE)):
            if not self._learn_joined(some):
                self._learn_each(some)
        self._learn_each(list(set(units).difference(plain)))

    def _learn_joined(self, units: list[str]) -> bool:
        """Encodes all units as one text, which costs less, and cuts the ids at the units' ends."""
        joined = " ".join(units)
        raw = (" " + joined).encode("utf-8", "surrogatepass")
        ends = np.cumsum(np.fromiter((len(u.encode("utf-8", "surrogatepass")) + 1 for u in units), np.int64, len(units)))
        found = []
        for side in self.sides:
            ids = side.ids([joined])[0]
            flat = np.array(ids, np.int32)
            shown = np.cumsum(side.lengths[flat])
            at = np.searchsorted(shown, ends)
            if side.show(ids) != raw or (shown[at] != ends).any():
                return False
            found.append((flat.tobytes(), (4 * np.r_[0, at + 1]).tolist()))
        for known, (data, at) in zip(self.known, found, strict=True):
            known.update(zip(units, map(data.__getitem__, map(slice, at, at[1:])), strict=True))
        return True

    def _learn_each(self, units: list[str]) -> None:
        for side, known in zip(self.sides, self.known, strict=True):
            for unit, ids in zip(units, side.ids(units) if units else [], strict=True):
                known[unit] = np.array(ids, np.int32).tobytes()
                if side.show(ids) != b" " + unit.encode("utf-8", "surrogatepass"):
                    self.doubtful.add(unit)

    def encode(self, texts: list[str]) -> tuple[list[list[np.ndarray]], list[bool]]:
        """By side the ids of each text; and whether the tokens of a unit do not give back its bytes."""
        lines = [self.units(t) for t in texts]
        new = list(set().union(*lines).difference(self.known[0]))
        if new:
            self.learn(new)
        out = [[np.frombuffer(b"".join(map(known.__getitem__, line)), np.int32) for line in lines] for known in self.known]
        doubt = [bool(self.doubtful) and not self.doubtful.isdisjoint(line) for line in lines]
        if len(self.known[0]) > CACHED_UNITS:
            self.known, self.doubtful = [{} for _ in self.sides], set()
        return out, doubt


@lru_cache(maxsize=1)
def loaded(a: str, b: bytes) -> Units:
    """Both models, read once by a Python worker that runs many tasks."""
    return Units([ByteTokens(a), PieceTokens(b)])


@lru_cache(maxsize=1)
def _numbers(bits: int) -> list[str]:
    """Each id of so many bits followed by each sign."""
    return [f"{i}{sign}" for i in range(1 << bits) for sign in ",|;"]


def cut_points(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many entries of `a` are among the first `diagonals` of the merge (equal entries: a's first).

    One binary search a diagonal, all at once.
    """
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        live = low < high
        after = np.zeros(len(low), bool)
        after[live] = a[middle[live]] <= b[diagonals[live] - middle[live] - 1]
        low, high = np.where(live & after, middle + 1, low), np.where(live & ~after, middle, high)
    return low


def overlaps(a: np.ndarray, b: np.ndarray, steps: int = PIECE_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token of a, token of b) of every overlap in order, and of every end that both share.

    a, b: ascending byte ends of two tokenisations of the same bytes.
    """
    total = len(a) + len(b)
    cuts = np.r_[np.arange(0, total, steps), total] if total else np.zeros(1, np.int64)
    if len(cuts) < 2:
        return (np.zeros(0, np.int64),) * 4
    from_a = cut_points(a, b, cuts)
    from_b = cuts - from_a
    n_a, n_b = np.diff(from_a), np.diff(from_b)
    # Row p holds the ends of piece p, those of b marked by the lowest bit; each row is merged on its own.
    ends = np.full((len(n_a), steps), np.iinfo(np.int64).max)
    in_a, in_b = np.arange(len(a)), np.arange(len(b))
    ends[np.repeat(np.arange(len(n_a)), n_a), in_a - np.repeat(from_a[:-1], n_a)] = a * 2
    ends[np.repeat(np.arange(len(n_b)), n_b), in_b - np.repeat(from_b[:-1] - n_a, n_b)] = b * 2 + 1
    ends.sort(axis=1)
    is_b = (ends & 1).astype(bool)
    before_a = from_a[:-1, None] + np.cumsum(~is_b, axis=1) - ~is_b
    before_b = from_b[:-1, None] + np.cumsum(is_b, axis=1) - is_b
    # Stitching: the end before a piece's first is the last of the piece before.
    border = np.where(from_a[:-1] > 0, a[np.maximum(from_a[:-1], 1) - 1] * 2, -1) if len(a) else np.full(len(n_a), -1)
    last = np.column_stack([border, ends[:, :-1]])
    shared = is_b & (last == ends - 1)
    real = np.arange(steps) < (n_a + n_b)[:, None]
    link, close = real & ~shared, real & shared
    return before_a[link], before_b[link], before_a[close] - 1, before_b[close]


class Aligned:
    """The alignment of a batch of texts, as flat arrays; `used` tells which texts have tokens."""

    def __init__(self, texts: list[str], tokens: Units):
        (a, b), doubt = tokens.encode(texts)
        self.used = np.array([t != "" for t in texts], bool)
        for i in np.flatnonzero(doubt):
            raw = b" " + texts[i].encode("utf-8", "surrogatepass")
            self.used[i] = all(side.show(ids[i].tolist()) == raw for side, ids in zip(tokens.sides, (a, b), strict=True))
        none = np.zeros(0, np.int32)
        a, b = ([x if u else none for x, u in zip(ids, self.used, strict=True)] for ids in (a, b))
        self.n_a, self.n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a, b))
        self.a, self.b = (np.concatenate([none, *ids]).astype(np.int64) for ids in (a, b))
        ends = [np.cumsum(x.lengths[ids]) for x, ids in zip(tokens.sides, (self.a, self.b), strict=True)]
        self.link_a, self.link_b, self.close_a, self.close_b = overlaps(*ends)
        doc_of_a = np.repeat(np.arange(len(texts)), self.n_a)
        self.n_groups = np.bincount(doc_of_a[self.close_a], minlength=len(texts))
        self.n_links = np.bincount(doc_of_a[self.link_a], minlength=len(texts))
        #: Group of each link: as many groups as were closed before its token of a.
        self.link_group = np.searchsorted(self.close_a, self.link_a)

    def groups(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text; empty without tokens."""
        group_a, group_b = np.searchsorted(self.close_a, np.arange(len(self.a))), np.searchsorted(self.close_b, np.arange(len(self.b)))
        sign_a, sign_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        sign_a[self.close_a], sign_b[self.close_b] = 1, 2
        table = _numbers(int(max(self.a.max(initial=0), self.b.max(initial=0))).bit_length())
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + np.r_[0, self.close_b + 1][group_a]] = self.a * 3 + sign_a
        code[np.arange(len(self.b)) + np.r_[self.close_a + 1, 0][group_b]] = self.b * 3 + sign_b
        shown = list(map(table.__getitem__, code.tolist()))
        ends = np.cumsum(self.n_a + self.n_b)
        return ["".join(shown[e - n : e])[:-1] for e, n in zip(ends.tolist(), (self.n_a + self.n_b).tolist(), strict=True)]


class Chunk:
    """Distinct groups of some texts, and which groups each text has."""

    def __init__(self):
        self.rows, self.sizes, self.members, self.chars = [], [], [], 0
        self.codes, self.pairs, self.lengths, self.known = [], [], [], 0

    def add(self, rows: np.ndarray, found: Aligned, chars: int) -> None:
        self.chars += chars
        pairs = (found.a[found.link_a] << B_BITS) | found.b[found.link_b]
        count = np.bincount(found.link_group, minlength=len(found.close_a))
        start = np.cumsum(count) - count
        place = np.arange(len(pairs)) - np.repeat(start, count)
        mixed = (pairs.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
        mixed *= (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        code = np.add.reduceat(mixed * MULTIPLIER, start) if len(start) else np.zeros(0, np.uint64)
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        # Groups with one code are compared pair by pair, so a code stands for one group only.
        model = first[which]
        if (count[model] != count).any() or (pairs[np.repeat(start[model], count) + place] != pairs).any():
            raise RuntimeError("two groups of a batch have one code")
        self.rows.append(rows)
        self.sizes.append(found.n_groups)
        self.members.append(self.known + which.astype(np.uint32))
        self.known += len(first)
        self.codes.append(code[first])
        self.lengths.append(count[first])
        at = np.repeat(start[first], count[first])
        at += np.arange(len(at)) - np.repeat(np.cumsum(count[first]) - count[first], count[first])
        self.pairs.append(pairs[at])

    def row(self, number: int) -> dict:
        codes, lengths, members = (np.concatenate(x) for x in (self.codes, self.lengths, self.members))
        _, first, same = np.unique(codes, return_index=True, return_inverse=True)
        n = np.bincount(same[members], minlength=len(first))
        start, size = (np.cumsum(lengths) - lengths)[first], lengths[first]
        # Frequent groups get small numbers, which take few bytes.
        by = np.argsort(-n, kind="stable")
        number_of = np.empty(len(by), np.uint32)
        number_of[by] = np.arange(len(by))
        start, size, n = start[by], size[by], n[by]
        at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        pairs = np.concatenate(self.pairs)[at]
        distinct, pair = np.unique(pairs, return_inverse=True)
        counts = np.bincount(pair, np.repeat(n, size), len(distinct)).astype(np.int64)
        planes = number_of[same[members]].view(np.uint8).reshape(-1, 4).T
        data = {
            "chunk": number,
            "rows": np.concatenate(self.rows).tobytes(),
            "sizes": np.concatenate(self.sizes).astype(np.int32).tobytes(),
            "members": planes.tobytes(),
            "links": pair.astype(np.int32).tobytes(),
            "lengths": size.astype(np.int32).tobytes(),
            "pairs": distinct,
            "counts": counts,
        }
        return {k: pd.Series([v], dtype=object) for k, v in data.items()}


DOC_FIELDS = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
CHUNK_FIELDS = ("chunk", "rows", "sizes", "members", "links", "lengths", "pairs", "counts")


def align_documents(
    docs: DataFrame, byte_model: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One narrow pass; rows of two kinds, of which the other's columns are null.

    One for each row of `docs`: (row, doc_id, n_a, n_b, n_groups, n_links, groups), groups as
    `a1,a2|b1;a3|b2,b3`, row a number. One for each chunk: what `link_statistics` needs. `byte_model`,
    `piece_model`: files readable on the driver. Side A encodes a space and the text, side B the text,
    which its model puts a space before; strings of special tokens are ordinary text. Texts that are null
    or empty, or whose tokens do not give back the bytes of space and text, have no tokens: zeros and an
    empty string. A very long text is one chunk. Rows that repeat stay rows of their own; further columns
    are not read; an empty table gives no rows.
    """
    with open(byte_model, encoding="utf-8") as file:
        first = file.read()
    with open(piece_model, "rb") as file:
        models = docs.sparkSession.sparkContext.broadcast((first, file.read()))

    def frame_of(data: dict) -> pd.DataFrame:
        n = len(next(iter(data.values())))
        return pd.DataFrame({c: data.get(c, pd.Series([None] * n, dtype=object)) for c in DOC_FIELDS + CHUNK_FIELDS})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = loaded(*models.value)
        row = number = TaskContext.get().partitionId() << 40
        chunk = Chunk()
        for frame in pieces(batches):
            found = Aligned(frame["text"].tolist(), tokens)
            rows = np.arange(row, row + len(frame))
            row += len(frame)
            columns = (rows, frame["doc_id"].array, found.n_a, found.n_b, found.n_groups, found.n_links, found.groups())
            yield frame_of(dict(zip(DOC_FIELDS, columns, strict=True)))
            chunk.add(rows, found, int(frame["text"].str.len().sum()))
            if chunk.chars >= CHUNK_CHARS:
                yield frame_of(chunk.row(number))
                number, chunk = number + 1, Chunk()
        if chunk.rows:
            yield frame_of(chunk.row(number))

    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = (
        f"row bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, "
        "n_links bigint, groups string, chunk bigint, rows binary, sizes binary, members binary, links binary, "
        "lengths binary, pairs array<bigint>, counts array<bigint>"
    )
    return docs.mapInPandas(run, schema)


def written(aligned: DataFrame, **kept: Column) -> DataFrame:
    """`aligned` as a table in the shared folder, with `kept`, made from the groups, in place of them."""
    spark = aligned.sparkSession
    folder = shared_path(spark, "aligned")
    slim = aligned.withColumns(kept).drop("groups")
    slim.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(slim.schema).parquet(folder)


def _chunk_sums(chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """(row, n_best, count_sum) of one chunk's texts, from the counts of its id pairs."""
    out = []
    answers = answers.sort_values("pair")
    for c in chunks.itertuples(index=False):
        links, lengths = np.frombuffer(c.links, np.int32), np.frombuffer(c.lengths, np.int32)
        members = np.frombuffer(c.members, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
        ends = np.cumsum(np.frombuffer(c.sizes, np.int32))
        sums = {}
        for name in ("best", "count"):
            of_link = np.r_[0, np.cumsum(answers[name].to_numpy(np.int64)[links])]
            of_group = np.diff(of_link[np.r_[0, np.cumsum(lengths)]])
            sums[name] = np.diff(np.r_[0, np.cumsum(of_group[members])][np.r_[0, ends]])
        out.append(pd.DataFrame({"row": np.frombuffer(c.rows, np.int64), "n_best": sums["best"], "count_sum": sums["count"]}))
    return pd.concat(out) if out else pd.DataFrame({"row": [], "n_best": [], "count_sum": []}, dtype=np.int64)


def link_statistics(table: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of each row of a `written` table.

    An id pair's count is the number of its links in all texts. n_best: links whose count is the highest
    of their B id, ties included; count_sum: sum of the counts of all links. A chunk asks once for each
    distinct pair, so a frequent pair has at most as many rows as there are chunks.
    """
    chunks = table.filter("chunk IS NOT NULL")
    asked = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "counts")).alias("z"))
    asked = asked.select("chunk", F.col("z.pairs").alias("pair"), F.col("z.counts").alias("n"))
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))  # as many rows as B has ids
    counts = counts.withColumn("b", b).join(F.broadcast(highest), "b")
    answers = asked.join(counts, "pair").select(
        F.col("chunk").alias("of"), "pair", "count", (F.col("count") == F.col("highest")).cast("int").alias("best")
    )
    payload = chunks.select("chunk", "rows", "sizes", "members", "links", "lengths")
    return (
        payload.groupBy("chunk")
        .cogroup(answers.groupBy("of"))
        .applyInPandas(_chunk_sums, "row bigint, n_best bigint, count_sum bigint")
    )
