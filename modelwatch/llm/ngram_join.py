"""Exact Jaccard join of word n-gram sets with adaptive multi-match prefixes.

Each document is the set of its distinct 64-bit shingle keys. All sets are sorted by one global
order, rare shingles first. Two sets whose Jaccard similarity reaches t overlap in at least
a = t / (1 + t) * (|x| + |y|) shingles and therefore share at least m shingles within their first
|x| - a + m and |y| - a + m. A longer prefix costs more index entries but asks for more common
entries (m) before a pair is verified. Every document chooses its own m from the candidate cost
that the shingle frequencies in its prefix predict; a pair must share the smaller of both.

Steps, all distributed:

1. Profile: size and key of each set; equal sets form one class. Shingles that repeat within a
   task are counted; the most frequent of them (a bounded table) define the order. The order only
   decides speed: any order gives the same result.
2. Index: the prefix entries of each class, shuffled once by shingle and read as a sorted stream
   that keeps entries held by two or more classes. Their number bounds the overlap of a document
   with any other, together with what lies behind the prefix that ends first.
3. Hubs: each class is verified against the classes it shares most entries with among those in
   which a shared shingle stands first. Large groups of near copies fall together here without
   any pair of two ordinary members.
4. Join: pairs from different components only, by size, position and number of common entries,
   then verified on the whole sets. A pair inside a component cannot change it.

Only documents in a pair to be verified have their sets built again; a Bloom filter of their ids
keeps all other texts out of the shuffle.

Keys are 64 bits wide: n distinct texts meet by chance with probability n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.llm.bloom import bloom_filter
from modelwatch.llm.common import join_by_key, keyed_texts, pieces, unite
from modelwatch.session import materialise

#: Size of the table of frequent shingles that is sent to every task (16 bytes an entry).
ORDER_TABLE = 262_144
#: Entries that one task reports for it, and the shingles it compares at once.
TASK_TABLE, TASK_SHINGLES = 32_768, 1_500_000
#: Index entries that one verification is taken to cost; most candidates fail cheaper tests before.
VERIFY_COST = 1
#: A frequent shingle's index entries are read in runs of about so many.
RUN_ROWS = 20_000
#: Bytes whose words are hashed at once.
BLOCK_BYTES = 1 << 20
#: Sets whose repetition a task notices.
CACHED_SETS = 200_000
#: Links that a task joins into sets at once (16 bytes a link).
LOCAL_LINKS = 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (in place)."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


STEP = np.uint64(0x9E3779B97F4A7C15)
#: A random number for each byte at each of the first places of a word; later places are computed.
PLACES = 64
_PLACED = _mixed(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * STEP)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += ord("a") - ord("A")
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False


def _block_keys(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, key) of each word: the sum of the numbers of its bytes at their places."""
    solid = _SOLID[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = np.flatnonzero(solid)
    starts = np.flatnonzero(first)
    begins = np.searchsorted(at, starts)
    place = at - np.repeat(starts, np.diff(np.r_[begins, len(at)]))
    code = place * 256 + _LOWER[raw[at]]
    number = _PLACED[np.minimum(code, len(_PLACED) - 1)]
    late = np.flatnonzero(place >= PLACES)
    if len(late):
        number[late] = _mixed((code[late].astype(np.uint64) + np.uint64(1)) * STEP)
    return starts, np.add.reduceat(number, begins) if len(starts) else np.empty(0, np.uint64)


def word_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit key) of each word, A-Z lower-cased; worked on in blocks that end at white space."""
    raw, at, found = np.frombuffer(data, np.uint8), 0, []
    while at < len(raw):
        end = min(at + BLOCK_BYTES, len(raw))
        while end < len(raw) and not (gaps := np.flatnonzero(~_SOLID[raw[end : end + BLOCK_BYTES]])[:1]).size:
            end = min(end + BLOCK_BYTES, len(raw))
        end += int(gaps[0]) if end < len(raw) else 0
        starts, keys = _block_keys(raw[at:end])
        found.append((starts + at, keys))
        at = end
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _combined(keys: np.ndarray, span: int) -> np.ndarray:
    """Key of every run of `span` words."""
    h = np.full(max(0, len(keys) - span + 1), span, np.uint64)
    for i in range(span):
        h *= STEP
        h += keys[i : i + len(h)]
    return _mixed(h).view(np.int64)


def shingle_sets(texts: Iterable[str], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct keys of its `width`-word shingles; a shorter text is one shingle."""
    data = [t.encode("utf-8", "replace") for t in texts]
    starts, keys = word_keys(b" ".join(data))
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(d) + 1 for d in data]))
    every = _combined(keys, width)
    for first, end in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        if end - first >= width:
            s = np.sort(every[first : end - width + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]]
        else:
            yield _combined(keys[first:end], end - first) if end > first else np.empty(0, np.int64)


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def least_overlap(n: int, percent: int) -> int:
    """Overlap that a set of n needs with any partner: ceil(t * n)."""
    return -(-percent * n // 100)


def _repeated(sets: list[np.ndarray], tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that two or more of the sets hold, added to what was counted before."""
    if not sets:
        return tokens, counts
    found, n = np.unique(np.concatenate(sets), return_counts=True)
    found, n = found[n > 1], n[n > 1]
    tokens, where = np.unique(np.concatenate([tokens, found]), return_inverse=True)
    counts = np.bincount(where, np.concatenate([counts, n]), len(tokens)).astype(np.int64)
    top = np.sort(np.argsort(-counts, kind="stable")[: 4 * TASK_TABLE])
    return tokens[top], counts[top]


def _profile(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        held, shingles, seen = [], 0, set()
        for frame in pieces(batches):
            sizes, classes = [], []
            for s in shingle_sets(frame["text"], width):
                sizes.append(len(s))
                classes.append(set_key(s))
                if classes[-1] not in seen:
                    seen.add(classes[-1])
                    held.append(s)
                    shingles += len(s)
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].array,
                    "row_key": frame["row_key"].array,
                    "n": np.array(sizes, np.int64),
                    "cls": np.array(classes, np.int64),
                    "token": pd.array([None] * len(sizes), "Int64"),
                    "count": np.zeros(len(sizes), np.int64),
                }
            )
            if shingles > TASK_SHINGLES:
                tokens, counts = _repeated(held, tokens, counts)
                held, shingles, seen = [], 0, set()
        tokens, counts = _repeated(held, tokens, counts)
        top = np.argsort(-counts, kind="stable")[:TASK_TABLE]
        yield pd.DataFrame(
            {
                "doc_id": pd.array([None] * len(top), "Int64"),
                "row_key": np.zeros(len(top), np.int64),
                "n": np.full(len(top), -1, np.int64),
                "cls": np.zeros(len(top), np.int64),
                "token": tokens[top],
                "count": counts[top],
            }
        )

    return run


def matches_wanted(frequencies: np.ndarray, n: int, percent: int, most: int) -> int:
    """Number of common entries to ask for, from the frequencies along the set's order.

    The cost is estimated for partners of equal size.
    """
    choices = np.arange(1, min(most, least_overlap(n, percent)) + 1)
    overlap = -(-2 * percent * n // (100 + percent))
    entries = np.cumsum(np.maximum(frequencies - 1, 0))[np.minimum(n - overlap + choices, n) - 1]
    return int(choices[np.argmin(entries * (1 + VERIFY_COST / choices))])


def _entries(width: int, percent: int, most: int, order):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        frequent, counts = order.value
        for frame in pieces(batches):
            out = []
            if len(seen) > CACHED_SETS:
                seen = set()
            for s in shingle_sets(frame["text"], width):
                n, cls = len(s), set_key(s)
                if not n or cls in seen:
                    continue
                seen.add(cls)
                m, run = 1, 0
                p = n - least_overlap(n, percent) + m
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    f = np.where(frequent[at] == s, counts[at], 0)
                    if f.any():
                        by = np.argsort(f, kind="stable")
                        s, f = s[by], f[by]
                        m = matches_wanted(f, n, percent, most)
                        p = n - least_overlap(n, percent) + m
                        runs = f[:p] // RUN_ROWS
                        run = np.where(runs > 0, 1 + cls % (runs + 1), 0) if runs[-1] else 0
                out.append((s[:p], np.broadcast_to(np.int32(run), p), (cls, p, n, m)))
            if out:
                tokens, runs, heads = zip(*out, strict=True)
                cls, p, n, m = np.array(heads).T
                yield pd.DataFrame(
                    {
                        "token": np.concatenate(tokens),
                        "run": np.concatenate(runs),
                        "pos": (np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)).astype(np.int32),
                        "cls": np.repeat(cls, p),
                        "n": np.repeat(n.astype(np.int32), p),
                        "matches": np.repeat(m.astype(np.int8), p),
                    }
                )

    return run


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries held by two or more classes, from a stream sorted by token, run, pos and class.

    Holds one batch and one row. The first entry of a run is its hub's. Run 0 holds all entries of a
    shingle; runs from 1 are parts of a frequent one and kept even if they hold a single class.
    """
    names = ["cls", "pos", "n", "matches"]
    held = last = hub = None  # a run's only row so far; key and hub of the run read last
    for frame in batches:
        if held is not None:
            frame, held, last = pd.concat([held, frame], ignore_index=True), None, None
        if not len(frame):
            continue
        token, run, cls = (frame[c].to_numpy() for c in ("token", "run", "cls"))
        first = np.r_[True, (token[1:] != token[:-1]) | (run[1:] != run[:-1])]
        new = first | np.r_[True, cls[1:] != cls[:-1]]
        goes_on = last is not None and (token[0], run[0]) == last[:2]
        if goes_on:
            new[0] = cls[0] != last[2]
            first[0] = False
        last = (token[-1], run[-1], cls[-1])
        part = np.cumsum(first) - (0 if goes_on else 1)
        start = np.flatnonzero(first)
        hubs = frame[names].to_numpy()[start]
        if goes_on:
            hubs = np.vstack([hub, hubs])
        hub = hubs[-1:]
        size = np.bincount(part[new], minlength=len(hubs))
        if goes_on:
            size[0] += 1
        keep = new & ((size[part] > 1) | (run > 0))
        if len(start) and size[-1] == 1 and run[-1] == 0:  # a run that goes on holds a class of an earlier batch
            held = frame.iloc[[start[-1]]]
        out = frame[keep].drop(columns="run")
        for i, c in enumerate(names):
            out[f"hub_{c}"] = hubs[part[keep], i]
        yield out


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(batches):
            sets = {set_key(s): s for s in shingle_sets(frame["text"], width)}
            yield pd.DataFrame({"cls": list(sets), "shingles": list(sets.values())})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those whose sets reach the threshold."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .filter(100 * common >= percent * (F.size("x") + F.size("y") - common))
        .select("a", "b")
    )


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) to fewer links that join the same nodes: each node to the smallest of its set.

    Holds LOCAL_LINKS links and one batch; what a task has read so far is reduced when it holds more.
    """

    def reduced(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = np.arange(len(nodes))
        unite(label, place[: len(a)], place[len(a) :])
        leaf = np.flatnonzero(label != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[leaf], "b": nodes[label[leaf]]})

    held = pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    for frame in batches:
        held = pd.concat([held, frame], ignore_index=True)
        if len(held) > LOCAL_LINKS:
            held = reduced(held["a"].to_numpy(), held["b"].to_numpy())
            if len(held) > LOCAL_LINKS // 2:
                yield held
                held = held.iloc[:0]
    yield reduced(held["a"].to_numpy(), held["b"].to_numpy())


def components(links: DataFrame, at_once: int = LOCAL_LINKS) -> DataFrame:
    """(node, label) for every node of the links (a, b): label is the component's smallest node.

    Every task first reduces its links to a forest. Up to `at_once` links, a fixed number, are then joined
    by one task. More go through alternating star contraction, whose rounds are written to the shared
    folder: a node with many links is reduced by partial minima and its links are dealt out by salt.
    """
    both_ways = "a bigint, b bigint"
    edges = links.filter("a <> b").select("a", "b").mapInPandas(_forest, both_ways)
    edges = materialise(edges)
    while edges.count() > at_once:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count("*").alias("degree"))
        large = join_by_key(both, materialise(low), ["a"], "degree", "b").filter("b > a")
        large = large.select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = materialise(large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("degree")))
        small = join_by_key(large, low, ["a"], "degree", "b")
        small = small.select("a", F.col("low").alias("b")).unionByName(
            small.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        edges = materialise(small.distinct())
        # Stars only: no node has two edges, and no centre is a leaf.
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("leaf")).unionByName(
            edges.select(F.col("b").alias("node"), F.lit(0).alias("leaf"))
        )
        ends = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("centre"))
        if ends.filter("leaf > 1 OR leaf = 1 AND centre = 0").isEmpty():
            return ends.filter("leaf = 0").select("node", F.col("node").alias("label")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
            )
    stars = edges.coalesce(1).mapInPandas(_forest, both_ways)
    centres = stars.select(F.col("b").alias("node")).distinct()
    return centres.select("node", F.col("node").alias("label")).unionByName(
        stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
    )


def row_key(id_col: str, text_col: str) -> Column:
    """64-bit key of a row's id and text; rows that repeat both have the same."""
    return F.xxhash64(id_col, F.coalesce(F.col(text_col), F.lit("")))


def _linked(docs: DataFrame, width: int, percent: int, most_matches: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (doc_id, text): every row with its class, the classes, and the labels of linked classes."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    profile = materialise(
        docs.withColumn("row_key", row_key("doc_id", "text")).mapInPandas(
            _profile(width), f"doc_id {id_type}, row_key bigint, n bigint, cls bigint, token bigint, count bigint"
        )
    )
    rows = profile.filter("n >= 0").select("doc_id", "row_key", "n", "cls")
    classes = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))

    top = profile.filter("n < 0").groupBy("token").agg(F.sum("count").alias("count"))
    top = top.orderBy(F.desc("count"), "token").limit(ORDER_TABLE).toArrow().sort_by("token")
    order = spark.sparkContext.broadcast((top["token"].to_numpy(), top["count"].to_numpy()))

    fields = "pos int, cls bigint, n int, matches tinyint"
    entries = docs.select("text").mapInPandas(
        _entries(width, percent, most_matches, order), f"token bigint, run int, {fields}"
    )
    index = materialise(
        entries.repartition("token", "run")
        .sortWithinPartitions("token", "run", "pos", "cls")
        .mapInPandas(
            _shared,
            f"token bigint, {fields}, hub_cls bigint, hub_pos int, hub_n int, hub_matches tinyint",
        )
    )
    # Of two prefixes, the one that ends first has all its common entries in the other, so they are
    # shared; the rest of the overlap lies behind it.
    held = index.groupBy("cls").agg(F.countDistinct("token").alias("held"))
    index = index.join(held, "cls")
    behind = F.greatest(*[F.expr(f"({percent}L * {o}n + 99) div 100 - {o}matches") for o in ("", "other_")])

    overlap = F.expr(f"({percent}L * (n + other_n) + {99 + percent}) div {100 + percent}")
    asked = F.least("matches", "other_matches")

    def candidates(entries: DataFrame) -> DataFrame:
        """Pairs (a, b) that pass by size, position and number of common entries."""
        fits = (F.col("held") + behind >= overlap) & (F.least("n", "other_n") >= overlap)
        for pos, n in (("pos", "n"), ("other_pos", "other_n")):
            fits &= F.col(pos) < F.col(n) - overlap + asked
        rest = F.least(F.col("n") - F.col("pos"), F.col("other_n") - F.col("other_pos"))
        fits &= F.least("pos", "other_pos") + rest >= overlap
        pairs = entries.filter(fits).groupBy(F.col("cls").alias("a"), F.col("other_cls").alias("b"))
        return pairs.agg(F.count("*").alias("common"), F.first(asked).alias("asked")).filter("common >= asked")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs.select("a", "b"))
        wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        wanted = materialise(wanted.join(classes, "cls").select("cls", F.col("doc_id").alias("wanted")))
        ids = wanted.select("wanted").distinct()
        texts = docs.filter(bloom_filter(ids)(F.col("doc_id")))
        sets = (
            texts.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
            .select("text")
            .mapInPandas(_sets(width), "cls bigint, shingles array<bigint>")
            .join(wanted.select("cls"), "cls", "left_semi")
            .dropDuplicates(["cls"])
        )
        return materialise(_verified(pairs, materialise(sets), percent))

    to_hub = index.filter("cls <> hub_cls")
    for c in ("cls", "pos", "n", "matches"):
        to_hub = to_hub.withColumnRenamed(f"hub_{c}", f"other_{c}")
    best = Window.partitionBy("a").orderBy(F.desc("common"), "b")
    hubs = candidates(to_hub).withColumn("rank", F.row_number().over(best)).filter("rank <= 2")
    first = verified(hubs)

    labels = materialise(components(first))
    labelled = (
        index.select("token", "cls", "pos", "n", "matches", "held")
        .join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        .withColumn("label", F.coalesce("label", "cls"))
    )
    spread = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    labelled = labelled.join(spread.select("token"), "token", "left_semi")
    others = labelled.select("token", *[F.col(c).alias(f"other_{c}") for c in labelled.columns if c != "token"])
    across = labelled.join(others, "token").filter("cls < other_cls AND label <> other_label")
    links = first.unionByName(verified(candidates(across.filter(F.col("other_held") + behind >= overlap))))

    return rows, classes, components(links)


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    most_matches: int = 4,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Words are runs of characters outside ASCII white space, A-Z lower-cased. Rows link when the
    Jaccard similarity of their shingle sets is `percent` / 100 or more; a component's id is the
    smallest doc_id reachable. Null and empty texts have no set and no links. Repeated rows link
    with each other. A null doc_id takes part but never names a component unless all its members
    have none (component_id is then null). An empty table gives an empty result.
    """
    rows, classes, labels = _linked(keyed_texts(docs, id_col, text_col), width, percent, most_matches)
    names = labels.join(classes.withColumnRenamed("cls", "node"), "node")
    names = labels.join(names.groupBy("label").agg(F.min("doc_id").alias("low")), "label")
    named = classes.join(names.select(F.col("node").alias("cls"), "low"), "cls", "left").select(
        "cls", F.coalesce("low", "doc_id").alias("component_id")
    )
    return rows.join(named, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    most_matches: int = 4,
) -> DataFrame:
    """(row_key) of the rows that go so that each component of `near_groups` keeps one document.

    The document with the smallest id stays, a null id only if all have none; of those that share it,
    the one with the smallest key. Rows that repeat id and text are one document and stay or go together.
    """
    rows, _, labels = _linked(keyed_texts(docs, id_col, text_col), width, percent, most_matches)
    rows = rows.filter("n > 0").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    rows = rows.select(
        F.coalesce("label", "cls").alias("label"),
        F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key").alias("place"),
    )
    kept = rows.groupBy("label").agg(F.min("place").alias("kept"))
    gone = rows.join(kept, "label").filter("place.row_key <> kept.row_key")
    return gone.select("place.row_key").distinct()
