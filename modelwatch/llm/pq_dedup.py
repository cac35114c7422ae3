"""Near-duplicate vectors by product quantisation, without a missed pair.

Unit vectors have a coarse list (the nearest centre) and a code: one centroid for each part of the
residual's dimensions. Centres and codebooks are fitted on a bounded sample; they decide speed only:

* probes: a vector within distance r of a member of list l is no farther than r from l's cell, so a list
  is left out only where the bisector between both centres, or the list's distances to its own
  centre, prove it;
* table look-ups: |y - x| >= |y - decoded x| - |x - decoded x|, so a pair is left out only where its
  table distance less the stored error of x exceeds r;
* what remains is decided by the exact cosine of the original vectors.

Vectors are packed in order of (label, list) into blocks of bounded rows. A task compares two blocks
and returns, for each vector, how many links it found and the edges of a spanning forest, never
the pairs: a group of n near copies costs n rows, not n^2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import join_by_key, matrix, unite
from modelwatch.llm.ngram_join import components
from modelwatch.llm.whitening import vector_keys
from modelwatch.session import materialise

#: The index is fitted on so many vectors (those with the smallest hash) of at most so many values in all.
SAMPLE_ROWS, SAMPLE_VALUES = 8_192, 1 << 21
MOST_LISTS, PARTS, CODES, ROUNDS = 512, 8, 256, 6
#: Vectors of a block and their bytes; queries whose tables are held at once.
BLOCK_ROWS, BLOCK_BYTES, QUERIES = 4_096, 8 << 20, 256
#: Added to every bound, above the rounding of distances of unit vectors.
SLACK = 1e-9


@dataclass(frozen=True)
class Quantiser:
    centres: np.ndarray  # lists x width
    cuts: tuple[int, ...]  # first dimension of each part, and the width
    books: tuple[np.ndarray, ...]  # by part: codes x dimensions of the part

    def lists(self, u: np.ndarray) -> np.ndarray:
        """Squared distances to the centres."""
        return np.maximum((u * u).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * u @ self.centres.T, 0)

    def codes(self, residual: np.ndarray) -> np.ndarray:
        out = np.empty((len(residual), len(self.books)), np.uint8)
        for p, book in enumerate(self.books):
            part = residual[:, self.cuts[p] : self.cuts[p + 1]]
            out[:, p] = ((book**2).sum(1) - 2 * part @ book.T).argmin(1)
        return out

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.hstack([book[codes[:, p]] for p, book in enumerate(self.books)])


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; a centre without rows stays where it is."""
    centres = x[np.arange(k) * len(x) // k].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([
            ((centres**2).sum(1) - 2 * x[at : at + 1024] @ centres.T).argmin(1) for at in range(0, len(x), 1024)
        ])
        count = np.bincount(near, minlength=k)
        by = np.argsort(near, kind="stable")
        used = np.flatnonzero(count)
        first = (np.cumsum(count) - count)[used]
        centres[used] = np.add.reduceat(x[by], first, axis=0) / count[used, None]
    return centres


def fit_quantiser(sample: np.ndarray, rows: int) -> Quantiser:
    """From unit vectors: about sqrt(rows) / 4 lists, and codebooks of the residuals."""
    width = sample.shape[1]
    parts = max(1, min(PARTS, width))
    cuts = tuple(width * i // parts for i in range(parts + 1))
    if not len(sample):
        return Quantiser(np.zeros((1, width)), cuts, tuple(np.zeros((1, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)))
    centres = k_means(sample, max(1, min(MOST_LISTS, round(rows**0.5 / 4), len(sample) // 16)))
    quantiser = Quantiser(centres, cuts, ())
    residual = sample - centres[quantiser.lists(sample).argmin(1)]
    books = [k_means(residual[:, a:b], min(CODES, max(1, len(sample) // 4))) for a, b in zip(cuts, cuts[1:], strict=False)]
    return Quantiser(centres, cuts, tuple(books))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _encoded(sent):
    """Adds each vector's list, its distance to the centre, its code and the code's error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            u = unit(matrix(batch.column("vec"), q.centres.shape[1]))
            near = q.lists(u).argmin(1)
            residual = u - q.centres[near]
            codes = q.codes(residual)
            columns = {
                "list": pa.array(near.astype(np.int32)),
                "far": pa.array(np.linalg.norm(residual, axis=1)),
                "error": pa.array(np.linalg.norm(residual - q.decoded(codes), axis=1)),
                "code": pa.array([c.tobytes() for c in codes], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])

    return run


def probed(q: Quantiser, u: np.ndarray, radius: float) -> np.ndarray:
    """Which lists may hold a vector within the radius (vectors x lists), by the bisectors of centres."""
    far = q.lists(u)
    own = far.argmin(1)
    between = np.sqrt(q.lists(q.centres))[own]
    return far - far[np.arange(len(u)), own][:, None] <= 2 * between * (radius + SLACK) + SLACK


def _packed(sent, rows_at_most: int, radius: float, dtype: str):
    """Sorted rows to blocks. Only labels at a block's ends can go on elsewhere, so only their lists are named."""

    def block(base: int, part: pd.DataFrame) -> pd.DataFrame:
        q = sent.value
        labels, lists = part["label"].to_numpy(object), part["list"].to_numpy(np.int32)
        vectors = np.zeros((len(part), q.centres.shape[1]), dtype)
        for i, v in enumerate(part["vec"]):
            vectors[i, : len(v)] = v
        runs, probes = [], []
        for name in {labels[0], labels[-1]}:
            mine = np.flatnonzero(labels == name)
            wanted = np.zeros(len(q.centres), bool)
            for at in range(0, len(mine), QUERIES):
                wanted |= probed(q, unit(vectors[mine[at : at + QUERIES]]), radius).any(0)
            runs += [(name, c) for c in np.unique(lists[mine])]
            probes += [(name, c) for c in np.flatnonzero(wanted)]
        data = {"base": base, "labels": labels, "lists": lists.tobytes(), "vectors": vectors.tobytes()}
        data |= {c: part[c].to_numpy().tobytes() for c in ("far", "error")}
        data |= {"codes": b"".join(part["code"]), **{c: part[c].array for c in ("copies", "k1", "k2", "low_id")}}
        for name, pairs in (("run", runs), ("probe", probes)):
            data |= {f"{name}_labels": [a for a, _ in pairs], f"{name}_lists": [int(b) for _, b in pairs]}
        return pd.DataFrame({k: pd.Series([v], dtype=object) for k, v in data.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, held = TaskContext.get().partitionId() << 40, pd.DataFrame()
        for frame in batches:
            held = pd.concat([held, frame], ignore_index=True) if len(held) else frame
            while len(held) >= rows_at_most:
                yield block(base, held.iloc[:rows_at_most])
                base, held = base + rows_at_most, held.iloc[rows_at_most:]
        if len(held):
            yield block(base, held)

    return run


class Block:
    """Vectors of one block as arrays, in order of label and list."""

    FIELDS = ("base", "labels", "lists", "far", "error", "copies", "vectors", "codes")

    def __init__(self, q: Quantiser, dtype: str, base, labels, lists, far, error, copies, vectors, codes):
        self.base, self.label = base, np.array(labels, object)
        self.list = np.frombuffer(lists, np.int32)
        self.far, self.error = (np.frombuffer(v, np.float64) for v in (far, error))
        self.copies = np.asarray(copies, np.int64)
        self.u = unit(np.frombuffer(vectors, dtype).reshape(len(self.list), -1))
        self.codes = np.frombuffer(codes, np.uint8).reshape(len(self.list), -1)
        self.square = ((q.centres[self.list] + q.decoded(self.codes)) ** 2).sum(1)

    def spans(self) -> dict[str, tuple[int, int]]:
        """First row and end of each label."""
        first = np.flatnonzero(np.r_[True, (self.label[1:] != self.label[:-1]).astype(bool)])
        return {self.label[a]: (int(a), int(b)) for a, b in zip(first, np.r_[first[1:], len(self.label)], strict=True)}

    def runs(self, first: int, end: int) -> list[tuple[int, int]]:
        """First row and end of each list between two rows."""
        start = first + np.flatnonzero(np.r_[True, np.diff(self.list[first:end]) != 0])
        return [(int(a), int(b)) for a, b in zip(start, np.r_[start[1:], end], strict=True)]


def compare(left: Block, right: Block, q: Quantiser, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, label) for the rows of left, then of right; of left alone if it is compared with itself.

    links counts linked vectors, copies included; label is the smallest row of the same set.
    """
    same = left is right
    radius = np.sqrt(max(0.0, 2 - 2 * cosine))
    shift = 0 if same else len(left.u)
    links = np.zeros(shift + len(right.u), np.int64)
    label = np.arange(len(links))
    spans = right.spans()
    for name, (first, last) in left.spans().items():
        if name not in spans:
            continue
        runs = right.runs(*spans[name])
        for at in range(first, last, QUERIES):
            u = left.u[at : min(at + QUERIES, last)]
            far, wanted, products = np.sqrt(q.lists(u)), probed(q, u, radius), u @ q.centres.T
            tables = [u[:, a:b] @ book.T for a, b, book in zip(q.cuts, q.cuts[1:], q.books, strict=False)]
            for r, e in runs:
                c = right.list[r]
                own = right.far[r:e]
                near = (far[:, c] <= own.max() + radius + SLACK) & (far[:, c] >= own.min() - radius - SLACK)
                some = np.flatnonzero(wanted[:, c] & near)
                if not len(some) or same and e <= at + some[0] + 1:
                    continue
                look = products[some, c][:, None] + sum(t[some][:, right.codes[r:e, p]] for p, t in enumerate(tables))
                bound = np.sqrt(np.maximum(1 + right.square[r:e] - 2 * look, 0)) - right.error[r:e]
                maybe = bound <= radius + SLACK
                if same:
                    maybe &= (at + some)[:, None] < np.arange(r, e)
                rows, columns = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
                exact = u[some[rows]] @ right.u[r + columns].T
                i, j = np.nonzero((exact >= cosine) & maybe[np.ix_(rows, columns)])
                a, b = at + some[rows[i]], r + columns[j]
                np.add.at(links, a, right.copies[b])
                np.add.at(links, shift + b, left.copies[a])
                unite(label, a, shift + b)
    return links, label


def _compared(sent, cosine: float, dtype: str):
    """Rows of one block, compared with itself, or of two, to (node, links, low) of linked vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = sent.value
        for frame in batches:
            for row in frame.itertuples(index=False):
                left = right = Block(q, dtype, *(getattr(row, f) for f in Block.FIELDS))
                if hasattr(row, "other_base"):
                    right = Block(q, dtype, *(getattr(row, f"other_{f}") for f in Block.FIELDS))
                links, label = compare(left, right, q, cosine)
                node = left.base + np.arange(len(left.u))
                if right is not left:
                    node = np.r_[node, right.base + np.arange(len(right.u))]
                found = np.flatnonzero(links)
                yield pd.DataFrame({"node": node[found], "links": links[found], "low": node[label[found]]})

    return run


def _blocks(rows: DataFrame, n: int, sent, width: int, radius: float, id_type: str, dtype: str) -> DataFrame:
    """Distinct vectors of each label, encoded, sorted by (label, list) and packed; written to the shared folder."""
    distinct = rows.groupBy("label", "vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low_id"))
    distinct = distinct.select("label", "vec", "copies", "low_id", *vector_keys(F.col("label"), F.col("vec")))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    encoded = distinct.mapInArrow(_encoded(sent), f"{fields}, list int, far double, error double, code binary")
    order = ["label", "list", "k1", "k2"]
    size = max(256, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))
    # No more partitions than there are full blocks: part of a block costs as many comparisons as a whole one.
    packed = encoded.repartitionByRange(*order).coalesce(max(1, n // size)).sortWithinPartitions(*order)
    schema = (
        "base bigint, labels array<string>, lists binary, vectors binary, far binary, error binary, codes binary, "
        f"copies array<bigint>, k1 array<bigint>, k2 array<bigint>, low_id array<{id_type}>, "
        "run_labels array<string>, run_lists array<int>, probe_labels array<string>, probe_lists array<int>"
    )
    return materialise(packed.mapInPandas(_packed(sent, size, radius, dtype), schema))


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """(base, other_base) of different blocks in which a vector of one probes a list of the other."""

    def named(kind: str, base: str) -> DataFrame:
        zipped = F.explode(F.arrays_zip(f"{kind}_labels", f"{kind}_lists")).alias("z")
        rows = blocks.select(F.col("base").alias(base), zipped)
        return rows.select(base, F.col(f"z.{kind}_labels").alias("label"), F.col(f"z.{kind}_lists").alias("list"))

    met = named("probe", "a").join(named("run", "b"), ["label", "list"]).filter("a <> b")
    return met.select(F.least("a", "b").alias("base"), F.greatest("a", "b").alias("other_base")).distinct()


def near_vectors(
    vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Two rows link when their labels are equal and their cosine, in double precision, is at least
    `cosine` (above 0). n_links counts the other rows linked directly; component_id is the smallest id
    reachable, itself included; kept where that is its own id. Rows without label, and vectors that are
    null, empty, zero or hold null or non-finite components, link with nothing and keep their own id.
    Shorter vectors count as filled up with zeros. Rows that repeat a vector link with each other. A
    null id takes part and names a component only if all its rows have none. An empty table gives no
    rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind, dtype = ("float", "<f4") if kind == "float" else ("double", "<f8")
    rows = vectors.select(
        F.col(id_col).alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast(f"array<{kind}>").alias("vec"),
    )
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    valid = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    used = rows.filter(valid)
    id_type = rows.schema["vec_id"].dataType.simpleString()

    width, n = used.agg(F.max(F.size("vec")), F.count("*")).first()
    wanted = max(256, min(SAMPLE_ROWS, SAMPLE_VALUES // max(1, width or 1)))
    sample = used.select("vec").orderBy(F.xxhash64("vec_id", "vec"), "vec").limit(wanted).toArrow()["vec"].combine_chunks()
    sample = np.unique(unit(matrix(sample, width or 1)), axis=0) if len(sample) else np.zeros((0, width or 1))
    sent = spark.sparkContext.broadcast(fit_quantiser(np.random.default_rng(0).permutation(sample), n))

    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    blocks = _blocks(used, n, sent, width or 1, radius, id_type, dtype)
    single = blocks.select(*Block.FIELDS)
    second = single.select(*[F.col(c).alias(f"other_{c}") for c in single.columns])
    double = _block_pairs(blocks).join(single, "base").join(second, "other_base").select(*single.columns, *second.columns)
    schema = "node bigint, links bigint, low bigint"
    found = single.mapInPandas(_compared(sent, cosine, dtype), schema)
    found = materialise(found.unionByName(double.mapInPandas(_compared(sent, cosine, dtype), schema)))

    zipped = F.posexplode(F.arrays_zip("k1", "k2", "copies", "low_id")).alias("at", "z")
    nodes = blocks.select("base", zipped).select((F.col("base") + F.col("at")).alias("node"), "z.*")
    labels = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    labelled = labels.join(nodes.select("node", "low_id"), "node")
    names = materialise(labelled.groupBy("label").agg(F.min("low_id").alias("component_id"), F.count("*").alias("members")))
    named = join_by_key(labels, names, ["label"], "members", "node").select("node", "component_id")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = materialise(
        nodes.join(links, "node", "left")
        .join(named, "node", "left")
        .select(
            *("k1", "k2", "copies"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "low_id").alias("component_id"),
        )
    )
    keyed = used.select("vec_id", *vector_keys(F.col("label"), F.col("vec")))
    linked = join_by_key(keyed, groups, ["k1", "k2"], "copies", "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
