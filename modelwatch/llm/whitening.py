"""Embedding whitening from a weighted multiplicity covariance.

Rows with the same quantised vector x form one group. The distinct vectors are the fit list; each
weighs one, or as much as it has rows. Means come from exact integer sums; each task multiplies its
centred vectors into one square matrix, and the matrices are added up by executors. Every distinct
vector is whitened once and joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import join_by_key, matrix
from modelwatch.llm.topk import quantised
from modelwatch.session import materialise

#: An eigenvalue below this part of the trace counts as zero.
NO_VARIANCE = 1e-12
#: Rows of one matrix product.
GEMM_ROWS = 4_096
LONG_MAX = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """What was fitted; its size depends on the vectors' width only."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray  # width x components, unit eigenvectors by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    @property
    def explained(self) -> list[float | None]:
        return [float(e) / self.trace if self.trace > 0 else None for e in self.eigenvalues]

    @property
    def usable(self) -> np.ndarray:
        return self.eigenvalues > NO_VARIANCE * max(self.trace, 0.0)


def vector_keys(*values: Column) -> list[Column]:
    """Two 64-bit hashes: n different values meet in both with probability n^2 / 2^129."""
    return [F.xxhash64(*values).alias("k1"), F.xxhash64(F.lit("k2"), *values).alias("k2")]


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(k1, k2, x, copies) of rows with a column x; copies are counted before the shuffle."""
    groups = rows.groupBy("x").agg(F.count("*").alias("copies"))
    return materialise(groups.select(*vector_keys(F.col("x")), "x", "copies"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, high, low): sums of x = high * 2^32 + low of one task; dim -1 has the weights."""
    high, low, weight = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for batch in batches:
        x, w = batch.column("x"), batch.column("w").to_numpy()
        x = matrix(x, int(np.diff(x.offsets.to_numpy()).max(initial=0)))
        if x.shape[1] > len(high):
            high, low = (np.pad(v, (0, x.shape[1] - len(v))) for v in (high, low))
        high[: x.shape[1]] += w @ (x >> 32)
        low[: x.shape[1]] += w @ (x & 0xFFFFFFFF)
        weight += int(w.sum())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(-1, len(high))), pa.array(np.r_[0, high]), pa.array(np.r_[weight, low])], ["dim", "high", "low"]
    )


def _products(mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            x, w = matrix(batch.column("x"), len(mean)), batch.column("w").to_numpy()
            for at in range(0, len(x), GEMM_ROWS):
                centred = x[at : at + GEMM_ROWS] - mean
                total += centred.T @ (w[at : at + GEMM_ROWS, None] * centred)
        i, j = np.triu_indices(len(mean))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i, j, total[i, j])], ["i", "j", "value"])

    return run


def fit_whitening(distinct: DataFrame, components: int, weigh_copies: bool = False) -> Whitening:
    """Fit on the distinct vectors, each with weight one or its copies.

    The driver gets one sum a dimension and one sum a pair of dimensions, whatever the number of rows.
    """
    weighted = distinct.select("x", (F.col("copies") if weigh_copies else F.lit(1).cast("long")).alias("w"))
    sums = weighted.mapInArrow(_sums, "dim bigint, high bigint, low bigint").groupBy("dim")
    sums = sums.agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    found = {r.dim: (int(r.high) << 32) + int(r.low) for r in sums.collect()}
    n, width = found.pop(-1, 0), len(found)
    totals = tuple(found[d] for d in range(width))
    if not n or not width:
        return Whitening(n, totals, np.zeros((width, 0)), np.zeros(0), 0.0)
    mean = Whitening(n, totals, np.zeros((width, 0)), np.zeros(0), 0.0).mean
    parts = weighted.mapInArrow(_products(mean), "i bigint, j bigint, value double")
    covariance = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        covariance[r.i, r.j] = covariance[r.j, r.i] = r.value / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    largest = np.abs(vectors).argmax(axis=0)
    return Whitening(n, totals, vectors * np.sign(vectors[largest, range(len(values))]), values, float(np.trace(covariance)))


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2; null if it does not fit a long."""
    estimate = (np.abs(x.astype(float) * n) + np.abs(np.array(sums, float))) ** 2
    if estimate.sum(axis=1).max(initial=0) < 2.0**62:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v <= LONG_MAX else None for v in exact]


def _whitened(model: Whitening):
    mean = model.mean
    good = model.usable
    scale = np.where(good, 1 / np.sqrt(np.where(good, model.eigenvalues, 1.0)), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), len(mean))
            white = ((x - mean) @ model.directions) * scale
            values = pa.array(white.ravel(), mask=np.tile(~good, len(x)))
            places = pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("k1", "k2", "copies")),
                    pa.array(_deviations(x, model.n, model.sums), pa.int64()),
                    pa.ListArray.from_arrays(places, values),
                ],
                ["k1", "k2", "copies", "deviation", "whitened"],
            )

    return run


def identity_error(white: DataFrame, model: Whitening, weigh_copies: bool = False) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - identity), over usable components."""
    used = np.flatnonzero(model.usable).tolist()
    if not used:
        return 0.0
    w = F.col("copies") if weigh_copies else F.lit(1)
    value = {i: F.get("whitened", F.lit(i)) for i in used}
    mean = white.agg(*[(F.sum(w * value[i]) / model.n).alias(str(i)) for i in used]).first()
    centred = {i: value[i] - F.lit(mean[str(i)]) for i in used}
    pairs = [(i, j) for i in used for j in used if i <= j]
    found = white.agg(*[(F.sum(w * centred[i] * centred[j]) / model.n).alias(f"{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(
    vectors: DataFrame, components: int = 4, weigh_copies: bool = False, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, Whitening, float]:
    """((vec_id, copies, deviation, whitened), what was fitted, its identity error), one row per vector.

    Entries c become x = floor(256 * c). Rows whose vector is null or holds null or non-finite entries
    are left out; a null id stays. Rows that repeat a vector share one whitened vector, rows that repeat
    altogether all stay. Shorter vectors count as filled up with zeros, though each length is a vector
    of its own in the fit list. Components are numbered by falling eigenvalue, as many as the width
    allows; each has its largest entry positive. A component without variance gives null. `deviation`
    is null where it does not fit a long. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), quantised(F.col(vector_col)).alias("x")).filter("x IS NOT NULL")
    distinct = distinct_vectors(rows)
    model = fit_whitening(distinct, components, weigh_copies)
    schema = "k1 bigint, k2 bigint, copies bigint, deviation bigint, whitened array<double>"
    white = materialise(distinct.mapInArrow(_whitened(model), schema))
    error = identity_error(white, model, weigh_copies)
    out = join_by_key(rows.select("vec_id", *vector_keys(F.col("x"))), white, ["k1", "k2"], "copies", "vec_id")
    return out.select("vec_id", "copies", "deviation", "whitened"), model, error
