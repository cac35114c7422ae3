"""Exact top-k inner-product search by a three-phase uniform threshold.

A score is the sum of `lists` partial scores, one for each part of the dimensions. For blocks of
queries against blocks of vectors:

1. every block reports, for each query and list, the k entries of highest partial score, with
   their full scores; the k-th best full score gathered for a query is a safe cutoff, since k
   candidates reach it;
2. the cutoff goes back with its query. A candidate that reaches it has a partial score of at least
   cutoff / lists in some list, so each list need only collect entries from there up;
3. the collected entries' remaining partial scores are resolved and their sums compared.

Blocks have bounded rows; vectors are replicated by query block, never paired as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.session import materialise

VECTOR_ROWS, QUERY_ROWS = 8_192, 512
#: Sums of products below this are exact in double precision.
EXACT = 1 << 52


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component; null if the vector or a component is null or not finite."""
    values = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(good, F.transform(values, lambda x: F.floor(x * 256.0).cast("long")))


def _matrix(rows: list) -> np.ndarray:
    """Rows of unequal length are filled up with zeros."""
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _packed(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                values = _matrix(part["v"].tolist())
                ids = part["vec_id"].to_numpy(np.int64)
                yield pd.DataFrame(
                    {"ids": [ids.tobytes()], "vectors": [values.tobytes()], "width": [values.shape[1]]}
                )

    return run


def _unpacked(ids: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vectors, np.int64).reshape(len(ids), width)


def _parts(q: np.ndarray, v: np.ndarray, lists: int) -> list[np.ndarray]:
    """Partial scores (queries x vectors) by list; components beyond the shorter side are zero."""
    width = min(q.shape[1], v.shape[1])
    q, v = q[:, :width], v[:, :width]
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(width, 1)
    if largest < EXACT:
        q, v = q.astype(np.float64), v.astype(np.float64)
    cuts = [width * i // lists for i in range(lists + 1)]
    return [q[:, a:b] @ v[:, a:b].T for a, b in zip(cuts, cuts[1:], strict=False)]


def _rows(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query_id": queries, "vec_id": ids, "score": scores.astype(np.int64)})


def _gathered(k: int, lists: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r in frame.itertuples(index=False):
                queries, q = _unpacked(r.q_ids, r.q_vectors, r.q_width)
                ids, v = _unpacked(r.ids, r.vectors, r.width)
                parts = _parts(q, v, lists)
                total = sum(parts)
                own = queries[:, None] == ids[None, :]
                chosen = np.zeros(total.shape, bool)
                for part in parts:
                    part = np.where(own, -np.inf if part.dtype.kind == "f" else np.iinfo(np.int64).min, part)
                    top = np.argpartition(-part if part.dtype.kind == "f" else ~part, min(k, len(ids)) - 1, axis=1)
                    np.put_along_axis(chosen, top[:, :k], True, axis=1)
                row, at = np.nonzero(chosen & ~own)
                yield _rows(queries[row], ids[at], total[row, at])

    return run


def _resolved(lists: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r in frame.itertuples(index=False):
                queries, q = _unpacked(r.q_ids, r.q_vectors, r.q_width)
                ids, v = _unpacked(r.ids, r.vectors, r.width)
                cutoff = {x["query_id"]: x["cutoff"] for x in (r.cutoffs if r.cutoffs is not None else [])}
                cut = np.array([cutoff.get(i, -(1 << 62)) for i in queries.tolist()], np.int64)[:, None]
                parts = _parts(q, v, lists)
                collected = np.zeros(parts[0].shape, bool)
                for part in parts:
                    collected |= part * lists >= cut
                row, at = np.nonzero(collected & (queries[:, None] != ids[None, :]))
                total = sum(part[row, at] for part in parts)
                good = total >= cut[row, 0]
                yield _rows(queries[row[good]], ids[at[good]], total[good])

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, lists: int = 2, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    is_query: a condition on `vec_id`. Candidates are all rows but those with the query's own id;
    ties go to the smaller id. Vectors that are null or hold null or non-finite components and rows
    without id take no part. Shorter vectors count as filled up with zeros. A query id that repeats is
    asked once, with its smallest vector; candidate rows that repeat count each. Fewer candidates than
    k give all of them.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("v"))
    rows = rows.filter("vec_id IS NOT NULL AND v IS NOT NULL")
    schema = "ids binary, vectors binary, width bigint"
    blocks = rows.mapInPandas(_packed(VECTOR_ROWS), schema)
    blocks = materialise(blocks.withColumn("block", F.monotonically_increasing_id()))
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.coalesce(max(1, blocks.rdd.getNumPartitions() // 8)).mapInPandas(_packed(QUERY_ROWS), schema)
    asked = materialise(
        asked.select(
            F.col("ids").alias("q_ids"),
            F.col("vectors").alias("q_vectors"),
            F.col("width").alias("q_width"),
            F.monotonically_increasing_id().alias("q_block"),
        )
    )
    # Every block of queries against every block of vectors: pairs of blocks, not of rows.
    found = "query_id bigint, vec_id bigint, score bigint"
    first = blocks.crossJoin(asked).mapInPandas(_gathered(k, lists), found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    cutoffs = kth.groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count("*").alias("n")).filter(F.col("n") == k)
    place = asked.select("q_block", "q_ids").mapInPandas(
        lambda frames: (
            pd.DataFrame({"q_block": r.q_block, "query_id": np.frombuffer(r.q_ids, np.int64)})
            for frame in frames
            for r in frame.itertuples(index=False)
        ),
        "q_block bigint, query_id bigint",
    )
    cutoffs = place.join(cutoffs, "query_id").groupBy("q_block")
    cutoffs = cutoffs.agg(F.collect_list(F.struct("query_id", "cutoff")).alias("cutoffs"))  # QUERY_ROWS at most
    asked = materialise(asked.join(cutoffs, "q_block", "left"))
    final = blocks.crossJoin(asked).mapInPandas(_resolved(lists), found)
    ranked = final.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
