"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word-based operators define it; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of one Arrow batch are worked on in pieces of about so many characters.
PIECE_CHARS = 500_000

#: A key is hot if it holds this part of all rows; the rows of hot keys are dealt out to so many tasks.
HEAVY, SALTS = 1_000, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that further columns and their names cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def pieces(batches: Iterator[pd.DataFrame], text_col: str = "text") -> Iterator[pd.DataFrame]:
    """The same rows in frames of bounded text length (one long text may exceed it alone)."""
    for frame in batches:
        if not len(frame):
            continue
        piece = (frame[text_col].str.len().fillna(0).cumsum() // PIECE_CHARS).to_numpy()
        start = 0
        for end in [*(piece[1:] != piece[:-1]).nonzero()[0] + 1, len(frame)]:
            yield frame.iloc[start:end]
            start = end


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The rows of a list column; shorter ones are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def join_by_key(rows: DataFrame, groups: DataFrame, keys: list[str], copies: str, salt_by: str, how: str = "inner") -> DataFrame:
    """Join rows with `groups`, one row a key, whose `copies` tells how many rows have it.

    Keys that hold a thousandth of all rows or more, so a thousand at most, are named to every task; their
    rows are dealt out by a hash of `salt_by` and meet as many copies of their group. `groups` is read
    three times and so comes from a checkpoint or a table.
    """
    total = groups.agg(F.sum(copies)).first()[0] or 0
    heavy = F.col(copies) * HEAVY >= total
    hot = groups.filter(heavy).select(*keys, F.lit(True).alias("_hot"))
    spread = groups.withColumn(
        "_salt", F.explode(F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    )
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")).otherwise(0)
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_hot")
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a and b. `label` has a set's smallest place for each of its places and keeps doing so."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
