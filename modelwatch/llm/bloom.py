"""Blocked Bloom filters as an array of 64-bit words, built and tested by DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About 16 bits a key, at most 8 MiB in all. Beyond 4 million keys more false positives pass, which
#: the exact join behind a filter removes.
KEYS_PER_WORD, MOST_WORDS, BITS_SET = 4, 1 << 20, 4


def _mask(columns: list[Column]) -> Column:
    bits = F.xxhash64(*columns, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for i in range(BITS_SET):
        place = F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def bloom_filter(keys: DataFrame) -> Callable[..., Column]:
    """A test for columns that may equal a row of `keys`; it never misses one.

    Each key sets its bits in one word, so a test reads one word. The words are aggregated by
    executors and reach the tasks as a constant of proven size (a scalar subquery).
    """
    columns = [F.col(c) for c in keys.columns]
    n, words = keys.count(), 1
    while words * KEYS_PER_WORD < n and words < MOST_WORDS:
        words *= 2
    place = F.pmod(F.xxhash64(*columns), F.lit(words)).cast("int")
    blocks = keys.groupBy(place.alias("word")).agg(F.bit_or(_mask(columns)).alias("mask"))
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word"))
    blocks = every.join(blocks, "word", "left").select("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    ordered = F.sort_array(F.collect_list(F.struct("word", "mask")))
    filled = blocks.agg(F.transform(ordered, lambda x: x["mask"]).alias("words")).scalar()

    def may_hold(*values: Column) -> Column:
        mask = _mask(list(values))
        return F.get(filled, F.pmod(F.xxhash64(*values), F.lit(words)).cast("int")).bitwiseAND(mask) == mask

    return may_hold
