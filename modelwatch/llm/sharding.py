"""Minimax contiguous sharding of atomic groups.

Groups (rows of equal text, which stay together) are ordered by a 64-bit key. The smallest
capacity C for which greedy filling in that order needs no more than the given number of shards
is found by binary search, and the order is cut there.

The check runs on cells: ranges of keys with their total size. A cell boundary is always a valid
cut, so whole cells give an upper bound of C; cells that may be cut anywhere give a lower bound.
Only cells that a cut could fall into are divided further, by one aggregation a round, until both
bounds meet. The driver holds cell totals only: at most 2^12 and, in a round, 2^6 for each cell in
question; the rows never leave the executors.

A group larger than an equal share would set C for all others. Such groups (fewer than there are
shards) stand first in the order and have a shard each; the others are cut for the shards left.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.session import materialise

FIRST_BITS, MORE_BITS, KEY_BITS = 12, 6, 64
#: Rows numbered together by one window group, on average, and the most such groups.
BLOCK_ROWS, MOST_BLOCKS = 512, 65_536


class _Cells:
    """Key ranges in order: (first key, bits, size, one group only)."""

    def __init__(self, rows: list[tuple[int, int, int, bool]]):
        self.rows = sorted(rows)
        self.ends = []
        total = 0
        for _, _, size, _ in self.rows:
            total += size
            self.ends.append(total)
        self.total = total

    def cuts(self, capacity: int, shards: int, divisible: bool) -> list[int] | None:
        """Prefix sizes at the greedy cuts, or None if `shards` shards do not suffice."""
        cuts, start = [], 0
        for _ in range(shards):
            goal = start + capacity
            if goal >= self.total:
                return cuts
            i = bisect_right(self.ends, goal)
            before = self.ends[i - 1] if i else 0
            end = goal if divisible and not self.rows[i][3] else before
            if end <= start:
                return None
            cuts.append(start := end)
        return None

    def least(self, shards: int, divisible: bool) -> int:
        low, high = max(1, -(-self.total // shards)), max(1, self.total)
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, divisible) is None:
                low = middle + 1
            else:
                high = middle
        return low

    def doubtful(self, low: int, high: int, shards: int) -> set[int]:
        """Indices of divisible cells that a greedy cut for a capacity in [low, high] may hit."""
        hit, first, last = set(), 0, 0
        for _ in range(shards):
            i, j = bisect_right(self.ends, first + low), bisect_right(self.ends, last + high)
            if i >= len(self.ends):
                break
            hit.update(k for k in range(i, min(j, len(self.ends) - 1) + 1) if not self.rows[k][3])
            first = self.ends[i - 1] if i else 0
            last = min(last + high, self.total)
        return hit


def _measured(groups: DataFrame, bits: int) -> list[tuple[int, int, int, bool]]:
    start = F.shiftleft(F.shiftright("key", KEY_BITS - bits), KEY_BITS - bits)
    cells = groups.groupBy(start.alias("start")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    return [(r.start, bits, int(r["size"]), r.n == 1) for r in cells.collect()]


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """First keys of the second and later shards for (key, size) groups, at most shards - 1."""
    if not (cells := _Cells(_measured(groups, FIRST_BITS))).rows:
        return []
    while True:
        low, high = cells.least(shards, True), cells.least(shards, False)
        doubt = cells.doubtful(low, high, shards) if low < high else set()
        if not doubt:
            break
        rows = [r for k, r in enumerate(cells.rows) if k not in doubt]
        by_bits: dict[int, list[int]] = {}
        for k in doubt:
            by_bits.setdefault(cells.rows[k][1], []).append(cells.rows[k][0])
        for bits, starts in by_bits.items():
            start = F.shiftleft(F.shiftright("key", KEY_BITS - bits), KEY_BITS - bits)
            rows += _measured(groups.filter(start.isin(starts)), min(bits + MORE_BITS, KEY_BITS))
        cells = _Cells(rows)
    at = [bisect_right(cells.ends, cut) for cut in cells.cuts(high, shards, False)]
    return [cells.rows[i][0] for i in at]


def _shard(key: Column, large: list[int], cuts: list[int]) -> Column:
    shard = F.lit(len(large))
    for cut in cuts:
        shard = shard + (key >= F.lit(cut)).cast("int")
    for i, k in enumerate(large):
        shard = F.when(key == F.lit(k), F.lit(i)).otherwise(shard)
    return shard


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row; equal texts share a shard.

    size: UTF-8 bytes of the text plus 8 (null: 8, and grouped with empty text). slot numbers the
    rows of a shard from 0 without gaps, by hash block and then doc_id; equal rows are
    interchangeable. Fewer groups than shards leave shards empty; an empty table gives no rows.

    Numbering does not sort a shard in one task: rows are dealt into hash blocks that cut across
    all shards, numbered inside them, and shifted by the counts of the blocks before.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        )
    )
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("size")))
    total, n = (int(x or 0) for x in rows.agg(F.sum("size"), F.count("*")).first())

    # Larger than a share of all: fewer than `shards`. Of these, those above a share of the rest.
    large, rest = [], total
    for r in groups.filter(F.col("size") * shards > total).orderBy(F.desc("size"), "key").collect():
        if len(large) < shards - 1 and r["size"] * (shards - len(large)) > rest:
            large.append(r.key)
            rest -= r["size"]
    cuts = minimax_cuts(groups.filter(~F.col("key").isin(large)) if large else groups, shards - len(large))

    blocks = max(1, min(MOST_BLOCKS, n // BLOCK_ROWS))
    rows = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        _shard(F.col("key"), large, cuts).alias("shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).alias("block"),
    )
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    inside = F.row_number().over(Window.partitionBy("block", "shard").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.repartition("block")
        .withColumn("inside", inside)
        .join(counts.select("shard", "block", before.alias("before")), ["block", "shard"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside") - 1).alias("slot"))
    )
