"""Mixing sources to target weights by pivotal dependent rounding.

A source that is to give `target` words of its `size` words takes each of its documents
target / size times: the whole part always, the fractional part as a probability. Rounding is
dependent: two documents exchange probability mass, words for words, until one of them is 0 or 1,
so that the words taken stay at the target and each document keeps its own probability on average.

Documents of a source are dealt into chunks of bounded size. A chunk is rounded from its longest
document to its shortest and leaves at most one fractional document; these residuals are the
documents of the next level, until each source has one left. What rounding that one leaves over or short
is made up by other documents of the source's first chunk, the longest that fit first; of its two
sides it goes to the one that ends nearer to the target. Draws are hashes of document and level, so
reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.llm.common import WORD, unused
from modelwatch.session import materialise

CHUNK_ROWS, FAN_IN = 4_096, 512
EDGE = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    Sources by code point, null last, take the weights in turn. Targets split `share` of all words
    by weight and stop at `most` times the source's words; the excess is shared among the others by
    weight, again and again, until none is above. Ranks are made per range of sources, so the list
    of sources may be long.
    """
    order = F.col("source").asc_nulls_last()
    ranked = materialise(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    counts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # a row for each partition
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(order))).join(
        F.broadcast(counts.select("part", before.alias("before"))), "part"
    )
    weight = F.get(F.array(*map(F.lit, weights)), ((F.col("before") + F.col("rank") - 1) % len(weights)).cast("int"))
    ranked = materialise(
        ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("limit"))
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    unit, left, free = None, share * total, ranked.agg(F.sum("weight")).first()[0]
    while free:
        unit = left / free
        above = F.col("weight") * F.lit(unit) >= F.col("limit")
        used, open_weight = ranked.agg(
            F.sum(F.when(above, F.col("limit"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        now = share * total - (used or 0.0)
        if not open_weight or (open_weight == free and now == left):
            break
        left, free = now, open_weight
    target = F.least("limit", F.col("weight") * F.lit(float(unit or 0.0)))
    return ranked.select("source", "source_size", target.alias("target"))


def round_pivotal(sizes: list[int], parts: list[float], draws: list[float]) -> tuple[list[float], int | None]:
    """Rounded parts, and the index of the only one that may stay fractional.

    Two open documents a and b: mass moves one way until one is 0 or 1, with a probability that
    keeps both expectations. sizes * parts keeps its sum.
    """
    parts, a = list(parts), None
    for b, draw in enumerate(draws):
        if parts[b] <= EDGE or parts[b] >= 1 - EDGE:
            parts[b] = float(round(parts[b]))
            continue
        if a is None:
            a = b
            continue
        up = min((1 - parts[a]) * sizes[a], parts[b] * sizes[b])
        down = min(parts[a] * sizes[a], (1 - parts[b]) * sizes[b])
        move = up if draw * (up + down) < down else -down
        parts[a] += move / sizes[a]
        parts[b] -= move / sizes[b]
        still = [i for i in (a, b) if EDGE < parts[i] < 1 - EDGE]
        for i in (a, b):
            if i not in still:
                parts[i] = float(round(parts[i]))
        a = still[0] if still else None
    return parts, a


def _rounded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Round the chunks of a stream sorted by (source, chunk); a chunk may span batches."""
    kept = None
    keys = ["source", "chunk"]

    def chunks(frame):
        for _, chunk in frame.groupby(keys, dropna=False, sort=False):
            chunk = chunk.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
            parts, open_ = round_pivotal(chunk["size"].tolist(), chunk["part"].tolist(), chunk["draw"].tolist())
            is_open = [i == open_ for i in range(len(chunk))]
            yield chunk.assign(part=parts, is_open=is_open).drop(columns="draw")

    for frame in frames:
        frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
        if not len(frame):
            continue
        last = frame[keys].iloc[-1]
        same = (frame["chunk"] == last["chunk"]) & (
            frame["source"].isna() if pd.isna(last["source"]) else frame["source"] == last["source"]
        )
        kept = frame[same]
        yield from chunks(frame[~same])
    if kept is not None:
        yield from chunks(kept)


def settle_miss(sizes: list[int], parts: list[float], miss: float) -> tuple[list[float], float]:
    """(parts, words still missed): rounded parts after documents changed sides to take `miss` words more.

    The longest that fits goes first; in the end one more may, which takes a little too much. Equal
    documents change in the given order.
    """
    parts, side, left = list(parts), 0.0 if miss > 0 else 1.0, abs(miss)
    for i, size in sorted(enumerate(sizes), key=lambda x: -x[1]):
        if parts[i] == side and size <= left:
            parts[i], left = 1.0 - side, left - size
    last = min((abs(left - s) for s, p in zip(sizes, parts, strict=True) if p == side), default=left)
    if last < left:
        i = next(i for i, s in enumerate(sizes) if parts[i] == side and abs(left - s) == last)
        parts[i], left = 1.0 - side, left - sizes[i]
    return parts, left if miss > 0 else -left


def _settled(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows of one source's first chunk and its last open document, if there is one."""
    frame = frame.sort_values(["is_open", "size", "doc_id"], ascending=[True, False, True], kind="stable")
    sizes, parts = frame["size"].tolist(), frame["part"].tolist()
    if not frame["is_open"].iloc[-1]:
        return frame
    open_size, part = sizes.pop(), parts.pop()
    sides = [(*settle_miss(sizes, parts, (part - side) * open_size), side) for side in sorted((0.0, 1.0), key=lambda x: abs(x - part))]
    parts, _, side = min(sides, key=lambda x: abs(x[1]))
    return frame.assign(part=[*parts, side])


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row.

    size: words of the text (null: 0). copies: how often the mix takes the row, the whole part of
    target / source_size or one more, never above `most` rounded up. Rows that repeat id, source
    and size are rounded as one document and taken alike. Documents without words and sources
    without words have copies by the same rule, which cost nothing (whole part only). A null source
    is a source. An empty table gives an empty result.
    """
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = materialise(
        source_targets(sizes.drop("rows"), weights, share, most).join(
            sizes.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s")), "left"
        )
    ).drop("s")
    # One row a source: small beside the rows, but not bounded, so no hint; a hot source's side is split.
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    units = (
        rows.groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("copies_in"))
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("ratio", ratio)
        .withColumn("whole", F.floor(F.col("ratio") + EDGE))
        .withColumn("part", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")))
    )
    units = materialise(units)
    most_rows = targets.agg(F.max("rows")).first()[0] or 0
    hashed = F.xxhash64("doc_id", "size", F.lit(seed))
    chunk = F.pmod(hashed, F.ceil(F.col("rows") / CHUNK_ROWS))
    level = units.filter("size > 0 AND part > 0").select(
        "doc_id", "source", F.col("size").alias("own"), (F.col("size") * F.col("copies_in")).alias("size"), "part",
        chunk.alias("chunk"),
    )
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"doc_id {kind['doc_id']}, source {kind['source']}, own bigint, size bigint, part double, chunk bigint, is_open boolean"
    settled, depth, chunks = [], 0, -(-most_rows // CHUNK_ROWS)
    while True:
        draw = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed), F.lit(depth)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        level = materialise(
            level.withColumn("draw", draw)
            .repartition("source", "chunk")
            .sortWithinPartitions("source", "chunk")
            .mapInPandas(_rounded, schema)
        )
        settled.append(level.filter("NOT is_open"))
        rest = level.filter("is_open")
        if chunks <= 1:
            break
        depth, chunks = depth + 1, -(-chunks // FAN_IN)
        level = rest.select("doc_id", "source", "own", "size", "part", F.expr(f"chunk div {FAN_IN}").alias("chunk"))
    # One chunk of bounded size and one open document of each source.
    near = settled[0].filter("chunk = 0").unionByName(rest).groupBy("source").applyInPandas(_settled, schema)
    settled = [settled[0].filter("chunk <> 0"), *settled[1:], near]
    added = settled[0]
    for more in settled[1:]:
        added = added.unionByName(more)
    added = added.select(
        F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("own").alias("z"), F.col("part").alias("more")
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("d"))
        & F.col("source").eqNullSafe(F.col("s"))
        & (F.col("size") == F.col("z"))
    )
    return units.join(added, same, "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") + F.coalesce(F.col("more"), F.lit(0.0)).cast("long")).alias("copies"),
        F.explode(F.sequence(F.lit(1), F.col("copies_in"))).alias("_row"),
    ).drop("_row")


def mixed_documents(docs: DataFrame, decisions: DataFrame, id_col="doc_id", text_col="text", source_col="source"):
    """The rows of the mix: each row of `docs` as often as it is taken, with all its columns."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    own, name, copy = (unused(docs, c) for c in ("mix_size", "mix_row", "mix_copy"))
    taken = decisions.select(F.struct("doc_id", "source", "size", "copies").alias(name)).distinct()
    same = (
        F.col(id_col).eqNullSafe(F.col(f"{name}.doc_id"))
        & F.col(source_col).eqNullSafe(F.col(f"{name}.source"))
        & (F.col(own) == F.col(f"{name}.size"))
    )
    rows = docs.withColumn(own, size).join(taken, same).filter(f"{name}.copies > 0")
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"{name}.copies")))).select(*docs.columns)
