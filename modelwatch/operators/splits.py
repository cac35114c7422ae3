"""Exact stratified multi-way split, reproducible from the ids alone.

Rows are ordered by a digest of (id, seed). A digest spreads evenly, so its first four
hex digits cut each class into 65,536 equal slices; the slice counts say in which slice
each quota ends, and only those few slices are sorted. The rest of the data is compared
with the resulting cut points in a narrow pass: nothing but counts is shuffled. Quotas of
few classes are shared out on the driver, of more than `driver_classes` in a table.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.operators.ordering import order_blocks, running_totals
from modelwatch.session import materialise

SLICE_DIGITS = 4

# Share held out at each step, of the rows still left.
DEFAULT_STEPS = (
    ("eval_frozen", 0.125),
    ("test", 0.125 / (1 - 0.125)),
    ("val", 0.15 / (1 - 0.25)),
)


def order_digest(id_column: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")))


def allot(total: int, sizes: Mapping[str, int]) -> dict[str, int]:
    """Share `total` among the classes in proportion, largest remainders first."""
    n = sum(sizes.values())
    exact = {k: total * v / n for k, v in sizes.items()}
    got = {k: math.floor(x) for k, x in exact.items()}
    by_remainder = sorted(sizes, key=lambda k: (-(exact[k] - got[k]), str(k)))
    for k in by_remainder[: total - sum(got.values())]:
        got[k] += 1
    return got


def quotas(
    sizes: Mapping[str, int], steps: Sequence[tuple[str, float]], remainder: str
) -> dict[str, dict[str, int]]:
    """Rows per split and class: each step takes ceil(fraction * rows left)."""
    left = dict(sizes)
    result: dict[str, dict[str, int]] = {}
    for name, fraction in steps:
        take = allot(math.ceil(fraction * sum(left.values())), left)
        result[name] = take
        left = {k: left[k] - take[k] for k in left}
    result[remainder] = left
    return result


def end_ranks(sizes: Mapping[str, int], steps: Sequence[tuple[str, float]]) -> list[tuple[str, int, int]]:
    """(class, step, running end rank of that split in the class); the remainder has no end."""
    plan = quotas(sizes, steps, "")
    ends = []
    for k in sizes:
        end = 0
        for i, (name, _) in enumerate(steps):
            end += plan[name][k]
            ends.append((k, i, end))
    return ends


def end_rank_table(sizes: DataFrame, steps: Sequence[tuple[str, float]]) -> DataFrame:
    """`end_ranks` as a table (_class, step, end_rank), for any number of rows (_class, n).

    The classes are ranked by remainder in ranges, so no task sees them all; the driver gets two
    sums a step.
    """
    rows = sizes.agg(F.sum("n")).first()[0] or 0
    left = sizes.select("_class", F.col("n").alias("_left"), F.lit(0).cast("bigint").alias("_end"))
    ends = []
    for i, (_, fraction) in enumerate(steps):
        total = math.ceil(fraction * rows)
        exact = F.lit(float(total)) * F.col("_left").cast("double") / F.lit(float(rows or 1))
        parts = left.withColumn("_exact", exact).withColumn("_whole", F.floor("_exact"))
        keyed = parts.select(
            "_class", "_left", "_end", "_whole", F.lit(1).alias("_one"),
            F.struct((F.col("_whole") - F.col("_exact")).alias("rest"), "_class").alias("_key"),
        )
        blocks = order_blocks(keyed, [], "_key")
        spare = total - (blocks.agg(F.sum("_whole")).first()[0] or 0)
        ranked = running_totals(blocks, [], "_key", ["_one"])
        take = F.col("_whole") + (F.col("cum__one") <= spare).cast("bigint")
        left = ranked.select("_class", (F.col("_left") - take).alias("_left"), (F.col("_end") + take).alias("_end"))
        ends.append(left.select("_class", F.lit(i).alias("step"), F.col("_end").alias("end_rank")))
        rows -= total
    return reduce(DataFrame.unionAll, ends)


def _as_is(df: DataFrame) -> DataFrame:
    return df


def stratified_split(
    df: DataFrame,
    id_column: str,
    target: str,
    excluded: Column | None = None,
    steps: Sequence[tuple[str, float]] = DEFAULT_STEPS,
    remainder: str = "train",
    seed: int = 42,
    driver_classes: int = 10_000,
) -> DataFrame:
    """Manifest (id, split); rows meeting `excluded` get the split 'excluded'.

    Up to `driver_classes` classes are shared out on the driver and broadcast; more stay in tables, with
    the same result, and are joined as adaptive execution sees fit.
    """
    digest = order_digest(id_column, seed)
    is_out = F.coalesce(excluded, F.lit(False)) if excluded is not None else F.lit(False)
    keyed = df.select(
        F.col(id_column),
        F.col(target).cast("string").alias("_class"),
        is_out.alias("_out"),
        digest.alias("_h"),
        F.substring(digest, 1, SLICE_DIGITS).alias("_slice"),
    )
    population = keyed.filter(~F.col("_out"))

    # A class has 65,536 slices at most.
    slices = materialise(population.groupBy("_class", "_slice").agg(F.count("*").alias("cnt")))
    per_class = slices.groupBy("_class").agg(F.sum("cnt").alias("n"))
    first = {r["_class"]: r["n"] for r in per_class.limit(driver_classes + 1).collect()}
    few = len(first) <= driver_classes
    if None in first or (not few and not slices.filter("_class IS NULL").isEmpty()):
        raise ValueError(f"{target} must not be null")
    if few:
        small = F.broadcast
        cuts = df.sparkSession.createDataFrame(end_ranks(first, steps), "_class string, step int, end_rank bigint")
    else:
        small = _as_is
        cuts = end_rank_table(materialise(per_class), steps)
    before = Window.partitionBy("_class").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    located = (
        slices.withColumn("_upto", F.sum("cnt").over(before))
        .join(small(cuts), "_class")
        .filter((F.col("_upto") >= F.col("end_rank")) & (F.col("_upto") - F.col("cnt") < F.col("end_rank")))
        .select("_class", "_slice", "step", (F.col("end_rank") - F.col("_upto") + F.col("cnt")).alias("_rank"))
    )
    # Sort only the slices that hold a cut.
    in_slice = Window.partitionBy("_class", "_slice").orderBy("_h", id_column)
    edge = (
        population.join(small(located.select("_class", "_slice").distinct()), ["_class", "_slice"])
        .withColumn("_rn", F.row_number().over(in_slice))
        .join(small(located), ["_class", "_slice"])
        .filter(F.col("_rn") == F.col("_rank"))
        .select("_class", "step", F.struct("_h", id_column).alias("cut"))
    )
    per_class_cuts = edge.groupBy("_class").agg(
        *[F.max(F.when(F.col("step") == i, F.col("cut"))).alias(f"_cut{i}") for i in range(len(steps))]
    )
    here = F.struct("_h", id_column)
    split = F.when(F.col("_out"), F.lit("excluded"))
    for i, (name, _) in enumerate(steps):
        # A split without rows in a class has no cut row; nothing is at or below it.
        split = split.when(here <= F.col(f"_cut{i}"), F.lit(name))
    return keyed.join(small(per_class_cuts), "_class", "left").select(
        id_column, split.otherwise(F.lit(remainder)).alias("split")
    )


def split_summary(manifest: DataFrame, df: DataFrame, id_column: str, positive: Column) -> DataFrame:
    """Rows and positive rate (percent) per split."""
    joined = manifest.join(df.select(id_column, positive.alias("_y")), id_column)
    return joined.groupBy("split").agg(
        F.count("*").alias("n"), (F.lit(100.0) * F.avg(F.col("_y").cast("double"))).alias("positive_pct")
    )
