"""Running totals and exact order statistics that never put one group into one task.

A window without a partition (or over one hot group) sorts everything in a single task.
Here the rows are cut into ranges of the ordering, each range is accumulated on its own,
and the per-range totals, one small row each, are turned into offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.functions.columns import sql_literal, sql_name
from modelwatch.session import materialise

BLOCK = "_block"

# Counted values of one group that one window may order: segments * SEGMENT_ROWS. More are ordered in ranges.
SEGMENTS, SEGMENT_ROWS = 64, 24
# Rank error of the sketch that places the cuts is rows / SKETCH_ACCURACY.
SKETCH_ACCURACY = 10_000


def order_blocks(df: DataFrame, by: Sequence[str], order: str, descending: bool = False) -> DataFrame:
    """Range-partition by (by, order) and pin each row's range number in `_block`.

    (by, order) must be unique, so that no key is larger than one row and the ranges
    balance. The result is materialised: range numbers must not change between reads.
    """
    key = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_first()
    ranged = df.repartitionByRange(*[F.col(b) for b in by], key)
    return materialise(ranged.withColumn(BLOCK, F.spark_partition_id()))


def sketch_cuts(df: DataFrame, value: str, pieces: int) -> list[float]:
    """At most pieces - 1 rising values that cut the rows of `df` into nearly equal pieces: one mergeable sketch.

    Nulls and NaN do not count. Rows that share a value make cuts fall together; each is returned once.
    """
    steps = [i / pieces for i in range(1, pieces)]
    if not steps:
        return []
    number = F.col(value).cast("double")
    usable = df.select(F.when(~F.isnan(number), number).alias("_v"))
    found = usable.agg(F.percentile_approx("_v", steps, max(SKETCH_ACCURACY, 20 * pieces))).first()[0]
    return sorted(set(found or []))


def cut_blocks(df: DataFrame, order: str, cuts: Sequence[float], descending: bool = False) -> DataFrame:
    """Add `_block`, the number of the piece between `cuts` that holds the row, first in the order first.

    The cuts are literals in the plan, so the number depends on the row alone and nothing has to be
    written to keep it. Nulls have a block of their own, at the end of a falling order, else at the start.
    """
    name = sql_name(order)

    def search(lo: int, hi: int) -> str:
        # Binary search; piece i holds the values above cut i - 1 up to cut i.
        if lo == hi:
            return str(len(cuts) - lo if descending else lo)
        mid = (lo + hi) // 2
        above, below = search(mid + 1, hi), search(lo, mid)
        return f"CASE WHEN {name} > {sql_literal(float(cuts[mid]))} THEN {above} ELSE {below} END"

    missing = len(cuts) + 1 if descending else -1
    return df.withColumn(BLOCK, F.expr(f"CASE WHEN {name} IS NULL THEN {missing} ELSE {search(0, len(cuts))} END"))


def running_totals(
    blocks: DataFrame,
    by: Sequence[str],
    order: str,
    measures: Sequence[str],
    descending: bool = False,
) -> DataFrame:
    """Add `cum_<m>`, the total of `m` up to and including the row, per group.

    `blocks` comes from `order_blocks` with the same arguments or, without groups, from `cut_blocks`,
    whose blocks make a single exchange of the rows: one row a block is all that is added up beside it.
    """
    key = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_first()
    inside = Window.partitionBy(*by, BLOCK).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)

    # One row per group and range: also without groups this window sees ranges, not rows.
    offsets = blocks.groupBy(*by, BLOCK).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures]).select(
        *[F.col(c).alias(f"_o_{c}") for c in [*by, BLOCK]],
        *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
    )
    same_block = F.col(BLOCK) == F.col(f"_o_{BLOCK}")
    for b in by:
        same_block = same_block & F.col(b).eqNullSafe(F.col(f"_o_{b}"))
    return (
        blocks.withColumns({f"_in_{m}": F.sum(m).over(inside) for m in measures})
        .join(offsets, same_block)
        .select(
            *blocks.columns,
            *[(F.col(f"_in_{m}") + F.col(f"_off_{m}")).alias(f"cum_{m}") for m in measures],
        )
    )


def _ranks(fraction: float, kind: str) -> tuple[str, str, str]:
    """SQL of the 1-based lower rank, upper rank and interpolation weight of a fraction of n rows."""
    if kind == "disc":
        rank = f"greatest(ceil({float(fraction)!r}D * n), 1L)"
        return rank, rank, "0D"
    position = f"(CAST(n - 1 AS DOUBLE) * {float(fraction)!r}D)"
    return f"floor({position}) + 1", f"least(floor({position}) + 2, n)", f"({position} - floor({position}))"


def _interpolate(lo: str, hi: str, t: str) -> str:
    # Taken from the nearer end, so that t = 0 and t = 1 give the sample values themselves.
    return f"CASE WHEN {t} < 0.5D THEN {lo} + ({hi} - {lo}) * {t} ELSE {hi} - ({hi} - {lo}) * (1D - {t}) END"


def exact_percentiles(
    df: DataFrame,
    value: str,
    fractions: Mapping[str, float],
    by: Sequence[str] = (),
    kind: str = "disc",
    segments: int = SEGMENTS,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Exact percentiles per group: columns `by`, `n` and one per entry of `fractions`.

    kind 'disc' returns the smallest value whose share of rows reaches the fraction,
    kind 'linear' interpolates between the two neighbouring values. Nulls do not count.

    Two scans, one way for every size. The first merges sketches of the raw values; their error
    is at most n / accuracy ranks, so two cuts a little farther apart hold a wanted rank between them.
    The second counts: rows between such cuts by value, all others by the segment that they lie in, with
    its smallest and largest value. Only these counts are shuffled. Ranks are read off their running
    totals; a group whose brackets may hold more than `segments` * SEGMENT_ROWS values is ordered in ranges.
    """
    by = list(by)
    if kind not in ("disc", "linear"):
        raise ValueError(f"unknown percentile kind {kind!r}")
    base = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    margin = 2.5 / accuracy
    ends = [(max(0.0, q - margin), min(1.0, q + margin)) for q in fractions.values()]
    steps = sorted({e for pair in ends for e in pair})
    sketch = base.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_v", steps, accuracy).alias("_cuts"))
    if by:
        sketch = materialise(sketch)
        most = sketch.agg(F.max("n")).first()[0] or 0
        placed, cuts = _join_group(base, sketch, by), [f"_cuts[{i}]" for i in range(len(steps))]
    else:
        most, found = sketch.first()
        cuts = [sql_literal(float(c)) for c in found or [0.0] * len(steps)]
        placed = base.withColumn("n", F.lit(most).cast("long"))
    between = " OR ".join(f"(_v >= {cuts[steps.index(lo)]} AND _v <= {cuts[steps.index(hi)]})" for lo, hi in ends)
    segment = " + ".join(f"CAST({c} < _v AS INT)" for c in cuts)
    counts = placed.selectExpr(
        *[sql_name(b) for b in by], "n", "_v", f"{segment} AS _seg", f"CASE WHEN {between} THEN _v END AS _kept"
    )
    counts = counts.groupBy(*by, "n", "_seg", "_kept").agg(
        F.count("*").alias("_cnt"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    if most * 2 * margin * len(ends) <= segments * SEGMENT_ROWS:
        so_far = Window.partitionBy(*by).orderBy("_hi").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("cum__cnt", F.sum("_cnt").over(so_far))
    else:
        ranked = running_totals(order_blocks(counts, by, "_hi"), by, "_hi", ["_cnt"])
    return _pick(ranked, fractions, by, kind)


def _join_group(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Inner join on group columns, in which nulls are equal; without any, `groups` is one row."""
    if not by:
        return rows.crossJoin(F.broadcast(groups))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_s_{b}"))
    return rows.join(groups.withColumnsRenamed({b: f"_s_{b}" for b in by}), same).drop(*[f"_s_{b}" for b in by])


def _pick(ranked: DataFrame, fractions: Mapping[str, float], by: list[str], kind: str) -> DataFrame:
    """Read the values at the wanted ranks off the running totals, in one aggregate."""
    aggregates, results = [], []
    for name, q in fractions.items():
        lower, upper, weight = _ranks(q, kind)
        for label, rank in (("lo", lower), ("hi", upper)):
            # Exactly one row holds the rank.
            holds = f"cum__cnt >= {rank} AND cum__cnt - _cnt < {rank}"
            at = (
                f"CASE WHEN _lo = _hi OR cum__cnt - _cnt + 1 = {rank} THEN _lo WHEN cum__cnt = {rank} THEN _hi "
                "ELSE CAST(raise_error('a rank lies outside the bracket of its sketch') AS DOUBLE) END"
            )
            aggregates.append(F.expr(f"max(CASE WHEN {holds} THEN {at} END) AS `_{label}_{name}`"))
        lo, hi = f"`_lo_{name}`", f"`_hi_{name}`"
        results.append(f"{lo if kind == 'disc' else _interpolate(lo, hi, weight)} AS `{name}`")
    grouped = ranked.groupBy(*by).agg(F.max("n").alias("n"), *aggregates)
    return grouped.filter(F.col("n").isNotNull()).selectExpr(*[sql_name(b) for b in by], "n", *results)
