"""Row parity by digests: two tables are compared as bucket digests first, rows only where these differ.

A bucket's digest is a count and two sums of row hashes, so it does not depend on row order, partial
digests combine map-side, and at most `buckets` rows a task are shuffled. Equal tables end there. Of
tables that differ only the rows of differing buckets are shuffled and compared, exactly.

Equal digests of unlike buckets need two sums of 64-bit hashes to agree by chance.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.operators.checks import CheckFailed

BUCKETS = 16_384
#: Numbers of more than this many cells are compared as they are.
_MOST_CELLS = float(2**50)


def _told_apart(rows: DataFrame, names: Sequence[str]) -> list[Column]:
    """What is hashed of whole columns. A hash skips nulls, so that they are nulls is hashed as well."""
    out = []
    for name in names:
        column = F.col(f"`{name}`")
        if rows.schema[name].dataType.typeName() in ("array", "struct"):
            column = F.to_json(F.struct(column.alias("c")), {"ignoreNullFields": "false"})
        out += [column, column.isNull()]
    return out


def _digests(rows: DataFrame, place: Sequence[Column], content: Sequence[Column], buckets: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64(*place), F.lit(buckets)).cast("int")
    sums = [
        F.sum(F.xxhash64(F.lit(salt), *content).cast("decimal(20,0)")).alias(name)
        for salt, name in ((1, "_s1"), (2, "_s2"))
    ]
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("_n"), *sums)


def _differing(left: DataFrame, right: DataFrame) -> DataFrame | None:
    """The buckets whose digests differ, at most `buckets` rows; None if there are none."""
    sums = ["_n", "_s1", "_s2"]
    signed = left.unionAll(right.select("bucket", *[(-F.col(c)).alias(c) for c in sums]))
    total = signed.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in sums])
    odd = [tuple(r) for r in total.filter(" OR ".join(f"{c} <> 0" for c in sums)).select("bucket").collect()]
    return left.sparkSession.createDataFrame(odd, "bucket int") if odd else None


def _inside(rows: DataFrame, place: Sequence[Column], odd: DataFrame, buckets: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64(*place), F.lit(buckets)).cast("int")
    # At most `buckets` numbers.
    return rows.withColumn("_bucket", bucket).join(F.broadcast(odd), F.col("_bucket") == F.col("bucket"), "left_semi").drop("_bucket")


def unlike_rows(actual: DataFrame, expected: DataFrame, buckets: int = BUCKETS) -> DataFrame | None:
    """Rows that one table holds more often than the other, with `surplus` (> 0: more in `actual`).

    None if both hold the same rows equally often, which one scan of each and their digests show. Nulls are
    equal to each other, and so are NaN. Columns are those of `actual`; maps cannot be compared.
    """
    columns = actual.columns
    expected = expected.select(*columns)
    whole = [F.col(f"`{c}`") for c in columns]
    mine, theirs = _told_apart(actual, columns), _told_apart(expected, columns)
    odd = _differing(_digests(actual, mine, mine, buckets), _digests(expected, theirs, theirs, buckets))
    if odd is None:
        return None
    sides = [
        _inside(rows, content, odd, buckets).select(*whole, F.lit(sign).alias("surplus"))
        for rows, content, sign in ((actual, mine, 1), (expected, theirs, -1))
    ]
    return sides[0].unionAll(sides[1]).groupBy(*whole).agg(F.sum("surplus").alias("surplus")).filter("surplus <> 0")


def require_same_rows(actual: DataFrame, expected: DataFrame, what: str, buckets: int = BUCKETS) -> None:
    """Raise if a row of `expected` is missing from `actual`, and if one is too many."""
    unlike = unlike_rows(actual, expected, buckets)
    if unlike is None:
        return
    lost, odd = unlike.agg(
        F.coalesce(F.sum(F.greatest(-F.col("surplus"), F.lit(0))), F.lit(0)),
        F.coalesce(F.sum(F.greatest("surplus", F.lit(0))), F.lit(0)),
    ).first()
    if lost or odd:
        raise CheckFailed(f"{what}: {lost} rows are missing, {odd} are not as expected")


def _cell(value: Column, side: str, tolerance: float) -> list[Column]:
    """What is hashed of a number: equal for two sides only if row comparison finds them equal too.

    Numbers of one cell, half a tolerance wide, are near enough. Numbers that are not finite are unlike
    whatever the other side has, so the side is hashed with them.
    """
    number = value.cast("double")
    finite = F.abs(number) < F.lit(float("inf"))
    cells = number / F.lit(tolerance / 2) if tolerance > 0 else F.lit(_MOST_CELLS)
    near = F.when(F.abs(cells) < _MOST_CELLS, F.rint(cells))
    kind = F.when(number.isNull(), "none").when(~finite, F.lit(side)).when(near.isNull(), "whole").otherwise("cell")
    return [F.coalesce(near, number), kind]


def parity_offenders(
    actual: DataFrame,
    expected: DataFrame,
    key: str,
    columns: Mapping[str, str],
    tolerance: float = 1e-9,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Rows whose values differ by more than the absolute tolerance, or lack a partner on `key`.

    `columns` maps actual to expected column names. A null key has no partner. The rows of a key that
    repeats are paired in the order of their values.
    """
    a = actual.select(F.col(key), *[F.col(c).alias(f"actual_{c}") for c in columns])
    e = expected.select(F.col(key), *[F.col(x).alias(f"expected_{c}") for c, x in columns.items()])
    place = [F.col(key)]

    def content(side: str) -> list[Column]:
        cells = [x for c in columns for x in _cell(F.col(f"{side}_{c}"), side, tolerance)]
        return [F.col(key), F.when(F.col(key).isNull(), F.lit(side)).otherwise("key"), *cells]

    odd = _differing(_digests(a, place, content("actual"), buckets), _digests(e, place, content("expected"), buckets))
    if odd is None:
        a, e = a.limit(0), e.limit(0)
    else:
        a, e = _inside(a, place, odd, buckets), _inside(e, place, odd, buckets)

    def placed(rows: DataFrame, side: str, mark: str) -> DataFrame:
        cells = content(side)[2:]
        # Null keys have no partner: they need no place and must not gather in one task.
        spread = F.when(F.col(key).isNull(), F.xxhash64(*cells))
        order = Window.partitionBy(key, spread).orderBy(*cells)
        return rows.withColumn("_place", F.row_number().over(order)).withColumn(mark, F.lit(1))

    joined = placed(a, "actual", "_a").join(placed(e, "expected", "_e"), [key, "_place"], "full")
    off = F.col("_a").isNull() | F.col("_e").isNull()
    for c in columns:
        x, y = F.col(f"actual_{c}"), F.col(f"expected_{c}")
        off = off | F.coalesce(F.abs(x - y) > tolerance, x.isNull() != y.isNull())
    return joined.filter(off).drop("_a", "_e", "_place")
