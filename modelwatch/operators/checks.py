"""Data-quality operators. Each returns the violating rows; the require_* forms raise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.columns import is_missing


class CheckFailed(ValueError):
    """A relation broke a rule it must keep."""


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row. Counts combine map-side, so a hot key is one row."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent (foreign key)."""
    return child.join(parent.select(key), key, "left_anti")


def outside_domain(df: DataFrame, column: str, domain: Sequence) -> DataFrame:
    """Rows whose value is null or not in the domain."""
    c = F.col(column)
    return df.filter(c.isNull() | ~c.isin(*domain))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (column_name, n_missing) per column; NaN counts as missing. One pass."""
    floating = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    counted = df.agg(*[F.count_if(is_missing(c, c in floating)).alias(c) for c in columns])
    return counted.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in columns]
            )
        )
    )


def row_count_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row with both counts and whether they agree."""
    counts = left.agg(F.count("*").alias("n_left")).crossJoin(
        F.broadcast(right.agg(F.count("*").alias("n_right")))
    )
    return counts.withColumn("equal", F.col("n_left") == F.col("n_right"))


def versions(df: DataFrame, column: str = "model_version") -> DataFrame:
    """Rows per model version, as text."""
    return df.groupBy(F.col(column).cast("string").alias(column)).agg(F.count("*").alias("n_rows"))


def single_version_report(df: DataFrame, champion: str, column: str = "model_version") -> DataFrame:
    """One row: how many versions scored the rows, the lowest one, and is it the champion."""
    per_version = versions(df, column)
    return per_version.agg(
        F.count("*").alias("n_versions"),
        F.min(column).alias("found_version"),
        F.coalesce(
            (F.count("*") == 1) & (F.min(column) == F.lit(str(champion))), F.lit(False)
        ).alias("passes"),
    )


def require_single_version(df: DataFrame, champion: str, column: str = "model_version") -> None:
    # A handful of rows at most are fetched, however many versions there are.
    found = [(r[0], r[1]) for r in versions(df, column).limit(10).collect()]
    if len(found) != 1:
        raise CheckFailed(f"expected one model version, found: {found}")
    if found[0][0] != str(champion):
        raise CheckFailed(f"rows were scored by version {found[0][0]}, the champion is {champion}")


def require_no_nulls(df: DataFrame, columns: Sequence[str]) -> None:
    broken = [tuple(r) for r in null_counts(df, columns).filter("n_missing > 0").collect()]
    if broken:
        raise CheckFailed(f"missing values: {broken}")


def require_same_count(left: DataFrame, right: DataFrame, names: Mapping[str, str] | None = None) -> None:
    row = row_count_difference(left, right).first()
    if not row["equal"]:
        raise CheckFailed(f"row counts differ: {row['n_left']} and {row['n_right']}")


def require_empty(df: DataFrame, message: str) -> None:
    sample = [tuple(r) for r in df.limit(5).collect()]
    if sample:
        raise CheckFailed(f"{message}: {sample}")
