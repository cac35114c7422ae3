"""Scalar expressions: parsing, safe ratios, dates, bands. All stay inside codegen."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number syntax a text cell may have to be read as a number (fixed value).
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c: Column | str, floating: bool = True) -> Column:
    """Null, or NaN for floating point columns: both count as missing."""
    c = as_col(c)
    return c.isNull() | F.isnan(c) if floating else c.isNull()


def nan_to_null(c: Column | str) -> Column:
    return F.nanvl(as_col(c), F.lit(None).cast("double"))


def number_or_null(c: Column | str) -> Column:
    """Text to double; anything that is not a plain number becomes null.

    The pattern check keeps type suffixes such as '1d', which a bare cast accepts, out.
    """
    text = as_col(c).cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def number_sql(text: str) -> str:
    """`number_or_null` of a SQL text expression, as SQL."""
    return f"CASE WHEN {text} RLIKE {sql_literal(NUMBER_PATTERN)} THEN try_cast(trim({text}) AS DOUBLE) END"


def number_or_zero(c: Column | str) -> Column:
    return F.coalesce(number_or_null(c), F.lit(0.0))


def blank_to_null(c: Column | str) -> Column:
    """Blank text is null; other text must be a plain number (a bad cell is an error).

    The pattern check keeps type suffixes such as '1d' out.
    """
    text = as_col(c).cast("string")
    bad = F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")
    number = F.when(text.rlike(NUMBER_PATTERN), F.trim(text).cast("double")).otherwise(bad)
    return F.when(F.trim(text) != "", number)


def map_values(c: Column | str, mapping: Mapping) -> Column:
    """Replace by lookup; unmapped values become null, to be caught by a null check."""
    c = as_col(c)
    pairs = list(mapping.items())
    return reduce(
        lambda acc, kv: acc.when(c == F.lit(kv[0]), F.lit(kv[1])),
        pairs[1:],
        F.when(c == F.lit(pairs[0][0]), F.lit(pairs[0][1])),
    )


def decide(score: Column | str, threshold, positive: str, negative: str) -> Column:
    """The positive answer at or above the threshold; no answer without a score (null or NaN)."""
    score = as_col(score)
    answer = F.when(score >= threshold, F.lit(positive)).otherwise(F.lit(negative))
    return F.when(score.isNotNull() & ~F.isnan(score), answer)


def default_time(c: Column | str, now: Column | None = None) -> Column:
    return F.coalesce(as_col(c), now if now is not None else F.current_timestamp())


def default_id(c: Column | str, record: Sequence[Column | str], position: Column | None = None) -> Column:
    """Missing ids get a digest of the record and of its position in the source.

    Equal records at different positions are different requests. Without a position the id
    depends on the record alone.
    """
    parts = [F.to_json(F.struct(*[as_col(r) for r in record]))]
    if position is not None:
        parts.append(position.cast("string"))
    return F.coalesce(as_col(c), F.sha2(F.concat_ws("@", *parts), 256))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double, null when b is zero."""
    return as_col(a).cast("double") / F.nullif(as_col(b).cast("double"), F.lit(0.0))


def percent(a: Column | str, b: Column | str) -> Column:
    return F.lit(100.0) * ratio(a, b)


def round_half_up(c: Column | str, places: int) -> Column:
    """Round half away from zero on the decimal value, as a double."""
    return F.round(as_col(c), places)


def share(condition: Column) -> Column:
    """Mean of a condition over rows, as a double aggregate."""
    return F.avg(condition.cast("double"))


def day_of(ts: Column | str) -> Column:
    return F.to_date(as_col(ts))


def week_of(ts: Column | str) -> Column:
    """Monday of the week."""
    day = day_of(ts)
    return F.date_sub(day, F.weekday(day))


def midnight(day: Column | str) -> Column:
    return as_col(day).cast("timestamp_ntz")


def plus_days(ts: Column | str, days: Column | str | int) -> Column:
    n = F.lit(days) if isinstance(days, int) else as_col(days)
    return as_col(ts) + F.make_dt_interval(n.cast("int"))


def whole_days(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(as_col(later), as_col(earlier)).cast("bigint")


def fractional_days(later: Column | str, earlier: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", as_col(earlier), as_col(later)) / F.lit(86400e6)


def status_class(status: Column | str) -> Column:
    """Hundreds digit of a status code: 4 for client errors, 5 for server errors."""
    return F.floor(as_col(status) / 100).cast("int")


def sql_name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"
    return str(value)


# Long generated expressions are written as SQL text: one parse on the JVM side instead of
# a bridge call per operator, and the same compiled code.


def right_closed_bin(value: str, inner_edges: Sequence[float]) -> str:
    """SQL: index of the interval (e[i-1], e[i]] holding the value; the outer bins are open-ended.

    `value` is SQL text. The edges are literals, so this is a comparison chain in codegen.
    """
    if not inner_edges:
        return "0"
    whens = " ".join(f"WHEN {value} <= {sql_literal(float(e))} THEN {i}" for i, e in enumerate(inner_edges))
    return f"CASE {whens} ELSE {len(inner_edges)} END"


def level_index(value: str, levels: Sequence, missing: int, other: int) -> str:
    """SQL: position in a fixed domain; null and unknown levels get their own codes."""
    whens = " ".join(f"WHEN {value} = {sql_literal(level)} THEN {i}" for i, level in enumerate(levels))
    return f"CASE WHEN {value} IS NULL THEN {missing} {whens} ELSE {other} END"


def band(column: str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bands, the lowest edge included; values outside are null."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per band is needed")
    c = sql_name(column)
    whens = " ".join(
        f"WHEN {c} <= {sql_literal(edge)} THEN {sql_literal(label)}" for edge, label in zip(edges[1:], labels)
    )
    return F.expr(f"CASE WHEN {c} < {sql_literal(edges[0])} THEN NULL {whens} END")


def unpivot_columns(columns: Mapping[str, Column | str], name: str, value: str) -> Column:
    """One generator turning columns into (name, value) rows, in one narrow step."""
    return F.inline(
        F.array(*[F.struct(F.lit(k).alias(name), as_col(v).alias(value)) for k, v in columns.items()])
    )
