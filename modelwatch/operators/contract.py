"""Validation of incoming feature records: type, presence, domain, range, cross-field rules.

Everything is one narrow pass. A record is never dropped: it ends up valid or in quarantine
with the names of all offending fields.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.columns import number_sql, sql_literal, sql_name
from modelwatch.schemas import CATEGORICAL_VALUES

ERRORS = "errors"
UNREADABLE = "_record"
ZONE_PATTERN = r"(Z|[+-]\d{2}:?\d{2})$"


@dataclass(frozen=True)
class FieldRule:
    """What one field of a record must look like."""

    name: str
    kind: str  # 'string', 'int', 'float' or 'time'
    domain: tuple = ()
    minimum: float | None = None
    nullable: bool = False  # an explicit null is accepted
    optional: bool = False  # the key may be absent


@dataclass(frozen=True)
class CrossRule:
    """A condition over several fields, reported under one field's name."""

    name: str
    broken_when: str


@dataclass(frozen=True)
class Contract:
    fields: tuple[FieldRule, ...]
    cross: tuple[CrossRule, ...] = ()

    def rule(self, name: str) -> FieldRule:
        return next(f for f in self.fields if f.name == name)


TELCO_CONTRACT = Contract(
    fields=(
        FieldRule("customer_id", "string"),
        FieldRule("SeniorCitizen", "int", domain=(0, 1)),
        FieldRule("tenure", "int", minimum=0),
        FieldRule("MonthlyCharges", "float", minimum=0),
        FieldRule("TotalCharges", "float", minimum=0, nullable=True),
        *[FieldRule(name, "string", domain=tuple(levels)) for name, levels in CATEGORICAL_VALUES.items()],
        FieldRule("event_time", "time", nullable=True, optional=True),
    ),
    cross=(CrossRule("TotalCharges", "TotalCharges IS NULL AND tenure <> 0"),),
)


def parse_records(df: DataFrame, raw: str, contract: Contract, keep: Sequence[str] = ()) -> DataFrame:
    """Typed columns from JSON text, plus `_malformed`: fields absent or of the wrong type.

    The text is parsed once into a variant, which keeps "absent" and "null" apart and knows
    the JSON type of every value.
    """
    kept = [sql_name(k) for k in keep]
    parsed = df.selectExpr(*kept, f"{sql_name(raw)} AS _raw", f"try_parse_json({sql_name(raw)}) AS _v")
    paths = [sql_literal(f"$.{rule.name}") for rule in contract.fields]
    nodes = parsed.selectExpr(
        *kept,
        "_raw",
        "_v IS NULL AS _broken",
        *[f"schema_of_variant(try_variant_get(_v, {p}, 'variant')) AS _t{i}" for i, p in enumerate(paths)],
        *[f"try_variant_get(_v, {p}, 'string') AS _x{i}" for i, p in enumerate(paths)],
    )
    # A generator of one row: a filter on the result is not pushed below it, which would
    # repeat the parsing for every field the filter looks at.
    values = ", ".join(
        f"{_typed(rule, f'_x{i}', f'_t{i}')} AS {sql_name(rule.name)}" for i, rule in enumerate(contract.fields)
    )
    typed = nodes.selectExpr(
        *nodes.columns, f"inline(array(struct({values})))"
    )
    bad = []
    for i, rule in enumerate(contract.fields):
        # No type: the key is absent. Type VOID: an explicit null.
        wrong = [f"(_t{i} <> 'VOID' AND {sql_name(rule.name)} IS NULL)"]
        if not rule.optional:
            wrong.append(f"_t{i} IS NULL")
        if not rule.nullable:
            wrong.append(f"_t{i} = 'VOID'")
        bad.append(_named(wrong, rule.name))
    return typed.selectExpr(
        *kept,
        "_raw",
        *[sql_name(rule.name) for rule in contract.fields],
        f"CASE WHEN _broken THEN array('{UNREADABLE}') ELSE {_names(bad)} END AS _malformed",
    )


def _names(found: Sequence[str]) -> str:
    """SQL: the distinct names without the nulls. No lambda, so it stays in compiled code."""
    return f"array_except(array({', '.join(found)}), array(CAST(NULL AS STRING)))"


def _named(conditions: Sequence[str], name: str) -> str:
    """SQL: the name if any condition holds, else null."""
    return f"CASE WHEN coalesce({' OR '.join(conditions)}, false) THEN {sql_literal(name)} END"


def _typed(rule: FieldRule, text: str, json_type: str) -> str:
    is_number = f"{json_type} RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'"
    if rule.kind == "string":
        return f"CASE WHEN {json_type} = 'STRING' THEN {text} END"
    if rule.kind == "time":
        zoned = f"{json_type} = 'STRING' AND {text} RLIKE {sql_literal(ZONE_PATTERN)}"
        return f"CASE WHEN {zoned} THEN try_to_timestamp({text}) END"
    number = f"CASE WHEN {json_type} = 'STRING' OR {is_number} THEN {number_sql(text)} END"
    if rule.kind == "float":
        return number
    # Whole numbers only; members of an enumeration must be numbers, not text.
    accepted = f"({number}) = floor({number})" + (f" AND {is_number}" if rule.domain else "")
    return f"CASE WHEN {accepted} THEN CAST({number} AS INT) END"


def validate(df: DataFrame, contract: Contract, now: Column | None = None, slack_minutes: int = 10) -> DataFrame:
    """Add `errors`, the offending fields of each record in contract order (empty = valid).

    Works on typed frames as well as on the output of `parse_records`. `now` is injected so
    that a re-run judges the records alike.
    """
    moment = now if now is not None else F.current_timestamp()
    found = []
    for rule in contract.fields:
        c = sql_name(rule.name)
        if rule.name not in df.columns:
            if not rule.optional:
                found.append(sql_literal(rule.name))
            continue
        bad = ["false"] if rule.nullable or rule.optional else [f"{c} IS NULL"]
        if rule.domain:
            bad.append(f"{c} NOT IN ({', '.join(sql_literal(v) for v in rule.domain)})")
        if rule.minimum is not None:
            bad.append(f"{c} < {sql_literal(rule.minimum)}")
        if rule.kind == "float":
            # NaN compares above every number, so it is named explicitly.
            bad.append(f"isnan({c})")
        if rule.kind == "time":
            bad.append(f"{c} > _latest")
        found.append(_named(bad, rule.name))
    found += [_named([f"({cross.broken_when})"], cross.name) for cross in contract.cross]
    errors = _names(found)
    if "_malformed" in df.columns:
        # An unreadable record is reported as such, not as all its fields.
        errors = (
            f"CASE WHEN array_contains(_malformed, '{UNREADABLE}') THEN _malformed "
            f"ELSE array_distinct(concat(_malformed, {errors})) END"
        )
    return (
        df.withColumn("_latest", moment + F.make_dt_interval(mins=F.lit(slack_minutes)))
        .withColumn(ERRORS, F.expr(errors))
        .drop("_latest")
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records, quarantine with the reasons)."""
    valid = checked.filter(F.size(ERRORS) == 0).drop(ERRORS, "_malformed", "_raw")
    return valid, checked.filter(F.size(ERRORS) > 0)


def violations(checked: DataFrame) -> DataFrame:
    """Rows per offending field."""
    return (
        checked.select(F.explode(ERRORS).alias("field"))
        .groupBy("field")
        .agg(F.count("*").alias("n_records"))
    )
