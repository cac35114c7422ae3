"""Registered queries over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from modelwatch.suite import (
    drift,
    evaluation,
    expressions,
    latency,
    quality,
    reconciliation,
    service,
    splits,
    storage,
    streams,
    training,
)

MODULES = (
    latency,
    service,
    expressions,
    quality,
    reconciliation,
    drift,
    evaluation,
    splits,
    storage,
    training,
    streams,
)


def all_queries() -> dict:
    merged: dict = {}
    for module in MODULES:
        for name, query in module.QUERIES.items():
            if name in merged:
                raise ValueError(f"query {name} is registered twice")
            merged[name] = query
    return merged


def all_oracles() -> dict[str, str]:
    merged: dict[str, str] = {}
    for module in MODULES:
        merged.update(module.ORACLES)
    return merged
