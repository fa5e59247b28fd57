"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = [
    "tables", "features", "activity", "hopfeatures", "aggregation", "ledger", "spectra", "scores", "modelling",
    "build", "invariants",
]


def collect() -> tuple[dict[str, Callable], dict[str, str]]:
    queries: dict[str, Callable] = {}
    oracles: dict[str, str] = {}
    for name in MODULES:
        module = import_module(f"ringsight.registry.{name}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
