"""Registered queries: each maps (spark, sf_dir) to a DataFrame over the given tables."""

from __future__ import annotations

import importlib

MODULES = (
    "sources", "cleaning", "joins", "aggregates", "windows", "rankings",
    "portfolios", "scalars", "universe", "models", "audits",
)


def registered() -> dict:
    merged: dict = {}
    for name in MODULES:
        try:
            module = importlib.import_module(f"tidemark.plans.{name}")
        except ModuleNotFoundError as error:
            if error.name != f"tidemark.plans.{name}":
                raise
            continue
        clash = merged.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        merged.update(module.QUERIES)
    return merged
