"""SQL a second engine runs on the same tables, one text per registered query."""

from __future__ import annotations

import importlib

from tidemark.plans import MODULES


def all_sql() -> dict[str, str]:
    merged: dict[str, str] = {}
    for name in MODULES:
        try:
            module = importlib.import_module(f"oracles.{name}")
        except ModuleNotFoundError as error:
            if error.name != f"oracles.{name}":
                raise
            continue
        merged.update(module.SQL)
    return merged
