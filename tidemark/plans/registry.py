"""A per-module query table filled by decorator."""

from __future__ import annotations


def new_registry():
    table: dict = {}

    def query(function):
        table[function.__name__] = function
        return function

    return table, query
