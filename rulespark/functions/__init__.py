"""Library functions as Spark columns, one module for each of their areas.

An optional value is a null; a result that may be an error is a struct (ok,
err); a set is a sorted array without repeats; a map is a Spark map, read in key
order. Arguments are columns or Python values; names of columns are ``F.col``.
"""

from __future__ import annotations

import importlib

MODULES = ("std", "strings", "vecs", "sets", "maps", "groups", "fp", "json", "regex", "time", "net", "url", "uuid", "sql", "datalog", "allocate", "ovsdb", "logs")


def find(name: str):
    """The first function of this name."""
    for m in MODULES:
        f = getattr(importlib.import_module(f"rulespark.functions.{m}"), name, None)
        if callable(f):
            return f
    raise KeyError(name)
