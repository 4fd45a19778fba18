"""Queries over the driver's tables, each with the SQL for its expected result where SQL can say it."""

from __future__ import annotations

import importlib

from pyspark import cloudpickle

MODULES = ("descriptive", "grouping", "regression", "panels", "figures")


def all_entries() -> list:
    cloudpickle.register_pickle_by_value(importlib.import_module(__name__))
    found = [e for m in MODULES for e in importlib.import_module(f"{__name__}.{m}").entries()]
    names = [e.name for e in found]
    if len(set(names)) < len(names):
        raise ValueError("query names must differ")
    return found
