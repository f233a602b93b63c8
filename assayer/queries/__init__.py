"""Every query of the core with its SQL, by module."""

from __future__ import annotations

import importlib

_MODULES = ("delivery", "options", "evaluation", "sets", "confidence", "gates", "functions")


def _all(attribute: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        found = getattr(importlib.import_module(f"{__name__}.{name}"), attribute)
        if twice := out.keys() & found.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= found
    return out


def core_queries() -> dict:
    return _all("QUERIES")


def core_sql() -> dict:
    return _all("SQL")
