"""Pairs of a query and its SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """``@r.query("name", "SELECT ...")`` registers a query; without SQL only its rows are checked."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
        def keep(f: Callable) -> Callable:
            if name in self.queries:
                raise ValueError(f"registered twice: {name}")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep
