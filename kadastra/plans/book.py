"""A book of registered queries: each has a DataFrame builder and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from kadastra.sources.market import Market


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def register(build: Callable[[Market], object]):
            def run(spark, sf_dir):
                return build(Market(spark, sf_dir))

            self.queries[name] = run
            if sql is not None:
                self.oracle[name] = sql
            return build

        return register
