"""Name -> (DataFrame builder, equivalent SQL) for every registered query."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

#: Modules that register the property-market queries; each has QUERIES and ORACLE dictionaries.
PLAN_MODULES: tuple[str, ...] = ("kadastra.plans.dashboards", "kadastra.plans.relational", "kadastra.plans.domain", "kadastra.plans.streams", "kadastra.plans.more", "kadastra.plans.extra", "kadastra.plans.scores", "kadastra.plans.links", "kadastra.plans.forecasts", "kadastra.plans.selections", "kadastra.plans.completed", "kadastra.plans.pricing", "kadastra.plans.rentals")


def load(modules: tuple[str, ...] = PLAN_MODULES) -> tuple[dict[str, Builder], dict[str, str]]:
    queries: dict[str, Builder] = {}
    oracle: dict[str, str] = {}
    for name in modules:
        module = importlib.import_module(name)
        clash = queries.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"{name} registers {sorted(clash)} a second time")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
