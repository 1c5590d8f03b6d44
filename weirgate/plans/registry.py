"""Registered queries: a function of (spark, folder), the survey rows it covers, and its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from weirgate.plans.derived import Tables, oracle
from weirgate.session import path_bytes, size_shuffles


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable:
    """Register a function of :class:`Tables` under its own name."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = function.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            size_shuffles(spark, path_bytes(spark, folder))
            return function(Tables(spark, folder))

        REGISTRY[name] = Query(name, tuple(covers.split()), run, oracle(sql) if sql else None)
        return function

    return register


def load() -> dict[str, Query]:
    """All registered queries."""
    importlib.import_module("weirgate.plans.queries")

    return REGISTRY
