"""SQL models with source references, and transforms run stage by stage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from weirgate.contracts import Contract, conform

_SOURCE = re.compile(r"\{\{\s*source\(\s*'([^']+)'\s*,\s*'([^']+)'\s*\)\s*\}\}")
_REF = re.compile(r"\{\{\s*ref\(\s*'([^']+)'\s*\)\s*\}\}")
_CONFIG = re.compile(r"\{\{\s*config\(.*?\)\s*\}\}", re.S)


def run_model(spark: SparkSession, text: str, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Result of a SQL model. ``source('schema', 'table')`` and ``ref('model')`` name the inputs, by
    ``schema.table`` or ``table``; Spark's own parser does the rest."""
    bound: dict[str, DataFrame] = {}

    def bind(name: str, fallback: str) -> str:
        df = inputs.get(name, inputs.get(fallback))
        if df is None:
            raise KeyError(f"model needs {name!r}")
        alias = re.sub(r"\W", "_", name)
        bound[alias] = df
        return "{" + alias + "}"

    body = _CONFIG.sub("", text).replace("{%", "{ %")
    body = _SOURCE.sub(lambda m: bind(f"{m[1]}.{m[2]}", m[2]), body)
    body = _REF.sub(lambda m: bind(m[1], m[1]), body)
    return spark.sql(body, **bound)


Stage = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def run_stages(
    inputs: Mapping[str, DataFrame],
    stages: Sequence[Stage],
    contracts: Mapping[str, Contract] | None = None,
    save: Callable[[str, DataFrame], DataFrame | None] | None = None,
) -> dict[str, DataFrame]:
    """Run stages in order; each sees all tables so far and adds its outputs.

    Outputs with a contract are cast to it. Without ``save`` everything stays one lazy plan per output.
    With it, an output is written before the next stage, which then reads what was written; an error
    stops the run, so nothing downstream of a failure is written.
    """
    tables = dict(inputs)
    for stage in stages:
        for name, df in stage(tables).items():
            if contracts and name in contracts:
                df = conform(df, contracts[name])
            if save:
                df = save(name, df) or df
            tables[name] = df
    return tables


def python_transform(
    function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], output: Contract
) -> Callable[[DataFrame], DataFrame]:
    """User code over Arrow batches as a DataFrame transform with a declared output."""
    return lambda df: df.mapInPandas(function, output.schema)
