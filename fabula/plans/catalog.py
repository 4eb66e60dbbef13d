"""All queries over the supplied tables, by name, with their SQL oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


#: The modules that register queries.
FAMILIES = ("style_plans", "voice_plans", "alert_plans", "story_plans", "text_plans", "model_plans", "temporal_plans", "editorial_plans", "story_text_plans")


def _registered() -> None:
    for name in FAMILIES:
        importlib.import_module(f"fabula.plans.{name}")


def queries() -> dict[str, Query]:
    _registered()
    return QUERIES


def oracles() -> dict[str, str]:
    _registered()
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical repetition over the documents."""
    return queries()["lexical_repetition"](spark, sf_dir)
