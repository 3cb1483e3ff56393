"""Registered queries over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans.registry import QUERIES, SQL

MODULES = ("lookups", "changed", "mapped", "searched", "chunked", "reported", "collected", "assembled", "filtered", "runs", "inspected")


def _load() -> None:
    for name in MODULES:
        import_module(f"palimpsest.plans.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return QUERIES["source_changes"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
