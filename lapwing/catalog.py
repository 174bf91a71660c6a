"""Registry of the library's queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .plans import base

MODULES = ("cleaning", "hourly", "daily", "pit", "scoring", "retrieval", "learning", "live", "files", "sensors", "tools")
for _name in MODULES:
    import_module(f"lapwing.plans.{_name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["w08_lookback_and_baseline"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
