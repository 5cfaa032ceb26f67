"""The engine's queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import plans  # noqa: F401  registers all queries
from .registry import ORACLES, QUERIES, Plan


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["official_quarter_value"](spark, sf_dir)


def queries() -> dict[str, Plan]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
