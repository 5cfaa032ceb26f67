"""Registration of queries: name -> plan, and name -> DuckDB SQL where it can be expressed."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its name, with its SQL twin."""

    def add(plan: Plan) -> Plan:
        key = name or plan.__name__
        QUERIES[key] = plan
        if sql:
            ORACLES[key] = sql
        return plan

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived input that Spark and the twin spell alike: tables stand as {name}."""
    names = {name for _, name, _, _ in Formatter().parse(sql) if name}
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in names})


def views(**sql: str) -> str:
    """The same inputs as the twin's leading common tables."""
    return ", ".join(f"{name} as ({Formatter().vformat(s, (), _Names())})" for name, s in sql.items())


class _Names(dict):
    def __missing__(self, name: str) -> str:
        return name
