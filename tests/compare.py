"""Run a query on Spark and its SQL twin on DuckDB and compare rows without order."""

from __future__ import annotations

import math
import os
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if Path(path).is_dir() else ''}')")
    rel = con.sql(sql)
    return list(rel.columns), rel.fetchall()


def plain(x):  # noqa: ANN001, ANN201
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def canonical(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark, plan, sql: str, sf_dir: str) -> str:  # noqa: ANN001
    """Empty when Spark and DuckDB agree."""
    df = plan(spark, sf_dir)
    cols, rows = oracle_rows(sql, sf_dir)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    a, b = canonical(df.columns, df.collect()), canonical(cols, rows)
    if not b:
        return "no rows"
    return "" if a == b else f"{sum(a.values())} and {sum(b.values())} rows; only Spark {list((a - b).items())[:2]}; only SQL {list((b - a).items())[:2]}"
