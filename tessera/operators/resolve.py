"""Rule-based row resolution with a three-valued outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cardinality_status(count: Column) -> Column:
    """0, 1 or more matches: not_found, resolved, ambiguous."""
    return F.when(count == 0, "not_found").when(count == 1, "resolved").otherwise("ambiguous")


def resolve_by_priority(targets: DataFrame, rows: DataFrame, keys: list[str], by_id: Column, by_name: Column, identity: str, value: str) -> DataFrame:
    """Match rows to targets by id; by name only where no id matches, even an ambiguous one.

    A value is returned only for exactly one match: an ambiguous target picks no row.
    """
    matched = rows.withColumn("_rank", F.when(by_id, 1).when(by_name, 2)).where("_rank is not null")
    counted = matched.groupBy(*keys).agg(
        F.count_if(F.col("_rank") == 1).alias("_n1"), F.count_if(F.col("_rank") == 2).alias("_n2"),
        F.min_by(F.struct(identity, value), F.struct("_rank", identity)).alias("_one"),
    )
    n = F.when(F.col("_n1") > 0, F.col("_n1")).otherwise(F.coalesce("_n2", F.lit(0)))
    out = targets.join(counted, keys, "left").withColumn("matches", n)
    one = F.col("matches") == 1
    return out.select(
        *targets.columns, F.col("matches").cast("long").alias("matches"), cardinality_status(F.col("matches")).alias("status"),
        F.when(F.col("_n1") > 0, "id").when(F.col("_n2") > 0, "name").alias("matched_by"), F.when(one, F.col(f"_one.{identity}")).alias(identity), F.when(one, F.col(f"_one.{value}")).alias(value),
    )
