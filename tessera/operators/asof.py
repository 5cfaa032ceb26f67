"""Point-in-time selection: latest row per key, as-of joins, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_at(published: Column, cutoff: Column, available: Column | None = None) -> Column:
    """True for what was known at the cutoff: availability before publication; an undated row passes."""
    when = F.coalesce(available, published) if available is not None else published
    return when.isNull() | (when <= cutoff)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], value: list[str] | None = None) -> DataFrame:
    """The row of each key that is last in order, by an aggregation with a map-side combine (no sort, no window)."""
    cols = value or [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in cols])


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, known: str, tie: str, values: list[str], most_days: int | None = None) -> DataFrame:
    """Each left row with the last right row of its keys whose `known` is not after the left row's `at`.

    Both sides are laid in one order per key and the last right row is carried forward,
    so the cost is one shuffle and one sort, whatever the number of matches. With
    most_days, an older row is no match. Ties on `known` go to the larger `tie`.
    """
    packed = F.struct(F.col(known).alias("_known"), *[F.col(c) for c in values])
    blank = F.lit(None)
    rows = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[tie]).alias("_tie"), F.struct(*left.columns).alias("_left"))
    facts = right.where(F.col(known).isNotNull()).select(*keys, F.col(known).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), packed.alias("_fact"))
    both = rows.withColumn("_fact", blank.cast(facts.schema["_fact"].dataType)).unionByName(facts.withColumn("_left", blank.cast(rows.schema["_left"].dataType)))
    order = Window.partitionBy(*keys).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_fact", F.last("_fact", ignorenulls=True).over(order)).where("_side = 1")
    if most_days is not None:
        found = found.withColumn("_fact", F.when(F.col("_fact._known") >= F.col("_at") - F.expr(f"interval {most_days} days"), F.col("_fact")))
    return found.select("_left.*", F.col("_fact._known").alias(f"{known}_found"), *[F.col(f"_fact.{c}").alias(c) for c in values])


def versioned(df: DataFrame, key: str, order: list[str], identity: str) -> DataFrame:
    """Version numbers from 1 per key, and the identity of the version that each row supersedes."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("version", F.row_number().over(w)).withColumn("supersedes", F.lag(identity).over(w))


def next_version(resources: DataFrame, versions: DataFrame, key: str, version: str) -> DataFrame:
    """max + 1 per resource, 1 where there is none."""
    top = versions.groupBy(key).agg(F.max(version).alias("_top"))
    return resources.join(top, key, "left").withColumn("next_version", F.coalesce("_top", F.lit(0)) + 1).drop("_top")


def single_period(df: DataFrame, keys: list[str], year: str, period: str, amount: str) -> DataFrame:
    """Difference cumulative amounts into single periods; status says where the period before is missing.

    The first period is its own single value. Only the row of the period just before, in
    the same year, is subtracted.
    """
    w = Window.partitionBy(*keys, year).orderBy(period)
    before, last = F.lag(amount).over(w), F.lag(period).over(w)
    out = df.withColumn("_before", F.when(last == F.col(period) - 1, before))
    value = F.when(F.col(period) == 1, F.col(amount)).otherwise(F.col(amount) - F.col("_before"))
    status = F.when(value.isNotNull(), "validated").otherwise("report_unavailable")
    return out.withColumn("single_value", value).withColumn("status", status).drop("_before")
