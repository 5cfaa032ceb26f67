"""Relational building blocks: membership joins, keyed merges, search, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only(value: Column) -> Column:
    """The value where a group has exactly one distinct value, else null: no distinct aggregation is needed."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def member_join(lists: DataFrame, array: str, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is an element of the list's array; each element matches once."""
    return lists.withColumn("_id", F.explode(F.array_distinct(array))).join(rows, F.col("_id") == F.col(key)).drop("_id", array)


def covered(df: DataFrame, want: str, seen: str) -> DataFrame:
    """Adds missing (sorted), covered and complete."""
    return df.withColumn("missing", F.array_sort(F.array_except(want, seen))).withColumn("covered", F.size(F.array_intersect(want, seen)).cast("long")).withColumn("complete", F.size("missing") == 0)


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def contains_literal(c: Column, text: str) -> Column:
    """Case-insensitive containment of a literal text; wildcards in it mean themselves."""
    return F.contains(F.lower(c), F.lit(text.lower()))


def search(df: DataFrame, c: str, terms: list[str], order: list[str], most: int) -> DataFrame:
    """Rows that contain the last term, the first exact hits (0), then prefixes (1), then the rest (2)."""
    exact, prefix, inside = (t.lower() for t in terms)
    low = F.lower(c)
    rank = F.when(low == exact, 0).when(low.startswith(prefix), 1).otherwise(2)
    return df.where(low.contains(inside)).withColumn("rank_class", rank).orderBy("rank_class", *order).limit(most)


def natural(c: Column) -> Column:
    """A sort key that puts digit-only texts in numeric order, however long: how many digits there are, then the digits."""
    digits = F.regexp_replace(c, "^0+(?=[0-9])", "")
    return F.when(c.rlike("^[0-9]+$"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(c)


def keyed_merge(rows: DataFrame, key: str, content: str, order: str) -> DataFrame:
    """One row per key: how many contents it has, conflict or merged, last and first by order."""
    return rows.groupBy(F.col(key)).agg(
        F.count_distinct(content).alias("versions"), F.when(F.min(content) != F.max(content), "conflict").otherwise("merged").alias("status"),
        F.max_by(content, order).alias("last_value"), F.min_by(content, order).alias("first_value"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """New values win; outcome says inserted, kept or updated."""
    a = old.select(key, F.col(value).alias("_o"), F.lit(1).alias("_a"))
    b = new.select(key, F.col(value).alias("_n"), F.lit(1).alias("_b"))
    j = a.join(b, key, "full")
    outcome = F.when(F.col("_a").isNull(), "inserted").when(F.col("_b").isNull(), "kept").otherwise("updated")
    return j.select(key, F.coalesce("_n", "_o").alias(value), outcome.alias("outcome"))
