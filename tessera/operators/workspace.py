"""Validation chains, formula graphs, sections, clusters, copies with new keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import stored

FUNCTIONS = r"[A-Z][A-Z0-9.]*(?=\()"
#: Worksheet functions that spill or need a newer engine.
DYNAMIC = ["FILTER", "SORT", "SORTBY", "UNIQUE", "SEQUENCE", "RANDARRAY", "XLOOKUP", "XMATCH", "LET", "LAMBDA", "MAP", "REDUCE", "SCAN", "BYROW", "BYCOL", "MAKEARRAY", "TEXTSPLIT", "VSTACK"]


def unsupported_functions(formula: Column) -> Column:
    """The dynamic-array functions that a formula calls, sorted."""
    called = F.regexp_extract_all(F.upper(formula), F.lit(FUNCTIONS), F.lit(0))
    return F.array_sort(F.array_intersect(F.array_distinct(called), F.array(*[F.lit(f) for f in DYNAMIC])))


def issues(rows: DataFrame, key: str, checks: list[tuple[str, Column]]) -> DataFrame:
    """One row for each check that a row breaks (null breaks it): key, code."""
    found = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks]), lambda c: c.isNotNull())
    return rows.select(key, F.explode(found).alias("code"))


def state_machine(states: list[tuple[str, Column]], last: str) -> Column:
    """The first state whose condition holds, in order."""
    out = F.lit(last)
    for name, holds in reversed(states):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def formula_inputs(spark: SparkSession, refs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(output, cell, conditional): all cells behind each output, and whether every way to them is conditional.

    refs: (cell, ref, conditional). A plain way found after a conditional one replaces it, so a
    pair is extended at most twice; cycles end.
    """
    edge = refs.select(F.col("cell").alias("_m"), "ref", F.col("conditional").alias("_c"))
    every = stored(spark, outputs.select(F.col("cell").alias("output"), F.col("cell"), F.lit(False).alias("conditional")), "formula")
    fresh = every
    while True:
        nxt = fresh.withColumnRenamed("cell", "_m").join(edge, "_m").select("output", F.col("ref").alias("cell"), (F.col("conditional") | F.col("_c")).alias("conditional"))
        nxt = nxt.groupBy("output", "cell").agg(F.bool_and("conditional").alias("conditional"))
        known = every.select("output", "cell", F.col("conditional").alias("_k"))
        better = nxt.join(known, ["output", "cell"], "left").where(F.col("_k").isNull() | (F.col("_k") & ~F.col("conditional"))).drop("_k")
        fresh = stored(spark, better, "formula")
        if not fresh.limit(1).count():
            return every
        every = stored(spark, every.unionByName(fresh).groupBy("output", "cell").agg(F.bool_and("conditional").alias("conditional")), "formula")


def copy_forward(rows: DataFrame, key: str, salt: str, keep: Column) -> DataFrame:
    """Rows that stay, under new ids made of the old ones, with the old id beside."""
    return rows.where(keep).withColumn("copied_from", F.col(key)).withColumn(key, opaque_id("copy", F.concat_ws("|", F.lit(salt), F.col(key).cast("string"))))


def opaque_id(prefix: str, of: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(of, 256), 1, 20))


def row_keys(cells: DataFrame, keys: list[str], col: str, is_text: Column, before: Column, most: int = 3, share: float = 0.5) -> DataFrame:
    """Columns that name rows: mostly text, left of the first period column, at most `most`."""
    per = cells.where(before).groupBy(*keys, col).agg(F.round(F.avg(F.when(is_text, 1.0).otherwise(0.0)), 6).alias("text_share")).where(F.col("text_share") >= share)
    return per.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(col))).where(F.col("place") <= most)


def role_backfill(df: DataFrame, keys: list[str], at: str, role: str) -> DataFrame:
    """Unknown periods before the first forecast are actual; the others stay unknown."""
    first = F.min(F.when(F.col(role) == "forecast", F.col(at))).over(Window.partitionBy(*keys))
    return df.withColumn(role, F.when(F.col(role).isNull() & (F.col(at) < first), "actual").otherwise(F.col(role)))


def stable_json(values: Column) -> Column:
    """JSON of a map with its keys in order, which makes its hash stable."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def unique_match(df: DataFrame, key: str, entries: str, wanted: Column) -> DataFrame:
    """The one field whose value is the wanted text, else the one that is the same number; two of a kind are no match."""
    e = df.select(key, wanted.alias("_w"), F.explode_outer(entries).alias("_k", "_v"))
    number = lambda c: c.try_cast("decimal(30,6)")
    same = F.when(F.col("_v") == F.col("_w"), 1).when(number(F.col("_v")) == number(F.col("_w")), 2)
    g = e.withColumn("_s", same).groupBy(key).agg(F.count_if(F.col("_s") == 1).alias("_a"), F.count_if(F.col("_s") == 2).alias("_b"), F.min(F.when(F.col("_s").isNotNull(), F.struct("_s", "_k")))["_k"].alias("_f"))
    one = (F.col("_a") == 1) | ((F.col("_a") == 0) & (F.col("_b") == 1))
    status = F.when(one, "resolved").when(F.col("_a") + F.col("_b") == 0, "not_found").otherwise("ambiguous")
    return g.select(key, F.when(one, F.col("_f")).alias("field"), status.alias("status"))
