"""Collection plans, bindings, materialisation, validation and edit folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def request_plan(targets: DataFrame, entity: str, year: str, quarter: str) -> DataFrame:
    """Distinct (entity, year, quarter) to fetch: each target's, the quarter before it in its year, and the same one a year ago."""
    wanted = F.array(
        F.struct(F.col(year).alias("year"), F.col(quarter).alias("quarter")),
        F.when(F.col(quarter) > 1, F.struct(F.col(year).alias("year"), (F.col(quarter) - 1).alias("quarter"))),
        F.struct((F.col(year) - 1).alias("year"), F.col(quarter).alias("quarter")),
    )
    return targets.select(entity, F.explode(F.filter(wanted, lambda x: x.isNotNull())).alias("r")).select(entity, "r.year", "r.quarter").distinct()


def fill_scope(rows: DataFrame, group: str, scope: str, requested: Column) -> DataFrame:
    """A missing scope is the requested one, if exactly one was requested; a group with two scopes is rejected."""
    filled = F.coalesce(F.col(scope), F.when(F.size(requested) == 1, requested[0]))
    out = rows.withColumn(scope, filled)
    w = Window.partitionBy(group)
    mixed = F.min(scope).over(w) != F.max(scope).over(w)
    status = F.when(F.coalesce(mixed, F.lit(False)), "scope_mismatch").when(F.col(scope).isNull(), "scope_unknown").otherwise("validated")
    return out.withColumn("status", status)


def allowed_roles(roles: Column, allowed: Column) -> Column:
    """Roles that are allowed, or the first allowed one where none is."""
    kept = F.array_intersect(roles, allowed)
    return F.when(F.size(kept) == 0, F.slice(allowed, 1, 1)).otherwise(kept)


def overlay(base: DataFrame, top: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One value per key; the top layer's wins."""
    both = base.select(*keys, value, F.lit(0).alias("_l")).unionByName(top.select(*keys, value, F.lit(1).alias("_l")))
    return both.groupBy(*keys).agg(F.max_by(value, "_l").alias(value), F.max("_l").alias("layer"))


def either_join(a: DataFrame, b: DataFrame, first: tuple[str, str], second: tuple[str, str], keys: list[str]) -> DataFrame:
    """Pairs that meet on the first or on the second pair of columns: two equi joins and a distinct, no nested loop."""
    one = a.join(b, F.col(first[0]) == F.col(first[1])).select(*keys)
    return one.union(a.join(b, F.col(second[0]) == F.col(second[1])).select(*keys)).distinct()


def best_cover(targets: DataFrame, ranges: DataFrame, sheet: str, row: str, col: str, keys: list[str], identity: str) -> DataFrame:
    """The smallest range of its sheet that holds each target, ties by identity; targets no range holds have none."""
    from .sheets import cells_in

    held = cells_in(targets, ranges, sheet, row, col)
    area = (F.col("row_last") - F.col("row_first") + 1) * (F.col("col_last") - F.col("col_first") + 1)
    best = held.withColumn("area", area).groupBy(*keys).agg(F.min_by(F.struct(identity, "area"), F.struct("area", identity)).alias("_b"))
    return targets.select(*keys).distinct().join(best, keys, "left").select(*keys, F.col(f"_b.{identity}").alias(identity), F.col("_b.area").alias("area"))


def materialise(items: DataFrame, slot: str, order: str, value: str, blocked: Column) -> DataFrame:
    """One JSON per artifact with items by slot id; a blocked item blocks the whole artifact. The content's hash names it."""
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(slot).alias("slot"), F.col(value).alias("value")))), lambda x: x))
    g = items.groupBy(order).agg(body.alias("json"), F.bool_or(blocked).alias("_blocked"))
    return g.select(order, F.when(F.col("_blocked"), "blocked").otherwise("ready").alias("status"), F.when(~F.col("_blocked"), F.sha2("json", 256)).alias("content_hash"))


def fold_edits(edits: DataFrame, block: str, order: list[str], revision: str, base: Column, value: str) -> DataFrame:
    """Edits of a block in order, each of which must name the revision before it; one wrong edit rejects all, the last one wins."""
    w = Window.partitionBy(block).orderBy(*order)
    ok = F.col(revision) == base + F.row_number().over(w) - 1
    g = edits.withColumn("_ok", ok).withColumn("_n", F.row_number().over(w)).groupBy(block).agg(F.bool_and("_ok").alias("_all"), F.max_by(value, "_n").alias("_last"), F.count(F.lit(1)).alias("edits"))
    return g.select(block, "edits", F.when(F.col("_all"), "applied").otherwise("revision_conflict").alias("status"), F.when(F.col("_all"), F.col("_last")).alias(value))


def period_series(cells: DataFrame, keys: list[str], row: str, col: str, least_points: int, least_share: float) -> DataFrame:
    """Rows of a range that make a series: enough points, and enough of the range's columns filled."""
    width = cells.groupBy(*keys).agg((F.max(col) - F.min(col) + 1).alias("_w"))
    per = cells.groupBy(*keys, row).agg(F.count_distinct(col).alias("points"))
    return per.join(width, keys).withColumn("share", F.round(F.col("points") / F.col("_w"), 6)).where((F.col("points") >= least_points) & (F.col("share") >= least_share)).drop("_w")


def zip_series(rows: DataFrame, chart: str, series: str, position: str, value: str) -> DataFrame:
    """Charts whose series are all as long as each other; any other chart is blocked as a whole."""
    per = rows.groupBy(chart, series).agg(F.count(F.lit(1)).alias("_n"), F.max(position).alias("_m"))
    ok = per.groupBy(chart).agg(F.count(F.lit(1)).alias("series"), F.min("_n").alias("points"), ((F.min("_n") == F.max("_n")) & (F.min("_m") == F.max("_m"))).alias("_ok"))
    return ok.select(chart, "series", F.when(F.col("_ok"), F.col("points")).alias("points"), F.when(F.col("_ok"), "ready").otherwise("series_length_mismatch").alias("status"))


def verify_patch(before: DataFrame, after: DataFrame, allowed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every cell that differs, with whether the patch allowed it."""
    j = before.select(*keys, F.col(value).alias("before_value")).join(after.select(*keys, F.col(value).alias("after_value")), keys, "full")
    diff = j.where(~F.col("before_value").eqNullSafe(F.col("after_value")))
    return diff.join(allowed.select(*keys).distinct().withColumn("_a", F.lit(True)), keys, "left").withColumn("status", F.when(F.col("_a"), "allowed").otherwise("unexpected_change")).drop("_a")
