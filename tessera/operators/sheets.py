"""Worksheets as sparse relations: islands, density, headers, matrices, containment, roll-forward, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Runs of consecutive distinct integers: first, last, cells of each."""
    w = Window.partitionBy(*keys).orderBy(at)
    runs = df.select(*keys, at).distinct().withColumn("_g", F.col(at) - F.row_number().over(w))
    return runs.groupBy(*keys, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("cells")).drop("_g")


def dense_ranges(cells: DataFrame, sheet: str, row: str, col: str, least_cells: int = 4, least_density: float = 0.15) -> DataFrame:
    """Rectangles of consecutive rows and, within these, consecutive columns, kept by cell count and density."""
    rows = islands(cells, [sheet], row).select(sheet, F.col("first").alias("row_first"), F.col("last").alias("row_last"))
    # A row belongs to one run: an equi join on the sheet and the run's first row.
    mark = Window.partitionBy(sheet).orderBy(row).rangeBetween(Window.unboundedPreceding, 0)
    tagged = cells.select(sheet, row, col).unionByName(rows.select(sheet, F.col("row_first").alias(row), F.lit(None).cast(dict(cells.dtypes)[col]).alias(col)))
    tagged = tagged.withColumn("row_first", F.max(F.when(F.col(col).isNull(), F.col(row))).over(mark)).where(F.col(col).isNotNull()).join(rows, [sheet, "row_first"])
    w = Window.partitionBy(sheet, "row_first").orderBy(col)
    tagged = tagged.withColumn("_g", F.col(col) - F.dense_rank().over(w))
    box = tagged.groupBy(sheet, "row_first", "row_last", "_g").agg(F.min(col).alias("col_first"), F.max(col).alias("col_last"), F.count_distinct(row, col).alias("cells")).drop("_g")
    area = (F.col("row_last") - F.col("row_first") + 1) * (F.col("col_last") - F.col("col_first") + 1)
    return box.withColumn("density", F.round(F.col("cells") / area, 6)).where((F.col("cells") >= least_cells) & (F.col("density") >= least_density))


def header_row(cells: DataFrame, keys: list[str], row: str, is_period: Column, within: int = 4) -> DataFrame:
    """The header among the first rows: most period labels, then most cells, then the lower row number."""
    top = cells.withColumn("_r", F.dense_rank().over(Window.partitionBy(*keys).orderBy(row))).where(F.col("_r") <= within)
    per = top.groupBy(*keys, row).agg(F.count_if(is_period).alias("periods"), F.count(F.lit(1)).alias("filled"))
    best = per.groupBy(*keys).agg(F.max_by(F.struct(row, "periods", "filled"), F.struct("periods", "filled", -F.col(row))).alias("h"))
    return best.select(*keys, F.col(f"h.{row}").alias("header_row"), "h.periods", "h.filled")


def matrix(cells: DataFrame, keys: list[str], row: str, col: str, value: str, blank: str = "") -> DataFrame:
    """One row per matrix row with the values of all columns of the range, blanks filled."""
    extent = cells.groupBy(*keys).agg(F.min(col).alias("_a"), F.max(col).alias("_z"))
    by_row = cells.groupBy(*keys, row).agg(F.map_from_entries(F.collect_list(F.struct(col, value))).alias("_m"))
    line = F.transform(F.sequence("_a", "_z"), lambda c: F.coalesce(F.try_element_at(F.col("_m"), c), F.lit(blank)))
    return by_row.join(extent, keys).select(*keys, row, line.alias("line"))


def cells_in(cells: DataFrame, ranges: DataFrame, sheet: str, row: str, col: str, block: int = 64) -> DataFrame:
    """Cells with the rectangles that contain them: an equi join on row blocks instead of a nested loop.

    A rectangle is copied to each block of rows that it touches, so keep `block` near the usual height.
    """
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col("row_first") / block), F.floor(F.col("row_last") / block))))
    c = cells.withColumn("_b", F.floor(F.col(row) / block))
    inside = F.col(row).between(F.col("row_first"), F.col("row_last")) & F.col(col).between(F.col("col_first"), F.col("col_last"))
    return c.join(r, [sheet, "_b"]).where(inside).drop("_b")


def roll_forward(df: DataFrame, keys: list[str], order: str, value: str, formula: Column) -> DataFrame:
    """Shift values one step to the left and clear the last; formula cells keep theirs."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("rolled", F.when(formula, F.col(value)).otherwise(F.lead(value).over(w)))


def sequence_starts(df: DataFrame, keys: list[str], at: str, label: str, expected: list[str]) -> DataFrame:
    """Where consecutive positions carry exactly the expected labels."""
    w = Window.partitionBy(*keys).orderBy(at)
    ok = F.lit(True)
    for k, want in enumerate(expected):
        ok = ok & F.coalesce((F.lead(label, k).over(w) == want) & (F.lead(at, k).over(w) == F.col(at) + k), F.lit(False))
    return df.withColumn("_ok", ok).where("_ok").select(*keys, F.col(at).alias("start"))


def nearest_before(df: DataFrame, keys: list[str], at: str, label: str, reach: int) -> DataFrame:
    """Adds the last label before each position, at most `reach` away."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-reach, -1)
    return df.withColumn("nearest", F.last(label, ignorenulls=True).over(w))


def gap_prefix(df: DataFrame, keys: list[str], top: str, bottom: str, tie: str, gap: float) -> DataFrame:
    """The rows from the first on, up to where the next one begins more than `gap` below all before it."""
    w = Window.partitionBy(*keys).orderBy(top, tie)
    before = F.max(bottom).over(w.rowsBetween(Window.unboundedPreceding, -1))
    broken = F.when(F.col(top) - before > gap, 1).otherwise(0)
    return df.withColumn("_b", broken).withColumn("_b", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_b = 0").drop("_b")


def stacked(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Start and end of stacked bars: positive values pile up, negative ones down."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    up, down = F.sum(F.greatest(value, F.lit(0))).over(w), F.sum(F.least(value, F.lit(0))).over(w)
    end = F.when(F.col(value) >= 0, up).otherwise(down)
    return df.withColumn("bar_end", end).withColumn("bar_start", end - F.col(value))


def candidate_ranges(tables: DataFrame, used: DataFrame, dense: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, sheet, kind, top, left, bottom, right, place, status: all ranges that a workbook offers, in its order.

    A dense region goes if it is the used range or a table of its sheet. Ranges are numbered by sheet: its
    tables, its used range, its dense regions. Dense regions numbered beyond `most` are marked `overflow`, not lost.
    Numbers are those within a sheet plus what the sheets before it hold, so no workbook is sorted as a whole.
    """
    box = ["top", "left", "bottom", "right"]
    same = tables.unionByName(used).select(*keys, "sheet", *box).distinct()
    own = dense.select(*keys, "sheet", *box).distinct().join(same, [*keys, "sheet", *box], "left_anti")
    side = lambda df, kind: df.select(*keys, "sheet", *box, F.lit(kind).alias("kind"))
    every = side(tables, 0).unionByName(side(used, 1)).unionByName(side(own, 2))
    counts = every.groupBy(*keys, "sheet").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("sheet").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "sheet", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    nth = F.row_number().over(Window.partitionBy(*keys, "sheet").orderBy("kind", *box))
    e = every.withColumn("_nth", nth).join(counts, [*keys, "sheet"]).withColumn("place", F.col("_ahead") + F.col("_nth"))
    status = F.when((F.col("kind") == 2) & (F.col("place") > most), "overflow").otherwise("kept")
    names = F.element_at(F.array(F.lit("excel_table"), F.lit("used_range"), F.lit("dense_region")), F.col("kind") + 1)
    return e.select(*keys, "sheet", names.alias("kind"), *box, "place", status.alias("status"))
