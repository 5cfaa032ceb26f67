"""Charts read from dense ranges: series in rows under contiguous periods, or series in columns beside row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised
from .formulas import touching

#: Labels that belong to checks and sources, and what a band chart's series are called.
IGNORED = ["정합성체크", "출처", "감사", "audit", "source", "reference"]
PRICE, BAND = ["주가", "price"], ["band", "밴드", "per", "pbr", "배수", "x"]


def _has(label: Column, tokens: list[str]) -> Column:
    found = F.lit(False)
    for t in tokens:
        found = found | F.contains(normalised(label), F.lit(t))
    return found


def dense_charts(ranges: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(range, layout, points, series, status) of every range, and (range, at, label, first, last) of the charts' series.

    ranges: range, sheet, top, left, bottom, right, header (row), key (column), periods (array of columns), band.
    cells: sheet, row, col, text, number (is it one). With two contiguous period columns or more, rows are series: labelled, with
    two values and 0.6 of the periods at least; every period needs a header. Else columns are series: labelled, with
    two numbers; the rows with a key and a number must follow the header without a gap, two at least, and a
    series fills 0.8 of them. A band chart also needs four periods and points, two series, a price and a band.
    """
    c = F.col
    inner = F.filter("periods", lambda p: p.between(F.col("left"), F.col("right")))
    r = ranges.withColumn("inner", F.array_distinct(inner)).withColumn("n", F.size("inner"))
    r = r.withColumn("layout", F.when((c("n") >= 2) & (F.array_max("inner") - F.array_min("inner") + 1 == c("n")), "rows").otherwise("columns"))
    text = F.trim(F.coalesce("text", F.lit("")))
    at = touching(cells.withColumn("text", text), r.select("range", "sheet", "top", "left", "bottom", "right", "header", "key", "inner", "n", "layout"), ["sheet"])
    kept = lambda label: (label != "") & ~_has(label, IGNORED)

    rows = at.where("layout = 'rows'")
    heads = rows.where("row = header").groupBy("range").agg(F.count_if(F.array_contains("inner", c("col")) & (c("text") != "")).alias("named"))
    lines = rows.where("row > header").groupBy("range", "row", "n", "inner").agg(F.coalesce(F.max(F.when(c("col") == c("key"), c("text"))), F.lit("")).alias("label"), F.count_if(F.array_contains("inner", c("col")) & c("number")).alias("filled"))
    lines = lines.where(kept(c("label")) & (c("filled") >= 2) & (c("filled") / c("n") >= 0.6)).select("range", c("row").alias("at"), "label", F.array_min("inner").alias("first"), F.array_max("inner").alias("last"))

    columns = at.where("layout = 'columns'")
    names = columns.where("col <> key").groupBy("range", "col").agg(F.coalesce(F.max(F.when(c("row") == c("header"), c("text"))), F.lit("")).alias("label"), F.count_if((c("row") > c("header")) & c("number")).alias("filled"))
    names = names.where(kept(c("label")) & (c("filled") >= 2)).select("range", "col", "label")
    keyed = columns.where("col = key and row > header and text <> ''").select("range", "row", "header")
    values = columns.where("row > header and number").select("range", "row", "col").join(names, ["range", "col"])
    data = values.select("range", "row").distinct().join(keyed, ["range", "row"])
    span = data.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("first"), F.max("row").alias("last"), F.min("header").alias("header"))
    span = span.withColumn("whole", (c("rows") >= 2) & (c("last") - c("first") + 1 == c("rows")) & (c("first") == c("header") + 1))
    filled = values.join(data.select("range", "row"), ["range", "row"]).groupBy("range", "col", "label").agg(F.count(F.lit(1)).alias("filled"))
    full = filled.join(span.where("whole").drop("header"), "range").where(c("filled") / c("rows") >= 0.8).select("range", c("col").alias("at"), "label", "first", "last")

    series = lines.unionByName(full)
    counts = series.groupBy("range").agg(F.count(F.lit(1)).alias("series"), F.max(c("last") - c("first") + 1).alias("points"), F.bool_or(_has(c("label"), PRICE)).alias("price"), F.bool_or(_has(c("label"), BAND)).alias("banded"))
    j = r.join(heads, "range", "left").join(counts, "range", "left").join(span.select("range", "whole"), "range", "left")
    gate = (F.size("periods") >= 4) & (c("points") >= 4) & (c("series") >= 2) & c("price") & c("banded")
    status = (
        F.when((c("layout") == "rows") & (F.coalesce("named", F.lit(0)) < c("n")), "PERIOD_HEADER_MISSING").when((c("layout") == "columns") & c("whole").isNull(), "SERIES_MISSING").when((c("layout") == "columns") & ~c("whole"), "ROWS_NOT_CONTIGUOUS")
        .when(c("series").isNull(), "SERIES_MISSING").when(c("band") & ~F.coalesce(gate, F.lit(False)), "BAND_GATE_CLOSED").otherwise("chart")
    )
    said = j.select("range", "layout", F.when(status == "chart", c("points")).alias("points"), F.when(status == "chart", c("series")).alias("series"), status.alias("status"))
    return said, series.join(said.where("status = 'chart'").select("range"), "range", "left_semi")
