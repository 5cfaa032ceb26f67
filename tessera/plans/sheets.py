"""Worksheet queries: line items as a sparse sheet (order blocks as sheets, parts as columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sheets as S
from ..registry import query, table

CELLS = "(select l_orderkey // 64 as sheet, l_orderkey % 64 as r, l_partkey % 24 as c, max(l_quantity) as v, min(l_returnflag) as flag from lineitem group by 1, 2, 3)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.floor(F.col("l_orderkey") / 64).alias("sheet"), (F.col("l_orderkey") % 64).alias("r"), (F.col("l_partkey") % 24).alias("c")).agg(F.max("l_quantity").alias("v"), F.min("l_returnflag").alias("flag"))


RANGES = f"""rr as (select sheet, r, r - dense_rank() over (partition by sheet order by r) as g from {CELLS}),
  runs as (select sheet, g, min(r) as row_first, max(r) as row_last from rr group by 1, 2),
  t as (select x.sheet, x.r, x.c, row_first, row_last, x.c - dense_rank() over (partition by x.sheet, row_first order by x.c) as h from {CELLS} x join runs on runs.sheet = x.sheet and x.r between row_first and row_last),
  boxes as (select sheet, row_first, row_last, min(c) as col_first, max(c) as col_last, count(distinct (r, c)) as cells from t group by sheet, row_first, row_last, h),
  dense as (select *, round(cells / ((row_last - row_first + 1) * (col_last - col_first + 1))::double, 6) as density from boxes)"""


@query(f"with {RANGES} select sheet, row_first, row_last, col_first, col_last, cells, density from dense where cells >= 4 and density >= 0.15")
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ranges: islands of rows, islands of columns, then cell count and density."""
    return S.dense_ranges(_cells(spark, sf_dir), "sheet", "r", "c").select("sheet", "row_first", "row_last", "col_first", "col_last", "cells", "density")


@query(f"""
with p as (select *, dense_rank() over (partition by sheet order by r) as k from {CELLS}), h as (select sheet, r, count(*) filter (where flag = 'N') as periods, count(*) as filled from p where k <= 4 group by 1, 2)
select sheet, r as header_row, periods, filled from h qualify row_number() over (partition by sheet order by periods desc, filled desc, r) = 1""")
def header_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.header_row(_cells(spark, sf_dir), ["sheet"], "r", F.col("flag") == "N")


@query(f"""
with x as (select sheet, min(c) as a, max(c) as z from {CELLS} group by 1), g as (select s.sheet, s.r, unnest(range(a, z + 1)) as c from (select distinct sheet, r from {CELLS}) s join x using (sheet))
select g.sheet, g.r, string_agg(coalesce(v::int::varchar, ''), '|' order by g.c) as line from g left join {CELLS} y on y.sheet = g.sheet and y.r = g.r and y.c = g.c group by 1, 2""")
def dense_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse cells as full rows, blanks filled."""
    cells = _cells(spark, sf_dir).withColumn("text", F.col("v").cast("int").cast("string"))
    return S.matrix(cells, ["sheet"], "r", "c", "text").select("sheet", "r", F.array_join("line", "|").alias("line"))


@query(f"with {RANGES} select d.sheet, row_first, col_first, count(*) as n, sum(v)::double as total from dense d join {CELLS} x on x.sheet = d.sheet and x.r between row_first and row_last and x.c between col_first and col_last where cells >= 4 and density >= 0.15 group by 1, 2, 3")
def range_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells joined to the rectangles that hold them."""
    cells = _cells(spark, sf_dir)
    j = S.cells_in(cells, S.dense_ranges(cells, "sheet", "r", "c"), "sheet", "r", "c")
    return j.groupBy("sheet", "row_first", "col_first").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("""
with y as (select o_custkey, year(o_orderdate)::int as y, sum(o_totalprice::decimal(18,2))::decimal(24,2) as v from orders group by 1, 2)
select o_custkey, y, v, case when y % 5 = 0 then v else lead(v) over (partition by o_custkey order by y) end as rolled from y""")
def roll_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(24,2)").alias("v"))
    return S.roll_forward(y, ["o_custkey"], "y", "v", F.col("y") % 5 == 0)


@query("""
with y as (select o_custkey, year(o_orderdate)::int as i, case when count(*) > 2 then 'busy' else 'calm' end as label from orders group by 1, 2)
select a.o_custkey, a.i as start from y a join y b on b.o_custkey = a.o_custkey and b.i = a.i + 1 join y c on c.o_custkey = a.o_custkey and c.i = a.i + 2 where a.label = 'calm' and b.label = 'busy' and c.label = 'calm'""")
def sequence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("i")).agg(F.when(F.count(F.lit(1)) > 2, "busy").otherwise("calm").alias("label"))
    return S.sequence_starts(y, ["o_custkey"], "i", "label", ["calm", "busy", "calm"])


@query(f"""
with l as (select sheet, c, r, v, case when flag = 'N' then flag || r end as label from {CELLS})
select a.sheet, a.c, a.r, (select arg_max(b.label, b.r) from l b where b.sheet = a.sheet and b.c = a.c and b.label is not null and b.r between a.r - 30 and a.r - 1) as nearest from l a""")
def nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest label above each cell, at most thirty rows away."""
    cells = _cells(spark, sf_dir).withColumn("label", F.when(F.col("flag") == "N", F.concat("flag", F.col("r").cast("string"))))
    return S.nearest_before(cells, ["sheet", "c"], "r", "label", 30).select("sheet", "c", "r", "nearest")


@query("""
with e as (select user_id, event_id, epoch(ts) as top, epoch(ts) + value * 100 as bottom from events), w as (select *, max(bottom) over (partition by user_id order by top, event_id rows between unbounded preceding and 1 preceding) as before from e),
g as (select *, sum(case when top - before > 7200 then 1 else 0 end) over (partition by user_id order by top, event_id) as b from w)
select user_id, event_id from g where b = 0""")
def gap_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first region of each lane, up to the first large gap."""
    top = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0
    e = table(spark, sf_dir, "events").select("user_id", "event_id", top.alias("top"), (top + F.col("value") * 100).alias("bottom"))
    return S.gap_prefix(e, ["user_id"], "top", "bottom", "event_id", 7200.0).select("user_id", "event_id")


@query("""
with v as (select l_orderkey, l_linenumber, max(case when l_returnflag = 'R' then -(l_quantity::decimal(12,2)) else l_quantity::decimal(12,2) end) as v from lineitem group by 1, 2),
s as (select *, sum(greatest(v, 0)) over w as up, sum(least(v, 0)) over w as down from v window w as (partition by l_orderkey order by l_linenumber))
select l_orderkey, l_linenumber, (case when v >= 0 then up - v else down - v end)::double as bar_start, (case when v >= 0 then up else down end)::double as bar_end from s""")
def stacked_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("decimal(12,2)")
    v = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.when(F.col("l_returnflag") == "R", -q).otherwise(q)).alias("v"))
    out = S.stacked(v, ["l_orderkey"], "l_linenumber", "v")
    return out.select("l_orderkey", "l_linenumber", F.col("bar_start").cast("double").alias("bar_start"), F.col("bar_end").cast("double").alias("bar_end"))


@query("""
with x as (select l_suppkey, case when l_quantity < 10 then 1 else 2 end as b, length(l_returnflag) + l_linenumber as w, l_quantity from lineitem), m as (select l_suppkey, b, sum(w) as w from x group by 1, 2),
md as (select l_suppkey, b from m qualify row_number() over (partition by l_suppkey order by w desc, b) = 1)
select x.l_suppkey, any_value(md.b) as mode_bucket, (list_sort(list(l_quantity)))[(count(*) // 2 + 1)::int] as upper_median, min(least(l_quantity, 0)) as low, max(l_quantity) + (max(l_quantity) - min(least(l_quantity, 0))) * 0.08 as high from x join md using (l_suppkey) group by 1""")
def extents_and_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mode of buckets, the upper of two medians, and padded extents with zero inside."""
    x = table(spark, sf_dir, "lineitem").withColumn("b", F.when(F.col("l_quantity") < 10, 1).otherwise(2)).withColumn("w", F.length("l_returnflag") + F.col("l_linenumber"))
    mode = x.groupBy("l_suppkey", "b").agg(F.sum("w").alias("w")).groupBy("l_suppkey").agg(F.max_by("b", F.struct("w", -F.col("b"))).alias("mode_bucket"))
    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_quantity"))
    mid = x.select("l_suppkey", "l_quantity", n.alias("n"), F.count(F.lit(1)).over(Window.partitionBy("l_suppkey")).alias("m")).where(F.col("n") == F.floor(F.col("m") / 2) + 1).select("l_suppkey", F.col("l_quantity").alias("upper_median"))
    low = F.min(F.least("l_quantity", F.lit(0.0)))
    ext = x.groupBy("l_suppkey").agg(low.alias("low"), (F.max("l_quantity") + (F.max("l_quantity") - low) * 0.08).alias("high"))
    return mode.join(mid, "l_suppkey").join(ext, "l_suppkey")


@query(f"""
with {RANGES}, d as (select sheet, row_first as top, col_first as "left", row_last as bottom, col_last as "right" from dense where cells >= 4 and density >= 0.15),
tt as (select * from d where (sheet * 7 + top) % 3 = 0 union select sheet, 0, 0, 3, 5 from {CELLS} where sheet % 4 = 1), u as (select sheet, min(r) as top, min(c) as "left", max(r) as bottom, max(c) as "right" from {CELLS} group by 1),
e as (select *, 1 as k from tt union all select *, 2 from u union all select *, 3 from (select * from d except select * from tt except select * from u)),
n as (select sheet // 4 as book, *, row_number() over (partition by sheet // 4 order by sheet, k, top, "left", bottom, "right") as place from e)
select book, sheet, case k when 1 then 'excel_table' when 2 then 'used_range' else 'dense_region' end as kind, top, "left", bottom, "right", place, case when k = 3 and place > 8 then 'overflow' else 'kept' end as status from n""")
def candidate_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ranges that a workbook offers: tables, used ranges and dense regions that are neither; beyond eight a dense one is reported as overflow."""
    cells = _cells(spark, sf_dir).withColumn("book", F.floor(F.col("sheet") / 4))
    named = {"row_first": "top", "col_first": "left", "row_last": "bottom", "col_last": "right"}
    dense = S.dense_ranges(cells, "sheet", "r", "c").withColumnsRenamed(named).withColumn("book", F.floor(F.col("sheet") / 4))
    fixed = cells.where("sheet % 4 = 1").select("book", "sheet").distinct().withColumns({c: F.lit(v).cast("long") for c, v in (("top", 0), ("left", 0), ("bottom", 3), ("right", 5))})
    tables = dense.where("(sheet * 7 + top) % 3 = 0").select("book", "sheet", "top", "left", "bottom", "right").union(fixed).distinct()
    used = cells.groupBy("book", "sheet").agg(F.min("r").alias("top"), F.min("c").alias("left"), F.max("r").alias("bottom"), F.max("c").alias("right"))
    return S.candidate_ranges(tables, used, dense, ["book"], most=8)
