"""Formula queries: parts as the cells of 25 workbooks, whose formulas read further down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import formulas as X
from ..registry import query, view, views

#: A part is a cell of column A; its size chooses the formula's form. Rows read rows about twice as far down.
CELLS = """
select p_partkey % 25 as book, 'Main' as sheet, r as line, 1 as place, shape, r, case shape
  when 0 then concat('=A', cast(2 * r as string), '*2+a', cast(2 * r + 1 as string))
  when 1 then concat('=SUM($A$', cast(2 * r + 3 as string), ':A', cast(2 * r as string), ')')
  when 2 then concat('=if(A', cast(2 * r as string), '>0,"A1 text ""B2"" x",$A', cast(2 * r + 1 as string), ')')
  when 3 then concat('=''It''''s''!B', cast(r as string), '+매출!$C$', cast(r as string))
  when 4 then concat('=INDIRECT("C5")+LOG10(A', cast(2 * r as string), ')')
  when 5 then '=SUM(A1:XFD1048576)'
  when 6 then concat('=Rate*A', cast(2 * r + 1 as string))
  when 7 then '=Missing!A1+[Book]x!B2'
  when 8 then '=A1048577+ZZZ1'
  when 9 then concat('=Sum(ROUND(A', cast(2 * r as string), ',2),A', cast(2 * r + 1 as string), ')+B', cast(r as string)) end as formula
from (select *, cast(floor(p_partkey / 25) as int) + 1 as r, p_size % 12 as shape from {part}) as x"""
#: What the forms mean, written down apart from the parser.
MEANT = """
select book, line, shape = 2 as conditional, 'Main' as sheet, 2 * r + d as top, 1 as "left", 2 * r + d as bottom, 1 as "right", shape = 9 as tolerant, null as problem from x, (values (0), (1)) as t(d)
  where shape in (0, 2, 9) or (shape = 4 and d = 0) or (shape = 6 and d = 1)
union all select book, line, false, 'Main', 2 * r, 1, 2 * r + 3, 1, true, null from x where shape = 1
union all select book, line, false, 'It''s', r, 2, r, 2, false, null from x where shape = 3 union all select book, line, false, '매출', r, 3, r, 3, false, null from x where shape = 3
union all select book, line, false, 'Main', 1, 1, 1048576, 16384, true, 'DEPENDENCY_RANGE_TOO_LARGE' from x where shape = 5
union all select book, line, false, 'Missing', 1, 1, 1, 1, false, 'REFERENCE_SHEET_MISSING:Missing' from x where shape = 7 union all select book, line, false, 'x', 2, 2, 2, 2, false, 'REFERENCE_SHEET_MISSING:x' from x where shape = 7
union all select book, line, false, 'Main', 1048577, 1, 1048577, 1, false, 'REFERENCE_ADDRESS_INVALID' from x where shape = 8 union all select book, line, false, 'Main', 1, 18278, 1, 18278, false, 'REFERENCE_ADDRESS_INVALID' from x where shape = 8
union all select book, line, false, 'Main', r, 2, r, 2, false, null from x where shape = 9"""
TABLES = f"{views(x=CELLS)}, meant as ({MEANT})"
#: Cells that a user may fill.
EDITABLE = """select book, 'Main' as sheet, r as line, 1 as place from {x} where shape >= 10 union select book, 'It''s', r, 2 from {x} where shape = 3 union select book, '매출', r, 3 from {x} where shape = 3 union select book, 'Main', r, 2 from {x} where shape = 9"""
BOOK = ["book"]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CELLS).withColumnsRenamed({"line": "row", "place": "col"})


def _sheets(cells: DataFrame) -> DataFrame:
    return cells.select("book").distinct().select("book", F.explode(F.array(F.lit("Main"), F.lit("It's"), F.lit("매출"))).alias("sheet"))


def _references(cells: DataFrame) -> DataFrame:
    return X.references(cells, ["book", "row"], _sheets(cells), BOOK)


def _editable(spark: SparkSession, cells: DataFrame) -> DataFrame:
    return spark.sql(EDITABLE, x=cells).withColumnsRenamed({"line": "row", "place": "col"})


@query(f"""with {TABLES} select distinct book, line as "row", conditional, sheet, top, "left", bottom, "right", tolerant, problem from meant""")
def formula_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What formulas read, as rectangles: literals scrubbed, any case, Hangul and quoted sheets, problems reported."""
    return _references(_cells(spark, sf_dir))


@query(f"""
with {TABLES}
select book, line as "row", problem as warning from meant where problem is not null union select book, line, 'BRANCH_ACTIVITY_NOT_EVALUATED' from x where shape = 2
union select book, line, 'UNSUPPORTED_DYNAMIC_REFERENCE' from x where shape = 4 union select book, line, 'UNSUPPORTED_STRUCTURED_OR_EXTERNAL_REFERENCE' from x where shape = 7
union select book, line, 'UNSUPPORTED_DEFINED_NAME:Rate' from x where shape = 6 and book % 2 = 0""")
def formula_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What references cannot tell: dynamic, structured and missing ones, branches, defined names (of even workbooks)."""
    cells = _cells(spark, sf_dir)
    names = cells.where("book % 2 = 0").select("book", F.lit("Rate").alias("name")).distinct()
    return X.warnings(cells, ["book", "row"], _references(cells), names, BOOK)


@query(f"""
with recursive {TABLES}, editable as ({EDITABLE.format(x='x')}),
every as (select book, sheet, line, place from x where formula is not null union select * from editable),
outputs as (select book, case line when 1 then 'forward_eps' when 2 then 'target_per' else 'target_price' end as metric, line from x where line <= 3),
walk(book, metric, sheet, line, place, cond) as (
  select book, metric, 'Main', line, 1, false from outputs
  union select w.book, w.metric, v.sheet, v.line, v.place, w.cond or m.conditional from walk w join meant m on m.book = w.book and m.line = w.line and w.sheet = 'Main' and w.place = 1 and m.problem is null
    join every v on v.book = w.book and v.sheet = m.sheet and v.line between m.top and m.bottom and v.place between m."left" and m."right"),
hit as (select book, sheet, line, place, metric, bool_and(cond) as cond from walk group by all)
select e.book, e.sheet, e.line as "row", e.place as col, coalesce(string_agg(metric || '_driver', ',' order by metric), 'unmapped') as impact, coalesce(string_agg(metric, ',' order by metric), '') as outputs, case when bool_or(not cond) then true end as active
from editable e left join hit h on h.book = e.book and h.sheet = e.sheet and h.line = e.line and h.place = e.place group by 1, 2, 3, 4""")
def formula_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editable cells with the outputs behind which they stand, and whether one reaches them without a branch."""
    cells = _cells(spark, sf_dir)
    editable = _editable(spark, cells)
    refs = X.references(cells.withColumn("at", F.col("sheet")), ["book", "at", "row", "col"], _sheets(cells), BOOK)
    metric = F.when(F.col("row") == 1, "forward_eps").when(F.col("row") == 2, "target_per").otherwise("target_price")
    outputs = cells.where("row <= 3").select(metric.alias("metric"), "book", "sheet", "row", "col")
    every = cells.where("formula is not null").select("book", "sheet", "row", "col").unionByName(editable)
    hit = X.inputs_behind(spark, outputs, every, refs, BOOK)
    place = ["book", "sheet", "row", "col"]
    found = hit.groupBy(*place).agg(F.array_sort(F.collect_set("metric")).alias("m"), F.bool_or(~F.col("conditional")).alias("a"))  # three metrics at most
    names = F.coalesce("m", F.array().cast("array<string>"))
    impact = F.when(F.size(names) == 0, "unmapped").otherwise(F.array_join(F.transform(names, lambda m: F.concat(m, F.lit("_driver"))), ","))
    return editable.join(found.hint("merge"), place, "left").select(*place, impact.alias("impact"), F.array_join(names, ",").alias("outputs"), F.when(F.col("a"), True).alias("active"))


#: A grid of labels and values: every seventh row is a header, every fourteenth one a whole row of periods.
GRID = """
select book, 'Main' as sheet, r as line, c as place, case when c = 1 then concat('item ', cast(r as string)) when r % 7 = 0 then case c when 2 then '2024' when 3 then ' 2025F ' else case when r % 14 = 0 then '2026 e' else 'note' end end
  when c = 2 then case when r % 3 = 0 then '12' else ' ' end when c = 4 and r % 5 = 0 then '7' end as text
from (select p_partkey % 25 as book, cast(floor(p_partkey / 25) as int) + 1 as r from {part}) as p cross join (values (1), (2), (3), (4)) as k(c)"""
READERS = """
select p_partkey % 25 as book, 'Main' as sheet, r as line, 6 as place, case r % 4 when 0 then concat('=SUM(B', cast(r as string), ':D', cast(r + 1 as string), ')') when 1 then concat('=C', cast(r as string), '+SUM(D', cast(r as string), ')')
  when 2 then concat('=AVERAGE(B1:D2)+COUNT(IF(D', cast(r as string), '>0,1))') end as formula
from (select p_partkey, cast(floor(p_partkey / 25) as int) + 1 as r from {part}) as p"""


@query(f"""
with {views(g=GRID)},
e as (select book, sheet, line, place from g where place >= 3 union all select book, sheet, line, 9 from g where place = 1),
n as (select e.*, trim(coalesce(g.text, '')) as t, g.book is not null as there, line % 14 <> 0 and (line % 7 = 0 or line % 3 = 0 or line % 5 = 0) as data,
  case place when 3 then line > 7 when 4 then line > 14 end as below, place = 3 and line % 4 = 1 as direct from e left join g using (book, sheet, line, place)),
k as (select *, not there or (data and (below or direct)) as need from n)
select book, sheet, line as "row", place as col, need as required, need and t = '' as missing from k""")
def required_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editable cells that must not stay blank: below a period in a row of data, or read outside calls that leave blanks out."""
    named = {"line": "row", "place": "col"}
    grid = view(spark, sf_dir, GRID).withColumnsRenamed(named)
    readers = view(spark, sf_dir, READERS).withColumnsRenamed(named)
    refs = X.references(readers, ["book", "row", "col"], grid.select("book", "sheet").distinct(), BOOK).drop("row", "col")
    editable = grid.where("col >= 3").select("book", "sheet", "row", "col").unionByName(grid.where("col = 1").select("book", "sheet", "row", F.lit(9).alias("col")))
    return X.required(grid, editable, refs, BOOK)
