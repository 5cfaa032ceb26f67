"""Band-chart queries: customers as charts, with a bridge range of three periods by six parts each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bandcharts as B
from ..registry import query, table, view, views

#: Chart m of fourteen has one fault: see FAULTS. Every third chart is of book values, every fourth has no direct bands.
CHARTS = """
select c_custkey as chart, c_custkey % 14 as m, case when c_custkey % 14 = 0 then 'table' else 'generated_band_chart' end as kind, case when c_custkey % 28 = 1 then ' ' else 'gen' end as generator, c_custkey % 28 = 15 as bare,
  case when c_custkey % 3 = 0 then 'pb' else 'pe' end as family, case when c_custkey % 14 <> 2 then concat('s', cast(c_custkey as string)) end as sheet, c_custkey % 4 as direct from {customer}"""
#: The records: k counts a chart's rows, p its periods, part its components; values are exact decimals.
RECORDS = """
select chart, m, family, sheet, direct, k, p, part, cast(1000 + chart % 97 + p as decimal(20,3)) as price, cast(cast(10 + p + chart % 5 as decimal(10,1)) + cast(0.5 as decimal(2,1)) as decimal(10,1)) as base,
  cast(cast(12 + p as decimal(5,2)) + cast(0.25 as decimal(3,2)) as decimal(5,2)) as high, cast(8.25 as decimal(5,2)) as low
from (select *, cast(floor((k - 1) / 6) as int) as p, case when m = 8 and k = 9 then 1 else (k - 1) % 6 end as part from {charts} cross join (values (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17), (18)) as n(k)) as q where sheet is not null"""
CELLS = """
select sheet, k + 1 as line, i as place, case i when 1 then concat('t', cast(k as string))
  when 2 then case when m = 7 and k = 8 then 'abc' when m = 10 and k = 13 then '-5' else case part when 0 then cast(price as string) when 1 then cast(base as string) when 2 then cast(high as string) when 3 then cast(low as string)
    when 4 then cast(cast(base * high as decimal(20,3)) + case when m = 12 and k = 11 then 1 else 0 end as string) else cast(cast(base * low as decimal(20,3)) as string) end end
  when 3 then case when m = 4 and k = 3 then ' , ' when m = 5 and k = 7 then 'e1,e9' else ' e1, e2' end
  when 4 then case when (m = 9 and k = 10) or (direct = 0 and part >= 4) then 'note' when family = 'pe' then case part when 0 then 'Adjusted price' when 1 then 'EPS' when 2 then 'PER multiple upper' when 3 then 'per 배수 하단' when 4 then 'P/E Band high' else 'PER 밴드 하단' end
    else case part when 0 then '주가' when 1 then 'BPS' when 2 then 'multiplier high' when 3 then 'multiple low' when 4 then 'band upper' else 'band lower' end end
  when 5 then concat('202', cast(4 + p as string), 'F')
  when 6 then case when (m = 6 and k = 7) or (m = 7 and k = 12) then '' when part = 2 or part = 3 then case when p = 0 then 'x' else '배' end when m = 11 and part = 1 then 'USD/share' when part = 1 then '원/주' else ' KRW' end
  else case when family = 'pe' then 'PER band' else 'PBR Band' end end as text
from {records} cross join (values (1), (2), (3), (4), (5), (6), (7)) as h(i)
union all select sheet, 1, i, case i when 1 then 'target_id' when 2 then 'Approved_Value' when 3 then ' evidence_ids' when 4 then 'metric' when 5 then 'period' when 6 then case when m = 3 then 'units' else 'unit' end else 'scope' end
from {charts} cross join (values (1), (2), (3), (4), (5), (6), (7)) as h(i) where sheet is not null"""
FAULTS = """case m when 0 then 'GENERATED_BAND_BINDING_REQUIRED' when 1 then 'BAND_EVIDENCE_MISSING' when 2 then 'BAND_BRIDGE_RANGE_UNAVAILABLE' when 3 then 'BAND_BRIDGE_SCHEMA_INVALID' when 4 then 'BAND_EVIDENCE_MISSING' when 5 then 'BAND_EVIDENCE_MISMATCH'
  when 6 then 'BAND_COMPONENT_PROVENANCE_INCOMPLETE' when 7 then 'BAND_COMPONENT_VALUE_INVALID' when 8 then 'BAND_COMPONENT_DUPLICATE' when 9 then 'BAND_COMPONENT_PROVENANCE_INCOMPLETE' when 10 then 'BAND_COMPONENT_VALUE_INVALID' when 11 then 'BAND_UNIT_MISMATCH'
  when 12 then case when direct <> 0 then 'BAND_SERIES_VALUE_MISMATCH' end end"""


def _charts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = view(spark, sf_dir, CHARTS)
    records = spark.sql(RECORDS, charts=base)
    cells = spark.sql(CELLS, records=records, charts=base).withColumnsRenamed({"line": "row", "place": "col"})
    evidence = F.when(F.col("bare"), F.array().cast("array<string>")).otherwise(F.array(F.lit("e1"), F.lit("e2"), F.lit("e3")))
    box = {"top": 1, "left": 1, "bottom": 19, "right": 7}
    return base.withColumn("evidence", evidence).withColumns({k: F.lit(v) for k, v in box.items()}), cells


@query(f"with {views(charts=CHARTS)}, f as (select *, {FAULTS} as fault from charts) select chart, case when fault is null then 'ready' else 'blocked' end as status, fault as blocker from f")
def band_chart_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band charts, ready or blocked with the first reason; every reason occurs."""
    charts, cells = _charts(spark, sf_dir)
    return B.band_charts(charts, cells)[0]


@query(f"""
with {views(charts=CHARTS)}, records as ({RECORDS.format(charts="charts")}), f as (select chart, {FAULTS} as fault from charts)
select chart, '202' || (4 + p) || 'F' as period, 'KRW' as unit, price::decimal(20,6) as price, (base * high)::decimal(38,12) as upper, (base * low)::decimal(38,12) as lower from records join f using (chart) where fault is null and part = 0""")
def band_chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and both bands of the ready charts: base times multiple, exact, and equal to a direct band where there is one."""
    charts, cells = _charts(spark, sf_dir)
    return B.band_charts(charts, cells)[1]


SLOTS = """
select o_custkey as project, o_orderkey as slot, case when o_orderkey % 4 = 0 then 'table' else 'chart' end as type, case o_orderkey % 5 when 0 then 'Figure 2 chart' when 1 then 'PBR' when 2 then 'P/E Band' when 3 then 'revenue' end as metric, case when o_orderkey % 5 = 1 then '밴드' end as scope from {orders}"""
BRIDGE = """
select o_custkey as project, line, i as place, case i when 3 then case when o_orderkey % 23 = 0 then ' , ' when o_orderkey % 29 = 0 then 'e9' else concat('e', cast(o_orderkey % 3 as string), ', e1') end
  when 4 then case o_orderkey % 3 when 0 then 'PER  band upper' when 1 then 'BPS' else 'sales' end when 7 then case when o_orderkey % 3 = 1 then 'PBR 밴드' else 'CFS' end else 'x' end as text
from (select *, 1 + row_number() over (partition by o_custkey order by o_orderkey) as line from {orders}) as o cross join (values (1), (2), (3), (4), (5), (6), (7)) as t(i)
union all select c_custkey, 1, i, case i when 1 then 'Target_ID' when 2 then 'approved_value' when 3 then 'evidence_ids' when 4 then case when c_custkey % 9 = 0 then 'name' else ' metric' end when 5 then 'period' when 6 then 'unit' else 'scope' end
from {customer} cross join (values (1), (2), (3), (4), (5), (6), (7)) as t(i)"""


@query(f"""
with {views(s=SLOTS, b=BRIDGE)}, last as (select project, max(line) as last from b group by 1),
r as (select o_custkey as project, o_orderkey % 23 = 0 or o_orderkey % 29 = 0 as bad, case o_orderkey % 3 when 0 then 'pe' when 1 then 'pb' end as family, unnest(['e' || (o_orderkey % 3), 'e1']) as evidence from orders where o_custkey % 9 <> 0),
f as (select project, family, string_agg(distinct evidence, ',' order by evidence) as evidence from r where family is not null group by 1, 2 having not bool_or(bad))
select s.project, slot, f.family, f.evidence, 'A1:G' || last as address from s join f on f.project = s.project and f.family = case slot % 5 when 0 then 'pe' when 1 then 'pb' when 2 then 'pe' end join last on last.project = s.project where type = 'chart'""")
def band_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart slots bound to the records of a bridge sheet, family by family; bad evidence takes a family out."""
    allowed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), F.explode(F.array(F.lit("e0"), F.lit("e1"), F.lit("e2"))).alias("evidence"))
    return B.band_bindings(view(spark, sf_dir, SLOTS), view(spark, sf_dir, BRIDGE).withColumnsRenamed({"line": "row", "place": "col"}), allowed)
