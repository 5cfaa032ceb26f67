"""Official values: customers as targets, orders as price and rate sources and as targets of a value set, lines as results and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalise import quote_key
from ..operators import official as O
from ..registry import query, table, view, views
from .graphs import _digest

CUTOFF = "2000-01-01"
PRICES = """
select o_orderkey as source, lpad(cast(o_custkey as string), 6, '0') as ticker, cast(cents as decimal(20,0)) as close, day, case when o_orderkey % 5 = 0 then o_orderdate + interval 5 day end as published,
  case when o_orderkey % 19 <> 0 then concat(cast(cast(floor(shown / 1000) as int) as string), ',', lpad(cast(shown % 1000 as string), 3, '0')) end as row_close,
  case when o_orderkey % 13 = 0 then concat(replace(day, '-', ''), '0') else replace(day, '-', '') end as row_day, case when o_orderkey % 17 = 0 then 'A999999' when o_orderkey % 2 = 0 then concat('A', lpad(cast(o_custkey as string), 6, '0')) else cast(o_custkey as string) end as row_ticker
from (select *, cast(floor(o_totalprice) as bigint) as cents, cast(floor(o_totalprice) as bigint) + case when o_orderkey % 11 = 0 then 1 else 0 end as shown, cast(cast(o_orderdate as date) as string) as day from {orders}) as x"""


@query(f"""
with {views(p=PRICES)},
g as (select *, row_number() over (partition by ticker order by day desc, source) as k from p where day::date + interval 1 day - interval 9 hour - interval 1 millisecond <= timestamp '{CUTOFF}' and coalesce(published, timestamp '1900-01-01') <= timestamp '{CUTOFF}'),
j as (select c_custkey as target, g.*, coalesce(replace(row_close, ',', '')::decimal(20,0) = close and row_day = replace(day, '-', '') and lpad(case when left(row_ticker, 1) = 'A' then substr(row_ticker, 2) else row_ticker end, 6, '0') = ticker, false) as same
  from customer left join g on ticker = case when c_custkey % 25 = 24 then 'unlisted' else lpad(c_custkey::varchar, 6, '0') end and k = 1)
select target, source, case when source is null then 'source_unavailable' when same then 'validated' else 'manual_review' end as status, case when same then close::bigint::varchar end as value, case when same then day end as period from j""")
def official_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last close before the cutoff of each ticker, checked against ticker, day and price of its row."""
    targets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"), F.when(F.col("c_custkey") % 25 == 24, "unlisted").otherwise(F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("ticker"))
    return O.price_results(targets, view(spark, sf_dir, PRICES), F.lit(CUTOFF).cast("timestamp"))


SERIES = """
select o_orderkey as source, o_custkey % 40 as market, case when o_custkey % 40 = 3 then '731Y002' else '731Y001' end as statistic, case when o_custkey % 40 = 5 then 'M' else 'D' end as cycle, '0000001' as item,
  case when o_orderkey % 9 = 0 then substring(replace(cast(cast(o_orderdate as date) as string), '-', ''), 1, 6) else concat(' ', replace(cast(cast(o_orderdate as date) as string), '-', '')) end as time,
  case when o_orderkey % 7 = 0 then 'n/a' when o_orderkey % 2 = 0 then concat('1,', lpad(cast(o_orderkey % 1000 as string), 3, '0'), '.5') else cast(o_orderkey % 1000 as string) end as value
from {orders}"""


@query(f"""
with {views(s=SERIES)},
g as (select *, trim(time) as t, row_number() over (partition by market order by trim(time) desc, source) as k from s where length(trim(time)) = 8 and strptime(trim(time), '%Y%m%d') + interval 1 day - interval 9 hour - interval 1 millisecond <= timestamp '{CUTOFF}'),
j as (select c_custkey as target, g.*, coalesce(c_custkey % 3 < 2 and statistic = '731Y001' and cycle = 'D' and regexp_matches(replace(value, ',', ''), '^[0-9.]+$'), false) as ok from customer left join g on market = c_custkey % 45 and k = 1)
select target, source, case when source is null then 'source_unavailable' when ok then 'validated' else 'manual_review' end as status, case when ok then replace(value, ',', '') end as value, case when ok then strftime(strptime(t, '%Y%m%d'), '%Y-%m-%d') end as period from j""")
def official_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last rate before the cutoff of each market, for the registered metrics and series only."""
    k = F.col("c_custkey")
    targets = table(spark, sf_dir, "customer").select(k.alias("target"), (k % 45).alias("market"), F.when(k % 3 == 0, "usd_krw").when(k % 3 == 1, "exchange_rate_usd_krw").otherwise("current_price").alias("metric"))
    return O.rate_results(targets, view(spark, sf_dir, SERIES), F.lit(CUTOFF).cast("timestamp"))


TARGETS = """
select o_orderkey as target, concat('m', cast(o_custkey % 9 as string)) as metric, case o_orderkey % 4 when 0 then '2026Q1' when 1 then '2026년 연간' when 2 then '1Q26' else ' FY2025 ' end as period, case when o_orderkey % 2 = 0 then '연결' else 'OFS' end as scope,
  case when o_orderkey % 3 = 0 then 'actual' else 'F' end as kind, case when o_orderkey % 11 = 0 then 'MULTIPLE' else 'KRW' end as unit, o_orderkey % 10 <> 0 as included, o_orderkey % 6 <> 0 as required
from {orders}"""
RESULTS = """
select l_orderkey as target, case when l_partkey % 40 = 1 then 'REJECTED' when l_partkey % 40 = 2 then 'RESOLVED' end as exception, case when l_partkey % 40 = 3 then 'stale' when l_partkey % 40 < 6 then 'needs_review' else 'passed' end as machine, l_suppkey % 2 = 0 as accepted,
  case when l_partkey % 40 = 7 then 'unresolved' else 'none' end as conflict, case when l_partkey % 40 = 8 then '' else concat(cast(cast(floor(l_extendedprice) as int) as string), '.50') end as original, case when l_partkey % 40 = 9 then '1.2.3' else concat(cast(cast(floor(l_extendedprice) as int) as string), '.5') end as normal,
  case when l_partkey % 40 = 10 then 'POUND' when l_suppkey % 3 = 0 then 'KRW_MILLION' else 'KRW' end as unit,
  case l_orderkey % 4 when 0 then case when l_partkey % 40 = 11 then '2026Q2' else '2026년 1분기' end when 1 then '2026' when 2 then '2026-Q1' else '2025 사업연도' end as period, case when l_partkey % 40 = 12 then '별도' when l_orderkey % 2 = 0 then 'CFS' else '개별' end as scope,
  case when l_orderkey % 3 = 0 then null else '예상' end as kind, l_partkey % 40 = 13 as bare, l_linenumber as line
from {lineitem} where l_linenumber < 3"""
APPROVED = f"""
with {views(t=TARGETS, x=RESULTS)},
n as (select target, count(*) as n from x group by 1),
j as (select t.target, t.metric, t.required, t.period as tp, t.scope as ts, t.unit as tu, coalesce(n, 0) as n, x.* exclude (target), x.unit as ru from t left join n using (target) left join x on x.target = t.target and n = 1 where included),
c as (select *, case when n > 1 then 'VALIDATED_VALUE_AMBIGUOUS' when n = 0 then case when required then 'VALIDATED_VALUE_MISSING' else 'absent' end when exception = 'REJECTED' or machine = 'stale' then 'VALIDATED_VALUE_NOT_APPROVED'
  when machine = 'needs_review' and not accepted then 'QUALIFIED_VALUE_DECISION_REQUIRED' when conflict = 'unresolved' then 'VALIDATED_VALUE_CONFLICT_UNRESOLVED' when original = '' or bare then 'VALIDATED_VALUE_INCOMPLETE'
  when period = '2026Q2' or (scope = '별도') <> (scope = '별도' and ts = 'OFS') then 'VALIDATED_VALUE_DIMENSION_MISMATCH' when normal = '1.2.3' then 'VALIDATED_DECIMAL_INVALID' when ru = 'POUND' then 'UNIT_UNKNOWN' when tu = 'MULTIPLE' then 'FAMILY_MISMATCH' else 'ok' end as code from j),
v as (select target, code, case when code = 'ok' then metric end as metric, case when code = 'ok' then case target % 4 when 1 then '2026년' when 3 then '2025년' else '2026년 1분기' end end as period, case when code = 'ok' then case when target % 2 = 0 then 'CFS' else 'OFS' end end as scope,
  case when code = 'ok' then normal end as original, case when code = 'ok' then ru end as unit_original, case when code = 'ok' then case when ru = 'KRW_MILLION' then regexp_extract(normal, '^[0-9]+') || '500000' else normal end end as value, case when code = 'ok' then 'KRW' end as unit,
  case when code = 'ok' then case when ru = 'KRW' then 'identity' else 'unit_scale' end end as rule, case when code = 'ok' then 'e' || line || ',f' end as evidence from c)
"""


def _approved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = F.concat(F.lit("e"), F.col("line").cast("string"))
    evidence = F.when(F.col("bare"), F.array().cast("array<string>")).otherwise(F.array(F.lit("f"), line, F.lit("f")))
    return O.approved_values(spark, view(spark, sf_dir, TARGETS), view(spark, sf_dir, RESULTS).withColumn("evidence", evidence))


@query(APPROVED + "select * from v")
def approved_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values approved for a workbook, in canonical dimensions and units, or the first fault of each target."""
    return _approved(spark, sf_dir)[0]


@query(APPROVED + """
select count(*) filter (code = 'ok') as values, count(*) filter (code not in ('ok', 'absent')) as blocked, min(target) filter (code not in ('ok', 'absent')) as first, case when count(*) filter (code not in ('ok', 'absent')) > 0 then 'blocked' when count(*) filter (code = 'ok') = 0 then 'VALIDATED_VALUE_SET_EMPTY' else 'approved' end as status, null::varchar as content_hash from v""")
def approved_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set as a whole: all or nothing."""
    return _approved(spark, sf_dir)[1]


BINDINGS = """
select c_custkey as binding, c_custkey % 12 <> 0 as confirmed, concat(case when c_custkey % 2 = 0 then 'Metric ' else 'metric_' end, cast(c_custkey % 50 as string)) as metric, case when c_custkey % 3 = 0 then 'valuation' end as source_type, case when c_custkey % 7 = 0 then 'A1' end as source_address,
  case when c_custkey % 5 <> 4 then concat('s', cast(c_custkey % 4 as string)) end as sheet, c_custkey % 60 as line, 1 as place, c_custkey % 60 + case when c_custkey % 8 = 5 then 1 else 0 end as last_line, 1 as last_place
from {customer}"""
SCALARS = """
select s_suppkey as nth, concat('METRIC', cast(s_suppkey % 20 as string)) as metric, case when s_suppkey % 2 = 0 then 'valuation' else 'report' end as source_type, case when s_suppkey % 3 = 0 then 'A1' else 'B2' end as source_address, concat('v', cast(s_suppkey as string)) as value from {supplier}"""
CELLS = """
select sheet, line, 1 as place, case when min(k) % 6 = 0 then '' else concat('t', cast(min(k) as string)) end as text, case when min(k) % 4 = 1 then concat('=A', cast(min(k) as string)) end as formula
from (select concat('s', cast(p_partkey % 4 as string)) as sheet, p_partkey % 53 as line, p_partkey as k from {part}) as p group by sheet, line"""


@query(f"""
with {views(b=BINDINGS, s=SCALARS, c=CELLS)},
f as (select binding, arg_min(struct_pack(v := s.value, t := s.source_type, a := s.source_address), nth) as s from b join s on lower(regexp_replace(b.metric, '[\\s_-]+', '', 'g')) = lower(s.metric) and coalesce(b.source_type, s.source_type) = s.source_type and coalesce(b.source_address, s.source_address) = s.source_address where confirmed group by 1),
j as (select b.*, f.s, c.text, c.formula, case when not confirmed then 'BINDING_NOT_CONFIRMED' when f.s is not null then null when b.sheet is null then 'SCALAR_SOURCE_REQUIRED' when last_line <> b.line then 'SCALAR_SOURCE_CELL_UNAVAILABLE' when coalesce(c.text, '') = '' then 'SCALAR_SOURCE_CELL_EMPTY' end as blocker
  from b left join f using (binding) left join c on c.sheet = b.sheet and c.line = b.line and c.place = b.place)
select binding, case when blocker is null then 'ready' else 'blocked' end as status, blocker, case when blocker is null then coalesce(s.v, text) end as value, case when blocker is null then case when s is not null then 'authoritative' when formula is not null then 'formula' else 'workbook' end end as authority,
  case when blocker is null then case when s is not null then s.t || ':' || s.a else sheet || '!R' || line || 'C1' || coalesce(':' || formula, '') end end as decision from j""")
def scalar_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars for a report: the approved one of the metric, else one cell."""
    named = {"line": "row", "place": "col", "last_line": "last_row", "last_place": "last_col"}
    return O.scalar_bindings(view(spark, sf_dir, BINDINGS).withColumnsRenamed(named), view(spark, sf_dir, SCALARS), view(spark, sf_dir, CELLS).withColumnsRenamed(named))


@query(f"""
with c as (select o_custkey as project, 'S' || (o_orderkey % 3) as sheet, 'A' || o_orderkey as address, case o_orderkey % 8 when 0 then '#N/A' when 1 then ' ' when 2 then ' #div/0!' when 3 then '#NAME?' else o_totalprice::decimal(12,2)::varchar end as display from orders)
select project, count(*) as cells, 'excel-consensus-fallback:' || project || ':' || substr({_digest("sheet || '!' || address || '=' || display")}, 1, 24) as source_key from c where trim(display) <> '' and not regexp_matches(trim(display), '(?i)^#(N/A|VALUE|REF|DIV/0)') group by 1""")
def consensus_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus cells of an uploaded workbook as a source of last resort."""
    k = F.col("o_orderkey")
    shown = F.when(k % 8 == 0, "#N/A").when(k % 8 == 1, " ").when(k % 8 == 2, " #div/0!").when(k % 8 == 3, "#NAME?").otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
    cells = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.concat(F.lit("S"), (k % 3).cast("string")).alias("sheet"), F.concat(F.lit("A"), k.cast("string")).alias("address"), shown.alias("display"))
    return O.consensus_fallback(cells)


@query("select page_id, trim(regexp_replace(nfc_normalize(html), '\\s+', ' ', 'g')) as key from pages")
def quote_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in canonical form with single blanks, by which quotes are looked for."""
    return table(spark, sf_dir, "pages").select("page_id", quote_key("html").alias("key"))
