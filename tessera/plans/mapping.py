"""Mapping queries: orders as templates and outlines, their lines as slots and pages, parts as workbook candidates and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mapping as M
from ..registry import query, table, view, views

METRIC = "case {k} when 0 then 'target_price' when 1 then 'current_price' when 2 then 'revenue' when 3 then 'forward_eps' when 4 then 'target_per' when 5 then 'investment_opinion' when 6 then 'figure_2_chart' when 7 then 'eps' else 'other metric' end"
SLOTS = f"""
select l_orderkey as template, (cast(l_linenumber as bigint) * 100000 + l_partkey) * 10000 + l_suppkey % 10000 as slot_no, {METRIC.replace('{k}', 'l_partkey % 10')} as metric, case when l_suppkey % 5 = 0 then 'table' when l_suppkey % 7 = 0 then 'chart' else 'decimal' end as type, l_quantity > 20 as required from {{lineitem}}"""
CANDIDATES = """
select l_orderkey as template, (cast(l_linenumber as bigint) * 100000 + l_partkey) * 10000 + l_suppkey % 10000 as slot_no, concat('c', cast(l_partkey * 10 + n as string)) as candidate, (l_suppkey + n * 3) % 5 as nth, (l_partkey + n) % 5 = 0 as selected
from {lineitem} cross join (values (0), (1), (2)) as t(n)"""
MARKETS = "select o_orderkey as template, case when o_orderkey % 3 = 0 then 'available' else 'unavailable' end as price from {orders} where o_orderkey % 4 > 0"
BUILT = f"""
with {views(s0=SLOTS, c0=CANDIDATES, m=MARKETS)}, v as (select unnest(['forward_eps', 'target_per', 'target_price']) as metric),
d as (select * from (values ('current_price', true), ('figure_2_chart', false), ('investment_opinion', true)) as t(metric, exclusive)),
s as (select template, slot_no::varchar as slot, metric, type, required from s0 union all select q.template, 'valuation:' || v.metric, v.metric, 'decimal', false from (select distinct template from s0) q, v
  where not exists (select 1 from s0 x where x.template = q.template and x.metric = v.metric and x.type not in ('table', 'chart'))),
e as (select s.*, d.exclusive, d.metric is not null as later, m.price, coalesce(s.metric = 'current_price' and m.price = 'available', false) as priced from s left join d using (metric) left join m using (template)),
b as (select e.template, e.slot, arg_min(candidate, (nth, candidate)) as candidate, any_value(type) as type from e join c0 on c0.template = e.template and c0.slot_no::varchar = e.slot where selected and not priced and not coalesce(exclusive, false) group by 1, 2),
bound as (select template, slot, candidate, case when type in ('table', 'chart') then type else 'scalar' end as kind, 'WORKBOOK_CANDIDATE' as reasons from b union all select template, slot, 'market', 'market_data', 'MARKET_PRICE_AUTHORITY' from e where priced),
"""


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    named = lambda q: view(spark, sf_dir, q).withColumn("slot", F.col("slot_no").cast("string")).drop("slot_no")
    return M.mapping_sets(spark, named(SLOTS), named(CANDIDATES), view(spark, sf_dir, MARKETS))


@query(BUILT + "last as (select 1) select template, slot, candidate, kind, reasons from bound")
def mapping_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate that each slot of a report is bound to; a market price goes before the workbook."""
    return _sets(spark, sf_dir)[0]


@query(BUILT + """
j as (select e.*, bound.slot is not null as is_bound from e left join bound using (template, slot)),
g as (select template, count(*) as slots, count(*) filter (required) as required, count(*) filter (is_bound) as bindings, count(*) filter (required and not is_bound and not later) as unmapped, max(price) as price,
  list_filter([case when not bool_or(metric = 'forward_eps' and type not in ('table', 'chart') and is_bound) then 'forward_eps' end, case when not bool_or(metric = 'target_per' and type not in ('table', 'chart') and is_bound) then 'target_per' end, case when not bool_or(metric = 'target_price' and type not in ('table', 'chart') and is_bound) then 'target_price' end], lambda x: x is not null) as lost from j group by 1)
select template, case when unmapped = 0 then 'confirmed' else 'blocked' end as status, slots, required, bindings, unmapped,
  array_to_string(list_filter([case when unmapped > 0 then 'REQUIRED_MAPPING_UNRESOLVED:' || unmapped end, case when price = 'unavailable' then 'MARKET_PRICE_PENDING' end, case when len(lost) > 0 then 'VALUATION_OUTPUT_MAPPING_UNRESOLVED:' || array_to_string(lost, '/') end], lambda x: x is not null), ',') as warnings from g""")
def mapping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping sets with their state, counts and warnings."""
    return _sets(spark, sf_dir)[1]


_NAMES = ", ".join(f"('{m}', '{n}')" for m, names in M.ALIASES.items() for n in (m, *names))
LABELS = """
select p_partkey as label, case p_partkey % 8 when 0 then 'Target  Price' when 1 then '매출' when 2 then ' Sales!' when 3 then 'eps' when 4 then '[Target PER]' when 5 then 'other-metric' when 6 then 'Forward EPS' else p_name end as text from {part}"""


@query(f"""
with {views(s=SLOTS, l=LABELS)}, names as (select distinct metric, regexp_replace(lower(name), '[^0-9a-z가-힣]', '', 'g') as key from (values {_NAMES}) as t(metric, name)),
m as (select distinct metric from s), k as (select m.metric, coalesce(n.key, regexp_replace(lower(m.metric), '[^0-9a-z가-힣]', '', 'g')) as key from m left join names n using (metric))
select distinct k.metric as slot, label from k join l on regexp_replace(lower(text), '[^0-9a-z가-힣]', '', 'g') = key""")
def alias_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a workbook that name a metric by one of its aliases."""
    metrics = view(spark, sf_dir, SLOTS).select("metric").distinct().select(F.col("metric").alias("slot"), "metric")
    return M.alias_matches(spark, metrics, view(spark, sf_dir, LABELS))


@query("""
with t as (select conv_id, turn, case (conv_id + turn) % 12 when 0 then ' Buy: ' when 1 then '매수 ' when 2 then '매수세 ' when 3 then 'Trailing P / E of ' when 4 then '목표 주가 ' when 5 then 'Fwd. EPS ' when 6 then '매출 ' when 7 then '지배주주순이익 ' when 8 then '적용 PER ' when 9 then 'buyers ' else '' end || coalesce(text, '') as text from conversations),
k as (select *, regexp_replace(lower(text), '[^0-9a-z가-힣]', '', 'g') as key from t),
m as (select conv_id, turn, case when regexp_matches(text, '(?i)^\\s*(buy|hold|sell)\\b') or regexp_matches(text, '^\\s*(매수|중립|매도)([^\\p{L}\\p{N}_]|$)') then 'investment_opinion' when regexp_matches(text, '(?i)\\bp\\s*/\\s*e\\b') then 'per' when regexp_matches(key, '^(목표주가|targetprice)') then 'target_price' when regexp_matches(key, '^(현재주가|currentprice|주가)') then 'current_price'
  when regexp_matches(key, '^매출') then 'revenue' when regexp_matches(key, '^영업이익') then 'operating_profit' when regexp_matches(key, '^(지배주주순이익|순이익)') then 'net_income' when regexp_matches(key, '^(forwardeps|fwdeps|eps)') then 'eps' when regexp_matches(key, '^(targetper|적용per|per)') then 'per' when regexp_matches(key, '^(투자의견|investmentopinion)') then 'investment_opinion' end as metric from k)
select conv_id, turn, metric, case when metric = 'investment_opinion' then 'string' when metric = 'per' then 'decimal' when metric is not null then 'money' end as type, case when metric is not null then metric <> 'investment_opinion' end as required from m""")
def inferred_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric that a text begins with."""
    k = (F.col("conv_id") + F.col("turn")) % 12
    lead = F.lit("")
    for n, t in enumerate([" Buy: ", "매수 ", "매수세 ", "Trailing P / E of ", "목표 주가 ", "Fwd. EPS ", "매출 ", "지배주주순이익 ", "적용 PER ", "buyers "]):
        lead = F.when(k == n, t).otherwise(lead)
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(lead, F.coalesce("text", F.lit(""))).alias("text"))
    return t.select("conv_id", "turn", M.infer_metric(F.col("text")).alias("m")).select("conv_id", "turn", "m.*")


PAGES = """
select l_orderkey as outline, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as nth, concat('p', cast(l_partkey as string)) as page, case when l_suppkey % 9 = 0 then '  ' when l_suppkey % 2 = 0 then 'Title' end as title, case when l_tax > 0.07 then 1 else 0 end as blanks, l_suppkey % 11 > 0 as seen from {lineitem}"""


@query(f"""
with {views(p=PAGES)}, o as (select o_orderkey as outline, o_orderkey % 5 > 0 as mapped, o_custkey % 7 > 0 as evidenced from orders), t as (select outline, case when outline % 10 = 3 and nth < 3 then 3 - nth else nth end as nth, page from p where not (outline % 10 = 4 and nth = 2)),
c as (select distinct coalesce(p.outline, t.outline) as outline from p full join t on p.outline = t.outline and p.nth = t.nth where p.page is distinct from t.page)
select outline, 'PAGE_STRUCTURE_CHANGED' as code, null as page from c union all select outline, 'REQUIRED_NARRATIVE_MISSING', page from p where trim(title) = '' or blanks > 0 union all select outline, 'MAPPING_REVALIDATION_REQUIRED', null from o where not mapped
union all select outline, 'EVIDENCE_REVALIDATION_REQUIRED', null from o where not evidenced union all select outline, 'PAGE_REVIEW_REQUIRED', page from p where (outline, page) not in (select (outline, page) from p where seen)""")
def outline_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a report's outline from being approved."""
    p = view(spark, sf_dir, PAGES)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("outline"), (F.col("o_orderkey") % 5 > 0).alias("mapped"), (F.col("o_custkey") % 7 > 0).alias("evidenced"))
    turned = F.when((F.col("outline") % 10 == 3) & (F.col("nth") < 3), 3 - F.col("nth")).otherwise(F.col("nth"))
    t = p.where("not (outline % 10 = 4 and nth = 2)").select("outline", turned.alias("nth"), "page")
    return M.outline_issues(o, p, t, p.where("seen").select("outline", "page"))


ENTRIES = """
select o_orderkey as entry, concat('slot', cast(o_orderkey % 700 as string)) as slot, case o_orderkey % 9 when 0 then 'current_price' when 1 then 'figure_2_chart' when 2 then 'investment_opinion' when 3 then 'target_per' when 4 then 'figure_5_chart' else 'revenue' end as metric, o_custkey % 3 > 0 as required, o_orderkey % 4 > 0 as connected,
  case when o_custkey % 11 = 0 then 'market_data' else 'range' end as source, case when o_custkey % 5 > 0 then concat('sheet', cast(o_custkey % 40 as string)) end as sheet, case o_custkey % 7 when 0 then 'refresh_required' when 1 then 'ready' end as coverage, o_orderkey % 31 = 0 as consensus
from {orders}"""


@query(f"""
with {views(e=ENTRIES)}, x as (select s_suppkey as target, 'sheet' || (s_suppkey % 60) as sheet, ['slot' || (s_suppkey * 3 % 700), 'slot' || (s_suppkey * 7 % 700)] as slots from supplier where s_suppkey % 60 > 25),
n as (select entry, count(distinct target) as k from e join x on list_contains(slots, slot) or x.sheet = e.sheet group by 1),
r as (select e.*, coalesce(k, 0) as k, case metric when 'current_price' then 'x' when 'figure_2_chart' then 'x' when 'investment_opinion' then 'l' else '' end as d,
  case when not connected then 'review_required' when source = 'market_data' then 'ready' when coverage = 'refresh_required' then 'period_refresh_required' when metric in ('current_price', 'figure_2_chart') then 'source_collection_required' when metric = 'investment_opinion' then 'later_stage' when metric = 'target_per' then 'valuation_required' else 'ready' end as readiness from e left join n using (entry)),
b as (select *, case when metric in ('investment_opinion', 'target_per') then 'later_stage' when readiness in ('source_collection_required', 'period_refresh_required') or (not connected and d = 'x') then 'collection_required' when not connected then 'connection_required' else 'carry_forward' end as base from r),
w as (select *, case when consensus then 'SOURCE_NOT_SUPPORTED' when base = 'collection_required' and metric = 'figure_5_chart' then 'LATER_BY_RULE' when base = 'collection_required' and k = 0 then case when required then 'EXECUTABLE_TARGET_MISSING' else 'LATER_WITHOUT_TARGET' end end as reason from b)
select entry, readiness, case when reason in ('SOURCE_NOT_SUPPORTED', 'EXECUTABLE_TARGET_MISSING') then 'connection_required' when reason is not null then 'later_stage' else base end as status, k as executables, reason from w""")
def report_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to be collected, connected or left to a later stage for each entry of a report."""
    k = F.col("s_suppkey")
    slot = lambda n: F.concat(F.lit("slot"), (k * n % 700).cast("string"))
    x = table(spark, sf_dir, "supplier").where("s_suppkey % 60 > 25").select(k.alias("target"), F.concat(F.lit("sheet"), (k % 60).cast("string")).alias("sheet"), F.array(slot(3), slot(7)).alias("slots"))
    return M.report_targets(spark, view(spark, sf_dir, ENTRIES), x)
