"""Discovery and snapshot queries: lines as worksheet cells and page objects, events as result envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import densecharts as D
from ..operators import regions as R
from ..operators import snapshots as N
from ..operators import targets as T
from ..registry import query, table, view, views

#: Lines as labelled cells of six kinds of sheets.
LABELLED = """
select (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey % 10000 as nth, sheet, case sheet % 6 when 0 then '12_p4_손익계산서' when 1 then '13_P4_대차대조표' when 2 then '14_p4_주당지표' when 3 then '08_도표4_분기' when 4 then '11_도표7_전망' else '99_기타' end as name,
  concat(substring('abcdefg', l_linenumber, 1), cast(l_orderkey % 64 + 1 as string)) as address,
  concat(case l_partkey % 10 when 0 then ' 매출액' when 1 then '영업이익(손실)' when 2 then 'OP' when 3 then '자산 총계' when 4 then '매출총이익' when 5 then '영업이익률' when 6 then 'EPS' when 7 then '매출액 성장률' when 8 then 'Controlling_Net_Income' else '' end,
    case l_suppkey % 6 when 0 then ' · 2025F' when 1 then 'ㆍ2025 e' when 2 then ' · 2026F' when 3 then '· 1Q26' when 4 then ' · 4Q25F ' else '1Q26' end) as label,
  case when l_orderkey % 5 = 0 then 'n/a' when l_orderkey % 5 = 1 then '1,234.5' else cast(cast(floor(l_quantity) as int) as string) end as value, case when l_tax > 0.06 then '=A1' when l_tax > 0.04 then '' end as formula
from (select *, cast(floor(l_orderkey / 64) as int) as sheet from {lineitem}) as x"""
_RULES = ", ".join(f"('{name}', '{rule}', '{metric}', '{kind}')" for rule, metric, kind, labels in T.RULES for name in (rule, metric, *labels))


@query(f"""
with {views(x=LABELLED)}, rules as (select distinct lower(regexp_replace(name, '\\s+', '', 'g')) as key, rule, metric_id, balance from (values {_RULES}) as t(name, rule, metric_id, balance)),
c as (select *, trim(label) as l, regexp_matches(value, '^[0-9,.]+$') as num, sheet % 6 as kind, l_row from (select *, regexp_extract(address, '[0-9]+') as l_row from x)),
y as (select nth, sheet, name, upper(address) as address, '2025년 연간' as period, null::int as q, 'actual:' || sheet || ':' || upper(address) || ':2025' as target_id, trim(regexp_replace(l, '\\s*[·ㆍ]\\s*2025\\s*[FfEe]\\s*$', '')) as metric from c where kind <= 2 and num and regexp_matches(l, '(^|[·ㆍ]\\s*)2025\\s*[FfEe]\\s*$')),
o as (select *, case when regexp_matches(l, '^\\s*[1-4]Q[0-9]{{2}}\\s*[FfEe]?\\s*$') then '' when upper(trim(regexp_replace(l, '\\s*[·ㆍ]\\s*[1-4]Q[0-9]{{2}}\\s*[FfEe]?\\s*$', ''))) = 'OP' then '영업이익' else trim(regexp_replace(l, '\\s*[·ㆍ]\\s*[1-4]Q[0-9]{{2}}\\s*[FfEe]?\\s*$', '')) end as own from c where kind in (3, 4)),
known as (select sheet, l_row, arg_max(own, nth) as row_metric from o where own <> '' and lower(regexp_replace(own, '\\s+', '', 'g')) in (select key from rules) and not regexp_matches(own, '성장률|이익률') group by 1, 2),
p as (select o.*, row_metric, case when kind = 4 and regexp_matches(l, '(^|[·ㆍ]\\s*)4Q25\\s*[FfEe]?\\s*$') then [2025, 4] when regexp_matches(l, '(^|[·ㆍ]\\s*)1Q26\\s*[FfEe]?\\s*$') then [2026, 1] end as yq from o left join known using (sheet, l_row) where num and coalesce(formula, '') = ''),
z as (select nth, sheet, name, upper(address) as address, yq[1] || '년 ' || yq[2] || '분기' as period, yq[2] as q, 'quarterly:' || sheet || ':' || upper(address) || ':' || yq[1] || 'Q' || yq[2] as target_id, case when own <> '' then own else coalesce(row_metric, '') end as metric from p where yq is not null),
e as (select u.*, rule, metric_id, balance, case when regexp_matches(metric, '성장률|이익률') then '%' else '십억원' end as unit from (select * from y union all select * from z) u join rules on key = lower(regexp_replace(metric, '\\s+', '', 'g')))
select target_id, sheet, name, address, metric_id, metric, period, case when balance = 'point_in_time' then balance when q is null then 'annual' when q = 4 then 'single_quarter' else 'year_to_date' end as basis, unit, 'KRW_BILLION' as target_unit, rule,
  metric in ('매출액', '영업이익', '세전이익', '당기순이익', '지배주주순이익', '자산총계', '부채총계', '자본총계', '영업활동 현금흐름') as required from e where unit <> '%'""")
def excel_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets to collect, found by the labels of a workbook's cells: last year's forecast column, and plain quarters."""
    return T.discover(spark, view(spark, sf_dir, LABELLED), 2026, 1)


#: Every part is a range of seven rows and seven columns; its size chooses where values, labels and headers are missing.
GRIDS = """
select p_partkey as range, concat('s', cast(p_partkey as string)) as sheet, r as line, k as place, p_size as size, p_partkey % 3 as form,
  case when k = 1 and r > 1 then case when p_size % 7 = 1 and r = 4 then '' when p_partkey % 3 = 0 and p_size % 5 = 2 and r = 5 then ' 출 처 ' when r = 2 then '주가' else concat('PER ', cast(r as string)) end
    when r = 1 and k > 1 then case when p_size % 9 = 4 and k = 3 then ' ' when p_partkey % 3 = 0 then concat('202', cast(k as string)) when k = 2 then 'Price' when k = 5 and p_size % 4 = 1 then 'data Source' else concat('band ', cast(k as string)) end
    when r > 1 then cast(r * k as string) end as text,
  r > 1 and k > 1 and not (p_size % 6 = 3 and r = 3) and not (p_size % 8 = 5 and k = 4 and r > 4) and not (p_size % 10 = 6 and r > 2) and not (p_size % 11 = 7 and r = 2) as number
from {part} cross join (values (1), (2), (3), (4), (5), (6), (7)) as rows(r) cross join (values (1), (2), (3), (4), (5), (6), (7)) as cols(k)"""
#: Form 0 has period columns 2 to 6, form 1 a gap between them, form 2 none.
CHARTS = """
with recursive g as (%s), b as (select distinct range, size, form, size %% 2 = 0 as band from g), keyed as (select range, line, trim(text) as key from g where place = 1),
  f as (select g.range, g.form, g.line, g.place, trim(coalesce(g.text, '')) as text, g.number, key from g join keyed using (range, line)),
  rowed as (select range, line as "at", key as label, 2 as first, 6 as last from f where form = 0 and line > 1 group by range, line, key having key <> '' and replace(key, ' ', '') <> '출처' and count(*) filter (number and place between 2 and 6) >= 3),
  heads as (select range, count(*) filter (text <> '') as named from f where form = 0 and line = 1 and place between 2 and 6 group by 1),
  cols as (select range, place, max(text) filter (line = 1) as label, count(*) filter (line > 1 and number) as filled from f where form > 0 and place > 1 group by 1, 2 having max(text) filter (line = 1) <> '' and not contains(lower(replace(max(text) filter (line = 1), ' ', '')), 'source') and count(*) filter (line > 1 and number) >= 2),
  data as (select distinct f.range, f.line from f join cols using (range, place) where f.line > 1 and number and key <> ''),
  span as (select range, count(*) as n, min(line) as first, max(line) as last from data group by 1),
  full_ as (select c.range, c.place as "at", label, first, last from cols c join span s using (range) join f on f.range = c.range and f.place = c.place and number join data d on d.range = f.range and d.line = f.line where n >= 2 and last - first + 1 = n and first = 2 group by c.range, c.place, label, first, last, n having count(*) / n >= 0.8),
  series as (select * from rowed union all select * from full_),
  counts as (select range, count(*) as series, max(last - first + 1) as points, bool_or(contains(lower(label), 'price') or contains(label, '주가')) as price, bool_or(contains(lower(label), 'per') or contains(lower(label), 'band')) as banded from series group by 1),
  said as (select b.range, case form when 0 then 'rows' else 'columns' end as layout, points, series, case when form = 0 and coalesce(named, 0) < 5 then 'PERIOD_HEADER_MISSING' when form > 0 and n is null then 'SERIES_MISSING' when form > 0 and not (n >= 2 and span.last - span.first + 1 = n and span.first = 2) then 'ROWS_NOT_CONTIGUOUS'
    when series is null then 'SERIES_MISSING' when band and not (form < 2 and points >= 4 and series >= 2 and price and banded) then 'BAND_GATE_CLOSED' else 'chart' end as status from b left join heads using (range) left join counts using (range) left join span using (range))
""" % GRIDS.format(part="part")


def _grids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = view(spark, sf_dir, GRIDS).withColumnsRenamed({"line": "row", "place": "col"})
    columns = lambda *xs: F.array(*[F.lit(x) for x in xs])
    periods = F.when(F.col("form") == 0, columns(2, 3, 4, 5, 6, 9)).when(F.col("form") == 1, columns(2, 4, 5, 6)).otherwise(F.array().cast("array<int>"))
    r = g.select("range", "sheet", "size", "form").distinct().select("range", "sheet", periods.alias("periods"), (F.col("size") % 2 == 0).alias("band"))
    return r.withColumns({k: F.lit(v) for k, v in (("top", 1), ("left", 1), ("bottom", 7), ("right", 7), ("header", 1), ("key", 1))}), g.select("sheet", "row", "col", "text", "number")


@query(CHARTS + "select range, layout, case when status = 'chart' then points end as points, case when status = 'chart' then series end as series, status from said")
def dense_chart_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a dense range a chart: periods across or series down, and the gate of band charts."""
    return D.dense_charts(*_grids(spark, sf_dir))[0]


@query(CHARTS + "select range, \"at\", label, first, last from series where range in (select range from said where status = 'chart')")
def dense_chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of the ranges that are charts."""
    return D.dense_charts(*_grids(spark, sf_dir))[1]


@query("""
with o as (select l_orderkey // 16 as page, l_orderkey, l_linenumber, case when l_partkey % 9 > 0 then [l_orderkey % 3, l_linenumber % 4] end as path, l_suppkey % 3 as z, (l_partkey % 50) * 10 as x0, (l_orderkey % 16) * 50 + l_linenumber * 7 as y0, '  ' || l_returnflag || l_orderkey || '   part ' || l_partkey || chr(10) as text from lineitem),
r as (select distinct page, page || '-' || k as region, k * 100 as x0, k * 150 as y0, k * 100 + 300 as x1, k * 150 + 400 as y1 from o, (values (0), (1), (2), (9)) as t(k)),
j as (select region, o.*, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ', chr(10), 'g') as words from r join o on o.page = r.page and o.x0 < r.x1 and o.x0 + 80 > r.x0 and o.y0 < r.y1 and o.y0 + 9 > r.y0)
select r.region, coalesce(sum(3) filter (words is not null), 0)::bigint as tokens, sha256(coalesce(string_agg(words, chr(10) order by path nulls first, j.y0, j.x0, z, words), '')) as hash from r left join j on j.region = r.region group by 1""")
def region_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the objects that a region cuts, hashed in the order of their container paths."""
    c = F.col
    o = table(spark, sf_dir, "lineitem").select(
        F.floor(c("l_orderkey") / 16).alias("page"), F.when(c("l_partkey") % 9 > 0, F.array(c("l_orderkey") % 3, (c("l_linenumber") % 4).cast("long"))).alias("path"), (c("l_suppkey") % 3).alias("z"), (c("l_partkey") % 50 * 10).alias("x0"), (c("l_orderkey") % 16 * 50 + c("l_linenumber") * 7).alias("y0"),
        F.concat(F.lit("  "), "l_returnflag", c("l_orderkey").cast("string"), F.lit("   part "), c("l_partkey").cast("string"), F.lit("\n")).alias("text"),
    ).withColumn("x1", c("x0") + 80).withColumn("y1", c("y0") + 9)
    k = F.explode(F.array(*[F.lit(x) for x in (0, 1, 2, 9)]))
    r = o.select("page").distinct().select("page", k.alias("k")).select("page", F.concat_ws("-", "page", "k").alias("region"), (c("k") * 100).alias("x0"), (c("k") * 150).alias("y0"), (c("k") * 100 + 300).alias("x1"), (c("k") * 150 + 400).alias("y1"))
    return R.token_hashes(o, r)


#: Events as envelopes; the event's number chooses a fault. Payloads repeat, so that a store holds fewer than there are envelopes.
PAYLOADS = """
select event_id, case event_id % 3 when 0 then concat('{{"value":"', cast(user_id as string), '","unit":"KRW","note":"', event_type, ' of a user whose number is ', cast(user_id as string), '"}}')
  when 1 then concat('{{"rows":[[', cast(user_id as string), ',"', event_type, '"],[1,null]]}}') else concat('{{"series":[{{"v":[1,', cast(user_id as string), ']}}],"categories":["a","b"]}}') end as given,
  case event_id % 3 when 0 then concat('{{"note":"', event_type, ' of a user whose number is ', cast(user_id as string), '","unit":"KRW","value":"', cast(user_id as string), '"}}')
  when 1 then concat('{{"rows":[[', cast(user_id as string), ',"', event_type, '"],[1,null]]}}') else concat('{{"categories":["a","b"],"series":[{{"v":[1,', cast(user_id as string), ']}}]}}') end as sorted,
  case event_id % 3 when 0 then 'scalar' when 1 then 'table' else 'chart' end as type, event_id % 20 as fault
from {events}"""
SAID = """case fault when 1 then 'ENVELOPE_NOT_AN_OBJECT' when 2 then 'ENVELOPE_NOT_AN_OBJECT' when 3 then 'SCHEMA_VERSION_UNSUPPORTED' when 4 then 'ATTEMPT_INVALID' when 5 then 'SEQUENCE_INVALID' when 6 then 'INPUT_VERSIONS_INVALID' when 7 then 'RESULT_TYPE_UNKNOWN' when 8 then 'PAYLOAD_MISSING'
  when 9 then 'PAYLOAD_NOT_OF_TYPE' when 10 then 'RESULTS_INVALID' when 11 then 'RESULT_HASH_MISMATCH' else 'ok' end"""


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    p = view(spark, sf_dir, PAYLOADS)
    fault = lambda n, bad, good: F.when(c("fault") == n, bad).otherwise(good)
    number = c("event_id").cast("string")
    digest = fault(11, F.lit("0" * 64), F.sha2("sorted", 256))
    body = F.concat(
        F.lit('{ "schemaVersion": '), fault(3, "2", "1"), F.lit(', "attempt": '), fault(4, '"x"', "3"), F.lit(', "sequence": '), fault(5, F.lit("-1"), number), F.lit(', "inputVersionIds": '), fault(6, F.lit('["a", null]'), F.concat(F.lit('["v'), number, F.lit('", "w"]'))),
        F.lit(', "resultType": "'), fault(7, F.lit("picture"), c("type")), F.lit('", "payload": '), F.when(c("fault") == 8, "null").when(c("fault") == 9, '{"other": 1}').otherwise(c("given")), F.lit(', "results": ['), fault(10, F.lit(""), F.concat(F.lit('{"hash": "'), digest, F.lit('"}'))), F.lit("]}"),
    )
    return p.select("event_id", F.when(c("fault") == 1, F.substring(body, 1, 40)).when(c("fault") == 2, F.lit("[1, 2]")).otherwise(body).alias("body"))


@query(f"""
with {views(p=PAYLOADS)}, s as (select *, {SAID} as code from p)
select event_id, code, case when code = 'ok' then 3 end as attempt, case when code = 'ok' then event_id end as sequence, case when code = 'ok' then type end as result_type, case when code = 'ok' then 'v' || event_id || ',w' end as inputs, case when code = 'ok' then sorted end as payload, case when code = 'ok' then sha256(sorted) end as hash from s""")
def result_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker results as JSON, parsed with a code for the first fault and checked against their payload's hash."""
    return N.parse_envelopes(_envelopes(spark, sf_dir), ["event_id"], "body")


@query(f"""
with {views(p=PAYLOADS)}, s as (select event_id, type, case when event_id % 50 = 0 then null else sorted end as t, sha256(sorted) as h from p)
select event_id, case when t is null then null when length(t) < 64 then t when substr(h, 1, 1) = '0' then null when substr(h, 1, 1) = '1' then null else t end as payload,
  case when t is null then 'empty' when length(t) < 64 then 'inline' when substr(h, 1, 1) = '0' then 'lost' when substr(h, 1, 1) = '1' then 'corrupt' else 'restored' end as status from s""")
def hydrated_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads replaced by references and restored from the store, from which some went missing and some were changed."""
    p = view(spark, sf_dir, PAYLOADS).select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("given")).alias("payload"))
    compacted, store = N.compact(p, ["event_id"], "payload")
    first = F.substring("reference", 1, 1)
    damaged = store.where(first != "0").withColumn("payload", F.when(first == "1", F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    return N.hydrate(compacted, damaged, ["event_id"])
