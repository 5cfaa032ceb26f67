"""Decimal, unit and valuation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decimals as D
from ..operators import units, valuation
from ..registry import query, table

M = "decimal(18,2)"


@query("""
with u(unit, family, factor) as (values ('KRW','currency',1.0), ('KRW_MILLION','currency',1000000.0), ('KRW_100M','currency',100000000.0), ('PERCENT','ratio',0.01), ('RATIO','ratio',1.0)),
l as (select l_orderkey, l_linenumber, l_extendedprice::decimal(18,2) as v, case l_linenumber % 3 when 0 then 'KRW' when 1 then 'KRW_MILLION' else 'PERCENT' end as su,
  case l_linenumber % 4 when 0 then 'KRW' when 1 then 'KRW_100M' when 2 then 'RATIO' else 'NOPE' end as tu from lineitem)
select l_orderkey, l_linenumber, su as source_unit, tu as target_unit,
  case when s.family is null or t.family is null then 'unit_unknown' when s.family <> t.family then 'family_mismatch' else 'validated' end as status,
  case when s.family = t.family then case when su = tu then 'identity' when s.family = 'ratio' then 'ratio_conversion' else 'unit_scale' end end as rule,
  case when s.family = t.family then round(v * s.factor / t.factor, 4)::double end as converted
from l left join u s on s.unit = su left join u t on t.unit = tu""")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast(M).alias("v"),
        F.when(n % 3 == 0, "KRW").when(n % 3 == 1, "KRW_MILLION").otherwise("PERCENT").alias("source_unit"),
        F.when(n % 4 == 0, "KRW").when(n % 4 == 1, "KRW_100M").when(n % 4 == 2, "RATIO").otherwise("NOPE").alias("target_unit"),
    )
    out = units.convert(spark, li, "v", "source_unit", "target_unit")
    return out.select("l_orderkey", "l_linenumber", "source_unit", "target_unit", "status", "rule", F.round("converted", 4).cast("double").alias("converted"))


@query("""
select l_orderkey, l_linenumber, case when l_discount = 0 then '0' else regexp_replace(regexp_replace((l_discount::decimal(18,4))::varchar, '0+$', ''), '\\.$', '') end as discount_text,
  regexp_replace(regexp_replace((l_quantity::decimal(18,4))::varchar, '0+$', ''), '\\.$', '') as quantity_text, (l_quantity::decimal(18,4) = l_quantity::decimal(18,1)) as same_number from lineitem""")
def canonical_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("decimal(18,4)")
    return li.select("l_orderkey", "l_linenumber", D.canonical(F.col("l_discount").cast("decimal(18,4)")).alias("discount_text"), D.canonical(q).alias("quantity_text"), (D.canonical(q) == D.canonical(F.col("l_quantity").cast("decimal(18,1)"))).alias("same_number"))


@query("""
with t as (select o_orderkey, case o_orderkey % 5 when 0 then ' ' || format('{:,.2f}', o_totalprice) when 1 then o_orderpriority when 2 then '+' || (o_totalprice::decimal(18,2))::varchar || '%' when 3 then '-' || (o_totalprice::decimal(18,2))::varchar else null end as raw from orders)
select o_orderkey, case when regexp_matches(trim(replace(raw, ',', '')), '^-?[0-9]+(\\.[0-9]+)?$') then try_cast(trim(replace(raw, ',', '')) as decimal(30,6)) end as amount,
  case when regexp_matches(regexp_replace(regexp_replace(raw, '[, ]', '', 'g'), '^\\+|%$', '', 'g'), '^-?[0-9]+(\\.[0-9]+)?$') then try_cast(regexp_replace(regexp_replace(raw, '[, ]', '', 'g'), '^\\+|%$', '', 'g') as decimal(30,6)) end as signed_amount,
  regexp_replace(raw, '[^0-9.+-]', '', 'g') as comparable from t""")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict parsing of written numbers: what does not parse is null, never an error."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast(M)
    raw = F.when(k % 5 == 0, F.concat(F.lit(" "), F.format_number("o_totalprice", 2))).when(k % 5 == 1, F.col("o_orderpriority")).when(k % 5 == 2, F.concat(F.lit("+"), p.cast("string"), F.lit("%"))).when(k % 5 == 3, F.concat(F.lit("-"), p.cast("string")))
    o = table(spark, sf_dir, "orders").withColumn("raw", raw)
    return o.select("o_orderkey", D.parse_amount(F.col("raw")).alias("amount"), D.parse_signed(F.col("raw")).alias("signed_amount"), D.comparable(F.col("raw")).alias("comparable"))


@query("""
with y as (select c_nationkey, year(o_orderdate)::int as y, sum(case when o_orderstatus = 'F' then -(o_totalprice::decimal(18,2)) else o_totalprice::decimal(18,2) end)::decimal(24,2) as v
  from orders join customer on c_custkey = o_custkey group by 1, 2),
g as (select a.c_nationkey, a.y, a.v as current_value, b.v as comparison_value, case when b.v = 0 then null else ((a.v - b.v)::double * 100 / b.v::double) end as rate from y a left join y b on a.c_nationkey = b.c_nationkey and a.y = b.y + 1)
select c_nationkey, y, current_value, comparison_value, round(rate, 4) as rate, case when rate is null then 'not_computable' when abs(rate - (case when c_nationkey % 2 = 0 then round(rate, 1) else round(rate, 1) + 1 end)) <= 0.1 then 'passed' else 'failed' end as status from g""")
def growth_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed sums by year, growth recomputed and a reported rate checked within 0.1 points."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    v = o.groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(D.signed_sum(F.when(F.col("o_orderstatus") == "F", "subtract").otherwise("add"), F.col("o_totalprice").cast(M)).cast("decimal(24,2)").alias("current_value"))
    before = v.select("c_nationkey", (F.col("y") + 1).alias("y"), F.col("current_value").alias("comparison_value"))
    j = v.join(before, ["c_nationkey", "y"], "left")
    rate = D.growth_percent(F.col("current_value"), F.col("comparison_value")).cast("decimal(20,8)")
    said = F.round(rate, 1) + F.when(F.col("c_nationkey") % 2 == 0, 0).otherwise(1)
    return j.select("c_nationkey", "y", "current_value", "comparison_value", F.round(rate, 4).cast("double").alias("rate"), D.growth_check(F.col("current_value"), F.col("comparison_value"), said).alias("status"))


@query("""
with t as (select p_partkey, p_size, p_retailprice, case when p_size > 0 then (round(p_retailprice * 100)::bigint * 20 + p_size * 100) // (p_size * 200) end as tenths from part)
select p_partkey, case when tenths between 1 and 1000 then tenths / 10.0 end::double as multiple, round(p_retailprice / (p_size * 20) - 1, 6) as upside from t""")
def inverse_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    price, size = F.col("p_retailprice").cast("decimal(12,2)"), F.col("p_size").cast("decimal(8,0)")
    return p.select("p_partkey", D.inverse_multiple(price, size).cast("double").alias("multiple"), F.round(D.upside(F.col("p_retailprice"), F.col("p_size") * 20), 6).alias("upside"))


@query("""
with p as (select p_partkey, (p_retailprice::decimal(12,2)) as eps, (1 + p_size % 3)::decimal(5,1) as base from part),
e as (select p_partkey, base, i, (eps * (0.9 + 0.05 * i))::decimal(18,4) as axis_eps from p, range(0, 5) r(i)),
m as (select p_partkey, o, greatest((base + o)::decimal(5,1), 0.1::decimal(5,1)) as axis_per from p, range(-2, 3) r(o)),
d as (select p_partkey, axis_per, min(abs(o)) as near from m group by 1, 2)
select e.p_partkey, i::int as eps_step, axis_eps, axis_per, (round((axis_eps * axis_per)::double / 1000) * 1000)::bigint as price, (i = 2 and near = 0) as is_current
from e join d using (p_partkey)""")
def sensitivity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price grid around each part's earnings and multiple; a clamped axis loses its repeated steps."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(12,2)").alias("eps"), (F.col("p_size") % 3 + 1).cast("decimal(5,1)").alias("base"))
    g = valuation.sensitivity_grid(p, ["p_partkey"], "eps", "base")
    return g.select("p_partkey", "eps_step", "axis_eps", "axis_per", F.col("price").cast("long").alias("price"), "is_current")


@query("""
with c as (select l_partkey, year(l_shipdate)::int as y, avg(l_quantity::decimal(18,2)) filter (where l_returnflag = 'N')::decimal(18,4) as base, max(l_discount::decimal(18,2)) filter (where l_returnflag = 'R') as mult,
  max(l_tax::decimal(18,2)) filter (where l_returnflag = 'A') as direct from lineitem group by 1, 2)
select l_partkey, y, (base * mult)::decimal(24,6)::double as band, case when base is null or mult is null then 'component_missing' when direct is not null and direct <> base * mult then 'band_mismatch' else 'ready' end as status from c""")
def pe_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base times multiple per period; a band that is given as well must agree."""
    li = table(spark, sf_dir, "lineitem")
    pick = lambda flag, c: F.when(F.col("l_returnflag") == flag, F.col(c).cast(M))
    c = li.groupBy("l_partkey", F.year("l_shipdate").alias("y")).agg(F.avg(pick("N", "l_quantity")).cast("decimal(18,4)").alias("base"), F.max(pick("R", "l_discount")).alias("multiple"), F.max(pick("A", "l_tax")).alias("direct"))
    out = valuation.band(c, "base", "multiple", "direct")
    return out.select("l_partkey", "y", F.col("band").cast("double").alias("band"), "status")


@query("select event_id, least(60.0, power(2, least(event_id % 9, 6)))::double as wait_s, greatest(value, 50.0) as progress from events")
def backoff_and_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", D.capped_backoff(F.col("event_id") % 9).alias("wait_s"), F.greatest("value", F.lit(50.0)).alias("progress"))
