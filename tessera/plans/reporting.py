"""Collection, binding, materialisation and verification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evidence, reporting as R
from ..registry import query, table
from .sheets import CELLS, RANGES, _cells
from ..operators import sheets as S


@query("""
with t as (select distinct o_custkey, year(o_orderdate)::int as y, quarter(o_orderdate)::int as q from orders where o_orderstatus = 'P')
select o_custkey, y as year, q as quarter from t union select o_custkey, y, q - 1 from t where q > 1 union select o_custkey, y - 1, q from t""")
def request_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))
    return R.request_plan(t, "o_custkey", "y", "q")


@query("""
with r as (select l_orderkey, l_linenumber, l_partkey, coalesce(nullif(l_returnflag, 'A'), case when l_orderkey % 2 = 0 then 'R' end) as scope from lineitem)
select l_orderkey, l_linenumber, l_partkey, scope, case when coalesce(min(scope) over w <> max(scope) over w, false) then 'scope_mismatch' when scope is null then 'scope_unknown' else 'validated' end as status from r window w as (partition by l_orderkey)""")
def scope_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing scope is filled only where one scope was asked for; mixed scopes are rejected."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.nullif("l_returnflag", F.lit("A")).alias("scope"))
    asked = F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit("R"))).otherwise(F.array(F.lit("R"), F.lit("N")))
    return R.fill_scope(li, "l_orderkey", "scope", asked)


@query("""
with r as (select o_orderkey, list_distinct(list(l_returnflag order by l_returnflag)) as roles from orders join lineitem on l_orderkey = o_orderkey group by 1)
select o_orderkey, array_to_string(list_sort(case when len(list_intersect(roles, ['N', 'R'])) = 0 then ['N'] else list_intersect(roles, ['N', 'R']) end), ',') as roles from r""")
def allowed_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("roles"))
    return g.select("o_orderkey", F.array_join(F.array_sort(R.allowed_roles(F.col("roles"), F.array(F.lit("N"), F.lit("R")))), ",").alias("roles"))


@query("""
with a as (select l_orderkey as k, l_linenumber as n, min(l_returnflag) as v from lineitem group by 1, 2), b as (select l_orderkey as k, l_linenumber as n, max(l_linestatus) as v from lineitem where l_quantity > 25 group by 1, 2)
select coalesce(a.k, b.k) as k, coalesce(a.n, b.n) as n, coalesce(b.v, a.v) as v, case when b.k is null then 0 else 1 end as layer from a full join b on a.k = b.k and a.n = b.n""")
def cell_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_returnflag", "l_linestatus", "l_quantity")
    a = li.groupBy("k", "n").agg(F.min("l_returnflag").alias("v"))
    return R.overlay(a, li.where("l_quantity > 25").groupBy("k", "n").agg(F.max("l_linestatus").alias("v")), ["k", "n"], "v")


@query("""
with c as (select c_custkey, c_nationkey * 1000 + floor(c_acctbal / 100)::bigint as c_band from customer), s as (select s_suppkey, s_nationkey * 1000 + floor(s_acctbal / 100)::bigint as s_band from supplier)
select c_custkey, s_suppkey from c join s on c_band = s_band union select c_custkey, s_suppkey from c join s on c_custkey = s_suppkey""")
def either_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disjunctive join as the union of two equi joins."""
    band = lambda nation, balance: F.col(nation) * 1000 + F.floor(F.col(balance) / 100)
    c = table(spark, sf_dir, "customer").select("c_custkey", band("c_nationkey", "c_acctbal").alias("c_band"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", band("s_nationkey", "s_acctbal").alias("s_band"))
    return R.either_join(c, s, ("c_band", "s_band"), ("c_custkey", "s_suppkey"), ["c_custkey", "s_suppkey"])


@query(f"""
with {RANGES}, ids as (select *, sheet * 1000000 + row_first * 1000 + col_first as id, (row_last - row_first + 1) * (col_last - col_first + 1) as area from dense where cells >= 2),
h as (select x.sheet, x.r, x.c, id, area from {CELLS} x join ids i on i.sheet = x.sheet and x.r between row_first and row_last and x.c between col_first and col_last)
select t.sheet, t.r, t.c, b.id as range_id, b.area from {CELLS} t left join (select distinct on (sheet, r, c) * from h order by sheet, r, c, area, id) b on b.sheet = t.sheet and b.r = t.r and b.c = t.c""")
def best_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest range around each cell, if any."""
    cells = _cells(spark, sf_dir)
    r = S.dense_ranges(cells, "sheet", "r", "c", 2, 0.0).withColumn("range_id", F.col("sheet") * 1000000 + F.col("row_first") * 1000 + F.col("col_first"))
    return R.best_cover(cells.select("sheet", "r", "c"), r, "sheet", "r", "c", ["sheet", "r", "c"], "range_id")


@query("""
with g as (select l_orderkey, '[' || string_agg('{"slot":' || l_linenumber || ',"value":"' || l_returnflag || '"}', ',' order by l_linenumber, l_returnflag) || ']' as j, bool_or(l_quantity > 48) as blocked from lineitem group by 1)
select l_orderkey, case when blocked then 'blocked' else 'ready' end as status, case when not blocked then sha256(j) end as content_hash from g""")
def materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts as JSON with their content hash; one blocked item blocks all."""
    return R.materialise(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_orderkey", "l_returnflag", F.col("l_quantity") > 48)


@query("""
with e as (select user_id, event_id, event_type, case when event_id % 211 = 0 then 99 else row_number() over (partition by user_id order by ts, event_id) end as rev, row_number() over (partition by user_id order by ts, event_id) as n from events)
select user_id, count(*) as edits, case when bool_and(rev = n) then 'applied' else 'revision_conflict' end as status, case when bool_and(rev = n) then arg_max(event_type, n) end as event_type from e group by 1""")
def fold_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered edit fold with a revision check, all or nothing."""
    e = table(spark, sf_dir, "events").withColumn("rev", F.when(F.col("event_id") % 211 == 0, 99).otherwise(F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))))
    return R.fold_edits(e, "user_id", ["ts", "event_id"], "rev", F.lit(1), "event_type")


@query(f"""
with w as (select sheet, max(c) - min(c) + 1 as w from {CELLS} group by 1), p as (select sheet, r, count(distinct c) as points from {CELLS} group by 1, 2)
select sheet, r, points, round(points / w::double, 6) as share from p join w using (sheet) where points >= 2 and round(points / w::double, 6) >= 0.2""")
def period_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.period_series(_cells(spark, sf_dir), ["sheet"], "r", "c", 2, 0.2)


@query("""
with p as (select user_id, event_type, count(*) as n, max(event_id % 50) as m from events group by 1, 2)
select user_id, count(*) as series, case when min(n) = max(n) and min(m) = max(m) then min(n) end as points, case when min(n) = max(n) and min(m) = max(m) then 'ready' else 'series_length_mismatch' end as status from p group by 1""")
def zip_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned series or a blocked chart."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("event_id") % 50)
    return R.zip_series(e, "user_id", "event_type", "at", "value")


@query("""
with b as (select l_orderkey, l_linenumber, max(l_quantity) as v from lineitem group by 1, 2), a as (select l_orderkey, l_linenumber, case when l_orderkey % 9 = 0 then v + 1 else v end as v from b where l_orderkey % 31 <> 0)
select coalesce(b.l_orderkey, a.l_orderkey) as l_orderkey, coalesce(b.l_linenumber, a.l_linenumber) as l_linenumber, b.v as before_value, a.v as after_value, case when coalesce(b.l_orderkey, a.l_orderkey) % 18 = 0 then 'allowed' else 'unexpected_change' end as status
from b full join a on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber where a.v is distinct from b.v""")
def verify_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a patch changed, against what it was allowed to."""
    b = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("v"))
    a = b.where("l_orderkey % 31 <> 0").withColumn("v", F.when(F.col("l_orderkey") % 9 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return R.verify_patch(b, a, b.where("l_orderkey % 18 = 0"), ["l_orderkey", "l_linenumber"], "v")


@query("""
with x as (select p_partkey, p_name, p_type, p_brand, p_retailprice, p_size from part)
select p_partkey, case when p_brand = 'Brand#13' then 'EXCLUDED_HOST' when p_type like '%STEEL' then 'COMPANY_PUBLISHER' when p_name like '%green%' then 'PRESS_RELEASE' when p_size not between 5 and 45 then 'OUTSIDE_WINDOW' when p_retailprice > 1800 then 'MODIFIED_AFTER_CUTOFF' end as reason,
  not (p_brand = 'Brand#13' or p_type like '%STEEL' or p_name like '%green%' or p_size not between 5 and 45 or p_retailprice > 1800) as eligible from x""")
def news_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered eligibility chain with the first reason against."""
    checks = [("EXCLUDED_HOST", F.col("p_brand") != "Brand#13"), ("COMPANY_PUBLISHER", ~F.col("p_type").endswith("STEEL")), ("PRESS_RELEASE", ~F.col("p_name").contains("green")), ("OUTSIDE_WINDOW", F.col("p_size").between(5, 45)), ("MODIFIED_AFTER_CUTOFF", F.col("p_retailprice") <= 1800)]
    reason = evidence.first_failure(checks)
    return table(spark, sf_dir, "part").select("p_partkey", reason.alias("reason"), reason.isNull().alias("eligible"))


@query("""
with o as (select o_custkey, o_orderkey, o_totalprice::decimal(18,2) as v, lag(o_totalprice::decimal(18,2)) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders)
select o_custkey, o_orderkey, v - before as delta, round(v, 0) is not distinct from round(before, 0) as same_rounded, (round((v::double - 800) / (600000 - 800) * 480, 4)) as plot_x from o""")
def value_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change against the value before, equality at a precision, and a linear plot scale."""
    v = F.col("o_totalprice").cast("decimal(18,2)")
    o = table(spark, sf_dir, "orders").withColumn("v", v).withColumn("before", F.lag("v").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return o.select("o_custkey", "o_orderkey", (F.col("v") - F.col("before")).cast("decimal(19,2)").alias("delta"), F.round("v", 0).eqNullSafe(F.round("before", 0)).alias("same_rounded"), F.round((F.col("v").cast("double") - 800) / (600000 - 800) * 480, 4).alias("plot_x"))


@query("""
with q as (select o_orderkey as question, list(distinct l_linenumber) filter (where l_quantity > 10) as allowed from orders join lineitem on l_orderkey = o_orderkey group by 1), a as (select l_orderkey as question, list(distinct l_linenumber) filter (where l_discount > 0.05) as used from lineitem group by 1)
select question, coalesce(len(list_filter(used, lambda x: not list_contains(coalesce(allowed, []::int[]), x))), 0)::bigint as ungrounded, case when used is null then 'EVIDENCE_MISSING' when len(list_filter(used, lambda x: not list_contains(coalesce(allowed, []::int[]), x))) > 0 then 'EVIDENCE_NOT_ALLOWED' else 'grounded' end as status from q join a using (question)""")
def answer_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited evidence must be a subset of what is linked and passed."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("question")).agg(F.collect_set(F.when(F.col("l_quantity") > 10, F.col("l_linenumber"))).alias("allowed"), F.collect_set(F.when(F.col("l_discount") > 0.05, F.col("l_linenumber"))).alias("used"))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question"))
    out = F.size(F.array_except("used", "allowed"))
    return g.join(known, "question", "left_semi").select("question", out.cast("long").alias("ungrounded"), F.when(F.size("used") == 0, "EVIDENCE_MISSING").when(out > 0, "EVIDENCE_NOT_ALLOWED").otherwise("grounded").alias("status"))


@query("""
with d as (select p_partkey % 500 as code, p_partkey, p_name, 0 as load from part where p_partkey % 3 <> 0 union all select p_partkey % 500, p_partkey, p_type, 1 from part where p_partkey % 3 = 0),
r as (select *, row_number() over (partition by code order by load desc, p_partkey desc) as n from d) select code, p_partkey, p_name as name from r where n = 1""")
def directory_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory from two sources; the last load wins per code."""
    from ..operators import asof

    p = table(spark, sf_dir, "part").withColumn("code", F.col("p_partkey") % 500)
    a = p.where("p_partkey % 3 <> 0").select("code", "p_partkey", F.col("p_name").alias("name"), F.lit(0).alias("load"))
    both = a.unionByName(p.where("p_partkey % 3 = 0").select("code", "p_partkey", F.col("p_type").alias("name"), F.lit(1).alias("load")))
    return asof.latest_per_key(both, ["code"], [F.col("load"), F.col("p_partkey")], ["p_partkey", "name"])


@query("""
with e as (select o_custkey, year(o_orderdate)::int as y, count(*) as n from orders group by 1, 2), x as (select c_custkey, unnest([1997, 1998, 1999]) as y from customer), m as (select e.o_custkey as k, e.y, e.n, 'explicit' as source from e where e.y between 1997 and 1999)
select k, y, n, source from m union all select c_custkey, x.y, 0, 'synthesised' from x where not exists (select 1 from m where m.k = c_custkey and m.y = x.y)""")
def relation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit candidates, and synthesised ones where there are none."""
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n")).where("y between 1997 and 1999").withColumn("source", F.lit("explicit"))
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.array(F.lit(1997), F.lit(1998), F.lit(1999))).alias("y"))
    return m.unionByName(x.join(m, ["k", "y"], "left_anti").withColumn("n", F.lit(0).cast("long")).withColumn("source", F.lit("synthesised")))
