"""Collection, lookup, layout and transition queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import periods as P
from ..operators import asof
from ..operators import sheets as S
from ..registry import query, table


@query("""
with f as (select *, case when o_orderpriority like '1%' or o_orderpriority like '2%' then 'annual' else 'interim' end as kind from orders where regexp_matches(o_orderpriority, '^[1-4]-') and o_orderdate <= timestamp '1999-12-31')
select distinct on (o_custkey, kind) o_custkey, kind, o_orderkey, o_orderdate from f order by o_custkey, kind, o_orderdate desc, o_orderkey desc""")
def filing_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest filing of each kind whose name fits the pattern, before the cutoff."""
    p = F.col("o_orderpriority")
    f = table(spark, sf_dir, "orders").where(p.rlike("^[1-4]-") & (F.col("o_orderdate") <= F.lit("1999-12-31").cast("timestamp")))
    f = f.withColumn("kind", F.when(p.startswith("1") | p.startswith("2"), "annual").otherwise("interim"))
    return asof.latest_per_key(f, ["o_custkey", "kind"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_orderdate"])


@query("""
with s as (select event_type as series, strftime(ts, '%Y%m%d') as time, max(value) as value from events group by 1, 2)
select series, max(time) filter (where time <= '20240118' and time >= '20231204') as time, arg_max(value, time) filter (where time <= '20240118' and time >= '20231204') as value from s group by 1""")
def fx_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last point of each series inside a window of 45 days before the cutoff."""
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), F.date_format("ts", "yyyyMMdd").alias("time")).agg(F.max("value").alias("value"))
    ok = F.col("time").between("20231204", "20240118")
    return s.groupBy("series").agg(F.max(F.when(ok, F.col("time"))).alias("time"), F.max_by(F.when(ok, F.col("value")), F.when(ok, F.col("time"))).alias("value"))


@query("""
with p as (select o_custkey, strftime(o_orderdate, '%Y%m') as yymm, sum(o_totalprice::decimal(18,2))::decimal(24,2) as v from orders group by 1, 2)
select o_custkey, coalesce(min(yymm) filter (where yymm like '1998%'), min(yymm) filter (where yymm like '%12'), min(yymm)) as chosen from p group by 1""")
def consensus_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first point of the target year, else the first December, else the first."""
    p = table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyyMM").alias("yymm")).distinct()
    pick = lambda cond: F.min(F.when(cond, F.col("yymm")))
    return p.groupBy("o_custkey").agg(F.coalesce(pick(F.col("yymm").startswith("1998")), pick(F.col("yymm").endswith("12")), F.min("yymm")).alias("chosen"))


@query("select p_partkey, p_brand, p_type from part where p_brand in (select distinct p_brand from part where p_size = 50) and p_partkey not in (select l_partkey from lineitem where l_quantity > 49)")
def universe_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in a list that is itself data, without what another table excludes."""
    p = table(spark, sf_dir, "part")
    listed = p.where("p_size = 50").select("p_brand").distinct()
    out = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return p.join(listed, "p_brand", "left_semi").join(out, "p_partkey", "left_anti").select("p_partkey", "p_brand", "p_type")


@query("""
with b as (select l_orderkey, l_linenumber, l_suppkey || ':' || upper(l_shipmode_) as k from (select *, case when l_linenumber % 2 = 0 then 'a' || (l_partkey % 9) else 'A' || (l_partkey % 9) end as l_shipmode_ from lineitem)),
c as (select s_suppkey || ':A' || r as k, s_nationkey * 10 + r as cell from supplier, range(0, 8) t(r))
select l_orderkey, l_linenumber, b.k as address, cell, case when cell is null then 'CELL_MISSING' else 'bound' end as status from b left join c using (k)""")
def binding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings joined to cells by sheet and upper-case address; a missing cell is a status."""
    li = table(spark, sf_dir, "lineitem").withColumn("raw", F.concat(F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("A"), (F.col("l_partkey") % 9).cast("string")))
    b = li.select("l_orderkey", "l_linenumber", F.concat_ws(":", F.col("l_suppkey").cast("string"), F.upper("raw")).alias("address"))
    c = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("r"))
    c = c.select(F.concat(F.col("s_suppkey").cast("string"), F.lit(":A"), F.col("r").cast("string")).alias("address"), (F.col("s_nationkey") * 10 + F.col("r")).cast("long").alias("cell"))
    return b.join(c, "address", "left").select("l_orderkey", "l_linenumber", "address", "cell", F.when(F.col("cell").isNull(), "CELL_MISSING").otherwise("bound").alias("status"))


@query("""
with t as (select o_custkey, year(o_orderdate)::int as y, quarter(o_orderdate)::int as q, case when o_orderkey % 2 = 0 then 'yoy' else 'qoq' end as kind from orders where o_orderstatus = 'F'),
a as (select o_custkey, y, q from t union select o_custkey, case when kind = 'yoy' then y - 1 when q = 1 then y - 1 else y end, case when kind = 'yoy' then q when q = 1 then 4 else q - 1 end from t)
select o_custkey, string_agg(q || 'Q' || lpad((y % 100)::varchar, 2, '0'), ',' order by y * 4 + q desc) as periods from a group by 1""")
def period_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All periods that questions ask for and compare with, newest first."""
    t = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.when(F.col("o_orderkey") % 2 == 0, "yoy").otherwise("qoq").alias("kind"))
    i = F.array(P.index(F.col("y"), F.col("q")), P.index(P.comparison_period(F.col("y"), F.col("q"), F.col("kind"))["year"], P.comparison_period(F.col("y"), F.col("q"), F.col("kind"))["quarter"]))
    g = t.select("o_custkey", F.explode(i).alias("i")).groupBy("o_custkey").agg(F.sort_array(F.collect_set("i"), asc=False).alias("s"))
    return g.select("o_custkey", F.array_join(F.transform("s", lambda x: P.label(P.of_index(x)["year"], P.of_index(x)["quarter"])), ",").alias("periods"))


@query("""
with j as (select o_orderkey, o_orderstatus as st, bool_or(l_returnflag = 'R') as hit from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
tr(st, hit, next_state) as (values ('F', true, 'needs_update'), ('O', true, 'blocked'), ('P', true, 'needs_update'), ('F', false, 'approved'), ('O', false, 'draft'))
select o_orderkey, st, hit, coalesce(next_state, 'unchanged') as next_state from j left join tr using (st, hit)""")
def stage_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State transitions from a table of rules; what no rule names stays."""
    rules = spark.createDataFrame([("F", True, "needs_update"), ("O", True, "blocked"), ("P", True, "needs_update"), ("F", False, "approved"), ("O", False, "draft")], "st string, hit boolean, next_state string")
    hit = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("hit"))
    j = table(spark, sf_dir, "orders").join(hit, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("o_orderstatus").alias("st"), "hit")
    return j.join(F.broadcast(rules), ["st", "hit"], "left").select("o_orderkey", "st", "hit", F.coalesce("next_state", F.lit("unchanged")).alias("next_state"))


@query("""
with h as (select l_suppkey as lane, l_orderkey * 10 as y from lineitem where l_returnflag = 'N'), d as (select distinct lane, y from h)
select lane, y, lead(y) over (partition by lane order by y) as region_end, (select count(*) from lineitem x where x.l_suppkey = lane and x.l_orderkey * 10 + 5 > d.y and x.l_orderkey * 10 + 5 < coalesce((select min(e.y) from d e where e.lane = d.lane and e.y > d.y), 1e15)) as items from d""")
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each heading's region ends at the next heading of its lane; items are counted by carrying the heading forward."""
    li = table(spark, sf_dir, "lineitem")
    heads = li.where("l_returnflag = 'N'").select(F.col("l_suppkey").alias("lane"), (F.col("l_orderkey") * 10).alias("y")).distinct()
    ends = heads.withColumn("region_end", F.lead("y").over(Window.partitionBy("lane").orderBy("y")))
    both = heads.select("lane", "y", F.col("y").alias("head")).unionByName(li.select(F.col("l_suppkey").alias("lane"), (F.col("l_orderkey") * 10 + 5).alias("y"), F.lit(None).cast("long").alias("head")))
    owner = both.withColumn("owner", F.last("head", True).over(Window.partitionBy("lane").orderBy("y").rangeBetween(Window.unboundedPreceding, 0))).where("head is null and owner is not null")
    n = owner.groupBy("lane", F.col("owner").alias("y")).agg(F.count(F.lit(1)).alias("items"))
    return ends.join(n, ["lane", "y"], "left").select("lane", "y", "region_end", F.coalesce("items", F.lit(0)).alias("items"))


@query("""
with c as (select l_orderkey // 16 as sheet, l_orderkey % 16 as r from lineitem where l_quantity > 45 group by 1, 2), i as (select *, r - row_number() over (partition by sheet order by r) as g from c),
s as (select sheet, min(r) as a, max(r) as z from i group by sheet, g), m as (select *, case when a - lag(z) over (partition by sheet order by a) <= 2 then 0 else 1 end as new_ from s), k as (select *, sum(new_) over (partition by sheet order by a) as k from m)
select sheet, min(a) as first, max(z) as last, count(*) as sections from k group by sheet, k""")
def merged_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of rows joined across a single blank row."""
    c = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.floor(F.col("l_orderkey") / 16).alias("sheet"), (F.col("l_orderkey") % 16).alias("r"))
    s = S.islands(c, ["sheet"], "r")
    w = Window.partitionBy("sheet").orderBy("first")
    s = s.withColumn("new", F.when(F.col("first") - F.lag("last").over(w) <= 2, 0).otherwise(1)).withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("sheet", "k").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("sections")).drop("k")


@query("""
with d as (select doc_id, text, position('the ' in text)::int as p from documents), e as (select doc_id, case when p > 0 then substring(text, greatest(p - 40, 1), 80) end as excerpt from d)
select doc_id, 'ev_' || substring(sha256(coalesce(excerpt, '')), 1, 20) as evidence_id, excerpt, excerpt is not null and length(trim(excerpt)) >= 20 as meaningful from e""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted excerpts with opaque ids, and whether they say anything."""
    from ..operators.workspace import opaque_id

    p = F.instr("text", "the ")
    e = F.when(p > 0, F.substring("text", F.greatest(p - 40, F.lit(1)), F.lit(80)))
    d = table(spark, sf_dir, "documents").withColumn("excerpt", e)
    return d.select("doc_id", opaque_id("ev", F.coalesce("excerpt", F.lit(""))).alias("evidence_id"), "excerpt", (F.col("excerpt").isNotNull() & (F.length(F.trim("excerpt")) >= 20)).alias("meaningful"))
