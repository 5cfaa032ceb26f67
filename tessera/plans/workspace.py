"""Validation, formula and workspace queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import folds
from ..operators import workspace as W
from ..registry import query, table
from .sheets import CELLS, _cells


@query("""
with p as (select o_custkey, o_orderkey, o_orderpriority, o_totalprice, count(*) over (partition by o_custkey, o_orderpriority) as same from orders)
select o_orderkey, 'DUPLICATE_TARGET' as code from p where same > 1 union all select o_orderkey, 'VALUE_OUT_OF_RANGE' from p where not (o_totalprice between 1000 and 400000) union all select o_orderkey, 'PRIORITY_NOT_ALLOWED' from p where o_orderpriority like '5%'""")
def plan_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan validator: every broken rule is a row."""
    p = table(spark, sf_dir, "orders").withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("o_custkey", "o_orderpriority")))
    return W.issues(p, "o_orderkey", [("DUPLICATE_TARGET", F.col("same") == 1), ("VALUE_OUT_OF_RANGE", F.col("o_totalprice").between(1000, 400000)), ("PRIORITY_NOT_ALLOWED", ~F.col("o_orderpriority").startswith("5"))])


@query("""
with o as (select o_orderkey, count(l_orderkey) as n, count(*) filter (where l_returnflag = 'R') as r, count(*) filter (where l_linestatus = 'O') as op from orders left join lineitem on l_orderkey = o_orderkey group by 1)
select o_orderkey, case when n = 0 then 'not_mapped' when r = n then 'blocked' when op = n then 'pending' when r > 0 then 'partial' when n < 3 then 'review' else 'ready' end as state from o""")
def readiness_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered state machine over counts."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_linestatus") == "O").alias("op"))
    o = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").na.fill(0, ["n", "r", "op"])
    n, r, op = F.col("n"), F.col("r"), F.col("op")
    return o.select("o_orderkey", W.state_machine([("not_mapped", n == 0), ("blocked", r == n), ("pending", op == n), ("partial", r > 0), ("review", n < 3)], "ready").alias("state"))


REFS = "(select s_suppkey as cell, s_suppkey // 2 as ref, s_suppkey % 4 = 0 as conditional from supplier where s_suppkey > 1 union select s_suppkey, s_suppkey // 3, s_suppkey % 5 = 0 from supplier where s_suppkey > 2)"


@query(f"""
with recursive r as {REFS}, w(output, cell, conditional) as (select s_suppkey, s_suppkey, false from supplier where s_suppkey % 7 = 0 union select w.output, r.ref, w.conditional or r.conditional from w join r on r.cell = w.cell)
select output, cell, bool_and(conditional) as conditional from w group by 1, 2""")
def formula_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells behind outputs, and whether they are reached only through conditional branches."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    refs = s.where("s_suppkey > 1").select(k.alias("cell"), F.floor(k / 2).alias("ref"), (k % 4 == 0).alias("conditional")).union(s.where("s_suppkey > 2").select(k, F.floor(k / 3), k % 5 == 0)).distinct()
    return W.formula_inputs(spark, refs, s.where("s_suppkey % 7 = 0").select(k.alias("cell")))


@query("""
with f as (select p_partkey, case p_partkey % 4 when 0 then '=SUM(A1:A9)+UNIQUE(B1:B9)' when 1 then '=IF(A1>0,FILTER(A:A,B:B),SORT(C:C))' when 2 then '=ROUND(A1,2)' else '' end as formula from part)
select p_partkey, case p_partkey % 4 when 0 then 'UNIQUE' when 1 then 'FILTER,SORT' else '' end as unsupported from f""")
def function_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    f = F.when(k == 0, "=SUM(A1:A9)+UNIQUE(B1:B9)").when(k == 1, "=IF(A1>0,FILTER(A:A,B:B),SORT(C:C))").when(k == 2, "=ROUND(A1,2)").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(W.unsupported_functions(f), ",").alias("unsupported"))


@query()
def position_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions clustered along a line, an order-dependent fold held by a test."""
    return folds.clusters(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 200.0)


@query("""
select 'copy_' || substring(sha256('run2|' || l_orderkey || ':' || l_linenumber || ':' || l_partkey), 1, 20) as id, l_orderkey || ':' || l_linenumber || ':' || l_partkey as copied_from, l_quantity from lineitem where l_returnflag <> 'A'""")
def copy_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results carried into a new run under new ids."""
    li = table(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey"))
    return W.copy_forward(li, "id", "run2", F.col("l_returnflag") != "A").select("id", "copied_from", "l_quantity")


@query(f"""
with f as (select sheet, min(c) filter (where flag = 'N') as p from {CELLS} group by 1), x as (select a.sheet, a.c, round(avg(case when flag = 'R' then 1.0 else 0.0 end), 6) as text_share from {CELLS} a join f on f.sheet = a.sheet and a.c < p + 12 group by 1, 2),
k as (select *, row_number() over (partition by sheet order by c) as place from x where text_share >= 0.5) select sheet, c, text_share, place from k where place <= 3""")
def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-key columns by text share, left of a bound, at most three."""
    cells = _cells(spark, sf_dir)
    first = F.min(F.when(F.col("flag") == "N", F.col("c"))).over(Window.partitionBy("sheet"))
    out = W.row_keys(cells.withColumn("p", first), ["sheet"], "c", F.col("flag") == "R", F.col("c") < F.col("p") + 12)
    return out.select("sheet", "c", "text_share", F.col("place").cast("long").alias("place"))


@query("""
with y as (select o_custkey, year(o_orderdate)::int as y, case when bool_or(o_orderstatus = 'O') then 'forecast' when count(*) > 2 then 'actual' end as role from orders group by 1, 2)
select o_custkey, y, case when role is null and y < min(y) filter (where role = 'forecast') over (partition by o_custkey) then 'actual' else role end as role from y""")
def role_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.when(F.bool_or(F.col("o_orderstatus") == "O"), "forecast").when(F.count(F.lit(1)) > 2, "actual").alias("role"))
    return W.role_backfill(y, ["o_custkey"], "y", "role")


@query("""
with e as (select l_orderkey, l_returnflag as k, max(l_linenumber)::varchar as v from lineitem group by 1, 2), m as (select l_orderkey, '{' || string_agg('"' || k || '":"' || v || '"', ',' order by k) || '}' as j from e group by 1) select l_orderkey, j as json, sha256(j) as hash from m""")
def stable_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with keys in order and its hash."""
    e = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("k")).agg(F.max("l_linenumber").cast("string").alias("v"))
    m = e.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m")).select("l_orderkey", W.stable_json(F.col("m")).alias("json"))
    return m.withColumn("hash", F.sha2("json", 256))


@query("""
with e as (select l_orderkey, l_linenumber || '/' || l_partkey as k, max(case when l_linenumber % 2 = 0 then l_quantity::int::varchar else (l_quantity::decimal(12,2))::varchar end) as v from lineitem group by 1, 2), w as (select o_orderkey, (max(l_quantity)::int)::varchar as w from orders join lineitem on l_orderkey = o_orderkey group by 1),
s as (select o_orderkey, k, case when v = w then 1 when try_cast(v as decimal(30,6)) = try_cast(w as decimal(30,6)) then 2 end as s from w join e on l_orderkey = o_orderkey),
g as (select o_orderkey, count(*) filter (where s = 1) as a, count(*) filter (where s = 2) as b, arg_min(k, (s, k)) filter (where s is not null) as f from s group by 1)
select o_orderkey, case when a = 1 or (a = 0 and b = 1) then f end as field, case when a = 1 or (a = 0 and b = 1) then 'resolved' when a + b = 0 then 'not_found' else 'ambiguous' end as status from g""")
def record_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field of a record that holds a value: by text, else by number, never one of two."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    v = F.when(F.col("l_linenumber") % 2 == 0, q.cast("int").cast("string")).otherwise(q.cast("decimal(12,2)").cast("string"))
    once = li.groupBy(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws("/", "l_linenumber", "l_partkey").alias("k")).agg(F.max(v).alias("v"), F.max(q).alias("q"))
    e = once.groupBy("o_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"), F.max("q").cast("int").cast("string").alias("w"))
    known = table(spark, sf_dir, "orders").select("o_orderkey")
    return W.unique_match(e.join(known, "o_orderkey", "left_semi"), "o_orderkey", "m", F.col("w"))


@query("""
with v as (select l_orderkey, l_linenumber, l_partkey, (l_quantity::decimal(12,2)) as before_value, case when l_discount > 0.04 then (l_quantity::decimal(12,2)) * 2 else l_quantity::decimal(12,2) end as after_value from lineitem),
b as (select *, count(*) over (partition by l_orderkey, l_linenumber) as n from v)
select l_orderkey, l_linenumber, l_partkey, before_value, after_value::decimal(14,2) as after_value, case when n > 1 then 'DUPLICATE_DESTINATION' when before_value = after_value then 'unchanged' when after_value > 90 then 'OUT_OF_RANGE' else 'planned' end as status from b""")
def patch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write-back commands with their blockers."""
    q = F.col("l_quantity").cast("decimal(12,2)")
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", q.alias("before_value"), F.when(F.col("l_discount") > 0.04, q * 2).otherwise(q).cast("decimal(14,2)").alias("after_value"))
    v = v.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey", "l_linenumber")))
    status = W.state_machine([("DUPLICATE_DESTINATION", F.col("n") > 1), ("unchanged", F.col("before_value") == F.col("after_value")), ("OUT_OF_RANGE", F.col("after_value") > 90)], "planned")
    return v.select("l_orderkey", "l_linenumber", "l_partkey", "before_value", "after_value", status.alias("status"))


@query("""
select c_custkey, 'report_' || strftime(date '2024-03-31', '%Y%m%d') || '_' || lpad((c_custkey % 100000)::varchar, 5, '0') || '.pdf' as filename, format('{:,}', c_custkey * 1000) as grouped, length(c_name) between 1 and 500 and not regexp_matches(c_name, '[\\r\\n]') as one_line from customer""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.lit("report_20240331_"), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit(".pdf"))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("filename"), F.format_number(k * 1000, 0).alias("grouped"), (F.length("c_name").between(1, 500) & ~F.col("c_name").rlike(r"[\r\n]")).alias("one_line"))


@query("""
with s as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as n, l_returnflag as flag from lineitem),
f as (select l_suppkey, flag, min(n) as n from s group by 1, 2) select l_suppkey, string_agg(flag, ',' order by n) as palette from (select *, row_number() over (partition by l_suppkey order by n) as r from f) where r <= 2 group by 1""")
def capped_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in first-seen order, the first two."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("first"))
    g = first.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("first", "l_returnflag"))).alias("s"))
    return g.select("l_suppkey", F.array_join(F.slice(F.transform("s", lambda x: x["l_returnflag"]), 1, 2), ",").alias("palette"))


@query("""
with h as (select user_id, event_id, epoch_ms(ts) as at from events where event_type = 'error'), i as (select user_id, event_id, epoch_ms(ts) as at from events where event_type = 'click')
select i.event_id, (select arg_min(h.event_id, (abs(h.at - i.at), h.event_id)) from h where h.user_id = i.user_id) as nearest from i""")
def nearest_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest marker of each item in its lane, before or behind: two carried values, no pairs."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp"))).where("event_type in ('error', 'click')")
    mark = F.when(F.col("event_type") == "error", F.struct("at", "event_id"))
    lane = Window.partitionBy("user_id").rowsBetween(Window.unboundedPreceding, 0)
    # Growing frames in both directions: one pass each, where a shrinking frame is quadratic.
    e = e.withColumn("b", F.last(mark, True).over(lane.orderBy("at", "event_id"))).withColumn("f", F.last(mark, True).over(lane.orderBy(F.desc("at"), F.desc("event_id"))))
    gap = lambda c: F.abs(F.col(f"{c}.at") - F.col("at"))
    nearest = F.when(F.col("f").isNull() | (gap("b") < gap("f")) | ((gap("b") == gap("f")) & (F.col("b.event_id") < F.col("f.event_id"))), F.col("b.event_id")).otherwise(F.col("f.event_id"))
    return e.where("event_type = 'click'").select("event_id", nearest.alias("nearest"))
