"""Retrieval, aggregation and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..registry import query, table

M = "decimal(18,2)"


@query("""
select o_custkey, count(*) as n_orders, count(*) filter (where o_orderstatus = 'O') as n_open, count(*) filter (where o_totalprice > 200000) as n_large,
  coalesce(array_to_string(list_sort(list(distinct o_orderpriority) filter (where o_orderstatus = 'F')), ','), '') as done_priorities from orders group by o_custkey""")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered counts and a filtered distinct list that is empty rather than null."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))), ",").alias("done_priorities"),
    )


@query("select l_orderkey, case when count(distinct l_suppkey) = 1 then min(l_suppkey) end as only_supplier, min(l_returnflag) as representative, coalesce(max(l_linenumber), 0)::int as last_line from lineitem group by l_orderkey")
def unique_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value where a group has only one, else null; smallest text and largest version beside it."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(R.only(F.col("l_suppkey")).alias("only_supplier"), F.min("l_returnflag").alias("representative"), F.coalesce(F.max("l_linenumber"), F.lit(0)).alias("last_line"))


@query("""
with a as (select l_partkey, list(distinct l_orderkey) as ids from lineitem group by 1)
select a.l_partkey, count(*) as n_orders, sum(o_totalprice::decimal(18,2))::decimal(24,2) as total from (select l_partkey, unnest(ids) as id from a) a join orders on o_orderkey = a.id group by 1""")
def array_member_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join on membership in an array column: explode, then an equi join."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_set("l_orderkey").alias("ids"))
    j = R.member_join(lists, "ids", table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return j.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast(M)).cast("decimal(24,2)").alias("total"))


@query("select c_custkey, c_nationkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_nationkey")


@query("select c_custkey, c_nationkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= timestamp '2001-01-01')")
def anti_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp")).select("o_custkey")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


@query("select event_id, 'k' as key, try_cast(props->>'k' as bigint) as value from events where props->>'k' is not null")
def json_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))
    return e.where("value is not null")


@query("select 'customer' as source, c_nationkey as nationkey, c_acctbal::decimal(18,2) as balance from customer union all select 'supplier', s_nationkey, s_acctbal::decimal(18,2) from supplier")
def union_all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").cast(M).alias("balance"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").cast(M).alias("balance")))


@query("select c_nationkey as nationkey from customer union select s_nationkey from supplier")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("""
with w as (select n_nationkey, p from nation, (select distinct o_orderpriority as p from orders)), s as (select distinct c_nationkey, o_orderpriority as p from orders join customer on c_custkey = o_custkey where o_totalprice > 300000)
select n_nationkey, coalesce(string_agg(w.p, ',' order by w.p) filter (where s.p is null), '') as missing, count(s.p) as covered, count(s.p) = count(*) as complete from w left join s on c_nationkey = n_nationkey and s.p = w.p group by 1""")
def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required minus seen per group, with set operators on arrays."""
    o = table(spark, sf_dir, "orders")
    seen = o.where("o_totalprice > 300000").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_set("o_orderpriority").alias("seen"))
    want = o.agg(F.collect_set("o_orderpriority").alias("want"))  # one row
    j = table(spark, sf_dir, "nation").select("n_nationkey").join(seen, "n_nationkey", "left").join(F.broadcast(want), how="cross").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    return R.covered(j, "want", "seen").select("n_nationkey", F.array_join("missing", ",").alias("missing"), "covered", "complete")


@query("""
select c_custkey, c_name, case when lower(c_name) = 'customer#000000001' then 0 when lower(c_name) like 'customer#00000001%' then 1 else 2 end as rank_class from customer where c_name ilike '%00000001%'
order by rank_class, c_name, c_custkey limit 20""")
def search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search: exact, then prefix, then contained; a unique tie-break makes the limit stable."""
    return R.search(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", ["customer#000000001", "customer#00000001", "00000001"], ["c_name", "c_custkey"], 20)


@query("select c_custkey, c_name from customer where c_name ilike '%!_%' escape '!' or c_mktsegment ilike 'mach%' or c_nationkey in (1, 2, 3) and c_acctbal between 0 and 5000")
def escaped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive search for a literal text, with membership and range predicates."""
    hit = R.contains_literal(F.col("c_name"), "_") | F.col("c_mktsegment").ilike("mach%") | (F.col("c_nationkey").isin(1, 2, 3) & F.col("c_acctbal").between(0, 5000))
    return table(spark, sf_dir, "customer").where(hit).select("c_custkey", "c_name")


@query("""
select l_orderkey, l_linenumber, (l_returnflag is distinct from l_linestatus) as differs, coalesce(nullif(trim(l_returnflag), 'N'), l_linestatus) as cascade, case when l_quantity > 40 then 'large' when l_quantity > 20 then 'medium' else 'small' end as size_class from lineitem""")
def conditional_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (~F.col("l_returnflag").eqNullSafe(F.col("l_linestatus"))).alias("differs"), F.coalesce(F.nullif(F.trim("l_returnflag"), F.lit("N")), "l_linestatus").alias("cascade"), F.when(q > 40, "large").when(q > 20, "medium").otherwise("small").alias("size_class"))


@query("""
with r as (select l_orderkey, list(l_partkey order by l_linenumber, l_partkey) as a from lineitem group by 1), s as (select l_orderkey, list(l_partkey order by l_linenumber, l_partkey) filter (where l_linenumber <= 2) as b from lineitem group by 1)
select r.l_orderkey, len(list_distinct(list_filter(a, lambda x: not list_contains(b, x)))) as n_missing, len(list_distinct(a)) = len(list_distinct(b)) as set_equal, a[1] as first_id, len(a) > 0 as filled from r join s using (l_orderkey) where b is not null""")
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subset, set equality, first element and emptiness of id lists."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("a"), F.collect_list(F.when(F.col("l_linenumber") <= 2, F.col("l_partkey"))).alias("b")).where("size(b) > 0")
    return g.select("l_orderkey", F.size(F.array_except("a", "b")).cast("long").alias("n_missing"), R.same_set(F.col("a"), F.col("b")).alias("set_equal"), F.try_element_at("a", F.lit(1)).alias("first_id"), (F.size("a") > 0).alias("filled"))


@query("""
with a as (select p_partkey as k, p_brand as h, 0 as ord from part union all select p_partkey, case when p_partkey % 7 = 0 then p_type else p_brand end, 1 from part where p_partkey % 2 = 0)
select k, count(distinct h) as versions, case when count(distinct h) > 1 then 'conflict' else 'merged' end as status, arg_max(h, ord) as last_value, arg_min(h, ord) as first_value from a group by k""")
def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge two keyed lists: equal keys with different content conflict; first and last by arrival."""
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("h"), F.lit(0).alias("ord"))
    b = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("h"), F.lit(1).alias("ord"))
    return R.keyed_merge(a.unionByName(b), "k", "h", "ord")


@query("""
with u as (select o_orderkey, o_orderstatus, case when o_orderkey in (select l_orderkey from lineitem where l_quantity > 49) then 'stale' else o_orderstatus end as new_status from orders)
select * from u""")
def update_from_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk update as a rewrite: a deduplicated key set joined to the table."""
    keys = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_orderkey").distinct().withColumn("hit", F.lit(True))
    o = table(spark, sf_dir, "orders").join(keys, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", "o_orderstatus", F.when(F.col("hit"), "stale").otherwise(F.col("o_orderstatus")).alias("new_status"))


@query("""
with old as (select p_partkey, p_brand as v from part where p_partkey % 3 > 0), new as (select p_partkey, p_type as v from part where p_partkey % 2 = 0)
select coalesce(o.p_partkey, n.p_partkey) as p_partkey, coalesce(n.v, o.v) as v, case when o.p_partkey is null then 'inserted' when n.p_partkey is null then 'kept' else 'updated' end as outcome from old o full join new n using (p_partkey)""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert or update by key; what changed is returned with the rows."""
    p = table(spark, sf_dir, "part")
    return R.upsert(p.where("p_partkey % 3 > 0").select("p_partkey", F.col("p_brand").alias("v")), p.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_type").alias("v")), "p_partkey", "v")


@query("""
select o_orderkey, o_custkey, o_orderpriority, row_number() over (order by o_orderpriority nulls last, lpad(o_custkey::varchar, 12, '0'), o_orderkey) as place from orders order by place limit 100""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several sort keys, nulls last, numbers in texts by value; a bounded top list."""
    o = table(spark, sf_dir, "orders").withColumn("code", F.col("o_custkey").cast("string"))
    order = [F.col("o_orderpriority").asc_nulls_last(), R.natural(F.col("code")), F.col("o_orderkey")]
    top = o.orderBy(*order).limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("o_orderkey", "o_custkey", "o_orderpriority", "place")


@query("""
with a as (select l_orderkey, list(l_linenumber order by l_linenumber) as n, list(l_partkey order by l_linenumber, l_partkey) as p from lineitem group by 1)
select l_orderkey, unnest(n) as line, unnest(p) as part from a""")
def positional_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several arrays unnested side by side."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    a = a.select("l_orderkey", F.transform("s", lambda x: x["l_linenumber"]).alias("line"), F.transform("s", lambda x: x["l_partkey"]).alias("part"))
    return a.select("l_orderkey", F.inline(F.arrays_zip("line", "part")))


@query("select c_nationkey, count(*) as found, count(*) = (select count(*) from customer c2 where c2.c_nationkey = c.c_nationkey) as all_known from customer c where c_custkey in (select o_custkey from orders) group by c_nationkey")
def owner_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do all requested keys exist: a semi join against a count."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select("o_custkey").distinct().withColumn("hit", F.lit(1))
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("asked"))
    return j.where("found > 0").select("c_nationkey", "found", (F.col("found") == F.col("asked")).alias("all_known"))
