"""Point-in-time queries: orders stand for filings, events for prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, resolve
from ..registry import query, table

CUTOFF = "1998-06-30 23:59:59"


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") <= F.lit(CUTOFF).cast("timestamp"))
    return o.select("o_custkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), "o_orderdate", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))


@query(f"""
with f as (select o_custkey, year(o_orderdate)::int as y, quarter(o_orderdate)::int as q, o_orderdate, o_orderkey, o_totalprice::decimal(18,2) as amount
  from orders where o_orderdate <= timestamp '{CUTOFF}'),
l as (select distinct on (o_custkey, y, q) * from f order by o_custkey, y, q, o_orderdate desc, o_orderkey desc),
p as (select c.*, b.amount as before from l c left join l b on b.o_custkey = c.o_custkey and b.y = c.y and b.q = c.q - 1)
select o_custkey, y, q, o_orderkey, amount, case when q = 1 then amount else (amount - before)::decimal(18,2) end as single_value,
  case when q = 1 or before is not null then 'validated' else 'report_unavailable' end as status from p""")
def official_quarter_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest filing per entity and quarter before the cutoff, differenced into single quarters."""
    latest = asof.latest_per_key(_filings(spark, sf_dir), ["o_custkey", "y", "q"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "amount"])
    out = asof.single_period(latest, ["o_custkey"], "y", "q", "amount")
    return out.select("o_custkey", "y", "q", "o_orderkey", "amount", F.col("single_value").cast("decimal(18,2)").alias("single_value"), "status")


@query(f"""
select distinct on (o_custkey) o_custkey, o_orderkey, o_orderdate, o_totalprice::decimal(18,2) as amount from orders
where o_orderdate <= timestamp '{CUTOFF}' order by o_custkey, o_orderdate desc, o_orderkey desc""")
def asof_latest_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.latest_per_key(_filings(spark, sf_dir), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_orderdate", "amount"])


@query("""
with p as (select event_id, user_id, ts, value from events where event_type = 'purchase'), v as (select event_id, user_id, ts, value from events where event_type = 'view')
select v.event_id, v.user_id, v.ts, p.ts as price_ts, p.event_id as price_event, p.value as price
from v asof left join (select user_id, ts, max(event_id) as event_id, arg_max(value, event_id) as value from p group by user_id, ts) p on v.user_id = p.user_id and v.ts >= p.ts""")
def asof_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backward, inclusive as-of join of views with the user's last purchase."""
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("price_ts"), F.col("event_id").alias("price_event"), F.col("value").alias("price"))
    found = asof.asof_join(views, buys, ["user_id"], "ts", "price_ts", "price_event", ["price_event", "price"])
    return found.select("event_id", "user_id", "ts", F.col("price_ts_found").alias("price_ts"), "price_event", "price")


@query("""
with u as (select distinct user_id from events), e as (select * from events where ts <= timestamp '2024-01-20 12:00:00' and ts >= timestamp '2024-01-20 12:00:00' - interval 10 day and event_type = 'purchase')
select u.user_id, b.event_id, b.ts, b.value as price, case when b.event_id is null then 'unavailable' else 'available' end as status
from u left join (select distinct on (user_id) * from e order by user_id, ts desc, event_id desc) b using (user_id)""")
def asof_walkback_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last price of at most ten days before the cutoff; older prices are never used."""
    e = table(spark, sf_dir, "events")
    cutoff = F.lit("2024-01-20 12:00:00").cast("timestamp")
    prices = e.where((F.col("event_type") == "purchase") & F.col("ts").between(cutoff - F.expr("interval 10 days"), cutoff)).select("user_id", "event_id", "ts", F.col("value").alias("price"))
    last = asof.latest_per_key(prices, ["user_id"], [F.col("ts"), F.col("event_id")])
    out = e.select("user_id").distinct().join(last, "user_id", "left")
    return out.withColumn("status", F.when(F.col("event_id").isNull(), "unavailable").otherwise("available"))


@query("""
with q as (select n.n_nationkey, year(o_orderdate)::int as y, quarter(o_orderdate)::int as q, sum(o_totalprice::decimal(18,2))::decimal(24,2) as amount
  from orders join customer on o_custkey = c_custkey join nation n on c_nationkey = n_nationkey group by 1, 2, 3),
y as (select *, sum(amount) over (partition by n_nationkey, y order by q)::decimal(24,2) as ytd from q)
select n_nationkey, y, q, ytd, (ytd - coalesce(lag(ytd) over (partition by n_nationkey, y order by q), 0))::decimal(24,2) as recovered,
  (case when q = 1 or lag(q) over (partition by n_nationkey, y order by q) = q - 1 then 'validated' else 'report_unavailable' end) as status from y
qualify q = 1 or lag(q) over (partition by n_nationkey, y order by q) = q - 1""")
def quarter_from_ytd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative amounts by nation, recovered to single quarters."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    q = o.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(24,2)").alias("amount"))
    ytd = q.withColumn("ytd", F.sum("amount").over(Window.partitionBy("n_nationkey", "y").orderBy("q")).cast("decimal(24,2)"))
    out = asof.single_period(ytd, ["n_nationkey"], "y", "q", "ytd").where("status = 'validated'")
    return out.select("n_nationkey", "y", "q", "ytd", F.col("single_value").cast("decimal(24,2)").alias("recovered"), "status")


@query(f"""
with t as (select c_custkey from customer), f as (select distinct on (o_custkey) o_custkey, o_orderkey from orders where o_orderdate <= timestamp '{CUTOFF}' order by o_custkey, o_orderdate desc, o_orderkey desc),
r as (select f.o_custkey, l_linenumber, l_extendedprice::decimal(18,2) as v, case when l_returnflag = 'R' then 1 when l_linestatus = 'F' then 2 end as rk from f join lineitem on l_orderkey = o_orderkey),
c as (select o_custkey, count(*) filter (where rk = 1) as n1, count(*) filter (where rk = 2) as n2, arg_min(l_linenumber, (rk, l_linenumber)) as ln, arg_min(v, (rk, l_linenumber)) as v from r where rk is not null group by 1),
m as (select t.c_custkey, f.o_orderkey, coalesce(case when n1 > 0 then n1 else n2 end, 0)::bigint as matches, case when n1 > 0 then 'id' when n2 > 0 then 'name' end as matched_by, ln, v
  from t left join f on f.o_custkey = t.c_custkey left join c on c.o_custkey = t.c_custkey)
select c_custkey, o_orderkey, matches, matched_by, case when matches = 1 then ln end as l_linenumber, case when matches = 1 then v end as amount,
  case when o_orderkey is null then 'report_unavailable' when matches = 0 then 'account_not_found' when matches > 1 then 'account_ambiguous' else 'validated' end as status_code from m""")
def official_value_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets against their latest filing's rows: id rule first, name rule as a fallback, ambiguity never picks."""
    latest = asof.latest_per_key(_filings(spark, sf_dir), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey"])
    targets = table(spark, sf_dir, "customer").select("c_custkey").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    rows = lines.join(targets.where("o_orderkey is not null"), "o_orderkey")
    found = resolve.resolve_by_priority(targets, rows.drop("o_orderkey"), ["c_custkey"], F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", "l_linenumber", "amount")
    code = F.when(F.col("o_orderkey").isNull(), "report_unavailable").when(F.col("status") == "not_found", "account_not_found").when(F.col("status") == "ambiguous", "account_ambiguous").otherwise("validated")
    return found.select("c_custkey", "o_orderkey", "matches", "matched_by", "l_linenumber", "amount", code.alias("status_code"))


@query("""
with t as (select distinct p_type as k from part union select distinct p_brand from part),
m as (select t.k, p_partkey, case when p_type = t.k and p_size = 1 then 1 when p_brand = t.k and p_size = 2 then 2 end as rk from t join part on (p_type = t.k and p_size = 1) or (p_brand = t.k and p_size = 2)),
c as (select k, count(*) filter (where rk = 1) as n1, count(*) filter (where rk = 2) as n2, arg_min(p_partkey, (rk, p_partkey)) as pk from m group by k)
select t.k as target, coalesce(case when n1 > 0 then n1 else n2 end, 0)::bigint as matches,
  case coalesce(case when n1 > 0 then n1 else n2 end, 0) when 0 then 'not_found' when 1 then 'resolved' else 'ambiguous' end as status,
  case when n1 > 0 then 'id' when n2 > 0 then 'name' end as matched_by, case when coalesce(case when n1 > 0 then n1 else n2 end, 0) = 1 then pk end as p_partkey
from t left join c using (k)""")
def priority_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule priority with a three-valued outcome over parts; both rules are equi joins."""
    p = table(spark, sf_dir, "part")
    targets = p.select(F.col("p_type").alias("target")).union(p.select("p_brand")).distinct()
    one = p.where("p_size = 1").select(F.col("p_type").alias("target"), "p_partkey", F.lit(1).alias("rule"))
    two = p.where("p_size = 2").select(F.col("p_brand").alias("target"), "p_partkey", F.lit(2).alias("rule"))
    rows = one.unionByName(two).withColumn("v", F.lit(0))
    found = resolve.resolve_by_priority(targets, rows, ["target"], F.col("rule") == 1, F.col("rule") == 2, "p_partkey", "v")
    return found.select("target", "matches", "status", "matched_by", "p_partkey")


@query("""
select o_custkey, o_orderkey, row_number() over w as version, lag(o_orderkey) over w as supersedes from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = asof.versioned(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")
    return v.select("o_custkey", "o_orderkey", F.col("version").cast("long").alias("version"), "supersedes")


@query("select c_custkey, (coalesce(count(o_orderkey), 0) + 1)::bigint as next_version from customer left join orders on o_custkey = c_custkey group by c_custkey")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = asof.versioned(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return asof.next_version(c, v.select(F.col("o_custkey").alias("c_custkey"), "version"), "c_custkey", "version").select("c_custkey", F.col("next_version").cast("long").alias("next_version"))


@query("""
with l as (select c_custkey, o.o_orderkey, o.o_orderdate, o.o_orderstatus from customer left join lateral
  (select o_orderkey, o_orderdate, o_orderstatus from orders where o_custkey = c_custkey order by o_orderdate desc, o_orderkey desc limit 1) o on true)
select * from l""")
def latest_version_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with its latest order, if any: the lateral top-1 as an aggregation and a left join."""
    o = table(spark, sf_dir, "orders")
    last = asof.latest_per_key(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_orderdate", "o_orderstatus"])
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")


@query("""
select event_id, case when coalesce(try_cast(props->>'k' as int), -1) < 10 then null else ts + interval (try_cast(props->>'k' as int)) hour end as available_at,
  (case when coalesce(try_cast(props->>'k' as int), -1) < 10 then null else ts + interval (try_cast(props->>'k' as int)) hour end is null
   or ts + interval (try_cast(props->>'k' as int)) hour <= timestamp '2024-01-15 00:00:00') as passes from events""")
def cutoff_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability decides over publication; a row without a date passes the cutoff."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    available = F.when(F.coalesce(k, F.lit(-1)) >= 10, F.col("ts") + F.make_interval(hours=k))
    e = table(spark, sf_dir, "events").withColumn("available_at", available)
    return e.select("event_id", "available_at", asof.known_at(F.col("available_at"), F.lit("2024-01-15").cast("timestamp")).alias("passes"))
