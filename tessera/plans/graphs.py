"""Graph queries over a reporting-line tree derived from suppliers and a part lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..registry import query, table

EDGES = "(select s_suppkey // 2 as src, s_suppkey as dst from supplier where s_suppkey // 2 > 0 union select s_suppkey // 3, s_suppkey from supplier where s_suppkey // 3 > 0 and s_suppkey % 5 = 0)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    a = s.select(F.floor(k / 2).alias("src"), k.alias("dst")).where("src > 0")
    return a.union(s.where("s_suppkey % 5 = 0").select(F.floor(k / 3).alias("src"), k.alias("dst")).where("src > 0")).distinct()


@query(f"with recursive e as {EDGES}, c(src, dst, depth) as (select src, dst, 1 from e union select c.src, e.dst, depth + 1 from c join e on c.dst = e.src) select src, dst, min(depth)::int as depth from c group by 1, 2")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.closure(spark, _edges(spark, sf_dir))


@query(f"""
with recursive e as {EDGES}, c(src, dst) as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src), p as (select s_suppkey as src, s_suppkey % 7 + 1 as dst from supplier)
select p.src, p.dst, (p.src = p.dst or exists (select 1 from c where c.src = p.dst and c.dst = p.src)) as closes_cycle from p""")
def cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Would each proposed edge close a cycle."""
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") % 7 + 1).alias("dst"))
    return G.would_cycle(spark, _edges(spark, sf_dir), p).select("src", "dst", "closes_cycle")


@query(f"""
with recursive e as {EDGES}, n as (select src as node from e union select dst from e), d(node, depth) as (select node, 0 from n where node not in (select dst from e) union select e.dst, depth + 1 from d join e on e.src = d.node)
select node, max(depth)::int as layer from d group by 1""")
def dag_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.layers(spark, _edges(spark, sf_dir))


@query(f"""
with recursive e as {EDGES}, c(node) as (select 3::bigint union select e.dst from c join e on c.node = e.src), j as (select l_orderkey as job, l_suppkey as input, o_orderstatus as s from lineitem join orders on o_orderkey = l_orderkey),
t as (select job, case s when 'F' then 'done' when 'O' then 'running' else 'queued' end as state, bool_or(input in (select node from c)) as hit from j group by 1, 2)
select job, state, case when hit and state = 'done' then 'stale' when hit and state = 'running' then 'cancel_requested' else state end as new_state from t""")
def invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that read anything behind a changed node."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("queued").alias("state"))
    jobs = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("job"), F.col("l_suppkey").alias("input"), "state")
    return G.invalidate(spark, _edges(spark, sf_dir), spark.createDataFrame([(3,)], "src long"), jobs)


def _digest(item: str) -> str:
    """The order-free digest in SQL."""
    return "sha256(concat_ws(':', " + ", ".join(f"sum(('0x' || substr(sha256({item}), {1 + 15 * k}, 15))::bigint)::varchar" for k in range(4)) + "))"


@query(f"""
with p as (select o_custkey, o_orderkey % 300 as k, count(*) as n, {_digest("(o_orderkey % 300)::varchar || '=' || o_orderstatus")} as h from orders group by 1, 2)
select o_custkey, {_digest("k::varchar || '=' || h")} as fingerprint, sum(n)::bigint as components, count(*) filter (n > 1) as repeated from p group by 1""")
def snapshot_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's set of components, in any order; keys that stand twice are counted."""
    return G.fingerprint(table(spark, sf_dir, "orders"), ["o_custkey"], (F.col("o_orderkey") % 300).cast("string"), F.col("o_orderstatus"))


@query(f"""
with pinned as (select o_custkey, {_digest("o_orderkey::varchar")} as h from orders where o_orderdate < timestamp '2000-01-01' group by 1), now_ as (select o_custkey, {_digest("o_orderkey::varchar")} as h from orders group by 1)
select n.o_custkey, case when p.h is null then 'current' when p.h = n.h then 'duplicate' else 'obsolete' end as decision from now_ n left join pinned p using (o_custkey)""")
def snapshot_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned inputs against today's: duplicate, current or obsolete. One pass over the orders for both digests."""
    old = F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp")
    key = F.col("o_orderkey").cast("string")
    j = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(G.set_digest(key).alias("n"), G.set_digest(F.when(old, key)).alias("p"), F.count_if(old).alias("pinned"))
    return j.select("o_custkey", F.when(F.col("pinned") == 0, "current").when(F.col("p") == F.col("n"), "duplicate").otherwise("obsolete").alias("decision"))


#: Three lineages over the same edges, whose nodes bear shuffled numbers.
NAMED = f"(select g as graph, src * 7919 % 1000003 as src, dst * 7919 % 1000003 as dst from {EDGES}, (values ('a'), ('b'), ('c')) as t(g))"


@query(f"""
with recursive e as {NAMED}, roots as (select 'a' as graph, 7919 as node union all select 'b', 2 * 7919 union all select 'b', 3 * 7919 union all select 'c', 7919 union all select 'c', 5 * 7919),
w(graph, node, way) as (select graph, node::bigint, [node::bigint] from roots union select e.graph, e.dst, list_append(list_filter(w.way, lambda x: x > e.dst), e.dst) from w join e on e.graph = w.graph and e.src = w.node),
best as (select graph, node, way from w qualify row_number() over (partition by graph, node order by way) = 1)
select graph, node, row_number() over (partition by graph order by way) as place from best""")
def closure_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What roots reach, in the order of a queue that yields its least node first."""
    from pyspark.sql import Window

    named = lambda c: F.col(c) * 7919 % 1000003
    e = _edges(spark, sf_dir).select(F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("graph"), named("src").alias("src"), named("dst").alias("dst"))
    roots = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 1), ("c", 5)], "graph string, k long").select("graph", named("k").alias("node"))
    ways = G.best_first(spark, e, roots)
    return ways.select("graph", "node", F.row_number().over(Window.partitionBy("graph").orderBy("way")).alias("place"))
