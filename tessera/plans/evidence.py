"""Evidence queries: line items and labelled documents stand for candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..registry import query, table


@query("""
with r as (select l_partkey, year(l_shipdate)::int as y, l_returnflag, round(l_quantity / 10)::int as v, l_linestatus as u, l_returnflag <> 'A' as passed, l_orderkey * 10 + l_linenumber as ord from lineitem)
select l_partkey, y, count(*) filter (where passed) as facts, count(distinct (v, u)) filter (where passed) as variants, count(*) filter (where passed) >= 2 and count(distinct (v, u)) filter (where passed) >= 2 as conflict from r group by 1, 2""")
def conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different values for one metric and period among passed candidates."""
    r = table(spark, sf_dir, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"), "l_returnflag", F.round(F.col("l_quantity") / 10).cast("int").alias("v"), F.col("l_linestatus").alias("u"))
    return E.conflicts(r, ["l_partkey", "y"], F.col("l_returnflag") != "A", ["v", "u"])


@query("""
with r as (select l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, case l_returnflag when 'A' then 'failed' when 'N' then 'needs_review' else 'passed' end as st, case when l_discount < 0.04 then 'supporting' when l_discount > 0.06 then 'contradicting' else 'neutral' end as sc from lineitem)
select l_orderkey, case when bool_or(st = 'passed') then 'passed' when bool_or(st = 'needs_review') then 'needs_review' else 'failed' end as status, case when count(distinct sc) = 1 then min(sc) else 'neutral' end as stance,
  bool_or(l_quantity > 30) as required, coalesce(arg_min(l_linenumber, l_linenumber) filter (where st = 'passed'), min(l_linenumber)) as representative from r group by 1""")
def group_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group status by precedence, the stance where unique, any required, the first passed row as representative."""
    flag, d = F.col("l_returnflag"), F.col("l_discount")
    r = table(spark, sf_dir, "lineitem").withColumn("st", F.when(flag == "A", "failed").when(flag == "N", "needs_review").otherwise("passed")).withColumn("sc", F.when(d < 0.04, "supporting").when(d > 0.06, "contradicting").otherwise("neutral"))
    return r.groupBy("l_orderkey").agg(E.group_status(F.col("st")).alias("status"), E.unique_stance(F.col("sc")).alias("stance"), F.bool_or(F.col("l_quantity") > 30).alias("required"), E.representative(F.col("l_linenumber"), F.col("st") == "passed", F.col("l_linenumber")).alias("representative"))


@query("""
with v as (select source, count(*) filter (where quality = 1 and toxic = 0) as s, count(*) filter (where toxic = 1) as c, count(l.doc_id) as n from documents d left join labels l on l.doc_id = d.doc_id group by source)
select source, s as supporting, c as contradicting, n as total, case when n = 0 then 'indeterminate' when s > 0 and c = 0 then 'positive' when c > 0 and s = 0 then 'negative' else 'neutral' end as decision from v""")
def stance_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "lid"), F.col("lid") == F.col("doc_id"), "left")
    g = d.groupBy("source").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("supporting"), F.count_if(F.col("toxic") == 1).alias("contradicting"), F.count("lid").alias("total"))
    return g.withColumn("decision", E.stance(F.col("supporting"), F.col("contradicting"), F.col("total")))


@query("""
with q as (select o_orderkey as question, o_orderpriority as need from orders), e as (select l_orderkey as question, l_linenumber as id, l_suppkey as source, l_returnflag as metric, l_discount > 0.05 as contradicts, l_quantity > 10 as passed from lineitem),
a as (select q.question, count(id) filter (where passed) as evidence, count(distinct source) filter (where passed) as sources, count(distinct metric) filter (where passed) as covered,
  count(*) filter (where passed and not contradicts) as s, count(*) filter (where passed and contradicts) as c from q left join e using (question) group by 1)
select question, evidence, sources, covered, case when evidence = 0 then 'blocked' when sources < 2 then 'single_source' when covered < 2 then 'caveat' else 'ready' end as gate, case when evidence = 0 then 'indeterminate' when c = 0 then 'positive' when s = 0 then 'negative' else 'neutral' end as decision from a""")
def question_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, source count and stance of each question's passed evidence, and what they allow."""
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question"))
    e = table(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("question"), "l_suppkey", "l_returnflag", (F.col("l_discount") > 0.05).alias("contradicts"))
    a = q.join(e, "question", "left").groupBy("question").agg(F.count("l_suppkey").alias("evidence"), F.count_distinct("l_suppkey").alias("sources"), F.count_distinct("l_returnflag").alias("covered"), F.count_if(~F.col("contradicts")).alias("s"), F.count_if(F.col("contradicts")).alias("c"))
    gate = F.when(F.col("evidence") == 0, "blocked").when(F.col("sources") < 2, "single_source").when(F.col("covered") < 2, "caveat").otherwise("ready")
    return a.select("question", "evidence", "sources", "covered", gate.alias("gate"), E.stance(F.col("s"), F.col("c"), F.col("evidence")).alias("decision"))


@query("""
select event_id, case when value is null then 'VALUE_MISSING' when not (ts <= timestamp '2024-01-20') then 'AFTER_CUTOFF' when event_type not in ('view', 'purchase', 'click') then 'SOURCE_NOT_ALLOWED' when not (coalesce(try_cast(props->>'k' as int), 0) >= 20) then 'LOCATOR_MISSING' end as failure,
  case when value is not null and ts <= timestamp '2024-01-20' and event_type in ('view', 'purchase', 'click') and coalesce(try_cast(props->>'k' as int), 0) >= 20 then 'passed' else 'failed' end as status from events""")
def evidence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered chain of checks: the first that fails names the row's code; no row is dropped."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0))
    checks = [("VALUE_MISSING", F.col("value").isNotNull()), ("AFTER_CUTOFF", F.col("ts") <= F.lit("2024-01-20").cast("timestamp")), ("SOURCE_NOT_ALLOWED", F.col("event_type").isin("view", "purchase", "click")), ("LOCATOR_MISSING", k >= 20)]
    code = E.first_failure(checks)
    return table(spark, sf_dir, "events").select("event_id", code.alias("failure"), F.when(code.isNull(), "passed").otherwise("failed").alias("status"))


@query("""
with a as (select l_orderkey, list(l_linenumber order by l_linenumber) as ids, min(l_linenumber) filter (where l_returnflag = 'R') as chosen from lineitem group by 1)
select l_orderkey, coalesce(chosen, ids[1]) as authority, len(list_distinct(ids)) - 1 as n_discarded from a""")
def authority_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence a conflict decision chose, else the first; all others are discarded."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ids"), F.min(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("chosen"))
    g = g.withColumn("authority", F.coalesce("chosen", F.element_at("ids", 1)))
    return g.select("l_orderkey", "authority", F.size(F.array_except("ids", F.array("authority"))).cast("long").alias("n_discarded"))


@query("""
with r as (select o_orderkey, o_custkey, o_orderstatus, count(*) over (partition by o_custkey, o_orderpriority) as same, lag(o_orderstatus) over (partition by o_custkey, o_orderpriority order by o_orderkey) as prev from orders)
select o_orderkey, case when same > 2 then 'SEMANTIC_KEY_AMBIGUOUS' when prev is null or prev <> o_orderstatus then 'STRUCTURE_FINGERPRINT_CHANGED' else 'inherited' end as outcome from r""")
def binding_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binding passes on only along one unambiguous key with an unchanged fingerprint."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey", "o_orderpriority")
    o = table(spark, sf_dir, "orders").withColumn("same", F.count(F.lit(1)).over(w)).withColumn("prev", F.lag("o_orderstatus").over(w.orderBy("o_orderkey")))
    return o.select("o_orderkey", F.when(F.col("same") > 2, "SEMANTIC_KEY_AMBIGUOUS").when(F.col("prev").isNull() | (F.col("prev") != F.col("o_orderstatus")), "STRUCTURE_FINGERPRINT_CHANGED").otherwise("inherited").alias("outcome"))
