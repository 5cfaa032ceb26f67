"""Period queries over order dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods as P
from ..registry import query, table


#: Ways to write a period, with what they mean: written around year, short year and quarter; the twin says the meaning, not the grammar.
LABELS = [
    ("{y}", "y", None, "actual"), ("{q}Q{yy}F", "s", "q", "forecast"), ("{y}Q{q}", "y", "q", "actual"), ("{yy}e", "s", None, "forecast"), ("{q}q {y}", "y", "q", "actual"), ("n/a", None, None, None),
    ("{yy}Q{q}", "s", "q", "actual"), ("{y}A", "y", None, "actual"), ("{yy} est", "s", None, "forecast"), ("FY {y} F", "y", None, "forecast"), ("{q}Q{y}EST", "y", "q", "forecast"), ("５Q{yy}", None, None, None),
    ("２０25E", "2025", None, "forecast"), ("{yy}", None, None, None), ("{q} Q {yy} a", "s", "q", "actual"), ("{y}X", None, None, None), ("2{y}", None, None, None),
]


def _said(k: int, year: str | None, quarter: str | None, role: str | None) -> str:
    number = {"y": "y", "s": "2000 + y % 100", None: "null"}.get(year, year)
    return f"when {k} then {{'year': ({number})::int, 'quarter': ({'q' if quarter else 'null'})::int, 'role': {repr(role) if role else 'null::varchar'}}}"


def _text(form: str) -> str:
    parts = form.replace("{yy}", "\0s\0").replace("{y}", "\0y\0").replace("{q}", "\0q\0").split("\0")
    return "||".join({"y": "y::varchar", "s": "lpad((y % 100)::varchar, 2, '0')", "q": "q::varchar"}.get(p, f"'{p}'") if k % 2 else f"'{p}'" for k, p in enumerate(parts))


@query(f"""
with l as (select o_orderkey, year(o_orderdate)::int as y, quarter(o_orderdate)::int as q, (o_orderkey % {len(LABELS)})::int as k from orders),
t as (select o_orderkey, case k {' '.join(f'when {k} then {_text(x[0])}' for k, x in enumerate(LABELS))} end as label, case k {' '.join(_said(k, *x[1:]) for k, x in enumerate(LABELS))} end as p from l)
select o_orderkey, label, p.year as year, p.quarter as quarter, p.role as role from t""")
def period_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period labels in all their forms: year, quarter and role, or nothing."""
    y, q = F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string")
    yy = F.lpad((F.year("o_orderdate") % 100).cast("string"), 2, "0")
    label = F.lit(None).cast("string")
    for k, (form, *_) in enumerate(LABELS):
        written = F.replace(F.replace(F.replace(F.lit(form), F.lit("{yy}"), yy), F.lit("{y}"), y), F.lit("{q}"), q)
        label = F.when(F.col("o_orderkey") % len(LABELS) == k, written).otherwise(label)
    o = table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label")).withColumn("p", P.parse_label(F.col("label")))
    return o.select("o_orderkey", "label", "p.year", "p.quarter", "p.role")


@query("""
with seen as (select o_custkey, year(o_orderdate)::int * 4 + quarter(o_orderdate)::int - 1 as i, bool_or(o_orderstatus = 'O') as fc from orders group by 1, 2),
want as (select c_custkey, r.i, r.i > 1998 * 4 + 1 as fc from customer, range(1998 * 4 + 3 - 7, 1998 * 4 + 4) r(i)),
a as (select coalesce(c_custkey, o_custkey) as c_custkey, count(*) filter (where seen.i is null) as missing, count(*) filter (where want.i is null) as unexpected, count(*) filter (where want.fc <> seen.fc) as role_mismatches, count(seen.i) as detected
  from want full join seen on o_custkey = c_custkey and seen.i = want.i group by 1)
select c_custkey, detected, missing, unexpected, role_mismatches, case when detected = 0 then 'not_detected' when missing + unexpected + role_mismatches > 0 then 'refresh_required' else 'ready' end as state from a""")
def period_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected against expected quarters: missing, unexpected and role mismatches per entity."""
    o = table(spark, sf_dir, "orders")
    seen = o.groupBy(F.col("o_custkey").alias("c_custkey"), P.index(F.year("o_orderdate"), F.quarter("o_orderdate")).alias("i")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("seen_forecast"))
    want = table(spark, sf_dir, "customer").select("c_custkey", F.explode(P.rolling_quarters(F.lit(1998), F.lit(4))).alias("p")).select("c_custkey", P.index(F.col("p.year"), F.col("p.quarter")).alias("i"))
    want = want.withColumn("want_forecast", F.col("i") > 1998 * 4 + 1)
    j = want.join(seen, ["c_custkey", "i"], "full")
    a = j.groupBy("c_custkey").agg(
        F.count("seen_forecast").alias("detected"), F.count_if(F.col("seen_forecast").isNull()).alias("missing"), F.count_if(F.col("want_forecast").isNull()).alias("unexpected"),
        F.count_if(F.col("want_forecast") != F.col("seen_forecast")).alias("role_mismatches"),
    )
    state = F.when(F.col("detected") == 0, "not_detected").when(F.col("missing") + F.col("unexpected") + F.col("role_mismatches") > 0, "refresh_required").otherwise("ready")
    return a.withColumn("state", state)


@query("""
with p as (select distinct year(o_orderdate)::int as y, quarter(o_orderdate)::int as q from orders)
select y, q, y * 4 + q - 1 as idx, q || 'Q' || lpad((y % 100)::varchar, 2, '0') as label, y - 1 as yoy_year, q as yoy_quarter, case when q = 1 then y - 1 else y end as qoq_year, case when q = 1 then 4 else q - 1 end as qoq_quarter,
  least(greatest(make_date(y, (q - 1) * 3 + 1, 1) - 30, date '1999-03-31' - 240), date '1999-03-31')::date as news_start from p""")
def comparison_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).distinct()
    y, q = F.col("y"), F.col("q")
    p = p.withColumn("a", P.comparison_period(y, q, F.lit("yoy"))).withColumn("b", P.comparison_period(y, q, F.lit("qoq")))
    return p.select("y", "q", P.index(y, q).alias("idx"), P.label(y, q).alias("label"), F.col("a.year").alias("yoy_year"), F.col("a.quarter").alias("yoy_quarter"), F.col("b.year").alias("qoq_year"), F.col("b.quarter").alias("qoq_quarter"), P.news_window(y, q, F.lit("1999-03-31").cast("date"))["start"].alias("news_start"))


@query("""
with y as (select o_custkey, max(year(o_orderdate))::int as b from orders group by 1)
select o_custkey, (b + r.o)::int as year, case when r.o <= 0 then 'actual' else 'forecast' end as role,
  case when r.o < -1 then 'connect' when r.o <= 0 then 'keep' when r.o = 1 then 'collect' else 'later_stage' end as action from y, range(-1, 4) r(o)""")
def collection_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annual plan of each entity, and what to do for each of its years."""
    b = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.year("o_orderdate")).alias("b"))
    p = b.select("o_custkey", "b", F.explode(P.annual_plan(F.col("b"))).alias("p"))
    off = F.col("p.year") - F.col("b")
    return p.select("o_custkey", "p.year", "p.role", F.when(off < -1, "connect").when(off <= 0, "keep").when(off == 1, "collect").otherwise("later_stage").alias("action"))


@query("""
select event_id, (ts + interval 9 hour)::date as kst_day, ((ts + interval 9 hour)::date + interval 1 day - interval 1 millisecond - interval 9 hour)::timestamp as day_end, ((ts + interval 9 hour)::date + interval 1 day - interval 9 hour)::timestamp as available_at,
  strftime(ts, '%Y%m%d') || lpad(event_id::varchar, 6, '0') as receipt, ts::date as filed from events""")
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    day = P.local_day(F.col("ts"))
    e = e.withColumn("receipt", F.concat(F.date_format("ts", "yyyyMMdd"), F.lpad(F.col("event_id").cast("string"), 6, "0")))
    return e.select("event_id", day.alias("kst_day"), P.end_of_local_day(day).cast("timestamp_ntz").alias("day_end"), P.next_local_midnight(day).cast("timestamp_ntz").alias("available_at"), "receipt", P.filing_date(F.col("receipt")).alias("filed"))
