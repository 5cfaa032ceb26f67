"""Validation queries: orders as filings, lines as their rows and as evidence candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..operators import asof
from ..operators import evidence as E
from ..operators import validation as V
from ..registry import query, table

SCOPES = "case o_orderstatus when 'F' then ['CFS'] when 'O' then ['CFS', 'OFS'] else ['OFS'] end"


def _chain(p: str) -> str:
    return f"when {p}r is null then case when {p}ro is not null then 'scope_mismatch' else 'report_unavailable' end when company is not null and {p}code <> company then 'manual_review' when {p}n is null then case when {p}no is not null then 'scope_mismatch' else 'account_not_found' end when {p}n > 1 then 'account_ambiguous'"


@query(f"""
with t as (select c_custkey as id, c_custkey as corp, 1996 + c_custkey % 5 as y, 1 + c_custkey % 4 as q, case c_custkey % 3 when 0 then 'single_quarter' when 1 then 'year_to_date' else 'annual' end as basis, case when c_custkey % 2 = 0 then 'CFS' else 'OFS' end as scope,
  case c_custkey % 7 when 0 then null when 1 then 'USD' when 2 then 'KRW_MILLION' else 'KRW' end as unit, c_custkey % 6 as metric, case when c_custkey % 4 <> 3 then 'co' || c_custkey end as company from customer),
x as (select *, case when scope = 'CFS' then 'OFS' else 'CFS' end as other, case when metric < 5 then 'acc' || metric end as rule, case when basis = 'annual' then 4 else q end as due, basis = 'single_quarter' and q > 1 as needs from t),
f as (select o_custkey as corp, year(o_orderdate) as y, quarter(o_orderdate) as q, unnest({SCOPES}) as scope, o_orderkey, o_orderdate from orders where o_orderdate <= timestamp '2001-01-01'),
r as (select corp, y, q, scope, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as report, 'co' || case when arg_max(o_orderkey, (o_orderdate, o_orderkey)) % 6 = 0 then 0 else corp end as code from f group by corp, y, q, scope),
w as (select l_orderkey as report, case when l_linestatus = 'F' then 'CFS' else 'OFS' end as scope, 'acc' || (l_partkey % 5) as rule, count(*) as n, min(case when l_partkey % 17 > 0 then l_extendedprice::decimal(18,2) end) as v from lineitem group by all),
j as (select x.*, a.code as ccode, c.code as pcode, a.report as cr, b.report as cro, aw.n as cn, aw.v as cv, bw.n as cno, c.report as pr, d.report as pro, cw.n as pn, cw.v as pv, dw.n as pno from x
  left join r a on a.corp = x.corp and a.y = x.y and a.q = due and a.scope = x.scope left join r b on b.corp = x.corp and b.y = x.y and b.q = due and b.scope = other
  left join w aw on aw.report = a.report and aw.rule = x.rule and aw.scope = x.scope left join w bw on bw.report = a.report and bw.rule = x.rule and bw.scope = other
  left join r c on c.corp = x.corp and c.y = x.y and c.q = x.q - 1 and c.scope = x.scope and needs left join r d on d.corp = x.corp and d.y = x.y and d.q = x.q - 1 and d.scope = other and needs
  left join w cw on cw.report = c.report and cw.rule = x.rule and cw.scope = x.scope left join w dw on dw.report = c.report and dw.rule = x.rule and dw.scope = other),
s as (select *, case when rule is null or unit is null then 'manual_review' {_chain('c')} when needs and (pr is null or (company is not null and pcode <> company) or pn is null or pn > 1) then case {_chain('p')} end when unit = 'USD' then 'unit_unknown' when cv is null or (needs and pv is null) then 'manual_review' else 'validated' end as status_code from j)
select id, rule, cr as report, status_code, case when status_code = 'validated' then ((cv - case when needs then pv else 0 end)::decimal(24,2) * case unit when 'KRW_MILLION' then 0.000001 else 1 end::decimal(12,9))::decimal(38,12) end as value from s""")
def official_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets against filings: alias, filing, company, scope, row, previous cumulative filing, unit and amount, each with its code."""
    k = F.col("c_custkey")
    targets = table(spark, sf_dir, "customer").select(
        k.alias("id"), k.alias("corp"), (k % 5 + 1996).cast("int").alias("year"), (k % 4 + 1).cast("int").alias("quarter"), F.when(k % 3 == 0, "single_quarter").when(k % 3 == 1, "year_to_date").otherwise("annual").alias("basis"),
        F.when(k % 2 == 0, "CFS").otherwise("OFS").alias("scope"), F.when(k % 7 == 1, "USD").when(k % 7 == 2, "KRW_MILLION").when(k % 7 > 2, "KRW").alias("unit"),
        F.concat(F.when(k % 2 == 0, " ACCOUNT  ").otherwise("acc ount"), (k % 6).cast("string")).alias("metric"), F.when(k % 4 != 3, F.concat(F.lit("co"), k.cast("string"))).alias("company"),
    )
    rules = spark.createDataFrame([(f"account{i}", f"acc{i}") for i in range(5)], "label string, rule string")
    scopes = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("CFS"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("CFS"), F.lit("OFS"))).otherwise(F.array(F.lit("OFS")))
    filed = table(spark, sf_dir, "orders").where(F.col("o_orderdate") <= F.lit("2001-01-01").cast("timestamp"))
    filed = filed.select(F.col("o_custkey").alias("corp"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"), F.explode(scopes).alias("scope"), F.col("o_orderkey").alias("report"), "o_orderdate")
    reports = asof.latest_per_key(filed, ["corp", "year", "quarter", "scope"], [F.col("o_orderdate"), F.col("report")], ["report"])
    reports = reports.withColumn("code", F.concat(F.lit("co"), F.when(F.col("report") % 6 == 0, 0).otherwise(F.col("corp")).cast("string")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report"), F.when(F.col("l_linestatus") == "F", "CFS").otherwise("OFS").alias("scope"), F.concat(F.lit("acc"), (F.col("l_partkey") % 5).cast("string")).alias("rule"), F.when(F.col("l_partkey") % 17 > 0, F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"))
    return V.official_values(targets, rules, reports, rows, {"KRW": "1", "KRW_MILLION": "0.000001"})


CANDIDATES = """c as (select l_orderkey, l_linenumber, l_partkey, l_quantity, o_orderkey, 'amount ' || (l_orderkey + case when l_linenumber = 7 then 1 else 0 end) as quote, o_orderpriority || ' company ' || o_custkey || ' amount ' || o_orderkey || ' end' as body,
  'company ' || (o_custkey + case when l_linenumber = 6 then 1 else 0 end) || ' ' as company, case o_orderstatus when 'F' then 'DART' when 'O' then 'NEWS' else 'ECOS' end as kind, case when o_orderkey % 10 <> 0 then o_orderdate end as available,
  year(o_orderdate)::int as y, quarter(o_orderdate)::int as q, (year(o_orderdate) - case when l_linenumber = 5 then 1 else 0 end) || case when l_quantity > 45 then ' 반기' when l_quantity > 40 then ' 연간' else ' ' || quarter(o_orderdate) || '분기' end as period,
  case l_linenumber % 3 when 0 then 'frmtrm_amount' when 1 then 'bfefrmtrm_amount' else 'thstrm_amount' end as field, case when l_linestatus = 'F' then 'CFS' else 'OFS' end as scope, l_suppkey % 2 = 0 as asked, l_returnflag as metric, o_custkey % 10 as question,
  (o_custkey + case when l_linenumber = 4 then 1 else 0 end) % 10 as bound, case when o_orderkey % 2 = 0 then 'YoY' else 'QoQ' end as comparison, l_tax > 0.04 as critical,
  case when l_discount > 0 then l_orderkey::varchar end as original, case when l_discount > 0.08 then '1,2' else l_orderkey::varchar end as normal, case when l_tax > 0.07 then ' ' else 'KRW' end as unit from lineitem join orders on o_orderkey = l_orderkey),
p as (select *, list_transform(regexp_extract_all(period, '(?:19|20)[0-9]{2}'), lambda x: x::int) as years, list_transform(regexp_extract_all(period, '([1-4])\\s*(?:분기|[qQ])', 1), lambda x: x::int) as quarters from c),
m as (select *, list_contains(years, y - case when field like 'bfefrmtrm%' then 2 when field like 'frmtrm%' then 1 else 0 end) and case when len(quarters) > 0 then list_contains(quarters, q) when period like '%반기%' then q = 2 when period like '%연간%' then q = 4 else false end as same_period from p)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as evidence candidates of their order, the source."""
    n, k = F.col("l_linenumber"), F.col("o_orderkey")
    year, quarter = F.year("o_orderdate"), F.quarter("o_orderdate")
    text = lambda c: c.cast("string")
    one = lambda at: F.when(n == at, 1).otherwise(0)
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == k)
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "o_orderkey", F.concat(F.lit("amount "), text(F.col("l_orderkey") + one(7))).alias("quote"),
        F.concat("o_orderpriority", F.lit(" company "), text(F.col("o_custkey")), F.lit(" amount "), text(k), F.lit(" end")).alias("body"), F.concat(F.lit("company "), text(F.col("o_custkey") + one(6)), F.lit(" ")).alias("company"),
        F.when(F.col("o_orderstatus") == "F", "DART").when(F.col("o_orderstatus") == "O", "NEWS").otherwise("ECOS").alias("kind"), F.when(k % 10 != 0, F.col("o_orderdate")).alias("available"), year.alias("y"), quarter.alias("q"),
        F.concat(text(year - one(5)), F.when(F.col("l_quantity") > 45, " 반기").when(F.col("l_quantity") > 40, " 연간").otherwise(F.concat(F.lit(" "), text(quarter), F.lit("분기")))).alias("period"),
        F.when(n % 3 == 0, "frmtrm_amount").when(n % 3 == 1, "bfefrmtrm_amount").otherwise("thstrm_amount").alias("field"), F.when(F.col("l_linestatus") == "F", "CFS").otherwise("OFS").alias("scope"), (F.col("l_suppkey") % 2 == 0).alias("asked"),
        F.col("l_returnflag").alias("metric"), (F.col("o_custkey") % 10).alias("question"), ((F.col("o_custkey") + one(4)) % 10).alias("bound"), F.when(k % 2 == 0, "YoY").otherwise("QoQ").alias("comparison"), (F.col("l_tax") > 0.04).alias("critical"),
        F.when(F.col("l_discount") > 0, text(F.col("l_orderkey"))).alias("original"), F.when(F.col("l_discount") > 0.08, "1,2").otherwise(text(F.col("l_orderkey"))).alias("normal"), F.when(F.col("l_tax") > 0.07, " ").otherwise("KRW").alias("unit"),
    )


@query(f"""
with {CANDIDATES},
a as (select *, case when comparison = 'YoY' then [y, y - 1] else [y] end as allowed_years, case when comparison = 'QoQ' then [q, case when q = 1 then 4 else q - 1 end] else [q] end as allowed_quarters from m),
e as (select l_orderkey, l_linenumber, l_partkey, l_quantity, list_filter([
  case when not contains(body, quote) then 'exact_quote' end, case when not (kind = 'ECOS' or contains(body, company)) then 'company' end, case when available > timestamp '2000-01-01' then 'cutoff' end,
  case when kind = 'DART' and not same_period then 'period' end, case when kind = 'DART' and o_orderkey % 3 <> 0 and scope <> 'CFS' then 'scope' end, case when l_partkey % 50 = 0 then 'source_location' end,
  case when asked and bound <> question then 'question_binding' end, case when asked and metric not in ('A', 'N') then 'metric_binding' end, case when asked and (kind = 'ECOS' or o_orderkey % 4 = 0) then 'source_binding' end,
  case when asked and not (len(years) > 0 and len(list_filter(years, lambda x: not list_contains(allowed_years, x))) = 0 and len(quarters) > 0 and len(list_filter(quarters, lambda x: not list_contains(allowed_quarters, x))) = 0) then 'planned_period' end,
  case when critical and (original is null or normal = '1,2') then 'numeric_normalization' end, case when critical and (original is null or 'amount ' || original <> quote) then 'numeric_quote_binding' end, case when critical and unit = ' ' then 'unit' end], lambda x: x is not null) as failed from a)
select l_orderkey, l_linenumber, l_partkey, l_quantity, array_to_string(failed, ',') as failed, case when len(failed) = 0 then 'passed' else 'failed' end as machine_status from e""")
def evidence_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six checks of every candidate, four more of those bound to a question, three more of critical numbers; all must hold."""
    c = F.col
    numbers = F.regexp_extract_all(c("quote"), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    checks = [
        ("exact_quote", None, F.contains("body", "quote")), ("company", None, (c("kind") == "ECOS") | F.contains("body", "company")), ("cutoff", None, c("available").isNull() | (c("available") <= F.lit("2000-01-01").cast("timestamp"))),
        ("period", c("kind") == "DART", V.source_period(c("period"), c("y"), c("q"), c("field"))), ("scope", c("kind") == "DART", (c("o_orderkey") % 3 == 0) | (c("scope") == "CFS")), ("source_location", None, c("l_partkey") % 50 != 0),
        ("question_binding", c("asked"), c("bound") == c("question")), ("metric_binding", c("asked"), c("metric").isin("A", "N")), ("source_binding", c("asked"), c("kind").isin("DART", "NEWS") & (c("o_orderkey") % 4 != 0)),
        ("planned_period", c("asked"), V.period_planned(c("period"), F.concat(c("y").cast("string"), F.lit("년 "), c("q").cast("string"), F.lit("Q")), c("comparison"))),
        ("numeric_normalization", c("critical"), c("original").isNotNull() & c("normal").rlike(r"^-?[0-9]+(\.[0-9]+)?$")), ("numeric_quote_binding", c("critical"), F.array_contains(numbers, c("original"))), ("unit", c("critical"), F.trim("unit") != ""),
    ]
    e = _candidates(spark, sf_dir).withColumn("failed", V.failed_checks(checks))
    return e.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.array_join("failed", ",").alias("failed"), F.when(F.size("failed") == 0, "passed").otherwise("failed").alias("machine_status"))


@query(f"with {CANDIDATES} select l_orderkey, l_linenumber, l_partkey, l_quantity, period, field, same_period as matches from m where kind = 'DART'")
def source_period_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate's period against its filing's, earlier terms shifted; quarters, halves and whole years by name."""
    e = _candidates(spark, sf_dir).where("kind = 'DART'")
    return e.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "period", "field", V.source_period(F.col("period"), F.col("y"), F.col("q"), F.col("field")).alias("matches"))


@query("""
with t as (select p_partkey, p_size, case p_partkey % 4 when 0 then p_size::varchar when 1 then (p_size * 3) || '.5' when 2 then ' ' || p_size || '.25' else '0' end as per, case p_partkey % 3 when 0 then (p_size * 1000)::varchar when 1 then '0' || p_size else (p_size::bigint * 100000000)::varchar end as price from part)
select p_partkey, case p_partkey % 4 when 0 then p_size || '.0' when 1 then case when p_size * 3 < 100 then (p_size * 3) || '.5' end end as multiple, case when p_partkey % 3 = 0 and p_size > 0 then price when p_partkey % 3 = 2 and p_size between 1 and 10 then price end as price from t""")
def target_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target multiples and prices as users write them, in canonical form or refused."""
    k, s = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    per = F.when(k % 4 == 0, text(s)).when(k % 4 == 1, F.concat(text(s * 3), F.lit(".5"))).when(k % 4 == 2, F.concat(F.lit(" "), text(s), F.lit(".25"))).otherwise("0")
    price = F.when(k % 3 == 0, text(s * 1000)).when(k % 3 == 1, F.concat(F.lit("0"), text(s))).otherwise(text(s.cast("long") * 100_000_000))
    return table(spark, sf_dir, "part").select("p_partkey", V.target_multiple(per).alias("multiple"), V.target_price(price).alias("price"))


@query("""
with t as (select o_orderkey, year(o_orderdate)::int as y, quarter(o_orderdate)::int as q, month(o_orderdate)::int as m from orders)
select o_orderkey, case o_orderkey % 4 when 0 then y || '-' || lpad(m::varchar, 2, '0') when 1 then y || '-0' || q when 2 then y || '-0' || q end as sort_key, (y - 1) || ',' || y || ',' || (y + 1) as years, (y - 2) || ',' || (y - 1) || ',' || y || ',' || (y + 1) as window_years from t""")
def category_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort keys of category labels, the years a target may have, and the compact window of four annual periods."""
    k, y, q = F.col("o_orderkey"), F.year("o_orderdate"), F.quarter("o_orderdate").cast("string")
    label = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM")).when(k % 4 == 1, F.concat(y.cast("string"), F.lit("Q"), q)).when(k % 4 == 2, F.concat(y.cast("string"), F.lit("  q"), q)).otherwise(F.concat(q, F.lit("Q"), y.cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.category_key(label).alias("sort_key"), F.array_join(F.sequence(y - 1, y + 1).cast("array<string>"), ",").alias("years"), F.array_join(F.slice(F.sequence(y - 2, y + 2), 1, 4).cast("array<string>"), ",").alias("window_years"))


@query("""
with u as (select user_id, event_type as model, event_id % 2 = 1 as output, (props->>'$.k')::bigint as tokens from events),
t as (select user_id, model, coalesce(sum(tokens) filter (not output), 0)::bigint as input_tokens, coalesce(sum(tokens) filter (output), 0)::bigint as output_tokens, count(*) filter (tokens is null) as unreported from u group by 1, 2)
select user_id, model, input_tokens, output_tokens, unreported, case model when 'click' then ((input_tokens * 500 + output_tokens * 2000)::decimal(20,0) * 0.00000001::decimal(9,8))::decimal(28,8) when 'purchase' then ((input_tokens * 25 + output_tokens * 125)::decimal(20,0) * 0.00000001::decimal(9,8))::decimal(28,8) end as cost from t""")
def usage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that calls report, by user and model, and their cost at a price per million; a model without a price costs an unknown amount."""
    prices = spark.createDataFrame([("click", 500, 2000), ("purchase", 25, 125)], "model string, price_in long, price_out long")  # cents per million: a fixed table
    tokens = F.get_json_object("props", "$.k").try_cast("long")
    u = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("model"), (F.col("event_id") % 2 == 1).alias("output"), tokens.alias("tokens"))
    total = lambda out: F.coalesce(F.sum(F.when(F.col("output") == out, F.col("tokens"))), F.lit(0))
    g = u.groupBy("user_id", "model").agg(total(False).alias("input_tokens"), total(True).alias("output_tokens"), F.count_if(F.col("tokens").isNull()).alias("unreported")).join(F.broadcast(prices), "model", "left")
    cents = (F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")).cast("decimal(20,0)")
    return g.select("user_id", "model", "input_tokens", "output_tokens", "unreported", (cents * F.lit("0.00000001").cast("decimal(9,8)")).cast("decimal(28,8)").alias("cost"))


@query("""
with l as (select user_id, arg_max(event_type, (ts, event_id)) as last_type, max(ts) as seen from events group by 1),
s as (select *, case last_type when 'click' then 'running' when 'view' then 'queued' when 'error' then 'cancel_requested' else 'done' end as state, (user_id % 3 = 0) as known from l)
select user_id, state, case when state = 'done' or seen > (select max(ts) from events) - interval 60 second then 'none' when known and state = 'cancel_requested' then 'mark_cancelled' when known or state = 'queued' then 'none' else 'mark_failed' end as repair from s""")
def stuck_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active jobs without a sign of life for a minute, and what to do about them: the last event of each lane against the clock."""
    e = table(spark, sf_dir, "events")
    clock = e.agg(F.max("ts").alias("clock"))  # one row
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("seen")).join(F.broadcast(clock), how="cross")
    t = F.col("last_type")
    state = F.when(t == "click", "running").when(t == "view", "queued").when(t == "error", "cancel_requested").otherwise("done")
    s = last.select("user_id", state.alias("state"), "seen", "clock", (F.col("user_id") % 3 == 0).alias("known"))
    alive = (F.col("state") == "done") | (F.col("seen") > F.col("clock") - F.expr("interval 60 seconds"))
    repair = F.when(alive, "none").when(F.col("known") & (F.col("state") == "cancel_requested"), "mark_cancelled").when(F.col("known") | (F.col("state") == "queued"), "none").otherwise("mark_failed")
    return s.select("user_id", "state", repair.alias("repair"))


@query("""
with e as (select l_orderkey as question, l_linenumber, l_partkey, l_returnflag as metric, l_quantity > 10 as passed, l_tax > 0.07 as rejected from lineitem), r as (select o_orderkey as question, case o_orderkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end as rerun from orders where o_orderstatus <> 'F')
select e.question, l_linenumber, l_partkey, metric from e join r using (question) where metric <> rerun and passed and not rejected""")
def prior_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a re-run of one metric keeps of a question's evidence: other metrics that passed and nobody rejected."""
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(k.alias("question"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise("R").alias("rerun"))
    e = table(spark, sf_dir, "lineitem").where("l_quantity > 10 and not l_tax > 0.07").select(F.col("l_orderkey").alias("question"), "l_linenumber", "l_partkey", F.col("l_returnflag").alias("metric"))
    return e.join(runs, "question").where("metric <> rerun").drop("rerun")


@query("""
with need as (select c_custkey, unnest(['F', 'O', 'P']) as slot from customer), have as (select o_custkey as c_custkey, o_orderstatus as slot, max(o_orderkey) as value from orders group by 1, 2)
select c_custkey, slot, value, case when value is null then 'synthesised' else 'present' end as origin from need left join have using (c_custkey, slot)""")
def slot_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required output slots: present ones with their value, missing ones synthesised."""
    have = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("slot")).agg(F.max("o_orderkey").alias("value"))
    need = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("P"))).alias("slot"))
    return need.join(have, ["c_custkey", "slot"], "left").withColumn("origin", F.when(F.col("value").isNull(), "synthesised").otherwise("present"))


#: Labels as sources write them.
LABELS = ["Actual", " EST ", "실적", None, "Preliminary Actual", "F", "전 망", "Guidance", "", "Projected"]


@query("""
with t as (select o_orderkey, lower(regexp_replace(coalesce((['Actual', ' EST ', '실적', null, 'Preliminary Actual', 'F', '전 망', 'Guidance', '', 'Projected'])[o_orderkey % 10 + 1], ''), '\\s+', '', 'g')) as bare from orders)
select o_orderkey, case when bare in ('', 'actual', 'a', 'preliminary_actual', 'preliminaryactual', '실적', '잠정실적', '확정') then 'actual' when bare in ('forecast', 'f', 'e', 'est', 'estimate', 'projection', 'projected', '전망', '예상', '추정') then 'forecast' else bare end as kind from t""")
def value_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of values as one of a few kinds."""
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.value_kind(label).alias("kind"))


@query("""
with b as (select l_orderkey // 16 as page, l_orderkey, l_linenumber, (l_partkey % 50) * 10 as x, (l_orderkey % 16) * 50 + l_linenumber * 7 as y from lineitem)
select page, floor(min(x) * 75 + 0.5) / 100 as x0, floor(min(y) * 75 + 0.5) / 100 as y0, floor(max(x + 80) * 75 + 0.5) / 100 as x1, floor(max(y + 9) * 75 + 0.5) / 100 as y1, (max(x + 80) - min(x)) * (max(y + 9) - min(y)) as area from b group by 1""")
def layout_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around all objects of a page, in points, and its area in pixels."""
    b = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 16).alias("page"), (F.col("l_partkey") % 50 * 10).alias("x"), (F.col("l_orderkey") % 16 * 50 + F.col("l_linenumber") * 7).alias("y"))
    box = b.groupBy("page").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + 80).alias("x1"), F.max(F.col("y") + 9).alias("y1"))
    return box.select("page", *[N.points(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")], ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


@query("""
with d as (select doc_id, lower(text) as body, case source when 'src0' then 'COMPANY_IR' when 'src1' then 'COMPANY_IR' when 'src2' then 'FILING' else 'NEWS' end as kind, case when doc_id % 11 <> 0 then date '2024-01-01' + (doc_id % 400)::int end as published,
  case lang when 'en' then ['THE', 'en'] when 'de' then ['sch', 'de'] when 'fr' then ['ment', 'fr'] else ['ción', 'es'] end as names, ['q' || (doc_id % 4 + 1), 'ta', 'no'] as periods from documents)
select doc_id, kind, case when published > date '2025-01-01' then 'cutoff_violation' when kind = 'FILING' then 'ok' when published is null then 'published_missing'
  when not coalesce(len(list_filter(names, lambda w: length(w) >= 3 and contains(body, lower(w)))) > 0, false) then 'company_mismatch'
  when kind = 'COMPANY_IR' and not coalesce(len(list_filter(periods, lambda w: contains(body, w))) > 0, false) then 'period_mismatch' else 'ok' end as identity from d""")
def material_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is of its company and period, before the cutoff."""
    k, source, lang = F.col("doc_id"), F.col("source"), F.col("lang")
    kind = F.when(source.isin("src0", "src1"), "COMPANY_IR").when(source == "src2", "FILING").otherwise("NEWS")
    names = F.when(lang == "en", F.array(F.lit("THE"), F.lit("en"))).when(lang == "de", F.array(F.lit("sch"), F.lit("de"))).when(lang == "fr", F.array(F.lit("ment"), F.lit("fr"))).otherwise(F.array(F.lit("ción"), F.lit("es")))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", kind.alias("kind"), names.alias("names"), F.when(k % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int"))).alias("published"))
    periods = F.array(F.concat(F.lit("q"), (k % 4 + 1).cast("string")), F.lit("ta"), F.lit("no"))
    return E.material_identity(d, F.col("text"), F.col("kind"), F.col("published"), F.lit("2025-01-01").cast("date"), F.col("names"), periods).select("doc_id", "kind", "identity")
