"""Streaming queries over all events: windows as batch twins, and idempotent requests as a stream that runs to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_path
from ..registry import query, table
from ..streaming import events as S
from ..streaming import idempotency as I


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select time_bucket(interval 6 hour, ts, timestamp '2024-01-01') as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tumbling(_events(spark, sf_dir), "6 hours", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("with o as (select ts, unnest([0, 1]) as k from events) select time_bucket(interval 6 hour, ts, timestamp '2024-01-01') - (k * interval 6 hour) as start, count(*) as n from o group by 1")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sliding(_events(spark, sf_dir), "12 hours", "6 hours", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
with g as (select user_id, ts, case when ts >= lag(ts) over w + interval 2 hour then 1 else 0 end as b from events window w as (partition by user_id order by ts)), s as (select *, sum(b) over (partition by user_id order by ts) as k from g)
select user_id, min(ts) as start, max(ts) + interval 2 hour as "end", count(*) as n from s group by user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.sessions(_events(spark, sf_dir), "2 hours", "1 hour")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""
with r as (select event_id, user_id as job, event_id % 3 as attempt, event_type, ts, event_type = 'error' as terminal, row_number() over (partition by user_id, event_id % 3, event_type order by ts, event_id) as again, max(event_id % 3) over (partition by user_id) as newest from events)
select event_id, job, case when again > 1 then 'duplicate' when attempt < newest then 'obsolete' when terminal then 'terminal' else 'publish' end as disposition from r""")
def late_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", F.col("user_id").alias("job"), (F.col("event_id") % 3).alias("attempt"), "event_type", "ts", (F.col("event_type") == "error").alias("terminal"))
    return S.fenced(e, "job", "attempt", "terminal", "event_type").select("event_id", "job", "disposition")


@query("select user_id, max(value) as progress from events group by 1")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.progress(_events(spark, sf_dir), "user_id", "value")


#: A user's events of one type share keys for some days; every tenth key is too short, every ninth request differs.
REQUESTS = """
with recursive r as (
  select event_id as request, user_id::varchar || '/' || event_type as scope, case when event_id % 10 = 0 then ' short ' || user_id else 'request-key-' || lpad((user_id % 7)::varchar, 8, '0') end as key, (case when event_id % 9 = 0 then 'other' else event_type end) as hash, ts from events),
n as (select *, row_number() over (partition by scope, trim(key) order by ts, request) as k from r where length(trim(key)) between 16 and 128),
w(scope, key, k, request, hash, ts, said, first, first_hash, expires) as (
  select scope, trim(key), k, request, hash, ts, 'stored', request, hash, ts + interval 24 hour from n where k = 1
  union all select n.scope, trim(n.key), n.k, n.request, n.hash, n.ts, case when w.expires <= n.ts then 'stored' when w.first_hash = n.hash then 'replayed' else 'conflict' end,
    case when w.expires <= n.ts then n.request else w.first end, case when w.expires <= n.ts then n.hash else w.first_hash end, case when w.expires <= n.ts then n.ts + interval 24 hour else w.expires end
  from w join n on n.scope = w.scope and trim(n.key) = w.key and n.k = w.k + 1)
select scope, key, request, said as disposition, case said when 'conflict' then 409 else 201 end as status, case when said <> 'conflict' then first end as answered_by from w
union all select scope, trim(key), request, 'refused', 400, null from r where length(trim(key)) not between 16 and 128"""


def requests(events: DataFrame) -> DataFrame:
    """Events as requests under keys."""
    user = F.col("user_id").cast("string")
    key = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit(" short "), user)).otherwise(F.concat(F.lit("request-key-"), F.lpad((F.col("user_id") % 7).cast("string"), 8, "0")))
    return events.select(F.col("event_id").alias("request"), F.concat(user, F.lit("/"), "event_type").alias("scope"), key.alias("key"), F.when(F.col("event_id") % 9 == 0, "other").otherwise(F.col("event_type")).alias("hash"), F.col("ts").cast("timestamp").alias("ts"))


@query(REQUESTS)
def idempotent_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests stored, replayed within a day, in conflict or refused: a stateful stream over all events, run to its end."""
    path = shared_path(spark, "idempotency")
    answered = I.respond(spark, requests(S.source(spark, f"{sf_dir}/events.parquet")), "1 day")
    return I.run_into(spark, answered, f"{path}/out", f"{path}/checkpoint").drop("ts")


#: A user's events as results of one job: attempts grow with time and sometimes fall back, few different hashes, errors end an attempt.
DECIDED = """
with recursive r as (select event_id as result, user_id::varchar as job, event_id // 250 - case when event_id % 13 = 0 then 1 else 0 end as attempt, event_id % 40 as sequence, case when event_id % 17 = 0 then 'bad' else sha256(user_id || '/' || (event_id // 60) % 3) end as hash, event_type = 'error' as ends, ts from events),
n as (select *, length(hash) = 64 as good, row_number() over (partition by job order by ts, result) as k from r),
w as (
  select job, k, result, attempt as row_attempt, sequence as row_sequence, case when ends then 'ended' when not good then 'hash_invalid' else 'publish' end as said,
    case when ends or good then attempt end as attempt, case when good and not ends then hash end as hash, case when good and not ends then sequence end as sequence, ends as ended from n where k = 1
  union all
  select job, k, result, row_attempt, row_sequence, said, case when moves then row_attempt else old_attempt end,
    case when moves then case when n_ends then null else n_hash end when said = 'publish' then n_hash else old_hash end, case when moves then case when n_ends then null else row_sequence end when said = 'publish' then row_sequence else old_sequence end,
    case when moves then n_ends when n_ends and said = 'ended' then true else old_ended end
  from (select n.job, n.k, n.result, n.attempt as row_attempt, n.sequence as row_sequence, n.hash as n_hash, n.ends as n_ends, w.attempt as old_attempt, w.hash as old_hash, w.sequence as old_sequence, w.ended as old_ended,
      (n.ends or n.good) and (w.attempt is null or n.attempt > w.attempt) as moves,
      case when n.ends then case when n.attempt < w.attempt then 'obsolete' else 'ended' end when not n.good then 'hash_invalid' when w.attempt is null or n.attempt > w.attempt then 'publish' when n.attempt < w.attempt then 'obsolete'
        when w.hash is not null and n.hash <> w.hash then 'hash_conflict' when w.sequence is not null and n.sequence < w.sequence then 'out_of_order' when n.hash = w.hash then 'duplicate' when w.ended then 'terminal' else 'publish' end as said
    from w join n on n.job = w.job and n.k = w.k + 1) as x)
select job, result, row_attempt as attempt, row_sequence as sequence, said as disposition from w"""


@query(DECIDED)
def result_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker results fenced by attempt, hash and sequence: a stateful stream over all events, run to its end."""
    path = shared_path(spark, "commits")
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    e = S.source(spark, f"{sf_dir}/events.parquet")
    digest = F.when(k % 17 == 0, "bad").otherwise(F.sha2(F.concat_ws("/", user, (F.floor(k / 60) % 3).cast("string")), 256))
    attempt = F.floor(k / 250) - F.when(k % 13 == 0, 1).otherwise(0)
    r = e.select(k.alias("result"), user.alias("job"), attempt.cast("long").alias("attempt"), (k % 40).alias("sequence"), digest.alias("hash"), (F.col("event_type") == "error").alias("ends"), F.col("ts").cast("timestamp").alias("ts"))
    return I.run_into(spark, I.commit(spark, r, "1 day", 3650 * I.DAY), f"{path}/out", f"{path}/checkpoint").drop("ts")
