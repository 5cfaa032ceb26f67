"""Ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking as R
from ..registry import query, table


@query("""
with a as (select doc_id, source, lang, row_number() over (partition by lang, source order by n_chars desc, doc_id) as p, n_chars from documents), b as (select *, row_number() over (partition by lang order by n_chars desc, doc_id) as place from a where p <= 2)
select doc_id, source, lang, place from b where place <= 8""")
def quota_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two documents of a source and eight of a language, in rank order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (-F.col("n_chars")).alias("rank"))
    return R.quota(d, "lang", "source", ["rank", "doc_id"], 2, 8).select("doc_id", "source", "lang", F.col("place").cast("long").alias("place"))


@query("""
with s as (select l_partkey, p_brand, p_size, year(l_shipdate)::int as question from lineitem join part on p_partkey = l_partkey where l_returnflag <> 'R' group by 1, 2, 3, 4),
y as (select *, 10 + question % 7 as retain, 1 + question % 2 as per_publisher from s where question % 5 <> 0),
a as (select *, row_number() over (partition by question, lower(p_brand) order by p_size, l_partkey) as p from y), b as (select *, row_number() over (partition by question order by p_size, l_partkey) as q from a where p <= per_publisher)
select l_partkey, string_agg(question, ',' order by question) as questions from b where q <= retain group by 1""")
def question_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sources of several questions (ship years) and one publisher (brand), each question with its own limits."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select("l_partkey", F.year("l_shipdate").alias("question"))
    sources = li.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size"), "l_partkey").withColumn("questions", F.array("question"))
    years = li.select("question").distinct().where("question % 5 <> 0")
    policies = years.select("question", (10 + F.col("question") % 7).alias("retain"), (1 + F.col("question") % 2).alias("per_publisher"))
    kept = R.shared_quota(sources, "l_partkey", "questions", "p_brand", ["p_size"], policies)
    return kept.select("l_partkey", F.array_join(F.col("questions").cast("array<string>"), ",").alias("questions"))


SLOTS = "(values ('copper', 'STANDARD'), ('brushed', 'ECONOMY'), ('nickel', 'PROMO'), ('steel', 'LARGE')) s(word, kind)"


SCORED = f"""sc as (select s.word as slot, p_partkey, p_brand = 'Brand#7' and p_size = 50 as contract, p_brand = 'Brand#3' as model, p_type like s.kind || '%' as period, p_size % 5 = 0 as structured,
  round((case when lower(p_name) like '%' || s.word || '%' then 0.5 else 0 end + case when p_type like s.kind || '%' then 0.3 else 0 end + p_size / 250.0)::double, 4) as score from part, {SLOTS})"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates of four slots, with the reasons that a mapping knows."""
    slots = spark.createDataFrame([("copper", "STANDARD"), ("brushed", "ECONOMY"), ("nickel", "PROMO"), ("steel", "LARGE")], "slot string, kind string")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").join(F.broadcast(slots), how="cross")  # four slots
    score = F.when(F.contains(F.lower("p_name"), "slot"), 0.5).otherwise(0.0) + F.when(F.startswith("p_type", "kind"), 0.3).otherwise(0.0) + F.col("p_size") / 250.0
    return p.select(
        "slot", "p_partkey", ((F.col("p_brand") == "Brand#7") & (F.col("p_size") == 50)).alias("contract"), (F.col("p_brand") == "Brand#3").alias("model"), F.startswith("p_type", "kind").alias("period"),
        (F.col("p_size") % 5 == 0).alias("structured"), F.round(score, 4).alias("score"),
    )


@query(f"""
with {SCORED}, r as (select *, row_number() over w as nth, lead(score) over w as rival from sc window w as (partition by slot order by score desc, p_partkey))
select slot, p_partkey, score, rival as rival_score, case when score < 0.45 then 'below_minimum' when rival is not null and round(score - rival, 4) < 0.004 then 'ambiguous' else 'selected' end as decision from r where nth = 1""")
def margin_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive scores of parts for a few slots; the best is taken only with a margin over the next."""
    return R.margin_gate(_scored(spark, sf_dir), ["slot"], "score", ["p_partkey"], 0.45, 0.004).select("slot", "p_partkey", "score", "rival_score", "decision")


@query(f"""
with {SCORED}, b as (select slot, p_partkey, contract, model, period, case when contract then 1.0 else score end as score from sc), r as (select *, row_number() over w as nth, lead(score) over w as rival from b window w as (partition by slot order by score desc, p_partkey))
select slot, p_partkey, score, rival as rival_score, case when contract or (score >= 0.3 and model and period) then 'selected' when score < 0.45 then 'below_minimum' when rival is not null and round(score - rival, 4) < 0.004 then 'ambiguous' else 'selected' end as decision from r where nth = 1""")
def scalar_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar slot: a documented contract is certain, a row of the model sheet in the right period needs no margin."""
    sc = _scored(spark, sf_dir).withColumn("score", F.when(F.col("contract"), 1.0).otherwise(F.col("score")))
    certain = F.col("contract") | ((F.col("score") >= 0.3) & F.col("model") & F.col("period"))
    return R.margin_gate(sc, ["slot"], "score", ["p_partkey"], 0.45, 0.004, certain=certain).select("slot", "p_partkey", "score", "rival_score", "decision")


@query(f"""
with {SCORED}, r as (select *, row_number() over (partition by slot order by score desc, structured desc, p_partkey) as nth from sc), v as (select slot, max(score) as rival from r where nth > 1 and (contract or structured) group by 1)
select r.slot, p_partkey, score, rival as rival_score, case when contract then 'selected' when score < 0.45 then 'below_minimum' when rival is not null and round(score - rival, 4) < 0.004 then 'ambiguous' else 'selected' end as decision from r left join v using (slot) where nth = 1""")
def table_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table slot: only structured ranges and documented contracts are rivals, and a contract is certain."""
    sc = _scored(spark, sf_dir).withColumn("loose", ~F.col("structured"))
    out = R.margin_gate(sc, ["slot"], "score", ["loose", "p_partkey"], 0.45, 0.004, rival=F.col("contract") | F.col("structured"), certain=F.col("contract"))
    return out.select("slot", "p_partkey", "score", "rival_score", "decision")


@query("""
with r as (select l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() over (partition by l_orderkey order by case when l_returnflag = 'R' then 0 else 1 end, l_quantity desc, l_partkey * 100 + l_linenumber) as place from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_quantity, place from r where place <= 3""")
def reserved_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top three per order, with places reserved for flagged rows."""
    li = table(spark, sf_dir, "lineitem").withColumn("tie", F.col("l_partkey") * 100 + F.col("l_linenumber"))
    return R.top_with_reserved(li, ["l_orderkey"], "l_quantity", "tie", F.col("l_returnflag") == "R", 3).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("place").cast("long").alias("place"))


@query("""
with f as (select user_id, event_type, min(event_id) as first_id from events group by 1, 2), q as (select *, row_number() over (partition by user_id order by first_id) as place from f)
select user_id, event_type, first_id, place from q where place <= 3""")
def fetch_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-seen deduplication, then a quota per group."""
    from pyspark.sql import Window

    f = R.first_seen(table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("first_id")), ["user_id", "event_type"], ["first_id"])
    return f.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("first_id")).cast("long")).where("place <= 3")


@query("""
with t as (select p_partkey, list_distinct(list_filter(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 2 and x not in ('the', 'of', 'and'))) as w, lower(p_type) as ty, lower(p_name || ' ' || p_type) as hay from part)
select p_partkey, array_to_string(list_sort(w), ' ') as tokens, round(case when len(w) > 0 then 0.24 * len(list_filter(w, lambda x: contains(ty, x))) / len(w) else 0 end, 4)::double as score from t""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("w", R.meaningful_tokens(F.col("p_name"), ["the", "of", "and"]))
    return p.select("p_partkey", F.array_join(F.array_sort("w"), " ").alias("tokens"), R.overlap_score(F.lower("p_type"), F.col("w")).cast("double").alias("score"))
