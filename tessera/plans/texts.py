"""Text queries over documents, pages, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import folds
from ..registry import query, table


@query("""
with d as (select doc_id, text, greatest(ceil(length(text) / 1900.0), 1)::int as n from documents), w as (select doc_id, text, unnest(range(0, n)) as i from d)
select doc_id, (i * 1900)::int as start, length(substring(text, i::int * 1900 + 1, 2000))::int as chars, sha256(substring(text, i::int * 1900 + 1, 2000)) as digest from w""")
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of every whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.windows(F.col("text"), 2000, 100)).alias("w"))
    return d.select("doc_id", "w.start", F.length("w.text").alias("chars"), F.sha2("w.text", 256).alias("digest"))


@query("""
select doc_id, len(regexp_extract_all(text, '[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?'))::bigint as n_numbers, array_to_string(list_transform(regexp_extract_all(text, '[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?'), lambda x: replace(x, ',', '')), ' ') as numbers from documents""")
def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.number_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(n).cast("long").alias("n_numbers"), F.array_join(n, " ").alias("numbers"))


@query("""
with q as (select doc_id, text, case doc_id % 3 when 0 then substring(text, 101, 20) when 1 then substring(text, 101, 10) || '#' || doc_id else upper(substring(text, 41, 12)) end as quote from documents)
select doc_id, position(quote in text) > 0 as found, case when position(quote in text) > 0 then position(quote in text)::int - 1 end as "offset",
  case when position(quote in text) > 0 then substring(text, greatest(position(quote in text)::int - 80, 1), position(quote in text)::int - greatest(position(quote in text)::int - 80, 1) + length(quote)::int + 80) end as context from q""")
def quote_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a quote stands in its source, with what surrounds it; two of three quotes are altered, and most of these are found nowhere."""
    k = F.col("doc_id")
    quote = F.when(k % 3 == 0, F.substring("text", 101, 20)).when(k % 3 == 1, F.concat(F.substring("text", 101, 10), F.lit("#"), k.cast("string"))).otherwise(F.upper(F.substring("text", 41, 12)))
    d = table(spark, sf_dir, "documents").withColumn("quote", quote)
    return d.select("doc_id", T.quote_at(F.col("text"), F.col("quote")).alias("q")).select("doc_id", "q.*")


@query("""
select conv_id, turn, case when regexp_matches(text, '[0-9]+(\\.[0-9]+)?%') then 'ratio' when regexp_matches(text, '[0-9]{3,}') then 'quantity' when text like '%?%' then 'question' when length(text) < 200 then 'short' else 'statement' end as claim_class from conversations""")
def claim_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    c = F.when(t.rlike(r"[0-9]+(\.[0-9]+)?%"), "ratio").when(t.rlike("[0-9]{3,}"), "quantity").when(t.contains("?"), "question").when(F.length(t) < 200, "short").otherwise("statement")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", c.alias("claim_class"))


@query()
def html_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, body and readability of every page; regular expression dialects differ, so a test holds it instead of SQL."""
    h = F.col("html")
    body = T.article_body(h)
    title = F.coalesce(T.json_ld(h, "headline"), T.meta(h, "og:title"), T.decode_entities(T.element(h, "title")))
    return table(spark, sf_dir, "pages").select("page_id", F.trim(title).alias("title"), body.alias("body"), F.when(F.length(body) >= 200, "readable").otherwise("unreadable").alias("status"))


@query("""
select page_id, regexp_replace(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)), '$', '') || substring(regexp_replace(url, '#.*$', ''), length(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1))::int + 1) as url,
  regexp_matches(url, '^https?://[^/]') and not regexp_matches(url, '^[a-z]+://[^/]*@') and contains(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1), '.') as is_public from pages""")
def public_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"), T.public_url(F.col("url")).alias("is_public"))


@query()
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns packed into requests in order: an order-dependent fold, held by a test."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    return folds.pack(c, "conv_id", "turn", "chars", 1500)


@query("""
with n as (select p_partkey, (p_partkey * 8191 % 16384 + 1)::int as number from part), l as (select *, number - 703 as m from n),
t as (select p_partkey, number, case when number <= 26 then '' when number <= 702 then chr(65 + (number - 27) // 26) else chr(65 + m // 676) || chr(65 + m // 26 % 26) end || chr(65 + (number - 1) % 26) as letters from l)
select p_partkey, letters, number, lower(letters || p_partkey) as key from t""")
def column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column numbers as letters and back, over all columns that a sheet can have."""
    p = table(spark, sf_dir, "part").withColumn("letters", T.column_letters(F.col("p_partkey") * 8191 % 16384 + 1))
    return p.select("p_partkey", "letters", T.column_number(F.col("letters")).alias("number"), T.normalised(F.concat("letters", F.lit(" "), F.col("p_partkey").cast("string"))).alias("key"))
