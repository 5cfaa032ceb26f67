"""Queries that read through the sources: tables and pages are built from the given data, then read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_path
from ..registry import query, table
from ..sources import listings


@query("select user_id, event_id as item, event_type as kind, value from events")
def json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of paged JSON answers, a page for each user and hour."""
    e = table(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), F.struct(F.col("event_id").alias("item"), F.col("event_type").alias("kind"), "value").alias("one"))
    pages = e.groupBy("user_id", "hour").agg(F.to_json(F.struct(F.collect_list("one").alias("list"))).alias("body")).drop("hour")
    return listings.json_pages(pages, "body", "list", "item bigint, kind string, value double")


@query("""
select n_regionkey as page, n_name as name, case when n_nationkey % 2 = 0 then n_nationkey || ' & co' else '<' || n_nationkey || '>' end as code from nation""")
def html_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories as HTML tables, a page for each region: tags go, references are decoded."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    code = F.when(F.col("n_nationkey") % 2 == 0, F.concat(key, F.lit(" &amp; co"))).otherwise(F.concat(F.lit("&lt;"), key, F.lit("&gt;")))
    row = F.concat(F.lit('<tr class="r">\n<td> <b>'), F.col("n_name"), F.lit("</b></td><TD>"), code, F.lit("</TD></tr>"))
    pages = n.groupBy(F.col("n_regionkey").alias("page")).agg(F.concat(F.lit("<table><tr><th>one head</th></tr>"), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("html"))
    return listings.html_table(pages, "html", ["name", "code"]).select("page", "name", "code")


@query("""
select p_partkey::varchar as key, sha256(case when p_partkey % 7 = 0 then p_type when p_partkey % 5 = 0 then least(p_name, p_brand) else p_brand end) as content_hash,
  case when p_partkey % 5 = 0 and p_name <> p_brand then 'content_conflict' when p_partkey % 2 = 0 then case when p_partkey % 7 = 0 then case when p_type = p_brand then 'kept' else 'content_conflict' end else 'kept' end else 'stored' end as status
from part where not (p_partkey % 5 = 0 and p_partkey % 7 = 0)
union all select p_partkey::varchar, sha256(least(p_name, p_type)), 'content_conflict' from part where p_partkey % 5 = 0 and p_partkey % 7 = 0""")
def immutable_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content-addressed store that is written twice: new keys are stored, known ones kept, other contents refused."""
    k = F.col("p_partkey")
    p, root = table(spark, sf_dir, "part"), shared_path(spark, "objects")
    listings.put_immutable(p.where(k % 2 == 0).select(k.alias("key"), F.col("p_brand").alias("content")), root, "key", "content")
    second = p.select(k.alias("key"), F.when(k % 7 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("content"))
    return listings.put_immutable(second.unionByName(p.where(k % 5 == 0).select(k.alias("key"), F.col("p_name").alias("content"))), root, "key", "content")


@query("""
select 'orders' as source, count(*) as n, null as warning from orders union all select 'customer', count(*), null from customer union all select 'absent', null, 'AnalysisException' union all select 'broken', null, 'NumberFormatException'""")
def collected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources collected side by side: one is not there, one fails on a row while it is read; both are warnings, the others are whole."""
    keyed = lambda name, key: table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.col(key).cast("long").alias("key"))
    wrong = F.when(F.col("s_suppkey") == 7, F.lit("seven")).otherwise(F.col("s_suppkey").cast("string")).cast("long")
    sources = {
        "orders": lambda: keyed("orders", "o_orderkey"), "absent": lambda: keyed("no_such_table", "key"), "broken": lambda: table(spark, sf_dir, "supplier").select(F.lit("broken").alias("source"), wrong.alias("key")), "customer": lambda: keyed("customer", "c_custkey"),
    }
    found, warnings = listings.collect_sources(spark, sources, "source string, key long")
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("warning", F.lit(None).cast("string")).unionByName(warnings.withColumn("n", F.lit(None).cast("long")))


@query("select s_suppkey::varchar as code, case when s_suppkey % 9 = 0 then null else s_name || ' & <co>' end as name, lpad((s_suppkey % 1000)::varchar, 6, '0') as stock_code from supplier")
def archived_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company codes read from zipped XML, two hundred to an archive, with references decoded and blanks as nulls; a damaged archive gives none."""
    code, name = F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 9 == 0, " ").otherwise(F.concat("s_name", F.lit(" &amp; &lt;co&gt;")))
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))
    record = tag("list", F.concat(F.lit("\n"), tag("corp_code", code), tag("corp_name", name), tag("stock_code", F.lpad((F.col("s_suppkey") % 1000).cast("string"), 6, "0"))))
    xml = table(spark, sf_dir, "supplier").groupBy(F.floor(F.col("s_suppkey") / 200).alias("part")).agg(F.array_join(F.collect_list(record), "").alias("xml"))  # 200 records

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("xml").to_pylist():
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("CORPCODE.xml", f"<result>{text}</result>")
                out.append(held.getvalue())
            yield pa.record_batch([pa.array([str(p) for p in b.column("part").to_pylist()]), pa.array(out, pa.binary())], names=["path", "content"])

    archives = xml.mapInArrow(packed, "path string, content binary")
    damaged = archives.select(F.concat("path", F.lit("-damaged")).alias("path"), F.substring("content", 1, 40).alias("content"))
    r = listings.archived_xml_records(archives.unionByName(damaged), "list", ["corp_code", "corp_name", "stock_code"])
    return r.select(F.col("corp_code").alias("code"), F.col("corp_name").alias("name"), "stock_code")
