"""Company directories and code lists from HTML tables, zipped XML and JSON pages; unions that survive a failed source."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_entities
from ..operators.graph import stored


def html_table(df: DataFrame, html: str, names: list[str]) -> DataFrame:
    """One row for each table row that has a cell for every name; tags go, references are decoded."""
    rows = df.select(*[c for c in df.columns if c != html], F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))).alias("line", "_tr"))
    cells = F.regexp_extract_all("_tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1))
    clean = F.transform(cells, lambda c: F.trim(F.regexp_replace(decode_entities(F.regexp_replace(c, "<[^>]+>", " ")), r"\s+", " ")))
    rows = rows.withColumn("_c", clean).where(F.size("_c") >= len(names))
    return rows.select(*[c for c in rows.columns if c not in ("_tr", "_c")], *[F.col("_c")[i].alias(n) for i, n in enumerate(names)])


def valid_ticker(c: Column) -> Column:
    return c.rlike("^[0-9A-Z]{6}$")


def zipped_xml_records(spark: SparkSession, path: str, record: str, fields: list[str]) -> DataFrame:
    """Records of the first entry of each archive file: text of the named fields inside each <record>."""
    return archived_xml_records(spark.read.format("binaryFile").load(path), record, fields)


def archived_xml_records(archives: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """path and the named fields of each <record> in the first entry of archives (path, content); one that does not open gives none."""
    files = archives.select("path", "content")

    def open_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for c in b.column("content").to_pylist():
                try:
                    z = zipfile.ZipFile(io.BytesIO(c))
                    texts.append(z.read(z.namelist()[0]).decode("utf-8", "replace"))
                except (zipfile.BadZipFile, IndexError):
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string())], names=["path", "xml"])

    xml = files.mapInArrow(open_first, "path string, xml string")
    parts = xml.select("path", F.explode(F.regexp_extract_all("xml", F.lit(rf"(?s)<{record}>(.*?)</{record}>"), F.lit(1))).alias("_r"))
    return parts.select("path", *[F.nullif(F.trim(decode_entities(F.regexp_extract("_r", rf"(?s)<{f}>(.*?)</{f}>", 1))), F.lit("")).alias(f) for f in fields])


def json_pages(pages: DataFrame, column: str, items: str, schema: str) -> DataFrame:
    """Items of paged JSON answers; an answer that does not parse gives no items."""
    parsed = F.from_json(F.get_json_object(column, f"$.{items}"), f"array<struct<{schema}>>")
    return pages.select(*[c for c in pages.columns if c != column], F.inline(parsed))


def collect_sources(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], schema: str) -> tuple[DataFrame, DataFrame]:
    """The union of all sources that can be read to their end, and a warning row for each that cannot.

    Each source is read once, into a table in the shared folder, so that one that fails while it runs is a warning too.
    """
    found, warnings = spark.createDataFrame([], schema), []
    for name, read in sources.items():
        try:
            found = found.unionByName(stored(spark, read(), f"source-{name}"))
        except Exception as e:  # noqa: BLE001  a failed source is a warning, not a failure
            warnings.append((name, type(e).__name__))
    return found, spark.createDataFrame(warnings, "source string, warning string")


def put_immutable(df: DataFrame, root: str, key: str, content: str) -> DataFrame:
    """Add contents below root, never over another: key, content_hash and what became of them.

    A key with two contents, or with another one than root holds, is a content_conflict and
    stays out; one that root holds already is kept; any other is stored.
    """
    spark = df.sparkSession
    g = df.groupBy(F.col(key).cast("string").alias(key)).agg(F.min(content).alias("content"), (F.min(content) != F.max(content)).alias("_conflict"))
    g = g.withColumn("content_hash", F.sha2("content", 256))
    try:
        have = spark.read.parquet(root).select(key, F.col("content_hash").alias("_have"))
    except AnalysisException:  # nothing there yet
        have = spark.createDataFrame([], f"{key} string, _have string")
    status = F.when(F.col("_conflict") | (F.col("_have") != F.col("content_hash")), "content_conflict").when(F.col("_have").isNotNull(), "kept").otherwise("stored")
    told = stored(spark, g.join(have, key, "left").withColumn("status", status), "puts")
    told.where("status = 'stored'").select(key, "content_hash", "content").write.mode("append").parquet(root)
    return told.select(key, "content_hash", "status")
