"""The training-corpus pipeline: five operators, one after the other, over `documents`.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs. All stages
but the last return the columns of docs; where text changes, n_chars follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from tessera.llm.common import shared_table


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; what language identification rejects goes."""
    models = language_id.fit(spark, docs)
    return language_id.predict(spark, docs, models, keep=docs.columns, prefix="_lid_").where("_lid_accepted").select(docs.columns)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template recurs across documents."""
    return _recounted(line_dedup.drop_lines(spark, docs, prefix="_lines_").select(docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts one row: that of the smallest doc_id (a null one last).

    Texts link at a similarity of 0.8 or more over five-word shingles. Rows are told apart by
    their place in the table, not by doc_id, so different texts under one doc_id both stay, and
    a row without a doc_id is kept unless it is a copy of another. Rows without words stay.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = shared_table(spark, docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    ids = numbered.select(F.col(row).alias("doc_id"), F.col("doc_id").cast("long").alias("known_as"))
    linked = jaccard_join.join(spark, numbered.select(F.col(row).alias("doc_id"), "text"), width=5, percent=80).select("doc_id", "component_id")
    groups = linked.groupBy("component_id").agg(F.max("doc_id").alias("last")).where("last <> component_id").select("component_id")
    groups = shared_table(spark, linked.join(groups, "component_id").join(ids, "doc_id"), "groups")
    # Ids first, nulls behind them; equal ids by their place.
    kept = groups.groupBy("component_id").agg(F.min(F.struct(F.col("known_as").isNull(), "known_as", "doc_id"))["doc_id"].alias("doc_id"))
    gone = groups.select("doc_id").join(kept.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias(row))
    return jaccard_join.among(numbered, shared_table(spark, gone, "near-copies"), "left_anti", on=row).select(docs.columns)


def remove_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that a benchmark window covers."""
    return _recounted(decontaminate.remove(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packing.pack(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_recurring_lines),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", remove_benchmark_text),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the language models nor the tokenizer; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each one's result is written in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
