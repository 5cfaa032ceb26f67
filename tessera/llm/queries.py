"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, hard_negatives, id_store, jaccard_join, language_id, line_dedup, lm_score, online_packing, packing, pii, secrets, vptree


#: The key of the surrogates that the query draws; a user passes their own secret.
PII_KEY = "tessera"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` without lines whose template recurs. Odd tables: see line_dedup."""
    return line_dedup.drop_lines(spark, _table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of `documents` that `benchmark` windows cover. Odd tables: see decontaminate."""
    return decontaminate.digest(decontaminate.find(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of `documents`. Odd tables: see language_id."""
    return language_id.identify(spark, _table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in sequences of 2,048 tokens. Odd tables: see packing."""
    return packing.pack(spark, _table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of linked `documents`. Odd tables: see jaccard_join."""
    return jaccard_join.join(spark, _table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in `documents`, also inside encoded layers. Odd tables: see secrets."""
    return secrets.digest(secrets.find(spark, _table(spark, sf_dir, "documents")))


def op7_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every text of `documents`. Odd tables: see lm_score."""
    return lm_score.score(spark, _table(spark, sf_dir, "documents"))


def op8_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of `documents`, written and read back. Odd tables: see id_store."""
    return id_store.round_trip(spark, _table(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` with surrogates for personal data. Odd tables: see pii."""
    return pii.replace(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op10_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth row of `embeddings`. Odd tables: see vptree."""
    return vptree.nearest(spark, _table(spark, sf_dir, "embeddings"))


def op11_pca_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row of `embeddings`; one label in seven is moved on first. Odd tables: see hard_negatives."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("decimal(20,0)").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark, rows.withColumn("label", moved))


def op12_apriori_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of each lang of `documents`. Odd tables: see collocations."""
    return collocations.mine(spark, _table(spark, sf_dir, "documents"))


def op13_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in sequences of 4,096 tokens. Odd tables: see online_packing."""
    return online_packing.pack(spark, _table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_benchmark_decontamination, op3_language_id, op4_best_fit_packing, op5_ngram_jaccard_join, op6_secret_scans, op7_suffix_tree_scores, op8_id_store, op9_pii_surrogates, op10_vantage_point_trees, op11_pca_hard_negatives, op12_apriori_collocations, op13_online_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op2_benchmark_decontamination": decontaminate.SQL, "op5_ngram_jaccard_join": jaccard_join.SQL, "op11_pca_hard_negatives": hard_negatives.SQL, "op12_apriori_collocations": collocations.SQL}
