"""Unit conversion through a small dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decimals import UNITS


def unit_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNITS, "unit string, family string, base string, factor string").withColumn("factor", F.col("factor").cast("decimal(20,6)"))


def convert(spark: SparkSession, df: DataFrame, value: str, source: str, target: str) -> DataFrame:
    """Adds converted, rule and status; units of different families, and unknown ones, never convert."""
    u = F.broadcast(unit_table(spark))  # a fixed table of ten rows
    s = u.select(F.col("unit").alias(source), F.col("family").alias("_fs"), F.col("factor").alias("_ks"))
    t = u.select(F.col("unit").alias(target), F.col("family").alias("_ft"), F.col("factor").alias("_kt"))
    j = df.join(s, source, "left").join(t, target, "left")
    same = F.col("_fs") == F.col("_ft")
    rule = F.when(F.col("_fs").isNull() | F.col("_ft").isNull() | ~same, None).when(F.col(source) == F.col(target), "identity").when(F.col("_fs") == "ratio", "ratio_conversion").otherwise("unit_scale")
    status = F.when(F.col("_fs").isNull() | F.col("_ft").isNull(), "unit_unknown").when(~same, "family_mismatch").otherwise("validated")
    exact = (F.col(value).cast("decimal(20,6)") * F.col("_ks")).cast("decimal(26,6)")
    # Factors below one are hundredths: dividing by them is multiplying by a hundred.
    out = F.when(F.col("_kt") < 1, exact * 100).otherwise(exact / F.col("_kt").cast("decimal(11,0)"))
    return j.withColumn("rule", rule).withColumn("status", status).withColumn("converted", F.when(same, F.round(out, 6)).cast("decimal(30,6)")).drop("_fs", "_ft", "_ks", "_kt")
