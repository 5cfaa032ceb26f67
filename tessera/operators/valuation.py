"""Valuation grids and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sensitivity_grid(df: DataFrame, keys: list[str], eps: str, multiple: str) -> DataFrame:
    """Five earnings steps of 5 % around eps by five multiples of one around the base, at least 0.1.

    Steps that the clamp makes equal are kept once, as the one nearest to the base; prices
    are rounded half up to thousands.
    """
    steps = df.select(*keys, F.col(eps).alias("_eps"), F.col(multiple).cast("decimal(5,1)").alias("_base"))
    across = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda o: F.struct(F.greatest((F.col("_base") + o).cast("decimal(5,1)"), F.lit("0.1").cast("decimal(5,1)")).alias("axis_per"), F.abs(o).alias("near")))
    per = F.array_distinct(F.transform(across, lambda x: x["axis_per"]))
    zero = F.greatest(F.col("_base"), F.lit("0.1").cast("decimal(5,1)"))
    grid = steps.withColumn("eps_step", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("axis_per", F.explode(per))
    factor = (F.lit("0.90").cast("decimal(4,2)") + F.col("eps_step") * F.lit("0.05").cast("decimal(4,2)")).cast("decimal(4,2)")
    grid = grid.withColumn("axis_eps", (F.col("_eps") * factor).cast("decimal(18,4)"))
    price = F.round((F.col("axis_eps") * F.col("axis_per")).cast("decimal(24,6)"), -3)
    return grid.select(*keys, "eps_step", "axis_eps", "axis_per", price.alias("price"), ((F.col("eps_step") == 2) & (F.col("axis_per") == zero)).alias("is_current"))


def band(df: DataFrame, base: str, multiple: str, direct: str) -> DataFrame:
    """Adds band = base * multiple and status: component_missing, band_mismatch (a direct band differs) or ready."""
    product = F.col(base) * F.col(multiple)
    status = F.when(product.isNull(), "component_missing").when(F.col(direct).isNotNull() & (F.col(direct) != product), "band_mismatch").otherwise("ready")
    return df.withColumn("band", product).withColumn("status", status)
