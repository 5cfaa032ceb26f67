"""Ranking: margin-gated choice, top candidates with reserved places, quotas, token overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def margin_gate(df: DataFrame, keys: list[str], score: str, ties: list[str], minimum: float, margin: float, rival: Column | None = None, certain: Column | None = None) -> DataFrame:
    """The best row of each key, selected only if its score is high enough and far enough above its rival's.

    The rival is the best of the other rows (of those that fulfil `rival`); without one the margin holds.
    A best row that fulfils `certain` is selected whatever the scores say. Two aggregations with a
    map-side combine, so a key may hold all rows.
    """
    place = F.struct((-F.col(score)).alias("_s"), *ties)
    top = df.groupBy(*keys).agg(F.min(place).alias("_top"), F.min_by(F.struct(*[c for c in df.columns if c not in keys], (certain if certain is not None else F.lit(False)).alias("_certain")), place).alias("_row"))
    others = df.join(top.select(*keys, "_top"), keys).where(place != F.col("_top"))
    rivals = (others.where(rival) if rival is not None else others).groupBy(*keys).agg(F.max(score).alias("rival_score"))
    best = top.join(rivals, keys, "left").select(*keys, "_row.*", "rival_score")
    enough = F.col(score) >= minimum
    apart = F.col("rival_score").isNull() | (F.round(F.col(score) - F.col("rival_score"), 4) >= margin)
    decision = F.when(F.col("_certain"), "selected").when(~enough, "below_minimum").when(~apart, "ambiguous").otherwise("selected")
    return best.withColumn("decision", decision).drop("_certain")


def top_with_reserved(df: DataFrame, keys: list[str], score: str, tie: str, reserved: Column, most: int) -> DataFrame:
    """At most `most` rows per key: reserved rows first, then the best others in what is left."""
    order = Window.partitionBy(*keys).orderBy(F.when(reserved, 0).otherwise(1), F.desc(score), tie)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def quota(df: DataFrame, group: str, part: str, order: list[str], per_part: int, per_group: int) -> DataFrame:
    """Rows in rank order, at most per_part of each part and per_group of each group.

    What its part rejects uses no place of the group, so the part's rank is taken first.
    """
    inner = df.withColumn("_p", F.row_number().over(Window.partitionBy(group, part).orderBy(*order))).where(F.col("_p") <= per_part)
    return inner.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= per_group).drop("_p")


def shared_quota(sources: DataFrame, key: str, questions: str, publisher: str, order: list[str], policies: DataFrame) -> DataFrame:
    """key, questions: the sources that at least one of their questions keeps, with those questions, sorted.

    Rows of one key are merged: the first by order counts, with the questions of all.
    Each question keeps, in order, at most per_publisher sources of a publisher (letter
    case aside) and retain in all; a question without a policy (question, retain,
    per_publisher) keeps none. The largest limits, two numbers, are known before the
    ranking, so every rank is cut before its shuffle.
    """
    most = policies.agg(F.max("per_publisher").alias("per_publisher"), F.max("retain").alias("retain")).first()
    first = first_seen(sources.select(key, publisher, *order), [key], [*order, publisher])
    asked = sources.select(key, F.explode(questions).alias("question")).distinct()
    rows = first.join(asked, key).join(policies, "question").withColumn("_publisher", F.lower(publisher))
    near = Window.partitionBy("question", "_publisher").orderBy(*order, key)
    rows = rows.withColumn("_p", F.row_number().over(near)).where(F.col("_p") <= (most.per_publisher or 0)).where(F.col("_p") <= F.col("per_publisher"))
    whole = Window.partitionBy("question").orderBy(*order, key)
    rows = rows.withColumn("_q", F.row_number().over(whole)).where(F.col("_q") <= (most.retain or 0)).where(F.col("_q") <= F.col("retain"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list("question")).alias(questions))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order, as an aggregation."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def overlap_score(text: Column, tokens: Column, weight: float = 0.24) -> Column:
    """weight * the share of tokens that the text contains."""
    return F.round(F.when(F.size(tokens) > 0, F.lit(weight) * F.size(F.filter(tokens, lambda t: F.contains(text, t))) / F.size(tokens)).otherwise(0.0), 4)


def meaningful_tokens(text: Column, stop: list[str]) -> Column:
    """Distinct lower-case tokens of two letters or more that are no stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (F.length(t) >= 2) & ~t.isin(stop)))
