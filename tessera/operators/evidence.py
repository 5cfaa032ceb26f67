"""Evidence: conflicts, stance votes, status precedence, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conflicts(rows: DataFrame, keys: list[str], passed: Column, facts: list[str]) -> DataFrame:
    """Per key the passed, complete facts: a conflict has two or more different ones among two or more rows."""
    fact = F.struct(*facts)
    whole = passed
    for c in facts:
        whole = whole & F.col(c).isNotNull()
    g = rows.groupBy(*keys).agg(F.count_if(whole).alias("facts"), F.count_distinct(F.when(whole, fact)).alias("variants"))
    return g.withColumn("conflict", (F.col("facts") >= 2) & (F.col("variants") >= 2))


def stance(supporting: Column, contradicting: Column, total: Column) -> Column:
    """positive or negative where all stances point one way, neutral where they do not, indeterminate without any."""
    return F.when(total == 0, "indeterminate").when((supporting > 0) & (contradicting == 0), "positive").when((contradicting > 0) & (supporting == 0), "negative").otherwise("neutral")


def group_status(status: Column) -> Column:
    """passed over needs_review over failed, as an aggregate."""
    rank = F.min(F.when(status == "passed", 0).when(status == "needs_review", 1).otherwise(2))
    return F.when(rank == 0, "passed").when(rank == 1, "needs_review").otherwise("failed")


def representative(value: Column, passed: Column, order: Column) -> Column:
    """The first passed value by arrival, else the first."""
    return F.min_by(value, F.struct(F.when(passed, 0).otherwise(1), order))


def unique_stance(value: Column) -> Column:
    """A group's stance where it is one and the same, else neutral."""
    return F.when(F.min(value) == F.max(value), F.min(value)).otherwise("neutral")


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The code of the first check that does not hold (null counts as not holding), else null."""
    out = F.lit(None).cast("string")
    for code, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)).otherwise(out)
    return out


def material_identity(sources: DataFrame, content: Column, kind: Column, published: Column, cutoff: Column, names: Column, periods: Column, told: tuple[str, str] = ("COMPANY_IR", "NEWS")) -> DataFrame:
    """sources with identity: ok, or the first reason why the material is not the company's.

    A date behind the cutoff counts for every kind. Company reports and news (`told`) need a
    date and one of the company's names of three characters or more in the content; reports
    (the first of `told`) also one of the period's names. Letter case doesn't count.
    """
    body = F.lower(content)

    def holds(words: Column) -> Column:
        return F.coalesce(F.exists(words, lambda w: F.contains(body, F.lower(w))), F.lit(False))

    named = holds(F.filter(names, lambda w: F.length(w) >= 3))
    reason = (
        F.when(published > cutoff, "cutoff_violation").when(~kind.isin(*told), "ok").when(published.isNull(), "published_missing")
        .when(~named, "company_mismatch").when((kind == told[0]) & ~holds(periods), "period_mismatch").otherwise("ok")
    )
    return sources.withColumn("identity", reason)
