"""Exact decimal functions: parsing, canonical text, units, growth, valuation arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit -> (family, canonical unit, factor to the canonical unit).
UNITS = [
    ("KRW", "currency", "KRW", "1"), ("KRW_THOUSAND", "currency", "KRW", "1000"), ("KRW_MILLION", "currency", "KRW", "1000000"), ("KRW_100M", "currency", "KRW", "100000000"), ("KRW_BILLION", "currency", "KRW", "1000000000"),
    ("PERCENT", "ratio", "RATIO", "0.01"), ("RATIO", "ratio", "RATIO", "1"), ("PERCENT_POINT", "ratio_point", "RATIO_POINT", "0.01"), ("MULTIPLE", "multiple", "MULTIPLE", "1"), ("COUNT", "count", "COUNT", "1"),
]


def parse_amount(text: Column) -> Column:
    """A number with thousands commas and blanks around it; anything else is null."""
    plain = F.trim(F.replace(text, F.lit(","), F.lit("")))
    return F.when(plain.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), plain.try_cast("decimal(30,6)"))


def parse_signed(text: Column) -> Column:
    """As parse_amount, also with inner blanks, a plus sign in front and a percent sign behind."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[, ]", ""), r"^\+|%$", "")
    return F.when(plain.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), plain.try_cast("decimal(30,6)"))


def canonical(value: Column) -> Column:
    """Decimal text without trailing zeros or a bare point; -0 is 0."""
    text = value.cast("string")
    cut = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    return F.when(cut == "-0", "0").otherwise(cut)


def comparable(text: Column) -> Column:
    """Digits, points and signs of a text, which is enough to compare how numbers were written."""
    return F.regexp_replace(text, "[^0-9.+-]", "")


def growth_percent(current: Column, comparison: Column) -> Column:
    """(current - comparison) / comparison * 100; null for a zero or missing comparison."""
    return F.try_divide((current - comparison) * 100, comparison)


def growth_check(current: Column, comparison: Column, reported: Column, tolerance: str = "0.1") -> Column:
    """passed, failed or not_computable for a reported growth rate in percent points."""
    rate = growth_percent(current, comparison)
    return F.when(rate.isNull() | reported.isNull(), "not_computable").when(F.abs(rate - reported) <= F.lit(tolerance).cast("decimal(10,4)"), "passed").otherwise("failed")


def inverse_multiple(price: Column, per_share: Column) -> Column:
    """price / per_share to one decimal, half up; null outside 0.1 to 100.0 or without a positive base."""
    m = F.round(F.when(per_share > 0, price / per_share), 1)
    return F.when(m.between(F.lit("0.1").cast("decimal(4,1)"), F.lit("100.0").cast("decimal(4,1)")), m).cast("decimal(5,1)")


def upside(target: Column, current: Column) -> Column:
    return F.try_divide(target, current) - 1


def capped_backoff(attempt: Column) -> Column:
    """Seconds to wait: two to the attempt, the exponent at most 6, the result at most 60."""
    return F.least(F.lit(60.0), F.pow(F.lit(2.0), F.least(attempt, F.lit(6))))


def signed_sum(operation: Column, value: Column) -> Column:
    """Sum in which terms marked subtract count against."""
    return F.sum(F.when(operation == "subtract", -value).otherwise(value))
