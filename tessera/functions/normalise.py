"""Canonical forms: Unicode normal forms, for which Spark has no function (a vectorised Python function over Arrow batches), kinds of values, units of layout."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_form(text: Column | str, form: str = "NFC") -> Column:
    """The text in a normal form; null stays null."""
    import pandas as pd

    def run(s):  # noqa: ANN001, ANN202
        return pd.Series([None if x is None else unicodedata.normalize(form, x) for x in s])

    return F.pandas_udf(run, "string")(text)


def nfkc_key(text: Column | str) -> Column:
    """Letters and digits of the compatibility form in lower case, for matching labels."""
    return F.regexp_replace(F.lower(normal_form(text, "NFKC")), r"[^\p{L}\p{N}]+", "")


def quote_key(text: Column | str) -> Column:
    """A quote in canonical form with single blanks."""
    return F.trim(F.regexp_replace(normal_form(text), r"\s+", " "))


#: How sources name what happened and what is expected.
ACTUAL = ("", "actual", "a", "preliminary_actual", "preliminaryactual", "실적", "잠정실적", "확정")
FORECAST = ("forecast", "f", "e", "est", "estimate", "projection", "projected", "전망", "예상", "추정")


def value_kind(label: Column) -> Column:
    """actual (also where nothing is said), forecast, or the label itself in lower case; letter case and white space don't count.

    Composed letters are expected, as `normal_form` gives them.
    """
    bare = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)\s+", ""))
    return F.when(bare.isin(*ACTUAL), "actual").when(bare.isin(*FORECAST), "forecast").otherwise(bare)


def points(pixels: Column) -> Column:
    """Pixels (96 to an inch) as points (72), to two decimals, halves up."""
    return F.floor(pixels * 75 + F.lit(0.5)) / 100
