"""Period algebra: labels, indices, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may stand behind a label's year or quarter; all but A are forecasts.
MARK = "(EST|[FEA])"
#: Quarters in either order, the year with two or four digits; nothing else in the label.
QUARTER = rf"^([1-4])Q((?:19|20)?[0-9]{{2}}){MARK}?$"
YEAR_QUARTER = rf"^((?:19|20)?[0-9]{{2}})Q([1-4]){MARK}?$"
#: A year anywhere in the label; one of two digits needs a mark, so that a bare number is no year.
ANNUAL = rf"[^0-9]((?:19|20)[0-9]{{2}})\s*{MARK}?[^A-Z0-9]"
SHORT_ANNUAL = rf"[^0-9]([0-9]{{2}})\s*{MARK}[^A-Z0-9]"


def compatible(text: Column) -> Column:
    """Full-width digits, letters and blanks as plain ones: the part of compatibility normal form that labels need, JVM-side."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000\u00a0"
    return F.translate(text, wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "  ")


def parse_label(label: Column) -> Column:
    """struct(year, quarter, role) of labels such as 2025, 26E, FY2026 EST, 1Q26F, 26Q1, 2026Q1A; null for anything else."""
    plain = F.upper(F.trim(compatible(label)))
    dense, apart = F.regexp_replace(plain, r"\s+", ""), F.concat(F.lit(" "), plain, F.lit(" "))

    def found(text: Column, pattern: str, year: int, quarter: int | None, mark: int) -> Column:
        part = lambda k: F.regexp_extract(text, pattern, k)
        number = F.when(F.length(part(year)) == 2, part(year).try_cast("int") + 2000).otherwise(part(year).try_cast("int"))
        return F.struct(number.alias("year"), (part(quarter).try_cast("int") if quarter else F.lit(None).cast("int")).alias("quarter"), F.when(part(mark).isin("", "A"), "actual").otherwise("forecast").alias("role"))

    return (
        F.when(dense.rlike(QUARTER), found(dense, QUARTER, 2, 1, 3)).when(dense.rlike(YEAR_QUARTER), found(dense, YEAR_QUARTER, 1, 2, 3))
        .when(apart.rlike(ANNUAL), found(apart, ANNUAL, 1, None, 2)).when(apart.rlike(SHORT_ANNUAL), found(apart, SHORT_ANNUAL, 1, None, 2))
    )


def index(year: Column, quarter: Column) -> Column:
    """Quarters on one line of integers."""
    return year * 4 + quarter - 1


def of_index(i: Column) -> Column:
    return F.struct(F.floor(i / 4).cast("int").alias("year"), (F.pmod(i, F.lit(4)) + 1).cast("int").alias("quarter"))


def label(year: Column, quarter: Column) -> Column:
    """1Q26 for quarters, 2026 for years."""
    return F.when(quarter.isNull(), year.cast("string")).otherwise(F.concat(quarter.cast("string"), F.lit("Q"), F.lpad((year % 100).cast("string"), 2, "0")))


def rolling_quarters(year: Column, quarter: Column, n: int = 8) -> Column:
    """The n quarters that end with the given one, oldest first."""
    last = index(year, quarter)
    return F.transform(F.sequence(last - (n - 1), last), of_index)


def annual_plan(base_year: Column) -> Column:
    """Two actual years and three forecasts: base - 1 to base + 3."""
    return F.transform(F.sequence(base_year - 1, base_year + 3), lambda y: F.struct(y.alias("year"), F.when(y <= base_year, "actual").otherwise("forecast").alias("role")))


def comparison_period(year: Column, quarter: Column, kind: Column) -> Column:
    """The period a yoy or qoq rate compares with; the first quarter's predecessor is the fourth of the year before."""
    back = F.when(kind == "yoy", 4).when(kind == "qoq", 1)
    return of_index(index(year, quarter) - back)


def filing_date(receipt: Column) -> Column:
    """The date in the first eight digits of a receipt number."""
    return F.to_date(F.when(receipt.rlike("^[0-9]{14}$"), F.substring(receipt, 1, 8)), "yyyyMMdd")


def local_day(at: Column, zone: str = "Asia/Seoul") -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def end_of_local_day(day: Column, zone: str = "Asia/Seoul") -> Column:
    """The last millisecond of a local business day, in UTC."""
    return F.to_utc_timestamp(day.cast("timestamp") + F.expr("interval 1 day") - F.expr("interval 1 millisecond"), zone)


def next_local_midnight(day: Column, zone: str = "Asia/Seoul") -> Column:
    """When something dated to the day only counts as available."""
    return F.to_utc_timestamp((F.date_add(day, 1)).cast("timestamp"), zone)


def news_window(year: Column, quarter: Column, cutoff: Column) -> Column:
    """struct(start, end): from 30 days before the quarter, at most 240 days before the cutoff, never after it."""
    begin = F.make_date(year, (quarter - 1) * 3 + 1, F.lit(1))
    return F.struct(F.least(F.greatest(F.date_sub(begin, 30), F.date_sub(cutoff, 240)), cutoff).alias("start"), cutoff.alias("end"))


def canonical_scope(text: Column) -> Column:
    """CFS for consolidated, OFS for separate statements, by what the text contains."""
    t = F.upper(text)
    return F.when(t.contains("CFS") | t.contains("연결"), "CFS").when(t.contains("OFS") | t.contains("별도") | t.contains("개별"), "OFS")


def canonical_period(text: Column) -> Column:
    """2026년 2분기 for quarters and 2026년 for years, however they are written; marks of role go; any other text with single blanks.

    Composed letters are expected, as `normal_form` gives them.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", ""), "(?i)[_-]?(?:EST|F|E|A|P)$", "")
    first, last, year = r"(?i)^([12][0-9]{3})년?(?:-?Q|년)?([1-4])(?:분기)?$", r"(?i)^([1-4])Q([12][0-9]{3}|[0-9]{2})$", r"(?i)^(?:FY)?([12][0-9]{3})년?(?:연간|사업연도|사업년도)?$"
    part = lambda p, k: F.regexp_extract(bare, p, k)
    full = F.when(F.length(part(last, 2)) == 2, F.concat(F.lit("20"), part(last, 2))).otherwise(part(last, 2))
    return (
        F.when(bare.rlike(first), F.concat(part(first, 1), F.lit("년 "), part(first, 2), F.lit("분기"))).when(bare.rlike(last), F.concat(full, F.lit("년 "), part(last, 1), F.lit("분기")))
        .when(bare.rlike(year), F.concat(part(year, 1), F.lit("년"))).otherwise(F.regexp_replace(F.trim(text), r"\s+", " "))
    )
