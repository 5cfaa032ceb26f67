"""Band charts from bridge ranges: a header-driven pivot that is ready as a whole or blocked with the first reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import nfkc_key
from .formulas import touching

#: The columns a bridge must have, and the parts a period must have.
HEADERS = ["target_id", "approved_value", "evidence_ids", "metric", "period", "unit", "scope"]
REQUIRED, DIRECT = ["price", "base", "multiple_upper", "multiple_lower"], ["band_upper", "band_lower"]
#: How metrics name the parts, and units their currencies.
UPPER, LOWER, MULTIPLE, BAND = "upper|high|상단", "lower|low|하단", "multiple|multiplier|배수", "band|밴드"
PRICE = "adjustedprice|currentprice|수정주가|^price$|^주가$"
BASE = {"pe": "eps|earningpershare|주당순이익", "pb": "bps|bookvaluepershare|주당순자산"}
FAMILY = {"pe": "^pe|per?(?:band|밴드)", "pb": "^pb|pbr?(?:band|밴드)"}
CURRENCY = {"KRW": ("krw", "원"), "USD": ("usd", "$", "달러"), "JPY": ("jpy", "엔")}
MULTIPLES = ("multiple", "x", "배")
VALUE = "decimal(20,6)"


def component(family: Column, m: Column) -> Column:
    """Which part of a band a metric (its NFKC key) is; null for none."""
    side = lambda what: F.when(m.rlike(UPPER), f"{what}_upper").when(m.rlike(LOWER), f"{what}_lower")
    base = F.when((family == "pe") & m.rlike(BASE["pe"]) | (family == "pb") & m.rlike(BASE["pb"]), "base")
    return F.coalesce(F.when(m.rlike(MULTIPLE), side("multiple")), F.when(m.rlike(BAND), side("band")), F.when(m.rlike(PRICE), "price"), base)


def of_family(family: Column, both: Column) -> Column:
    """Does the key of scope and metric name the family?"""
    return F.when(family == "pe", both.rlike(FAMILY["pe"])).otherwise(both.rlike(FAMILY["pb"]))


def unit_key(unit: Column) -> Column:
    return F.lower(F.regexp_replace(unit, r"\s+", ""))


def currency(unit: Column) -> Column:
    """The currency of a unit, a share's included; null for none."""
    key = F.regexp_replace(F.regexp_replace(unit_key(unit), "(?:/|per)?share", ""), "/주|주당", "")
    out = F.lit(None).cast("string")
    for name, units in CURRENCY.items():
        out = F.when(key.isin(*units), name).otherwise(out)
    return out


def number(text: Column) -> Column:
    return F.when(text.rlike(r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), text.try_cast(VALUE))


def bridge_rows(charts: DataFrame, cells: DataFrame) -> DataFrame:
    """chart, schema (all headers there), row and one column for each header, for the rows below a range's first.

    A header that stands twice counts at its last column. Two aggregations over the cells of the ranges.
    """
    inside = touching(cells, charts.select("chart", "sheet", "top", "left", "bottom", "right"), ["sheet"]).select("chart", "row", "col", "top", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    head = inside.where("row = top").groupBy("chart").agg(*[F.max(F.when(F.lower("text") == h, F.col("col"))).alias(f"at_{h}") for h in HEADERS])
    body = inside.where("row > top").join(head, "chart")
    rows = body.groupBy("chart", "row").agg(*[F.coalesce(F.max(F.when(F.col("col") == F.col(f"at_{h}"), F.col("text"))), F.lit("")).alias(h) for h in HEADERS])
    schema = head.select("chart", F.expr(" and ".join(f"at_{h} is not null" for h in HEADERS)).alias("schema"))
    return schema.join(rows, "chart", "left")


def band_charts(charts: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chart, status, blocker) of every chart, and (chart, period, unit, price, upper, lower) of the ready ones.

    charts: chart, kind, generator, family (pe or pb), evidence (array), sheet, top, left, bottom, right (a null sheet: no range).
    cells: sheet, row, col, text. Reasons are taken in order: the binding, its evidence, its range, the header, then the
    first bad row (evidence missing or foreign, provenance, value), then the periods (none, a part twice, a part
    missing, a value that is not positive), units, and a direct band that is not base times multiple.
    """
    c = F.col
    rows = bridge_rows(charts.where("sheet is not null"), cells).join(charts.select("chart", "family", "evidence"), "chart")
    rows = rows.withColumn("key", nfkc_key("metric")).withColumn("both", nfkc_key(F.concat_ws(" ", "scope", "metric"))).withColumn("part", component(c("family"), c("key")))
    used = rows.where(c("part").isNotNull() & of_family(c("family"), c("both")))
    ids = F.filter(F.transform(F.split("evidence_ids", ","), lambda x: F.trim(x)), lambda x: x != "")
    bad = (
        F.when(F.size(ids) == 0, "BAND_EVIDENCE_MISSING").when(F.size(F.array_except(ids, "evidence")) > 0, "BAND_EVIDENCE_MISMATCH")
        .when((c("period") == "") | (c("unit") == "") | (c("approved_value") == ""), "BAND_COMPONENT_PROVENANCE_INCOMPLETE").when(number(c("approved_value")).isNull(), "BAND_COMPONENT_VALUE_INVALID")
    )
    used = used.select("chart", "row", "part", "period", "unit", number(c("approved_value")).alias("value"), bad.alias("bad"))
    parts = [*REQUIRED, *DIRECT]
    of = lambda name, col: F.max(F.when(c("part") == name, c(col)))
    periods = used.groupBy("chart", "period").agg(
        *[of(p, "value").alias(p) for p in parts], *[of(p, "unit").alias(f"{p}_unit") for p in parts], (F.count(F.lit(1)) > F.count_distinct("part")).alias("twice"), F.min_by("bad", F.when(c("bad").isNotNull(), c("row"))).alias("bad"), F.min(F.when(c("bad").isNotNull(), c("row"))).alias("bad_row")
    )
    upper, lower = (c("base") * c(f"multiple_{s}") for s in ("upper", "lower"))
    money = [currency(c(f"{p}_unit")) for p in ("price", "base")]
    direct = [F.when(c(f"{p}_unit").isNotNull(), F.coalesce(currency(c(f"{p}_unit")) == money[0], F.lit(False))).otherwise(True) for p in DIRECT]
    plain = [unit_key(c(f"multiple_{s}_unit")).isin(*MULTIPLES) for s in ("upper", "lower")]
    fits = F.coalesce((money[0] == money[1]) & direct[0] & direct[1] & plain[0] & plain[1], F.lit(False))
    periods = periods.select(
        "*", F.expr(" or ".join(f"{p} is null" for p in REQUIRED)).alias("lacks"), F.expr(" or ".join(f"{p} <= 0" for p in REQUIRED)).alias("negative"), fits.alias("fits"), money[0].alias("money"),
        F.coalesce(c("band_upper") != upper, F.lit(False)).alias("off_upper"), F.coalesce(c("band_lower") != lower, F.lit(False)).alias("off_lower"),
    )
    whole = periods.groupBy("chart").agg(
        F.min_by("bad", "bad_row").alias("bad"), F.bool_or("twice").alias("twice"), F.bool_or("lacks").alias("lacks"), F.bool_or(F.coalesce("negative", F.lit(False))).alias("negative"),
        (F.bool_and("fits") & (F.min("money") == F.max("money"))).alias("fits"), F.bool_or(c("off_upper") | c("off_lower")).alias("off"),
    )
    schema = rows.groupBy("chart").agg(F.bool_or("schema").alias("schema"))
    j = charts.join(schema, "chart", "left").join(whole, "chart", "left")
    blocker = (
        F.when(F.coalesce(c("kind"), F.lit("")) != "generated_band_chart", "GENERATED_BAND_BINDING_REQUIRED").when((F.trim(F.coalesce("generator", F.lit(""))) == "") | (F.coalesce(F.size("evidence"), F.lit(0)) <= 0), "BAND_EVIDENCE_MISSING")
        .when(c("sheet").isNull(), "BAND_BRIDGE_RANGE_UNAVAILABLE").when(~F.coalesce("schema", F.lit(False)), "BAND_BRIDGE_SCHEMA_INVALID").when(c("bad").isNotNull(), c("bad"))
        .when(c("twice").isNull(), "BAND_COMPONENT_PROVENANCE_INCOMPLETE").when(c("twice"), "BAND_COMPONENT_DUPLICATE").when(c("lacks"), "BAND_COMPONENT_PROVENANCE_INCOMPLETE").when(c("negative"), "BAND_COMPONENT_VALUE_INVALID")
        .when(~F.coalesce("fits", F.lit(False)), "BAND_UNIT_MISMATCH").when(c("off"), "BAND_SERIES_VALUE_MISMATCH")
    )
    status = j.select("chart", F.when(blocker.isNull(), "ready").otherwise("blocked").alias("status"), blocker.alias("blocker"))
    ready = periods.join(status.where("blocker is null").select("chart"), "chart", "left_semi")
    series = ready.select("chart", "period", c("price_unit").alias("unit"), "price", F.coalesce("band_upper", upper.cast("decimal(38,12)")).cast("decimal(38,12)").alias("upper"), F.coalesce("band_lower", lower.cast("decimal(38,12)")).cast("decimal(38,12)").alias("lower"))
    return status, series


#: How a slot or a record names its family.
TEMPLATE = {"pe": "per?(?:band|밴드)|figure2chart", "pb": "pbr?(?:band|밴드)|figure3chart"}


def template_family(key: Column) -> Column:
    """pe or pb by the NFKC key of metric and scope; null for neither."""
    return F.when(key.rlike(TEMPLATE["pe"]), "pe").when(key.rlike(TEMPLATE["pb"]), "pb")


def band_bindings(slots: DataFrame, bridge: DataFrame, allowed: DataFrame) -> DataFrame:
    """project, slot, family, evidence, address: chart slots bound to their family's records in a project's bridge sheet.

    slots: project, slot, type, metric, scope. bridge: project, row, col, text (row 1: HEADERS in columns 1 to 7). allowed: project, evidence.
    A record without evidence, or with evidence that is not allowed, takes its whole family out. A project whose header is another has no bindings.
    """
    c = F.col
    b = bridge.where(c("col").between(1, len(HEADERS))).select("project", "row", "col", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    head = b.where("row = 1").groupBy("project").agg(*[F.max(F.when(c("col") == k + 1, F.lower("text"))).alias(f"h{k}") for k in range(len(HEADERS))])
    right = head.where(" and ".join(f"h{k} = '{h}'" for k, h in enumerate(HEADERS))).select("project")
    last = b.groupBy("project").agg(F.max("row").alias("last"))
    at = lambda k: F.coalesce(F.max(F.when(c("col") == k, c("text"))), F.lit(""))
    rows = b.where("row > 1").groupBy("project", "row").agg(at(3).alias("evidence_ids"), at(4).alias("metric"), at(7).alias("scope"))
    rows = rows.join(right, "project", "left_semi").withColumn("family", template_family(nfkc_key(F.concat_ws(" ", "metric", "scope")))).where("family is not null")
    ids = F.filter(F.transform(F.split("evidence_ids", ","), lambda x: F.trim(x)), lambda x: x != "")
    each = rows.select("project", "row", "family", F.explode_outer(F.when(F.size(ids) > 0, ids)).alias("evidence"))
    judged = each.join(allowed.select("project", "evidence", F.lit(True).alias("ok")).distinct(), ["project", "evidence"], "left")
    # A family names its evidence once each; records of a bridge are few against its cells.
    families = judged.groupBy("project", "family").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("whole"), F.array_sort(F.collect_set("evidence")).alias("evidence")).where("whole").drop("whole")
    s = slots.where("type = 'chart'").withColumn("family", template_family(nfkc_key(F.concat_ws(" ", F.coalesce("metric", F.lit("")), F.coalesce("scope", F.lit(""))))))
    return s.join(families, ["project", "family"]).join(last, "project").select("project", "slot", "family", F.array_join("evidence", ",").alias("evidence"), F.concat(F.lit("A1:G"), c("last").cast("string")).alias("address"))
