"""Official prices and rates checked against the rows they came from, and the set of values approved for a workbook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decimals import canonical
from ..functions.normalise import value_kind
from ..functions.periods import canonical_period, canonical_scope
from .graph import set_digest, side, stored
from .growth import strict_decimal
from .units import convert

#: The registered exchange-rate series and the metrics that may use it.
FX_SERIES = {"statistic": "731Y001", "cycle": "D", "item": "0000001"}
FX_METRICS = ["usd_krw", "usd_krw_exchange_rate", "exchange_rate_usd_krw"]
#: What keeps a result out of the approved set.
REFUSED, FAILED = ["REJECTED", "REINVESTIGATION_REQUESTED", "REINVESTIGATING", "SUPERSEDED"], ["failed", "stale"]


def day_end(day: Column) -> Column:
    """The last millisecond of a day in Seoul, as an instant in UTC."""
    return day.cast("timestamp") + F.expr("interval 1 day") - F.expr("interval 9 hours") - F.expr("interval 1 millisecond")


def dashed(day: Column) -> Column:
    """20260131 as 2026-01-31; null for anything else."""
    return F.when(day.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)))


def ticker_key(text: Column) -> Column:
    return F.lpad(F.regexp_replace(F.coalesce(text, F.lit("")), "(?i)^A", ""), 6, "0")


def price_results(targets: DataFrame, prices: DataFrame, cutoff: Column) -> DataFrame:
    """target, source, status, value, period: the last close before the cutoff, if the row that it came from says the same.

    targets: target, ticker. prices: source, ticker, close (a decimal), day (text), published, row_close, row_day, row_ticker (the row's
    texts; a null row_close is no row). Of equal days the source with the smaller name counts.
    """
    c = F.col
    good = prices.where(c("day").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & c("day").try_cast("date").isNotNull())
    end = day_end(c("day").try_cast("date"))
    good = good.where((end <= cutoff) & (F.coalesce("published", end) <= cutoff))
    latest = good.groupBy("ticker").agg(F.min_by(F.struct("source", "close", "day", "row_close", "row_day", "row_ticker"), F.struct((-F.unix_date(c("day").cast("date"))).alias("d"), "source")).alias("p"))
    j = targets.join(latest, "ticker", "left").select("target", "ticker", "p.*")
    same = (strict_decimal(c("row_close")) == c("close")) & (dashed(F.trim("row_day")) == c("day")) & (ticker_key(c("row_ticker")) == ticker_key(c("ticker")))
    status = F.when(c("source").isNull(), "source_unavailable").when(F.coalesce(same, F.lit(False)), "validated").otherwise("manual_review")
    ok = lambda x: F.when(c("status") == "validated", x)
    return j.withColumn("status", status).select("target", "source", "status", ok(canonical(c("close"))).alias("value"), ok(c("day")).alias("period"))


def rate_results(targets: DataFrame, series: DataFrame, cutoff: Column) -> DataFrame:
    """target, source, status, value, period: the last published rate before the cutoff, if metric and series are registered for each other.

    targets: target, market, metric. series: source, market, statistic, cycle, item, time (yyyymmdd), value (text).
    """
    c = F.col
    day = dashed(F.trim("time")).try_cast("date")
    good = series.withColumn("_day", day).where(c("_day").isNotNull() & (day_end(c("_day")) <= cutoff))
    latest = good.groupBy("market").agg(F.min_by(F.struct("source", "statistic", "cycle", "item", "value", "_day"), F.struct((-F.unix_date("_day")).alias("d"), "source")).alias("p"))
    j = targets.join(latest, "market", "left").select("target", "metric", "p.*")
    plain = F.trim(F.replace("value", F.lit(","), F.lit("")))
    registered = c("metric").isin(*FX_METRICS)
    for name, want in FX_SERIES.items():
        registered = registered & (c(name) == want)
    ok = F.coalesce(registered & plain.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.lit(False))
    status = F.when(c("source").isNull(), "source_unavailable").when(ok, "validated").otherwise("manual_review")
    return j.select("target", "source", status.alias("status"), F.when(ok, plain).alias("value"), F.when(ok, c("_day").cast("string")).alias("period"))


def approved_values(spark: SparkSession, targets: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(target, code, metric, period, scope, original, unit_original, value, unit, rule, evidence) of every included target, and one row for the set.

    targets: target, metric, period, scope, kind, unit, included, required. results: target, exception, machine, accepted (a qualified decision),
    conflict, original, normal, unit, period, scope, kind, evidence (array). The code is `ok`, `absent` (an optional target without a
    result) or the first fault. The set (values, blocked, first, status, content_hash) is approved only if no target is at fault
    and there is a value; `first` is the first target at fault. Its hash does not depend on the order of rows.
    """
    c = F.col
    n = results.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("exception", "machine", "accepted", "conflict", "original", "normal", "unit", "period", "scope", "kind", F.array_sort(F.array_distinct("evidence")).alias("evidence"))).alias("r"))
    j = targets.where("included").join(n, "target", "left")
    j = j.select("target", "metric", "required", c("period").alias("t_period"), c("scope").alias("t_scope"), c("kind").alias("t_kind"), c("unit").alias("to_unit"), F.coalesce("n", F.lit(0)).alias("n"), "r.*").withColumn("from_unit", c("unit"))
    amount = strict_decimal(c("normal"))
    j = convert(spark, j.withColumn("_amount", amount), "_amount", "from_unit", "to_unit")
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    differs = lambda f, a, b: ~F.coalesce(f(c(a)).eqNullSafe(f(c(b))), F.lit(False))
    scope = lambda x: F.coalesce(canonical_scope(x), F.trim(x))
    code = (
        F.when(c("n") > 1, "VALIDATED_VALUE_AMBIGUOUS").when(c("n") == 0, F.when(c("required"), "VALIDATED_VALUE_MISSING").otherwise("absent")).when(c("exception").isin(REFUSED) | c("machine").isin(FAILED), "VALIDATED_VALUE_NOT_APPROVED")
        .when((c("machine") == "needs_review") & ~F.coalesce("accepted", F.lit(False)), "QUALIFIED_VALUE_DECISION_REQUIRED").when(c("conflict") == "unresolved", "VALIDATED_VALUE_CONFLICT_UNRESOLVED")
        .when(blank(c("original")) | blank(c("normal")) | blank(c("from_unit")) | blank(c("period")) | blank(c("scope")) | (F.coalesce(F.size("evidence"), F.lit(0)) <= 0), "VALIDATED_VALUE_INCOMPLETE")
        .when(differs(canonical_period, "period", "t_period") | differs(scope, "scope", "t_scope") | differs(value_kind, "kind", "t_kind"), "VALIDATED_VALUE_DIMENSION_MISMATCH")
        .when(amount.isNull() | strict_decimal(c("original")).isNull(), "VALIDATED_DECIMAL_INVALID").when(c("status") != "validated", F.upper(c("status"))).otherwise("ok")
    )
    j = j.withColumn("code", code)
    ok = lambda x: F.when(c("code") == "ok", x)
    values = j.select(
        "target", "code", ok(c("metric")).alias("metric"), ok(canonical_period(c("t_period"))).alias("period"), ok(scope(c("t_scope"))).alias("scope"), ok(canonical(strict_decimal(c("original")))).alias("original"), ok(c("from_unit")).alias("unit_original"),
        ok(canonical(c("converted"))).alias("value"), ok(c("to_unit")).alias("unit"), ok(c("rule")).alias("rule"), ok(F.array_join("evidence", ",")).alias("evidence"),
    )
    good, fault = c("code") == "ok", ~c("code").isin("ok", "absent")
    whole = values.agg(F.count_if(good).alias("values"), F.count_if(fault).alias("blocked"), F.min(F.when(fault, c("target"))).alias("first"), set_digest(F.when(good, F.concat_ws("|", "target", "metric", "period", "scope", "value", "unit", "evidence"))).alias("content_hash"))
    status = F.when(c("blocked") > 0, "blocked").when(c("values") == 0, "VALIDATED_VALUE_SET_EMPTY").otherwise("approved")
    return values, whole.select("values", "blocked", "first", status.alias("status"), F.when(status == "approved", c("content_hash")).alias("content_hash"))


def scalar_bindings(bindings: DataFrame, scalars: DataFrame, cells: DataFrame) -> DataFrame:
    """binding, status, blocker, value, authority, decision: the approved scalar of a metric, else the one cell that a binding names.

    bindings: binding, confirmed, metric, source_type, source_address (null: any), sheet, row, col, last_row, last_col (null sheet: none).
    scalars: nth, metric, source_type, source_address, value. cells: sheet, row, col, text, formula. Metrics are the same in any case and
    with any blanks; of several scalars the first counts. A cell that is blank, or a range of several cells, blocks.
    """
    c = F.col
    key = lambda x: F.lower(F.regexp_replace(x, r"[\s_-]+", ""))
    # The first scalar for each way to ask: by metric alone, with its type, with its address, with both. So a binding meets one row, not all of its metric.
    spark, told_type, told_address = bindings.sparkSession, c("_ask") % 2 == 1, c("_ask") >= 2
    first = scalars.where("nth is not null").select(key(c("metric")).alias("_key"), F.struct("nth", c("value").alias("_value"), c("source_type").alias("_type"), c("source_address").alias("_address")).alias("_s"), F.explode(F.array(*map(F.lit, range(4)))).alias("_ask"))
    first = first.select("_key", "_ask", F.when(told_type, c("_s._type")).otherwise("").alias("_by_type"), F.when(told_address, c("_s._address")).otherwise("").alias("_by_address"), "_s").where("_by_type is not null and _by_address is not null")
    asked = ["_key", "_ask", "_by_type", "_by_address"]
    first = stored(spark, first.groupBy(*asked).agg(F.min("_s").alias("_s")), "scalars")
    b = bindings.withColumn("_key", key(c("metric"))).withColumn("_ask", c("source_type").isNotNull().cast("int") + 2 * c("source_address").isNotNull().cast("int"))
    b = b.withColumn("_by_type", F.coalesce("source_type", F.lit(""))).withColumn("_by_address", F.coalesce("source_address", F.lit("")))
    j = b.join(side(first), asked, "left").withColumn("_s", F.when(c("confirmed") & c("binding").isNotNull(), c("_s")))
    again = stored(spark, bindings.where("binding is not null").groupBy("binding").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("binding"), "bindings-again")
    if again.limit(1).count():  # a binding that stands more than once has the first scalar of all its rows
        shared = stored(spark, j.join(side(again), "binding", "left_semi").groupBy("binding").agg(F.min("_s").alias("_first")), "bindings-shared")
        j = j.join(side(shared), "binding", "left").withColumn("_s", F.coalesce("_first", "_s")).drop("_first")
    at = stored(spark, cells.select("sheet", "row", "col", c("text").alias("_text"), c("formula").alias("_formula")), "scalar-cells")
    j = j.join(side(at), ["sheet", "row", "col"], "left")
    one = (c("row") == c("last_row")) & (c("col") == c("last_col"))
    blocker = F.when(~c("confirmed"), "BINDING_NOT_CONFIRMED").when(c("_s").isNotNull(), None).when(c("sheet").isNull(), "SCALAR_SOURCE_REQUIRED").when(~one, "SCALAR_SOURCE_CELL_UNAVAILABLE").when(F.coalesce("_text", F.lit("")) == "", "SCALAR_SOURCE_CELL_EMPTY")
    j = j.withColumn("blocker", blocker)
    place = F.concat_ws(":", F.concat(c("sheet"), F.lit("!R"), c("row").cast("string"), F.lit("C"), c("col").cast("string")), "_formula")
    told = c("_s").isNotNull()
    ready = lambda x: F.when(c("blocker").isNull(), x)
    authority = F.when(told, "authoritative").when(c("_formula").isNotNull(), "formula").otherwise("workbook")
    decision = F.when(told, F.concat_ws(":", "_s._type", "_s._address")).otherwise(place)
    return j.select("binding", F.when(c("blocker").isNull(), "ready").otherwise("blocked").alias("status"), "blocker", ready(F.when(told, c("_s._value")).otherwise(c("_text"))).alias("value"), ready(authority).alias("authority"), ready(decision).alias("decision"))


def consensus_fallback(cells: DataFrame) -> DataFrame:
    """project, cells, source_key: an uploaded workbook's consensus cells as a source, without blanks and error values; a project without any gives none.

    cells: project, sheet, address, display. The key's hash does not depend on the order of cells.
    """
    shown = F.trim("display")
    good = cells.where((shown != "") & ~shown.rlike("(?i)^#(?:N/A|VALUE|REF|DIV/0)"))
    g = good.groupBy("project").agg(F.count(F.lit(1)).alias("cells"), set_digest(F.concat_ws("=", F.concat_ws("!", "sheet", "address"), "display")).alias("_h"))
    return g.select("project", "cells", F.concat(F.lit("excel-consensus-fallback:"), F.col("project").cast("string"), F.lit(":"), F.substring("_h", 1, 24)).alias("source_key"))
