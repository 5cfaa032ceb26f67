"""Financial targets discovered in worksheets: labels name a metric and a period, rules name what may be collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .validation import alias_key

#: Which sheets hold yearly and quarterly tables, and how a label ends in its period.
YEARLY, QUARTERLY, TWO_QUARTERS = r"(?i)^(?:12|13|14|15)_p4_", r"(?i)^(?:08_도표4_|10_도표6_|11_도표7_)", r"(?i)^11_도표7_"
LEAD, DOT = r"(?:^|[·ㆍ]\s*)", r"\s*[·ㆍ]\s*"
#: Rule, metric, kind of balance, labels; and the metrics that must be collected.
RULES = [
    ("revenue-rule-v1", "revenue", "flow", ["매출액", "영업수익", "수익(매출액)"]), ("operating-profit-rule-v1", "operating_profit", "flow", ["영업이익", "영업이익(손실)"]),
    ("profit-before-tax-rule-v1", "profit_before_tax", "flow", ["세전이익", "법인세비용차감전순이익"]), ("net-income-rule-v1", "net_income", "flow", ["당기순이익", "당기순이익(손실)"]),
    ("controlling-net-income-rule-v1", "controlling_net_income", "flow", ["지배주주순이익", "지배기업 소유주지분 순이익"]), ("total-assets-rule-v1", "total_assets", "point_in_time", ["자산총계"]),
    ("total-liabilities-rule-v1", "total_liabilities", "point_in_time", ["부채총계"]), ("total-equity-rule-v1", "total_equity", "point_in_time", ["자본총계"]), ("operating-cash-flow-rule-v1", "operating_cash_flow", "flow", ["영업활동 현금흐름", "영업활동현금흐름"]),
]
CORE = r"^(?:매출액|영업이익|세전이익|당기순이익|지배주주순이익|자산총계|부채총계|자본총계|영업활동 현금흐름)$"


def account_rules(spark: SparkSession) -> DataFrame:
    """key, rule, metric_id, balance: every name of a rule in one spelling (a fixed table of some thirty rows)."""
    rows = [(name, rule, metric, kind) for rule, metric, kind, labels in RULES for name in (rule, metric, *labels)]
    return spark.createDataFrame(rows, "name string, rule string, metric_id string, balance string").select(alias_key(F.col("name")).alias("key"), "rule", "metric_id", "balance").distinct()


def display_unit(sheet: Column, metric: Column) -> Column:
    ratio, multiple = metric.rlike("성장률|이익률|마진|ROE|ROA|배당률|수익률|비율"), metric.rlike(r"(?i)PER|PBR|PCR|EV/EBITDA")
    return F.when(ratio, "%").when(multiple, "배").when(sheet.rlike("(?i)^14_p4_") & metric.rlike("(?i)EPS|BPS|CFPS"), "원").otherwise("십억원")


def is_number(text: Column) -> Column:
    return F.coalesce(F.replace(F.trim(text), F.lit(","), F.lit("")).rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), F.lit(False))


def discover(spark: SparkSession, cells: DataFrame, year: int, quarter: int = 1) -> DataFrame:
    """target_id, sheet, name, address, metric_id, metric, period, basis, unit, target_unit, rule, required.

    cells: nth (their order), sheet, name, address, label, value (text), formula. Yearly sheets give the forecast column of
    the year before, quarterly ones plain numbers of the asked quarter (and of the one before on sheets that
    show two). A quarterly label without a metric takes that of the last labelled cell of its row. Metrics without a
    rule, and ratios, are no targets.
    """
    c = F.col
    rules = F.broadcast(account_rules(spark))
    label = F.trim(F.coalesce("label", F.lit("")))
    cells = cells.withColumn("label", label)
    last = year - 1
    yearly = cells.where(c("name").rlike(YEARLY) & is_number(c("value")) & label.rlike(rf"(?i){LEAD}{last}\s*(?:F|E)\s*$"))
    yearly = yearly.withColumn("metric", F.trim(F.regexp_replace("label", rf"(?i){DOT}{last}\s*(?:F|E)\s*$", ""))).withColumn("period", F.lit(f"{last}년 연간")).withColumn("q", F.lit(None).cast("int"))
    yearly = yearly.withColumn("target_id", F.concat_ws(":", F.lit("actual"), c("sheet").cast("string"), F.upper("address"), F.lit(str(last))))

    quarters = cells.where(c("name").rlike(QUARTERLY)).withColumn("row", F.regexp_extract(F.upper("address"), "^[A-Z]{1,3}([1-9][0-9]*)$", 1))
    bare = F.trim(F.regexp_replace("label", rf"(?i){DOT}[1-4]Q[0-9]{{2}}\s*(?:F|E)?\s*$", ""))
    own = F.when(c("label").rlike(r"(?i)^\s*[1-4]Q[0-9]{2}\s*(?:F|E)?\s*$"), "").when(F.upper(bare) == "OP", "영업이익").otherwise(bare)
    quarters = quarters.withColumn("own", own)
    known = quarters.where("own <> '' and row <> ''").withColumn("key", alias_key(c("own"))).join(rules, "key", "left_semi").where(display_unit(c("name"), c("own")) != "%")
    rows = known.groupBy("sheet", "row").agg(F.max_by("own", "nth").alias("row_metric"))
    before = (last, 4) if quarter == 1 else (year, quarter - 1)
    at = lambda y, q: c("label").rlike(rf"(?i){LEAD}{q}Q{y % 100:02d}\s*(?:F|E)?\s*$")
    found = F.when(c("name").rlike(TWO_QUARTERS) & at(*before), F.struct(F.lit(before[0]).alias("y"), F.lit(before[1]).alias("q"))).when(at(year, quarter), F.struct(F.lit(year).alias("y"), F.lit(quarter).alias("q")))
    plain = quarters.where(F.coalesce("formula", F.lit("")) == "").where(is_number(c("value"))).withColumn("_p", found).where("_p is not null")
    plain = plain.join(rows, ["sheet", "row"], "left").withColumn("metric", F.when(c("own") != "", c("own")).otherwise(F.coalesce("row_metric", F.lit("")))).withColumn("q", c("_p.q"))
    plain = plain.withColumn("period", F.concat(c("_p.y").cast("string"), F.lit("년 "), c("q").cast("string"), F.lit("분기")))
    plain = plain.withColumn("target_id", F.concat_ws(":", F.lit("quarterly"), c("sheet").cast("string"), F.upper("address"), F.concat(c("_p.y").cast("string"), F.lit("Q"), c("q").cast("string"))))

    columns = ["target_id", "sheet", "name", "address", "metric", "period", "q"]
    every = yearly.select(*columns).unionByName(plain.select(*columns)).withColumn("key", alias_key(c("metric"))).join(rules, "key")
    unit = display_unit(c("name"), c("metric"))
    target = F.when(unit == "십억원", "KRW_BILLION").when(unit == "원", "KRW")
    basis = F.when(c("balance") == "point_in_time", "point_in_time").when(c("q").isNull(), "annual").when(c("q") == 4, "single_quarter").otherwise("year_to_date")
    return every.select("target_id", "sheet", "name", F.upper("address").alias("address"), "metric_id", "metric", "period", basis.alias("basis"), unit.alias("unit"), target.alias("target_unit"), "rule", c("metric").rlike(CORE).alias("required")).where("target_unit is not null")
