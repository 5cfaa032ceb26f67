"""Mappings of report slots to workbook candidates: aliases, inferred metrics, the set of bindings, and the outline's checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import side, stored

#: Other names of metrics.
ALIASES = {
    "target_price": ["목표주가", "target price", "적정주가"], "current_price": ["현재주가", "current price", "종가"], "revenue": ["매출액", "매출", "revenue", "sales"], "operating_profit": ["영업이익", "operating profit", "op"],
    "net_income": ["지배주주순이익", "순이익", "net income"], "eps": ["forward eps", "fwd eps", "eps"], "per": ["target per", "적용 per", "per"], "investment_opinion": ["투자의견", "investment opinion", "rating"],
    "income_statement_table": ["손익계산서", "income statement", "profit and loss"], "balance_sheet_table": ["대차대조표", "재무상태표", "balance sheet"], "cash_flow_statement_table": ["현금흐름표", "cash flow statement", "cash flow"], "stock_price": ["주가추이", "stock price", "price trend"],
}
#: Metrics that a later stage fills, and whether nothing else may.
DEFERRED = [("current_price", "external_pending", True), ("figure_2_chart", "external_pending", False), ("figure_3_chart", "external_pending", False), ("consensus_data", "external_pending", False), ("stock_price", "external_pending", False), ("investment_opinion", "later_stage", True)]
#: What a valuation needs, and how texts begin that tell a metric (name, type, required).
VALUATION = ["forward_eps", "target_per", "target_price"]
SCALARS = [
    ("target_price", ["목표주가", "target price"], "money", True), ("current_price", ["현재주가", "current price", "주가"], "money", True), ("revenue", ["매출액", "매출"], "money", True), ("operating_profit", ["영업이익"], "money", True),
    ("net_income", ["지배주주순이익", "순이익"], "money", True), ("eps", ["forward eps", "fwd eps", "eps"], "money", True), ("per", ["target per", "적용 per", "per"], "decimal", True), ("investment_opinion", ["투자의견", "investment opinion"], "string", False),
]


def label_key(text: Column) -> Column:
    """Letters and figures in lower case."""
    return F.regexp_replace(F.lower(text), "[^0-9a-z가-힣]", "")


def aliases(spark: SparkSession) -> DataFrame:
    """metric, key: a metric's own name and its other ones (a fixed table of some forty rows)."""
    rows = [(m, n) for m, names in ALIASES.items() for n in (m, *names)]
    return spark.createDataFrame(rows, "metric string, name string").select("metric", label_key(F.col("name")).alias("key")).distinct()


def alias_matches(spark: SparkSession, slots: DataFrame, labels: DataFrame) -> DataFrame:
    """slot, label: labels whose key is one of a slot's metric's names; a metric without other names has its own. Equi joins on keys."""
    known = F.broadcast(aliases(spark))  # the fixed table
    named = slots.join(known, "metric", "left").select("slot", F.coalesce("key", label_key(F.col("metric"))).alias("key")).where("key <> ''").distinct()
    return named.join(labels.select("label", label_key(F.col("text")).alias("key")), "key").select("slot", "label").distinct()


def infer_metric(text: Column) -> Column:
    """struct(metric, type, required) of a text that begins with an opinion or a metric's name, or holds P/E; null for any other."""
    told = lambda m, t, r: F.struct(F.lit(m).alias("metric"), F.lit(t).alias("type"), F.lit(r).alias("required"))
    out = F.when(text.rlike(r"(?i)^\s*(?:(?:buy|hold|sell)\b|(?:매수|중립|매도)(?![\p{L}\p{N}_]))"), told("investment_opinion", "string", False)).when(text.rlike(r"(?i)\bp\s*/\s*e\b"), told("per", "decimal", True))
    key = label_key(text)
    for metric, names, kind, required in SCALARS:
        begins = F.lit(False)
        for n in names:
            begins = begins | F.startswith(key, label_key(F.lit(n)))
        out = out.when(begins, told(metric, kind, required))
    return out


def mapping_sets(spark: SparkSession, slots: DataFrame, candidates: DataFrame, markets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(template, slot, candidate, kind, reasons) of every bound slot, and (template, status, slots, required, bindings, unmapped, warnings).

    slots: template, slot, metric, type, required. candidates: template, slot, candidate, nth, selected (found in the workbook). markets:
    template, price (available or unavailable; no row: not asked). Valuation outputs that no plain slot has are added as slots
    that are not required. A metric whose source is exclusive takes no workbook candidate; an available market price is
    chosen for the current price, and workbook candidates only verify it. Of several selected the first counts. Required slots without a
    binding block, unless a later stage fills their metric.
    """
    c = F.col
    deferred = F.broadcast(spark.createDataFrame(DEFERRED, "metric string, resolution string, exclusive boolean"))  # a fixed table
    plain = slots.where(~c("type").isin("table", "chart") & c("metric").isin(VALUATION)).select("template", "metric").distinct()
    wanted = slots.select("template").distinct().select("template", F.explode(F.array(*map(F.lit, VALUATION))).alias("metric"))
    made = wanted.join(plain, ["template", "metric"], "left_anti").select("template", F.concat(F.lit("valuation:"), "metric").alias("slot"), "metric", F.lit("decimal").alias("type"), F.lit(False).alias("required"))
    every = slots.select("template", "slot", "metric", "type", "required").unionByName(made).join(deferred, "metric", "left").join(markets, "template", "left")
    priced = (c("metric") == "current_price") & (c("price") == "available")
    market = every.where(priced).select("template", "slot", F.lit("market").alias("candidate"), F.lit("market_data").alias("kind"), F.array(F.lit("MARKET_PRICE_AUTHORITY")).alias("reasons"))
    own = every.where(~F.coalesce("exclusive", F.lit(False))).select("template", "slot", "type", F.coalesce(priced, F.lit(False)).alias("priced"))
    book = candidates.join(own, ["template", "slot"]).where("selected and not priced")
    book = book.groupBy("template", "slot").agg(F.min_by(F.struct("candidate", "type"), F.struct("nth", "candidate")).alias("b"))
    kind = F.when(c("b.type").isin("table", "chart"), c("b.type")).otherwise("scalar")
    bound = book.select("template", "slot", c("b.candidate").alias("candidate"), kind.alias("kind"), F.array(F.lit("WORKBOOK_CANDIDATE")).alias("reasons")).unionByName(market)
    j = every.join(bound.select("template", "slot", F.lit(True).alias("bound")), ["template", "slot"], "left").withColumn("bound", F.coalesce("bound", F.lit(False)))
    open_ = c("required") & ~c("bound") & c("resolution").isNull()
    has = lambda m: F.bool_or((c("metric") == m) & ~c("type").isin("table", "chart") & c("bound"))
    g = j.groupBy("template").agg(
        F.count(F.lit(1)).alias("slots"), F.count_if("required").alias("required"), F.count_if("bound").alias("bindings"), F.count_if(open_).alias("unmapped"), F.max("price").alias("price"), *[has(m).alias(m) for m in VALUATION]
    )
    lost = F.filter(F.array(*[F.when(~c(m), m) for m in VALUATION]), lambda x: x.isNotNull())
    told = F.array(F.when(c("unmapped") > 0, F.concat(F.lit("REQUIRED_MAPPING_UNRESOLVED:"), c("unmapped").cast("string"))), F.when(c("price") == "unavailable", "MARKET_PRICE_PENDING"), F.when(F.size(lost) > 0, F.concat(F.lit("VALUATION_OUTPUT_MAPPING_UNRESOLVED:"), F.array_join(lost, "/"))))
    said = g.select("template", F.when(c("unmapped") == 0, "confirmed").otherwise("blocked").alias("status"), "slots", "required", "bindings", "unmapped", F.array_join(F.filter(told, lambda x: x.isNotNull()), ",").alias("warnings"))
    return bound.select("template", "slot", "candidate", "kind", F.array_join("reasons", ",").alias("reasons")), said


def outline_issues(outlines: DataFrame, pages: DataFrame, template: DataFrame, reviewed: DataFrame) -> DataFrame:
    """outline, code, page of all faults of report outlines.

    outlines: outline, mapped, evidenced (booleans). pages: outline, nth, page, title (null: none recommended), blanks (blocks without subtitle or
    summary). template: outline, nth, page. reviewed: outline, page. Page numbers and order must be the template's.
    """
    c = F.col
    p = pages.select("outline", "nth", c("page").alias("_p"))
    t = template.select("outline", "nth", c("page").alias("_t"))
    changed = p.join(t, ["outline", "nth"], "full").where(~F.coalesce(c("_p") == c("_t"), F.lit(False))).select("outline").distinct()
    null = F.lit(None).cast(dict(pages.dtypes)["page"])
    say = lambda df, code, page=null: df.select("outline", F.lit(code).alias("code"), page.alias("page"))
    lacking = pages.where(F.coalesce(F.trim("title") == "", F.lit(False)) | (c("blanks") > 0))
    unseen = pages.join(reviewed.select("outline", "page").distinct(), ["outline", "page"], "left_anti")
    out = say(changed, "PAGE_STRUCTURE_CHANGED").unionByName(say(lacking, "REQUIRED_NARRATIVE_MISSING", c("page"))).unionByName(say(outlines.where("not mapped"), "MAPPING_REVALIDATION_REQUIRED"))
    return out.unionByName(say(outlines.where("not evidenced"), "EVIDENCE_REVALIDATION_REQUIRED")).unionByName(say(unseen, "PAGE_REVIEW_REQUIRED", c("page")))


def served(spark: SparkSession, entries: DataFrame, executables: DataFrame) -> DataFrame:
    """entries with `executables`: how many different targets serve an entry by its slot or by its sheet.

    Targets are counted for each slot, for each sheet and for both at once, so an entry's number is a sum over its place and
    no entry meets a target. An entry that stands at several places is served by the union of theirs: its set
    of places meets the targets, once for all entries that have the same set.
    """
    c = F.col
    slots = executables.select("target", F.explode("slots").alias("_slot")).where("_slot is not null").distinct()
    sheets = executables.select("target", c("sheet").alias("_sheet")).where("_sheet is not null").distinct()
    n = F.count(F.lit(1))
    both = slots.join(sheets.withColumnRenamed("target", "_t"), c("target").eqNullSafe(c("_t"))).groupBy("_slot", "_sheet").agg(n.alias("_both"))
    places = entries.select(c("slot").alias("_slot"), c("sheet").alias("_sheet")).distinct()
    places = places.join(slots.groupBy("_slot").agg(n.alias("_a")), "_slot", "left").join(sheets.groupBy("_sheet").agg(n.alias("_b")), "_sheet", "left").join(both, ["_slot", "_sheet"], "left")
    number = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    places = stored(spark, places.select("_slot", "_sheet", (number("_a") + number("_b") - number("_both")).alias("_n")), "target-places")
    j = entries.join(side(places), c("slot").eqNullSafe(c("_slot")) & c("sheet").eqNullSafe(c("_sheet")), "left").drop("_slot", "_sheet")
    repeated = stored(spark, entries.where("entry is not null").groupBy("entry").agg(n.alias("_k")).where("_k > 1").select("entry"), "target-entries")
    if repeated.limit(1).count():
        own = entries.select("entry", F.struct(c("slot").alias("_slot"), c("sheet").alias("_sheet")).alias("_p")).join(side(repeated), "entry", "left_semi")
        own = own.groupBy("entry").agg(F.array_sort(F.collect_set("_p")).alias("_places")).where(F.size("_places") > 1)
        sets = stored(spark, own.select("_places").distinct().withColumn("_id", F.monotonically_increasing_id()), "target-sets")
        flat = sets.select("_id", F.explode("_places").alias("_p")).select("_id", "_p.*")
        pairs = flat.join(slots, "_slot").select("_id", "target").unionByName(flat.join(sheets, "_sheet").select("_id", "target")).distinct()
        union = sets.join(pairs.groupBy("_id").agg(n.alias("_union")), "_id", "left").select("_places", number("_union").alias("_union"))
        j = j.join(side(stored(spark, own.join(union, "_places").select("entry", "_union"), "target-unions")), "entry", "left").withColumn("_n", F.coalesce("_union", "_n")).drop("_union")
    return j.withColumn("executables", F.when(c("entry").isNull(), F.lit(0).cast("long")).otherwise(c("_n"))).drop("_n")


def report_targets(spark: SparkSession, entries: DataFrame, executables: DataFrame) -> DataFrame:
    """entry, readiness, status, executables, reason: what has to be collected for each entry of a report.

    entries: entry, slot, metric, required, connected, source (cell, range, chart or market_data), sheet, coverage (of its periods: ready,
    refresh_required or null), consensus (needs a source that is not collected). executables: target, sheet, slots (array). A target serves
    an entry by its slot or by its sheet; both are equi joins, and a target that fits both ways counts once.
    """
    c = F.col
    deferred = F.broadcast(spark.createDataFrame(DEFERRED, "metric string, resolution string, exclusive boolean"))  # a fixed table
    j = served(spark, entries, executables).join(deferred.drop("exclusive"), "metric", "left")
    valued = c("metric").isin(VALUATION)
    ready = (
        F.when(~c("connected"), "review_required").when(c("source") == "market_data", "ready").when(c("coverage") == "refresh_required", "period_refresh_required").when(c("resolution") == "external_pending", "source_collection_required")
        .when(c("resolution") == "later_stage", "later_stage").when(valued, "valuation_required").otherwise("ready")
    )
    j = j.withColumn("readiness", ready)
    base = (
        F.when((c("resolution") == "later_stage") | c("readiness").isin("valuation_required", "later_stage") | valued, "later_stage").when(c("readiness").isin("source_collection_required", "period_refresh_required"), "collection_required")
        .when(~c("connected"), F.when(c("resolution") == "external_pending", "collection_required").otherwise("connection_required")).when(c("readiness") == "ready", "carry_forward").otherwise("connection_required")
    )
    collect, none, backlog = base == "collection_required", c("executables") == 0, c("metric") == "figure_5_chart"
    reason = F.when(c("consensus"), "SOURCE_NOT_SUPPORTED").when(~backlog & collect & none & c("required"), "EXECUTABLE_TARGET_MISSING").when(collect & backlog, "LATER_BY_RULE").when(collect & none, "LATER_WITHOUT_TARGET")
    status = F.when(reason.isin("SOURCE_NOT_SUPPORTED", "EXECUTABLE_TARGET_MISSING"), "connection_required").when(reason.isNotNull(), "later_stage").otherwise(base)
    return j.select("entry", "readiness", status.alias("status"), "executables", reason.alias("reason"))
