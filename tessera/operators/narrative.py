"""Narrative sections of report pages: the prose column, its headings, and the runs of text below each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What text is furniture of the page, and what a heading with a colon looks like.
BOILERPLATE = [
    r"(?i)^(company|update|company update|research|research center)$", r"(?i)^(?:자료|주|출처)\s*[:：]", r"(?i)^(?:source|sources|note|notes)\s*[:：]", r"(?i)^compliance notice\b", r"^[A-Z][A-Z0-9.&-]{0,14}$", r"^\([0-9]{4,6}\)$",
    r"^\(?[0-9]{4,6}\)?$", r"^[0-9]{4}[./-]\s*[0-9]{1,2}[./-]\s*[0-9]{1,2}$",
]
COLON = r"[：:]($|\s)"
#: Points of height in one block of a page, by which runs and sections meet.
BLOCK = 64


def meaningful(text: Column) -> Column:
    return text.rlike("[A-Za-z가-힣]") & ~text.rlike(r"^[0-9\s.,()%+\-/:]+$")


def boilerplate(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    out = F.lit(False)
    for pattern in BOILERPLATE:
        out = out | plain.rlike(pattern)
    return out


def ordered_runs(runs: DataFrame) -> DataFrame:
    """Runs with text, trimmed and numbered by top, left, depth and object: nth."""
    r = runs.withColumn("text", F.trim("text")).where("text <> ''")
    return r.withColumn("nth", F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "z", "object")))


def prose(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """page, width, height, left, body: the left edge that most long text shares (to 4 points, the first of equals) and its upper median size."""
    long = runs.join(pages, "page").where((F.length("text") >= 20) & F.col("x0").between(0, F.col("width") * 0.82))
    edges = long.groupBy("page", (F.floor(F.col("x0") / 4 + 0.5) * 4).alias("left")).agg(F.sum(F.length("text")).alias("weight"), F.min("nth").alias("first"))
    left = edges.groupBy("page").agg(F.max_by("left", F.struct("weight", -F.col("first"))).alias("left"))
    sized = runs.join(left, "page").where((F.abs(F.col("x0") - F.col("left")) <= 18) & (F.length("text") >= 20) & (F.col("size") > 0))
    w = Window.partitionBy("page")
    ranked = sized.select("page", "size", F.row_number().over(w.orderBy("size")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    body = ranked.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select("page", F.col("size").alias("body"))
    return pages.join(left, "page").join(body, "page", "left")


def _blocks(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK)))


def headings(runs: DataFrame, frame: DataFrame) -> DataFrame:
    """The runs that head a section: a colon or larger letters in the prose column, and smaller text close below."""
    r = runs.join(frame, "page")
    colon = F.col("text").rlike(COLON)
    looks = colon | ((F.abs(F.col("x0") - F.col("left")) <= 18) & F.coalesce(F.col("size") >= F.col("body") * 1.07, F.lit(False)))
    fits = F.length("text").between(3, 100) & looks & meaningful(F.col("text")) & ~boilerplate(F.col("text")) & F.col("y0").between(F.col("height") * 0.18, F.col("height") * 0.84)
    h = r.where(fits).withColumn("colon", colon).withColumn("_b", _blocks(F.col("y0") - 1, F.greatest(F.col("y0") - 1, F.col("y1") + 36)))
    n = runs.where(F.length("text") >= 2).select("page", F.col("nth").alias("_nth"), F.col("y0").alias("_y"), F.col("x0").alias("_x"), F.col("size").alias("_size"), F.floor(F.col("y0") / BLOCK).alias("_b"))
    c = F.col
    below = (c("_nth") > c("nth")) & (c("_y") >= c("y0") - 1) & (c("_y") - c("y1") <= 36) & (c("_x") >= c("x0") - 10) & F.when(c("colon"), c("_size") <= c("size") * 1.05).otherwise(c("_size") < c("size") * 0.98)
    found = h.join(n, ["page", "_b"]).where(below).select("page", "nth").distinct()
    return r.withColumn("colon", colon).join(found, ["page", "nth"])


def sections(runs: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page, heading, runs, uncovered, x0, y0, x1, y1, text) of every section, and (page, heading, object, covered) of its runs.

    runs: page, object, text, size, x0, y0, x1, y1, z. pages: page, width, height. A section reaches to the next heading.
    Its runs are taken in order as long as each begins close enough below all before it: 42 points or 4.2
    letters below the heading, then 20 to 34 points or 2.8 letters. What follows a wider gap, or has no box, is
    uncovered. A section without a run is none. `text` holds the first 4,000 characters.
    """
    c = F.col
    runs = ordered_runs(runs)
    frame = prose(runs, pages)
    head = headings(runs, frame)
    w = Window.partitionBy("page").orderBy("nth")
    head = head.withColumn("until", F.coalesce(F.lead("y0").over(w), c("height") - 6))
    head = head.withColumn("until", F.when(c("until") == 0, c("height")).otherwise(c("until")))
    spans = head.select("page", c("nth").alias("heading_nth"), c("object").alias("heading"), c("y0").alias("h_top"), c("y1").alias("h_bottom"), c("x0").alias("h_left"), c("size").alias("h_size"), "colon", "until", "left", "body", "width")
    spans = spans.where("until >= h_top - 1").withColumn("_b", _blocks(c("h_top") - 1, c("until")))
    plain = runs.join(head.select("page", "nth"), ["page", "nth"], "left_anti").where(~boilerplate(c("text"))).withColumn("_b", F.floor(c("y0") / BLOCK))
    j = plain.join(spans, ["page", "_b"]).where((c("y0") >= c("h_top") - 1) & (c("y0") < c("until"))).drop("_b")
    column = ((c("x1") >= c("left") - 18) & (c("x0") <= c("width") * 0.96)) | (c("colon") & (c("x0") >= c("h_left") - 10) & (c("x0") <= c("width") * 0.94))
    sized = c("body").isNull() | c("size").between(c("body") * 0.78, F.greatest(c("h_size") * 1.05, c("body") * 1.24))
    j = j.where(column & sized).withColumn("boxed", (c("x1") >= c("x0")) & (c("y1") >= c("y0")))
    by = Window.partitionBy("page", "heading_nth", "boxed").orderBy("nth")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    letter = F.coalesce("body", F.greatest(F.lit(7.0), c("size")))
    allowed = F.when(F.row_number().over(by) == 1, F.greatest(F.lit(42.0), letter * 4.2)).otherwise(F.greatest(F.lit(20.0), F.least(F.lit(34.0), letter * 2.8)))
    gap = c("y0") - F.greatest(c("h_bottom"), F.coalesce(F.max("y1").over(before), c("h_bottom")))
    j = j.withColumn("_broken", F.when(gap > allowed, 1).otherwise(0)).withColumn("covered", c("boxed") & (F.sum("_broken").over(by.rowsBetween(Window.unboundedPreceding, 0)) == 0))
    inner = Window.partitionBy("page", "heading_nth", "covered").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("_at", F.coalesce(F.sum(F.length("text") + 1).over(inner), F.lit(0)))
    told = F.sort_array(F.collect_list(F.when(c("covered") & (c("_at") < 4000), F.struct("nth", "text"))))  # 4,000 characters' worth
    ok = lambda name: F.when(c("covered"), c(name))
    whole = j.groupBy("page", "heading_nth", "heading").agg(F.count_if("covered").alias("runs"), F.count_if(~c("covered")).alias("uncovered"), F.min(ok("x0")).alias("x0"), F.min(ok("y0")).alias("y0"), F.max(ok("x1")).alias("x1"), F.max(ok("y1")).alias("y1"), told.alias("_t"))
    text = F.substring(F.regexp_replace(F.array_join(F.transform("_t", lambda t: t["text"]), " "), r"\s+", " "), 1, 4000)
    whole = whole.where("runs > 0").select("page", "heading", "runs", "uncovered", "x0", "y0", "x1", "y1", text.alias("text"))
    return whole, j.select("page", "heading", "object", "covered").join(whole.select("page", "heading"), ["page", "heading"], "left_semi")
