"""Formulas as references: literals scrubbed, references kept as rectangles, warnings, and the walk from outputs to inputs.

A range costs one row whatever its size. Rectangles meet cells by dyadic row blocks: a rectangle
lies in at most two blocks of the level that its height chooses, a cell in one block of each level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import COMPACT, side, stored

#: A sheet's limits, and the functions that make references dynamic, conditional or tolerant of blanks.
ROWS, COLUMNS = 1_048_576, 16_384
DYNAMIC, BRANCHES = "INDIRECT|OFFSET", "IF|IFS|CHOOSE|SWITCH"
TOLERANT = "SUM|SUMPRODUCT|COUNT|COUNTA|AVERAGE|AVERAGEA|MEDIAN|MIN|MAX|PRODUCT|STDEV|STDEVP|VAR|VARP"
#: Fixed value: a cell or range, maybe of another sheet; no part of a longer word, no function name.
CELL = r"\$?[A-Z]{1,3}\$?[1-9][0-9]{0,6}"
REFERENCE = rf"(?i)(?<![A-Z0-9_.])(?:(?:'(?:[^']|'')+'|[A-Z0-9_가-힣]+)!)?{CELL}(?::{CELL})?(?![A-Z0-9_(])"
#: Heights of the block levels: 16^0 to 16^5 rows.
LEVELS = 6


def scrubbed(formula: Column) -> Column:
    """The formula with its string literals emptied."""
    return F.regexp_replace(formula, '"(?:[^"]|"")*"', '""')


def column_number(letters: Column) -> Column:
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)


def calls(formula: Column, names: str) -> Column:
    return formula.rlike(rf"(?i)(?<![A-Z0-9_.])({names})\s*\(")


def _rectangle(ref: Column, own: Column) -> Column:
    """sheet, top, left, bottom, right of a reference."""
    place = F.regexp_replace(F.regexp_replace(ref, "^(?:'(?:[^']|'')+'|[^!']+)!", ""), r"\$", "")
    quoted, bare = F.regexp_extract(ref, "^'((?:[^']|'')+)'!", 1), F.regexp_extract(ref, "^([^'!]+)!", 1)
    sheet = F.when(quoted != "", F.replace(quoted, F.lit("''"), F.lit("'"))).when(bare != "", bare).otherwise(own)
    end = lambda k: F.element_at(F.split(place, ":"), k)
    row = lambda k: F.regexp_extract(end(k), "([0-9]+)$", 1).cast("int")
    col = lambda k: column_number(F.regexp_extract(end(k), "^([A-Za-z]+)", 1))
    return F.struct(sheet.alias("sheet"), F.least(row(1), row(-1)).alias("top"), F.least(col(1), col(-1)).alias("left"), F.greatest(row(1), row(-1)).alias("bottom"), F.greatest(col(1), col(-1)).alias("right"))


def _tokens(formula: Column) -> Column:
    """References with `tolerant`: does one of the calls around it leave blanks out? A fold over names, brackets and references."""
    pieces = F.regexp_extract_all(formula, F.lit(rf"{REFERENCE}|[A-Za-z0-9_]+\s*\(|[()]"), F.lit(0))
    state = F.struct(F.lit("").alias("open"), F.array().cast("array<struct<ref:string,tolerant:boolean>>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        opens, closes = piece.endswith("("), piece == ")"
        kind = F.when(F.upper(piece).rlike(rf"^(?:{TOLERANT})\s*\($"), "T").otherwise("N")
        stack = F.when(opens, F.concat(acc["open"], kind)).when(closes, F.left(acc["open"], F.greatest(F.length(acc["open"]) - 1, F.lit(0)))).otherwise(acc["open"])
        found = F.when(opens | closes, acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(piece.alias("ref"), F.contains(acc["open"], F.lit("T")).alias("tolerant")))))
        return F.struct(stack.alias("open"), found.alias("found"))

    return F.aggregate(pieces, state, step, lambda acc: acc["found"])


def references(cells: DataFrame, keys: list[str], sheets: DataFrame, book: list[str], most_cells: int | None = 50_000) -> DataFrame:
    """keys, conditional, sheet, top, left, bottom, right, tolerant, problem of every reference of a formula.

    cells: keys, book's columns, sheet, formula. sheets: book's columns, sheet (its name). Names of sheets are
    the same in any case. A reference with a problem (a sheet that is missing, an address beyond the
    sheet, more than `most_cells` cells) is reported and leads nowhere. Equal references are one; one is
    tolerant only if all are.
    """
    f = cells.where("formula is not null").withColumn("_f", scrubbed(F.col("formula")))
    f = f.select(*dict.fromkeys([*keys, *book]), F.col("sheet").alias("_own"), calls(F.col("_f"), BRANCHES).alias("conditional"), F.explode(_tokens(F.col("_f"))).alias("_t"))
    r = f.select("*", _rectangle(F.col("_t.ref"), F.col("_own")).alias("_r")).select("*", "_r.*", F.upper("_r.sheet").alias("_name")).drop("_own", "_r")
    known = sheets.select(*book, F.upper("sheet").alias("_name"), F.col("sheet").alias("_there")).dropDuplicates([*book, "_name"])
    r = r.join(known, [*book, "_name"], "left")
    beyond = (F.col("bottom") > ROWS) | (F.col("right") > COLUMNS)
    area = (F.col("bottom") - F.col("top") + 1).cast("long") * (F.col("right") - F.col("left") + 1)
    large = area > most_cells if most_cells else F.lit(False)
    problem = F.when(F.col("_there").isNull(), F.concat(F.lit("REFERENCE_SHEET_MISSING:"), "sheet")).when(beyond, "REFERENCE_ADDRESS_INVALID").when(large, "DEPENDENCY_RANGE_TOO_LARGE")
    r = r.select(*dict.fromkeys([*keys, *book]), "conditional", F.coalesce("_there", "sheet").alias("sheet"), "top", "left", "bottom", "right", F.col("_t.tolerant").alias("tolerant"), problem.alias("problem"))
    return r.groupBy(*[c for c in r.columns if c != "tolerant"]).agg(F.bool_and("tolerant").alias("tolerant"))


def warnings(cells: DataFrame, keys: list[str], refs: DataFrame, names: DataFrame, book: list[str]) -> DataFrame:
    """keys, warning: what a formula's references cannot tell. names: book's columns, name (defined names)."""
    f = cells.where("formula is not null").withColumn("_f", scrubbed(F.col("formula")))
    codes = F.array(
        F.when(F.col("_f").rlike(r"[\[\]]"), "UNSUPPORTED_STRUCTURED_OR_EXTERNAL_REFERENCE"), F.when(calls(F.col("_f"), DYNAMIC), "UNSUPPORTED_DYNAMIC_REFERENCE"), F.when(calls(F.col("_f"), BRANCHES), "BRANCH_ACTIVITY_NOT_EVALUATED")
    )
    fixed = f.select(*keys, F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("warning"))
    words = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.upper("_f"), F.lit(p), F.lit(0)) for p in ("[A-Z0-9_.]+", "[A-Z0-9_.가-힣]+")])))
    named = f.select(*dict.fromkeys([*keys, *book]), F.explode(words).alias("_w")).join(names.select(*book, F.upper("name").alias("_w"), "name").distinct(), [*book, "_w"])
    named = named.select(*keys, F.concat(F.lit("UNSUPPORTED_DEFINED_NAME:"), "name").alias("warning"))
    return fixed.unionByName(named).unionByName(refs.where("problem is not null").select(*keys, F.col("problem").alias("warning"))).distinct()


def touching(cells: DataFrame, rectangles: DataFrame, on: list[str], row: str = "row", col: str = "col") -> DataFrame:
    """Cells joined to the rectangles (top, left, bottom, right) that hold them."""
    height = F.col("bottom") - F.col("top") + 1
    level = F.when(height <= 1, 0)
    for k in range(1, LEVELS):
        level = level.when(height <= 16**k, k) if k < LEVELS - 1 else level.otherwise(k)
    size = F.element_at(F.array(*[F.lit(16**k) for k in range(LEVELS)]), F.col("_l") + 1)
    blocks = lambda at: F.floor(F.col(at) / size)
    r = rectangles.withColumn("_l", level).withColumn("_b", F.explode(F.sequence(blocks("top"), blocks("bottom"))))
    c = cells.withColumn("_l", F.explode(F.array(*[F.lit(k) for k in range(LEVELS)]))).withColumn("_b", blocks(row))
    inside = F.col(row).between(F.col("top"), F.col("bottom")) & F.col(col).between(F.col("left"), F.col("right"))
    return c.join(r, [*on, "_l", "_b"]).where(inside).drop("_l", "_b")


def inputs_behind(spark: SparkSession, outputs: DataFrame, cells: DataFrame, refs: DataFrame, book: list[str]) -> DataFrame:
    """metric, book's columns, sheet, row, col, conditional of every cell (formula or editable) behind an output, the outputs among them.

    conditional: each way to the cell passes a formula with a branch. refs: of the formula at sheet `at`, row, col.
    Only what was reached anew, or now without a branch, is followed in the next round, so cycles end.
    Only rounds of few rows are broadcast.
    """
    place = [*book, "sheet", "row", "col"]
    refs = stored(spark, refs.where("problem is null").drop("problem", "tolerant"), "formula-refs")
    cells = stored(spark, cells.select(*place).distinct(), "formula-cells")
    now = stored(spark, outputs.select("metric", *place).distinct().withColumn("conditional", F.lit(False)), "formula-walk")
    every, rounds = now, 0
    best = lambda df: df.groupBy("metric", *place).agg(F.bool_and("conditional").alias("conditional"))
    while now.limit(1).count():
        steps = side(now).withColumnsRenamed({"sheet": "at", "conditional": "_c"}).join(refs, [*book, "at", "row", "col"])
        boxes = steps.select("metric", *book, "sheet", "top", "left", "bottom", "right", (F.col("_c") | F.col("conditional")).alias("conditional"))
        boxes = stored(spark, boxes.groupBy("metric", *book, "sheet", "top", "left", "bottom", "right").agg(F.bool_and("conditional").alias("conditional")), "formula-boxes")
        seen = best(every).withColumnRenamed("conditional", "_seen").hint("merge")
        found = best(touching(cells, side(boxes), [*book, "sheet"]))
        now = stored(spark, found.join(seen, ["metric", *place], "left").where("_seen is null or (_seen and not conditional)").drop("_seen"), "formula-walk")
        every, rounds = every.unionByName(now), rounds + 1
        if rounds % COMPACT == 0:
            every = stored(spark, best(every), "formula-walk")
    return best(every)


def required(cells: DataFrame, editable: DataFrame, refs: DataFrame, book: list[str]) -> DataFrame:
    """editable (book's columns, sheet, row, col) with `required` and `missing`.

    cells: book's columns, sheet, row, col, text. A cell is needed if its row holds data (a value beyond the first
    column that is no period label, and less than three labels) and either a period label stands
    above it or a formula reads it outside every call that leaves blanks out. A cell without a
    row in `cells` is needed.
    """
    place, on = [*book, "sheet", "row", "col"], [*book, "sheet"]
    text = F.trim(F.coalesce("text", F.lit("")))
    label = text.rlike(r"(?i)^(?:19|20)[0-9]{2}\s*[FEAP]?$")
    c = cells.select(*place, text.alias("_t"), label.alias("_p"))
    rows = c.where("col > 1").groupBy(*on, "row").agg((F.count_if("_p") < 3).alias("_few"), F.bool_or((F.col("_t") != "") & ~F.col("_p")).alias("_data"))
    above = c.where("_p").groupBy(*on, "col").agg(F.min("row").alias("_header"))
    strict = touching(editable.select(*place).distinct(), refs.where("problem is null and not tolerant").select(*on, "top", "left", "bottom", "right").distinct(), on).select(*place).distinct().withColumn("_read", F.lit(True))
    e = editable.join(c.select(*place, "_t"), place, "left").join(rows, [*on, "row"], "left").join(above, [*on, "col"], "left").join(strict, place, "left")
    data = F.coalesce(F.col("_few") & F.col("_data"), F.lit(False))
    needed = F.col("_t").isNull() | (data & (F.coalesce(F.col("_header") < F.col("row"), F.lit(False)) | F.coalesce("_read", F.lit(False))))
    return e.select(*place, needed.alias("required"), (needed & (F.coalesce("_t", F.lit("")) == "")).alias("missing"))
