"""Growth recomputation, formulas, band charts, closure order and region features on hand-made cases and against plain versions."""

from __future__ import annotations

import heapq
import random
import re

from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import bandcharts, formulas, graph, growth, sheets




def checked(spark, candidates, terms, sources, records):
    c = spark.createDataFrame(candidates, "candidate long, question string, comparison string, source_types array<string>, company string, corp string, critical boolean, label string, quote string, normal string, kind string, reported string")
    t = spark.createDataFrame(terms, "term long, candidate long, role string, source string, quote string, value string, operation string, period string, scope string")
    s = spark.createDataFrame(sources, "source string, kind string, type string, content string, available timestamp, questions array<string>, corp string, year int, quarter int")
    r = spark.createDataFrame(records, "source string, record long, fs_div string, field string, content string")
    return {x.candidate: x for x in growth.growth_checks(c, t, s, r, F.lit("2026-07-25").cast("timestamp")).collect()}


def test_growth_from_a_page(spark):
    """Right, manipulated and without inputs; a foreign question, a late source, an absent quote, a term taken off."""
    quote = "2026년 2분기 매출은 1,200억원, 전년 동기 매출은 1,000억원이며 20% 증가했습니다."
    base = ("q1", "전년 동기 대비", ["COMPANY_IR"], None, None, True, "revenue_growth", quote)
    candidates = [(1, *base, "20", "yoy", "20"), (2, *base, "28", "yoy", "20"), (3, *base, "20", None, None), (4, *base, "20", "qoq", None), (5, *base, "20", "yoy", "+20.05 %"), (6, *base, "20", "yoy", "20.2"), (7, *base, "+20", "yoy", None), (8, *base[:5], False, *base[6:], "20", None, None), (9, *base, "20", "yoy", None)]
    now = lambda k, v="1,200", q="1,200", src="ir", op="add": (k * 10, k, "current", src, q, v, op, "2026년 2분기", "연결")
    then = lambda k, v="1,000", q="1,000", scope="연결": (k * 10 + 1, k, "comparison", "ir", q, v, "add", "2025년 2분기", scope)
    terms = [x for k in (1, 2, 4, 5, 6) for x in (now(k), then(k))] + [now(7, src="late"), then(7), now(9), then(9, scope=" ")]
    sources = [("ir", "page", "COMPANY_IR", quote, None, ["q1"], None, None, None)]
    import datetime

    sources.append(("late", "page", "COMPANY_IR", quote, datetime.datetime(2026, 8, 1), ["q1"], None, None, None))
    got = checked(spark, candidates, terms, sources, [])
    ok, bad = "passed", "failed"
    text = lambda a, b, c=None: f"numeric_calculation_inputs:{a},numeric_calculation_formula:{b}" + (f",numeric_reported_rate:{c}" if c else "")
    assert [got[k].checks for k in range(1, 10)] == [text(ok, ok, ok), text(ok, bad, ok), "numeric_calculation_inputs:failed", text(bad, bad), text(ok, ok, bad), text(ok, ok, bad), text(bad, bad), "", text(bad, bad)]
    assert got[1].rate_e4 == 200_000 and got[1].bound and float(got[1].current) == 1200


def test_growth_from_a_filing(spark):
    """An earlier term's field moves its year; a value in two records, two fields or another scope binds nothing; terms add up with signs."""
    f = lambda k, row, fs="CFS": [("f", row, fs, name, v) for name, v in k.items()]
    records = f({"thstrm_amount": "120000000000", "frmtrm_amount": "100,000,000,000", "account_nm": "매출액"}, 1) + f({"thstrm_amount": "5", "frmtrm_amount": "5"}, 2) + f({"thstrm_amount": "7"}, 3) + f({"thstrm_amount": "7"}, 4) + f({"thstrm_amount": "30", "frmtrm_amount": "20"}, 5, "OFS")
    records += f({"thstrm_amount": "20000000000", "bfefrmtrm_amount": "80000000000"}, 6)
    content = " ".join(v for *_, v in records)
    base = ("q1", "YoY", ["DART"], None, "c9", True, "revenue growth", "x")
    candidates = [(k, *base, "20", "yoy", None) for k in range(1, 6)] + [(6, *base, "0", "yoy", None)]
    term = lambda n, k, role, v, year, op="add": (n, k, role, "f", v, v, op, f"{year}년 2분기", "연결")
    terms = [term(1, 1, "current", "120000000000", 2026), term(2, 1, "comparison", "100000000000", 2025), term(3, 2, "current", "120000000000", 2026), term(4, 2, "comparison", "100000000000", 2026)]
    terms += [term(5, 3, "current", "5", 2026), term(6, 3, "comparison", "100000000000", 2025), term(7, 4, "current", "7", 2026), term(8, 4, "comparison", "100000000000", 2025), term(9, 5, "current", "30", 2026), term(10, 5, "comparison", "100000000000", 2025)]
    terms += [term(11, 6, "current", "120000000000", 2026), term(12, 6, "current", "20000000000", 2026, "subtract"), term(13, 6, "comparison", "100000000000", 2025)]
    got = checked(spark, candidates, terms, [("f", "filing", "DART", content.replace(",", ""), None, ["q1"], "c9", 2026, 2)], records)
    assert [got[k].bound for k in range(1, 7)] == [True, False, False, False, False, True]
    assert got[1].checks.endswith("formula:passed") and got[6].rate_e4 == 0 and got[6].checks.endswith("formula:passed")


def test_references_of_probed_formulas(spark):
    """Strings, case, Hangul and quoted sheets, functions that look like cells, ranges of any size at one row."""
    probed = {
        '="A1 text"&B2': [("Main", 2, 2, 2, 2)], "=매출!A1": [("매출", 1, 1, 1, 1)], "='It''s'!A1": [("It's", 1, 1, 1, 1)], "=sum(a1:b2)": [("Main", 1, 1, 2, 2)], '=INDIRECT("C5")': [], "=SUM(A1:XFD1048576)": [("Main", 1, 1, 1048576, 16384)],
        "=LOG10(2)+A1B2+XA1_5": [], "=$B$3:A$1": [("Main", 1, 1, 3, 2)], "=main!C1+MAIN!C1": [("Main", 1, 3, 1, 3)], "=AB12(3)": [], "=A0+A01+A12345678": [], "=SUM(A1,(A2),IF(A3>0,MAX(A4)))+A5": [("Main", k, 1, k, 1) for k in range(1, 6)], None: [], "": [],
    }
    cells = spark.createDataFrame([("b", "Main", k, f) for k, f in enumerate(probed)], "book string, sheet string, row int, formula string")
    names = spark.createDataFrame([("b", "Main"), ("b", "매출"), ("b", "It's")], "book string, sheet string")
    r = formulas.references(cells, ["book", "row"], names, ["book"], most_cells=None)
    got: dict[int, list] = {}
    for x in r.where("problem is null").collect():
        got.setdefault(x.row, []).append((x.sheet, x.top, x.left, x.bottom, x.right))
    assert [sorted(got.get(k, [])) for k in range(len(probed))] == [sorted(v) for v in probed.values()]
    tolerant = {x.top: x.tolerant for x in r.where("row = 11").collect()}
    assert tolerant == {1: True, 2: True, 3: True, 4: True, 5: False}
    assert {x.problem for x in formulas.references(cells, ["book", "row"], names, ["book"]).collect()} == {None, "DEPENDENCY_RANGE_TOO_LARGE"}
    names_ = spark.createDataFrame([("b", "rate"), ("b", "성장률"), ("c", "tax")], "book string, name string")
    more = spark.createDataFrame([("b", "Main", 1, '=Rate*성장률+"tax"'), ("b", "Main", 2, "=Rate2+tax+OFFSET (A1,1,1)+[x]y!A1+IFS(1,2)")], "book string, sheet string, row int, formula string")
    told = formulas.warnings(more, ["row"], formulas.references(more, ["row"], names, ["book"]).select("row", "problem"), names_, ["book"])
    assert sorted((x.row, x.warning) for x in told.collect()) == [(1, "UNSUPPORTED_DEFINED_NAME:rate"), (1, "UNSUPPORTED_DEFINED_NAME:성장률"), (2, "BRANCH_ACTIVITY_NOT_EVALUATED"), (2, "REFERENCE_SHEET_MISSING:y"), (2, "UNSUPPORTED_DYNAMIC_REFERENCE"), (2, "UNSUPPORTED_STRUCTURED_OR_EXTERNAL_REFERENCE")]


def test_touching_against_plain(spark):
    rng = random.Random(4)
    points = [(rng.randrange(1, 3000), rng.randrange(1, 9), k) for k in range(300)]
    boxes = [(t := rng.randrange(1, 2900), l := rng.randrange(1, 8), t + rng.choice([0, 1, 16, 17, 900, 10**6]), l + rng.randrange(3), k) for k in range(60)]
    c = spark.createDataFrame([("s", *p) for p in points], "sheet string, row int, col int, id int")
    b = spark.createDataFrame([("s", *x) for x in boxes], "sheet string, top int, left int, bottom int, right int, box int")
    got = sorted((x.id, x.box) for x in formulas.touching(c, b, ["sheet"]).collect())
    assert got == sorted((k, n) for r, q, k in points for t, l, z, w, n in boxes if t <= r <= z and l <= q <= w)


def test_inputs_behind_cycles(spark):
    """A cycle ends, and a way without a branch wins over one with it."""
    cells = [("b", "Main", 1, 1, "=A2+IF(A3,1,2)"), ("b", "Main", 2, 1, "=A3+A1"), ("b", "Main", 3, 1, None), ("b", "Main", 4, 1, "=IF(A5,1,0)"), ("b", "Main", 5, 1, None), ("b", "Main", 6, 1, None)]
    df = spark.createDataFrame(cells, "book string, sheet string, row int, col int, formula string")
    refs = formulas.references(df.withColumn("at", F.col("sheet")), ["book", "at", "row", "col"], df.select("book", "sheet").distinct(), ["book"])
    out = df.where("row in (1, 4)").select(F.concat(F.lit("m"), "row").alias("metric"), "book", "sheet", "row", "col")
    got = {(x.metric, x.row): x.conditional for x in formulas.inputs_behind(spark, out, df, refs, ["book"]).collect()}
    assert got == {("m1", 1): False, ("m1", 2): True, ("m1", 3): True, ("m4", 4): False, ("m4", 5): True}


def test_inputs_behind_broadcasts_few_rows_only(spark, monkeypatch):
    """Beyond the bound no join of the walk is a broadcast, however few bytes the stored files have."""
    plans, real = [], formulas.stored
    monkeypatch.setattr(formulas, "stored", lambda s, df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(s, df, name))
    monkeypatch.setattr(graph, "FEW", 0, raising=False)
    df = spark.range(1, 60).selectExpr("'b' as book", "'Main' as sheet", "cast(id as int) as row", "1 as col", "concat('=SUM(A', id * 2, ':A', id * 2 + 1, ')') as formula")
    refs = formulas.references(df.withColumn("at", F.col("sheet")), ["book", "at", "row", "col"], df.select("book", "sheet").distinct(), ["book"])
    out = df.where("row = 1").select(F.lit("m").alias("metric"), "book", "sheet", "row", "col")
    assert formulas.inputs_behind(spark, out, df, refs, ["book"]).count() == 59
    assert len(plans) > 6 and not any("BroadcastHashJoin" in p for p in plans[2:])


def test_best_first_order_against_a_heap(spark):
    rng = random.Random(9)
    edges, want = [], {}
    for g in range(12):
        n = rng.randrange(1, 40)
        names = rng.sample(range(1000), n)
        own = [(names[a], names[b]) for a in range(n) for b in range(a + 1, n) if rng.random() < 3 / n]
        if g % 4 == 3 and n > 2:
            own.append((names[-1], names[0]))  # a cycle
        roots = set(rng.sample(names, min(n, rng.randrange(1, 4))))
        queue, seen, order = sorted(roots), set(), []
        while queue:
            x = heapq.heappop(queue)
            if x not in seen:
                seen.add(x)
                order.append(x)
                for a, b in own:
                    if a == x and b not in seen:
                        heapq.heappush(queue, b)
        want[g] = (roots, order)
        edges += [(g, a, b) for a, b in own]
    e = spark.createDataFrame(edges, "graph int, src int, dst int")
    r = spark.createDataFrame([(g, x) for g, (roots, _) in want.items() for x in roots], "graph int, node int")
    got: dict[int, list] = {}
    for x in graph.best_first(spark, e, r).collect():
        got.setdefault(x.graph, []).append((x.way, x.node))
    assert {g: [n for _, n in sorted(v)] for g, v in got.items()} == {g: order for g, (_, order) in want.items()}
    assert graph.best_first(spark, e.limit(0), r.limit(0)).count() == 0


def test_digest_ignores_order_and_partitions(spark):
    df = spark.range(5000).select(F.col("id") % 3, F.col("id").cast("string").alias("k"), (F.col("id") % 7).cast("string").alias("v")).toDF("g", "k", "v")
    one = {(r.g, r.fingerprint, r.components, r.repeated) for r in graph.fingerprint(df.coalesce(1), ["g"], F.col("k"), F.col("v")).collect()}
    many = {(r.g, r.fingerprint, r.components, r.repeated) for r in graph.fingerprint(df.repartition(37), ["g"], F.col("k"), F.col("v")).collect()}
    less = {r.fingerprint for r in graph.fingerprint(df.where("k <> '4999'"), ["g"], F.col("k"), F.col("v")).collect()}
    assert one == many and len(one) == 3 and len(less & {x[1] for x in one}) == 2 and all(x[3] == 0 for x in one)
    assert {r.repeated for r in graph.fingerprint(df.union(df.limit(5)), ["g"], F.col("k"), F.col("v")).collect()} <= {0, 1, 2}


def test_candidate_ranges_report_overflow(spark):
    box = "book int, sheet int, top int, left int, bottom int, right int"
    tables = spark.createDataFrame([(1, 1, 1, 1, 5, 5)], box)
    used = spark.createDataFrame([(1, s, 1, 1, 9, 9) for s in (1, 2)] + [(2, 1, 1, 1, 1, 1)], box)
    dense = spark.createDataFrame([(1, 1, 1, 1, 5, 5), (1, 1, 1, 1, 9, 9), *[(1, s, 10 * k, 1, 10 * k + 2, 3) for s in (1, 2) for k in (1, 2)], (2, 1, 1, 1, 1, 1)], box)
    got = [(r.book, r.sheet, r.kind, r.top, r.place, r.status) for r in sheets.candidate_ranges(tables, used, dense, ["book"], most=4).orderBy("book", "place").collect()]
    assert got == [(1, 1, "excel_table", 1, 1, "kept"), (1, 1, "used_range", 1, 2, "kept"), (1, 1, "dense_region", 10, 3, "kept"), (1, 1, "dense_region", 20, 4, "kept"), (1, 2, "used_range", 1, 5, "kept"), (1, 2, "dense_region", 10, 6, "overflow"), (1, 2, "dense_region", 20, 7, "overflow"), (2, 1, "used_range", 1, 1, "kept")]


def test_band_components_and_units(spark):
    metrics = {"Adjusted price": "price", "수정 주가": "price", "주가": "price", "목표주가": None, "EPS (12M)": "base", "BPS": None, "PER multiple upper": "multiple_upper", "배수 하단": "multiple_lower", "PER 밴드 상단": "band_upper", "band low": "band_lower", "multiple": None, "note": None}
    df = spark.createDataFrame([(m,) for m in metrics], "m string")
    from tessera.functions.normalise import nfkc_key

    got = {r.m: r.c for r in df.select("m", bandcharts.component(F.lit("pe"), nfkc_key("m")).alias("c")).collect()}
    assert got == metrics
    units = {"KRW": "KRW", " 원 / 주 ": "KRW", "주당원": "KRW", "USD per share": "USD", "$": "USD", "엔": "JPY", "%": None, "배": None}
    assert {r.m: r.c for r in spark.createDataFrame([(u,) for u in units], "m string").select("m", bandcharts.currency(F.col("m")).alias("c")).collect()} == units


def test_band_first_bad_row_decides(spark):
    """Two faults in one range: the upper row's reason; a good chart beside it stays ready; no rows and no cells are blocked."""
    head = ["target_id", "approved_value", "evidence_ids", "metric", "period", "unit", "scope"]
    rows = [("1000", "e1", "price", "2026F", "KRW"), ("10", "e1", "EPS", "2026F", "KRW/share"), ("12", "e1", "multiple upper", "2026F", "x"), ("8", "e1", "multiple lower", "2026F", "x")]
    bad = [rows[0], ("zz", "e1", *rows[1][2:]), ("12", "", *rows[2][2:]), rows[3]]
    cells = []
    for sheet, body in (("good", rows), ("bad", bad), ("none", [])):
        for r, line in enumerate([head, *[["t", *x, "PER band"] for x in body]]):
            cells += [(sheet, r + 1, c + 1, v) for c, v in enumerate(line)]
    charts = spark.createDataFrame([(k, "generated_band_chart", "g", "pe", ["e1"], s, 1, 1, 9, 7) for k, s in enumerate(["good", "bad", "none", "absent"])], "chart int, kind string, generator string, family string, evidence array<string>, sheet string, top int, left int, bottom int, right int")
    status, series = bandcharts.band_charts(charts, spark.createDataFrame(cells, "sheet string, row int, col int, text string"))
    assert {r.chart: r.blocker for r in status.collect()} == {0: None, 1: "BAND_COMPONENT_VALUE_INVALID", 2: "BAND_COMPONENT_PROVENANCE_INCOMPLETE", 3: "BAND_BRIDGE_SCHEMA_INVALID"}
    assert [(r.chart, float(r.price), float(r.upper), float(r.lower)) for r in series.collect()] == [(0, 1000.0, 120.0, 80.0)]
    assert re.fullmatch("KRW", series.first().unit)


def test_growth_reads_lines_for_terms_and_records_only(spark, sf):
    """The plan derives candidates and contents from one stored table: lines are read for terms (three times) and records (two times three), not again for each join."""
    plan = catalog.queries()["growth_recomputation"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in x and "l_orderkey" in x for x in plan.split("\n")) <= 9
