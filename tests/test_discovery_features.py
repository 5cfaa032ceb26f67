"""Targets, dense charts, region hashes, envelopes, snapshots, official values, mappings and folds on hand-made cases and against plain versions."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import periods
from tessera.operators import densecharts, folds, mapping, narrative, official, regions, snapshots, targets

#: Every code that a query's data must hold, so that no branch is green for want of rows.
CODES = {
    "band_chart_status": ("blocker", 11), "official_values": ("status_code", 7), "official_prices": ("status", 3), "official_rates": ("status", 3), "approved_values": ("code", 12), "scalar_bindings": ("blocker", 5), "dense_chart_status": ("status", 5), "result_envelopes": ("code", 11),
    "hydrated_snapshots": ("status", 5), "mapping_sets": ("status", 2), "report_targets": ("reason", 4), "outline_issues": ("code", 5), "idempotent_replay": ("disposition", 4), "result_commits": ("disposition", 8), "formula_warnings": ("warning", 8), "candidate_ranges": ("status", 2), "excel_targets": ("basis", 4),
}


@pytest.mark.parametrize("name", sorted(CODES))
def test_all_codes_occur(spark, name):
    column, n = CODES[name]
    sf = "/root/testdata/sf0.01" if name == "official_values" else "/root/testdata/sf0.001"
    got = {r[0] for r in catalog.queries()[name](spark, sf).select(column).distinct().collect()}
    assert len(got) >= n, got


def test_targets_of_labelled_cells(spark):
    """The forecast column that becomes actual, unregistered rows, balance sheets, quarters with and without a metric, two-quarter sheets, formulas."""
    q = "08_도표4_분기실적추이"
    two = "11_도표7_분기실적전망_수정전"
    rows = [
        ("s12", "12_p4_손익계산서", "d5", "매출액 · 2025F", "1065.3", "'M1'!J16"), ("s12", "12_p4_손익계산서", "E5", "매출액 · 2026F", "1485.5", None), ("s12", "12_p4_손익계산서", "D7", "매출총이익 · 2025F", "108.1", None), ("s13", "13_p4_대차대조표", "D5", "자산총계 ㆍ 2025 e", "2,200", None),
        ("s12", "12_p4_손익계산서", "D9", "매출액 성장률 · 2025F", "3", None), ("s12", "12_p4_손익계산서", "D6", "영업이익 · 2025F", "n/a", None), ("s08", q, "B5", "매출액 · 1Q25", "215.4", None), ("s08", q, "V5", "1Q26", "330", None), ("s08", q, "V6", "1Q26", "330", None), ("s08", q, "W5", "매출액 · 1Q26F", "1", "=A1"),
        ("s11", two, "E19", "OP · 4Q25", "29", None), ("s11", two, "F19", "OP · 1Q26F", "31.1", ""), ("s10", "10_도표6_x", "F19", "OP · 4Q25", "31.1", None), ("s99", "99_other", "A1", "매출액 · 2025F", "1", None),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "nth int, sheet string, name string, address string, label string, value string, formula string")
    got = {r.target_id: r for r in targets.discover(spark, df, 2026, 1).collect()}
    assert set(got) == {"actual:s12:D5:2025", "actual:s13:D5:2025", "quarterly:s08:V5:2026Q1", "quarterly:s11:E19:2025Q4", "quarterly:s11:F19:2026Q1"}
    one = got["actual:s12:D5:2025"]
    assert (one.metric_id, one.metric, one.period, one.basis, one.unit, one.target_unit, one.rule, one.required) == ("revenue", "매출액", "2025년 연간", "annual", "십억원", "KRW_BILLION", "revenue-rule-v1", True)
    assert got["actual:s13:D5:2025"].basis == "point_in_time" and got["quarterly:s08:V5:2026Q1"].metric == "매출액" and got["quarterly:s08:V5:2026Q1"].basis == "year_to_date"
    assert got["quarterly:s11:E19:2025Q4"].basis == "single_quarter" and got["quarterly:s11:F19:2026Q1"].metric_id == "operating_profit"
    assert targets.discover(spark, df.limit(0), 2026, 1).count() == 0


def test_dense_charts_by_hand(spark):
    grid = {
        "rows": [["", "2024", "2025", "2026", "note"], ["주가", "1", "2", "3", "x"], ["PER 배수", "1", None, "3", ""], ["출처", "1", "2", "3", ""], ["thin", "1", None, None, ""]],
        "cols": [["", "주가", "audit", "x", ""], ["a", "1", "1", "1", "9"], ["b", "2", "2", None, "9"], ["c", "3", "3", "3", "9"], ["d", "4", "4", None, "9"], ["e", "5", "5", "5", "9"]],
        "gap": [["", "v"], ["a", "1"], ["", "2"], ["c", "3"]], "late": [["", "v"], ["", "1"], ["b", "2"], ["c", "3"]],
    }
    cells = [(s, r + 1, c + 1, t, (t or "").isdigit() and r > 0) for s, g in grid.items() for r, line in enumerate(g) for c, t in enumerate(line) if t is not None]
    shape = {"rows": [2, 3, 4], "cols": [], "gap": [], "late": []}
    ranges = [(s, s, 1, 1, len(g), len(g[0]), 1, 1, shape[s], s == "cols") for s, g in grid.items()] + [("open", "cols", 1, 1, 6, 5, 1, 1, [], False)]
    r = spark.createDataFrame(ranges, "range string, sheet string, top int, left int, bottom int, right int, header int, key int, periods array<int>, band boolean")
    said, series = densecharts.dense_charts(r, spark.createDataFrame(cells, "sheet string, row int, col int, text string, number boolean"))
    assert {x.range: (x.layout, x.points, x.series, x.status) for x in said.collect()} == {"rows": ("rows", 3, 2, "chart"), "cols": ("columns", None, None, "BAND_GATE_CLOSED"), "gap": ("columns", None, None, "ROWS_NOT_CONTIGUOUS"), "late": ("columns", None, None, "ROWS_NOT_CONTIGUOUS"), "open": ("columns", 5, 1, "chart")}
    assert {(x.range, x.label, x.first, x.last) for x in series.collect()} == {("rows", "주가", 2, 4), ("rows", "PER 배수", 2, 4), ("open", "주가", 2, 6)}


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_region_hash_in_any_partitions(spark, parts):
    """In the order of paths, a shorter one first, whatever the partitions; objects over several blocks once; an empty region."""
    rng = random.Random(2)
    objects = [("p", rng.choice([None, [rng.randrange(3)], [rng.randrange(3), rng.randrange(12)]]), rng.randrange(3), x := rng.randrange(500), y := rng.randrange(700), x + 60, y + rng.choice([9, 9, 300]), rng.choice(["one  two", " three\n", "", None, "é 日本"]) and f"w{k} {rng.choice(['one  two', 'é 日本'])}") for k in range(300)]
    boxes = [(f"r{k}", "p", 50 * k, 60 * k, 50 * k + 200, 60 * k + 250) for k in range(6)] + [("none", "q", 0, 0, 9, 9)]
    o = spark.createDataFrame(objects, "page string, path array<int>, z int, x0 int, y0 int, x1 int, y1 int, text string").repartition(parts)
    r = spark.createDataFrame(boxes, "region string, page string, x0 int, y0 int, x1 int, y1 int")
    got = {x.region: (x.tokens, x.hash) for x in regions.token_hashes(o, r).collect()}
    for name, page, a, b, c, d in boxes:
        inside = [(p is not None, p or [], y0, x0, z, (t or "").split()) for q, p, z, x0, y0, x1, y1, t in objects if q == page and x0 < c and x1 > a and y0 < d and y1 > b]
        words = [w for *_, ws in sorted((i for i in inside if i[-1])) for w in ws]
        assert got[name] == (len(words), hashlib.sha256("\n".join(words).encode()).hexdigest())


def test_envelopes_and_snapshots_by_hand(spark):
    digest = hashlib.sha256(b'{"a":[1,{"b":2}],"unit":"x","value":"1"}').hexdigest()
    good = '{"schemaVersion":1,"attempt":1,"sequence":0,"inputVersionIds":[],"resultType":"scalar","payload":{"value":"1","unit":"x","a":[1,{"b":2}]},"results":[{"hash":"%s"}],"artifacts":[]}' % digest
    bodies = {good: "ok", "": "ENVELOPE_NOT_AN_OBJECT", None: "ENVELOPE_NOT_AN_OBJECT", "7": "ENVELOPE_NOT_AN_OBJECT", good.replace('"attempt":1', '"attempt":0'): "ATTEMPT_INVALID", good.replace('"sequence":0', '"sequence":-1'): "SEQUENCE_INVALID", good.replace('"value":"1"', '"value":"2"'): "RESULT_HASH_MISMATCH", good.replace('"inputVersionIds":[]', '"inputVersionIds":"x"'): "INPUT_VERSIONS_INVALID", good.replace("scalar", "chart"): "PAYLOAD_NOT_OF_TYPE", good.replace('}],"art', '},{}],"art'): "RESULTS_INVALID"}
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    got = {r.k: r for r in snapshots.parse_envelopes(df, ["k"], "body").collect()}
    assert [got[k].code for k in range(len(bodies))] == list(bodies.values()) and got[0].payload == '{"a":[1,{"b":2}],"unit":"x","value":"1"}' and got[1].payload is None
    rows = [(1, '{"b": 1, "a": "%s"}' % ("x" * 80)), (2, '{"a":"%s","b":1}' % ("x" * 80)), (3, "{}"), (4, None), (5, "no json " * 20)]
    compacted, store = snapshots.compact(spark.createDataFrame(rows, "k int, p string"), ["k"], "p")
    assert store.count() == 2
    back = {r.k: (r.payload, r.status) for r in snapshots.hydrate(compacted, store, ["k"]).collect()}
    assert back[1] == back[2] == ('{"a":"%s","b":1}' % ("x" * 80), "restored") and back[3] == ("{}", "inline") and back[4] == (None, "empty") and back[5] == ("no json " * 20, "restored")
    assert {r.status for r in snapshots.hydrate(compacted, store.limit(0), ["k"]).collect()} == {"lost", "inline", "empty"}


def test_canonical_periods_and_dates(spark):
    said = {"1Q26F": "2026년 1분기", "2026Q1": "2026년 1분기", "2026년2분기": "2026년 2분기", "2026-Q3": "2026년 3분기", " 2Q2026 EST": "2026년 2분기", "FY2025": "2025년", "2025년 연간": "2025년", "2025 사업연도": "2025년", "2027F": "2027년", "H1  2026": "H1 2026", "2026년 5분기": "2026년 5분기"}
    assert {r.t: r.c for r in spark.createDataFrame([(x,) for x in said], "t string").select("t", periods.canonical_period(F.col("t")).alias("c")).collect()} == said
    days = spark.createDataFrame([("20260131",), ("2026013",), (None,)], "d string").select(official.dashed(F.col("d")).alias("d"))
    assert [r.d for r in days.collect()] == ["2026-01-31", None, None]
    assert [r.t for r in spark.createDataFrame([("A123",), ("000123",), (None,)], "t string").select(official.ticker_key(F.col("t")).alias("t")).collect()] == ["000123", "000123", "000000"]


def test_prices_of_the_last_trading_day(spark):
    """A day that ends after the cutoff in Seoul is too late, as is a later publication; the latest good row must agree with itself."""
    import datetime
    from decimal import Decimal

    cut = F.lit("2026-01-05 15:00:00").cast("timestamp")  # midnight in Seoul
    late = datetime.datetime(2026, 1, 5, 15, 1)
    rows = [("a", "1", Decimal(10), "2026-01-05", None, "10", "20260105", "A000001"), ("b", "1", Decimal(11), "2026-01-06", None, "11", "20260106", "1"), ("c", "1", Decimal(12), "2026-01-05", late, "12", "20260105", "1"), ("d", "2", Decimal(5), "2026-01-02", None, "5.0", "20260102", "2"), ("e", "3", Decimal(5), "2026-13-02", None, "5", "x", "3"), ("f", "4", Decimal(5), "2026-01-02", None, None, None, None)]
    prices = spark.createDataFrame(rows, "source string, ticker string, close decimal(20,2), day string, published timestamp, row_close string, row_day string, row_ticker string")
    got = {r.target: (r.source, r.status, r.value) for r in official.price_results(spark.createDataFrame([(k, str(k)) for k in range(1, 6)], "target int, ticker string"), prices, cut).collect()}
    assert got == {1: ("a", "validated", "10"), 2: ("d", "validated", "5"), 3: (None, "source_unavailable", None), 4: ("f", "manual_review", None), 5: (None, "source_unavailable", None)}


def test_approved_set_is_whole(spark):
    row = ("m", "2026Q1", "연결", "actual", "KRW", True, True)
    t = spark.createDataFrame([(k, *row) for k in (1, 2)], "target int, metric string, period string, scope string, kind string, unit string, included boolean, required boolean")
    good = (None, "passed", None, "none", "1,000.50", "1000.5", "KRW", "1Q26", "CFS", None, ["e2", "e1", "e1"])
    schema = "target int, exception string, machine string, accepted boolean, conflict string, original string, normal string, unit string, period string, scope string, kind string, evidence array<string>"
    values, whole = official.approved_values(spark, t, spark.createDataFrame([(k, *good) for k in (1, 2)], schema))
    w = whole.first()
    assert (w.values, w.blocked, w.status) == (2, 0, "approved") and len(w.content_hash) == 64
    assert {(r.original, r.value, r.evidence, r.period) for r in values.collect()} == {("1000.5", "1000.5", "e1,e2", "2026년 1분기")}
    other = official.approved_values(spark, t.repartition(3), spark.createDataFrame([(k, *good) for k in (2, 1)], schema))[1].first()
    assert other.content_hash == w.content_hash
    broken = official.approved_values(spark, t, spark.createDataFrame([(1, *good), (2, "REJECTED", *good[1:])], schema))[1].first()
    assert (broken.first, broken.status, broken.content_hash) == (2, "blocked", None)
    assert official.approved_values(spark, t.limit(0), spark.createDataFrame([(1, *good)], schema))[1].first().status == "VALIDATED_VALUE_SET_EMPTY"


def test_folds_read_a_hot_key_in_batches(spark):
    """Clusters and bins over a key with nearly all rows, in Arrow batches of 100, against plain folds."""
    rng = random.Random(1)
    rows = [("hot", k, rng.choice([0.0, 5.0]) + rng.random() * 400) for k in range(4000)] + [("cold", 1, 2.0), (None, 1, 7.0), ("hot", 5, None)]
    df = spark.createDataFrame(rows, "k string, o int, x double").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = sorted(((r.k or "", r.center, r.n) for r in folds.clusters(df, ["k"], "x", 0.2).collect()))
        packed = sorted((r.k or "", r.o, r.x or 0, r.bin) for r in folds.pack(df.where("x is null or o <> 5").withColumn("x", F.col("x").cast("long")), "k", "o", "x", 900).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = []
    for key in ("hot", "cold", None):
        mean, n = 0.0, 0
        for x in sorted({x for k, _, x in rows if k == key and x is not None}):
            if n and abs(x - mean) <= 0.2:
                mean, n = (mean * n + x) / (n + 1), n + 1
            else:
                want += [(key or "", mean, n)] if n else []
                mean, n = x, 1
        want.append((key or "", mean, n))
    assert got == sorted(want)
    bins, fill = 0, None
    for k, _, s, b in packed:
        if k == "hot":
            if fill is not None and fill + s > 900:
                bins, fill = bins + 1, 0
            fill = (fill or 0) + s
            assert b == bins
    assert {b for k, _, _, b in packed if k != "hot"} == {0}


def test_inferred_metrics_and_aliases(spark):
    said = {"BUY (유지)": "investment_opinion", "buyers market": None, "P / E 12x": "per", "목표주가 10만원": "target_price", "주가 추이": "current_price", "FWD EPS": "eps", "매수세": None, "": None}
    got = {r.t: r.m and r.m.metric for r in spark.createDataFrame([(x,) for x in said], "t string").select("t", mapping.infer_metric(F.col("t")).alias("m")).collect()}
    assert got == said
    hits = mapping.alias_matches(spark, spark.createDataFrame([("a", "revenue"), ("b", "my metric"), ("c", "")], "slot string, metric string"), spark.createDataFrame([(1, "Sales"), (2, "My-Metric"), (3, "매출 액"), (4, "")], "label int, text string"))
    assert sorted((r.slot, r.label) for r in hits.collect()) == [("a", 1), ("a", 3), ("b", 2)]


def test_sections_stop_at_a_gap(spark):
    """A section keeps what follows closely; behind a wide gap runs are uncovered, and a page without long text has none."""
    runs = [("p", 1, "Earnings: second quarter", 12.0, 40.0, 200.0, 240.0, 212.0, 0), *[("p", 2 + k, f"a long line of body text number {k} here", 9.0, 40.0, 220.0 + 14 * k, 400.0, 230.0 + 14 * k, 0) for k in range(5)], ("p", 20, "far below the wide gap, also a long line", 9.0, 40.0, 400.0, 400.0, 409.0, 0), ("p", 21, "Source: someone", 9.0, 40.0, 290.0, 400.0, 299.0, 0), ("q", 1, "Title: x", 9.0, 40.0, 200.0, 60.0, 209.0, 0)]
    df = spark.createDataFrame(runs, "page string, object int, text string, size double, x0 double, y0 double, x1 double, y1 double, z int")
    pages = spark.createDataFrame([("p", 595.0, 842.0), ("q", 595.0, 842.0)], "page string, width double, height double")
    whole, each = narrative.sections(df, pages)
    (s,) = whole.collect()
    assert (s.heading, s.runs, s.uncovered, s.x0, s.y0, s.x1, s.y1) == (1, 5, 1, 40.0, 220.0, 400.0, 286.0) and s.text.startswith("a long line of body text number 0 here a long")
    assert {(r.object, r.covered) for r in each.collect()} == {(2 + k, True) for k in range(5)} | {(20, False)}


def most_joined(df) -> int:  # noqa: ANN001
    """Rows that the largest join of the plan made, as it ran."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if "Join" in name:
            most = max(most, p.metrics().get("numOutputRows").get().value())
        below = p.children()
        todo += [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else [below.apply(k) for k in range(below.size())]
    return most


def test_targets_are_counted_without_pairs(spark):
    """Entries of one sheet and its targets: no join makes their product; entries at several places have the union, null ones nothing."""
    shape = "entry long, slot string, metric string, required boolean, connected boolean, source string, sheet string, coverage string, consensus boolean"
    rng = random.Random(2)
    rows = [(k, f"s{rng.randrange(9)}" if k % 7 else None, "hot" if k % 3 else None) for k in range(400)] + [(k, f"s{k % 9}", f"x{k % 4}") for k in range(60)] + [(None, "s1", "hot"), (3, None, None), (500, "none", "none")]
    entries = spark.createDataFrame([(e, slot, "revenue", True, True, "range", sheet, None, False) for e, slot, sheet in rows], shape)
    targets = [(t, "hot" if t % 4 else f"x{t % 3}", [f"s{t % 11}", None, f"s{t % 5}"] if t % 6 else None) for t in range(300)] + [(1, "x1", ["s8"]), (1, "hot", ["s1"])]
    df = mapping.report_targets(spark, entries, spark.createDataFrame(targets, "target long, sheet string, slots array<string>"))
    want: dict = {}
    for e, slot, sheet in rows:
        want.setdefault(e, set()).update(t for t, s, slots in targets if (sheet is not None and s == sheet) or (slot is not None and slot in (slots or [])))
    got = [(r.entry, r.executables) for r in df.collect()]
    assert sorted(got, key=str) == sorted(((e, len(want[e]) if e is not None else 0) for e, _, _ in rows), key=str)
    assert most_joined(df) < 5_000


def test_scalars_are_found_without_pairs(spark):
    """Bindings and scalars of one metric: no join makes their product; types and addresses that are null, repeated bindings, ties."""
    rng = random.Random(6)
    scalars = [(rng.choice([None, *range(150)]), rng.choice(["Hot", "h-o_t", "cold"]), rng.choice(["a", "b", None]), rng.choice(["A1", "B2", "", None]), f"v{k}") for k in range(300)]
    rows = [(k % 260 if k % 50 else None, rng.choice([True, True, False, None]), rng.choice(["HOT", "co ld", "none", None]), rng.choice([None, "a", "b", "c"]), rng.choice([None, "A1", "", "C3"])) for k in range(300)]
    bindings = spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], "binding long, confirmed boolean, metric string, source_type string, source_address string, sheet string, row int, col int, last_row int, last_col int")
    cells = spark.createDataFrame([], "sheet string, row int, col int, text string, formula string")
    df = official.scalar_bindings(bindings, spark.createDataFrame(scalars, "nth int, metric string, source_type string, source_address string, value string"), cells)
    name = lambda m: "".join(x for x in m.lower() if x not in " _-")
    fits: dict = {}
    for b, ok, metric, kind, address in rows:
        if b is not None and ok and metric is not None:
            fits.setdefault(b, []).extend((n, v) for n, m, t, a, v in scalars if n is not None and name(m) == name(metric) and kind in (None, t) and address in (None, a))
    least = {b: {v for n, v in x if n == min(x)[0]} for b, x in fits.items() if x}
    got = df.collect()
    assert len(got) == len(rows) and any(r.value for r in got)
    confirmed = {}
    for b, ok, *_ in rows:
        confirmed.setdefault(b, []).append(ok)
    for r in got:
        if r.blocker == "BINDING_NOT_CONFIRMED":
            assert False in confirmed[r.binding]
        else:
            assert r.value in least[r.binding] if r.binding in least else r.value is None, r
    assert most_joined(df) < 1_000
