"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest
from compare import difference

from tessera import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf, name):
    assert difference(spark, catalog.queries()[name], catalog.oracle_sql()[name], sf) == ""


def test_entry_and_imports(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_greedy_pack(spark, sf):
    import pandas as pd

    got = catalog.queries()["greedy_pack"](spark, sf).toPandas().sort_values(["conv_id", "turn"])
    for _, part in got.groupby("conv_id"):
        bins, fill, want = -1, 0, []
        for s in part.chars:
            if bins < 0 or fill + s > 1500:
                bins, fill = bins + 1, 0
            fill += s
            want.append(bins)
        assert list(part["bin"]) == want
    assert isinstance(got, pd.DataFrame)


def test_html_article(spark):
    from pyspark.sql import functions as F

    from tessera.functions import text as T

    html = '<html><head><title>A &amp; B</title><meta content="og" property="og:title"><script type="application/ld+json">{"@graph":[{"headline":"H"}]}</script></head><body><nav>menu</nav><article><p>One</p><p>Two &lt;x&gt;</p><script>no()</script></article></body></html>'
    row = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(T.article_body(F.col("h")).alias("b"), T.json_ld(F.col("h"), "headline").alias("j"), T.meta(F.col("h"), "og:title").alias("m")).collect()
    assert (row[0].b, row[0].j, row[0].m) == ("One\nTwo <x>", "H", "og")
    assert row[1].b is None and row[2].b == ""


def test_public_url(spark):
    from pyspark.sql import functions as F

    from tessera.functions import text as T

    urls = {"https://a.example/x#y": True, "http://10.0.0.1/": False, "http://172.20.1.1/": False, "http://8.8.8.8/": True, "ftp://a.example/": False, "http://u:p@a.example/": False, "http://localhost/": False, "http://[::1]/": False}
    got = {r.u: r.ok for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", T.public_url(F.col("u")).alias("ok")).collect()}
    assert got == urls


def test_asof_join_against_plain(spark):
    import random

    from tessera.operators import asof

    rng = random.Random(5)
    left = [(rng.randrange(3), rng.randrange(20), i) for i in range(60)]
    right = [(rng.randrange(3), rng.randrange(20), i, rng.random()) for i in range(40)]
    a = spark.createDataFrame(left, "k int, t int, id int").selectExpr("k", "timestamp_seconds(t * 86400) as t", "id")
    b = spark.createDataFrame(right, "k int, u int, rid int, v double").selectExpr("k", "timestamp_seconds(u * 86400) as u", "rid", "v")
    got = {r.id: r.rid for r in asof.asof_join(a, b, ["k"], "t", "u", "rid", ["rid", "v"], most_days=5).collect()}
    for k, t, i in left:
        best = max(((u, r) for kk, u, r, _ in right if kk == k and t - 5 <= u <= t), default=(None, None))
        assert got[i] == best[1]


def test_cycles_end(spark):
    from tessera.operators import graph

    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert graph.closure(spark, e).count() == 12
    layers = {r.node: r.layer for r in graph.layers(spark, e).collect()}
    assert layers == {1: None, 2: None, 3: None, 4: None}


def test_streaming(spark, sf, tmp_path):
    from tessera.streaming import events as S

    src = tmp_path / "events"
    spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value").repartition(3).write.parquet(str(src))
    stream = S.source(spark, str(src), files=10)
    batch = {(r.start, r.event_type): r.n for r in S.tumbling(spark.read.parquet(str(src)), "1 day", "40 days").collect()}
    out = S.run_available(spark, S.tumbling(stream, "1 day", "40 days"), "complete", str(tmp_path / "cp"))
    assert {(r.start, r.event_type): r.n for r in out.collect()} == batch
    once = S.run_available(spark, S.distinct_within(S.source(spark, str(src), 10), ["event_type", "user_id"], "40 days"), "append", str(tmp_path / "cp"))
    assert once.count() == spark.read.parquet(str(src)).select("event_type", "user_id").distinct().count()


def test_position_clusters(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_extendedprice").toPandas()
    got = catalog.queries()["position_clusters"](spark, sf).toPandas()
    for key, part in rows.groupby("l_suppkey"):
        want: list[list[float]] = []
        for x in sorted(set(part.l_extendedprice)):
            if want and abs(x - want[-1][0]) <= 200.0:
                mean, n = want[-1]
                want[-1] = [(mean * n + x) / (n + 1), n + 1]
            else:
                want.append([x, 1])
        mine = got[got.l_suppkey == key]
        assert [n for _, n in want] == mine.n.tolist() and all(abs(a - b) < 1e-6 for (a, _), b in zip(want, mine.center, strict=True))


def test_capped_in_order_collects_flags_only(spark, tmp_path):
    spark.range(20_000).selectExpr("1 as l_suppkey", "id as l_orderkey", "1 as l_linenumber", "id as l_partkey", "substr('NRA', cast(id % 3 + 1 as int), 1) as l_returnflag").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.queries()["capped_in_order"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [(1, "N,R")]
    below = got._jdf.queryExecution().optimizedPlan().toString().split("collect_list")[-1]
    assert "Aggregate [l_suppkey" in below and "min(" in below


def test_nfkc(spark):
    from tessera.functions.normalise import nfkc_key

    got = [r.k for r in spark.createDataFrame([("Ａ１ b-C 가",), (None,)], "t string").select(nfkc_key("t").alias("k")).collect()]
    assert got == ["a1bc가", None]


def test_json_ld_walks_the_graph(spark):
    from pyspark.sql import functions as F

    from tessera.functions.text import json_ld

    page = '<script type="application/ld+json">{"@graph": [{"@type": "Site"}, {"name": "second", "body": {"x": 1}}, {"name": "third"}]}</script><script type="application/ld+json">{"name": "late", "url": "u"}</script>'
    df = spark.createDataFrame([(page,), ("<p>none</p>",), ('<script type="application/ld+json">{"@graph": 3, "name": "top"}</script>',)], "html string")
    assert [tuple(r) for r in df.select(json_ld(F.col("html"), "name"), json_ld(F.col("html"), "url")).collect()] == [("second", "u"), (None, None), ("top", None)]


def test_shared_quota_against_plain(spark):
    """Sequential choice in rank order; a source rejected by its publisher's limit uses no place, and a question without a policy keeps none."""
    from tessera.operators import ranking

    rows = [(k, [q for q in "abcd" if (k * 7 + ord(q)) % 3], f"{'pP'[k % 2]}{k % 4 // 2}", k * 37 % 50) for k in range(60)]
    limits = {"a": (5, 2), "b": (3, 9), "c": (40, 1)}
    sources = spark.createDataFrame(rows + rows[:9], "k int, qs array<string>, pub string, rank int")
    policies = spark.createDataFrame([(q, *v) for q, v in limits.items()], "question string, retain int, per_publisher int")
    want, used = {}, {}
    for k, qs, pub, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        for q in qs:
            whole, own = used.get(q, 0), used.get((q, pub.lower()), 0)
            if q in limits and whole < limits[q][0] and own < limits[q][1]:
                used[q], used[q, pub.lower()] = whole + 1, own + 1
                want.setdefault(k, []).append(q)
    got = ranking.shared_quota(sources, "k", "qs", "pub", ["rank"], policies)
    assert {r.k: r.qs for r in got.collect()} == want
    assert ranking.shared_quota(sources.limit(0), "k", "qs", "pub", ["rank"], policies).count() == 0
    assert ranking.shared_quota(sources, "k", "qs", "pub", ["rank"], policies.limit(0)).count() == 0
