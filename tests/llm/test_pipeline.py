"""The pipeline, stage by stage, against plain versions on each stage's own input."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus_pipeline
import plain
from test_operators import check_packing, rows

from tessera.llm import line_dedup


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], sf)
        out.write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    assert all(k.columns == docs.columns for k in kept[1:-1])
    read = lambda k: {r.doc_id: r.text for r in kept[k].collect()}
    texts = [read(k) for k in range(5)]
    assert len(texts[1]) >= 0.99 * len(texts[0]) and all(texts[0][i] == t for i, t in texts[1].items())
    con = duckdb.connect()
    con.register("documents", kept[1].select("doc_id", "text").toPandas())
    assert texts[2] == {i: t for i, _, _, t in con.sql(f"select doc_id, n_lines, n_dropped, text from ({line_dedup.SQL})").fetchall()}
    first = {i for i, _, c in plain.jaccard_components(sorted(texts[2].items()), 5, 80) if i == c}
    assert set(texts[3]) == first and all(texts[2][i] == t for i, t in texts[3].items())
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    order = sorted(texts[3])
    for i, (_, hit, _) in zip(order, plain.contamination([texts[3][i] for i in order], bench), strict=True):
        assert len(plain.alnum(texts[3][i])) - hit == len(plain.alnum(texts[4][i])) and (hit or texts[3][i] == texts[4][i])
    check_packing(kept[4], kept[5])
    cols = [c for c in kept[5].columns if c not in ("sequence_id", "offset")]
    assert Counter(rows(corpus_pipeline.run(spark, sf), *cols)) == Counter(rows(kept[5], *cols))
    assert all(r.n_chars == len(r.text) for r in kept[4].collect())


def test_stages_odd(spark, weird, none, sf):
    for table in (weird.withColumn("lang", weird["lang"]), none):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == table.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()


def test_near_copies_by_row(spark, sf):
    """Five words and 0.8; unrelated texts under one doc_id stay; of copies the smallest doc_id stays, a null one last."""
    words = [f"w{i}" for i in range(200)]
    near = words.copy()
    for k in (20, 70, 120, 170):
        near[k] = f"edit{k}"
    far = words.copy()
    for k in range(10, 200, 20):
        far[k] = f"far{k}"
    data = [(7, " ".join(words), 1), (3, " ".join(near), 2), (3, "another text under this id", 3), (None, " ".join(words), 4), (9, " ".join(far), 5), (None, None, 6), (None, "", 7), (3, "another text under this id", 8)]
    docs = spark.createDataFrame(data, "doc_id long, text string, _row int").repartition(3)
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, sf)
    got = Counter(rows(kept, "doc_id", "text"))
    assert kept.columns == docs.columns
    assert got == Counter([(3, " ".join(near)), (3, "another text under this id"), (9, " ".join(far)), (None, None), (None, "")])
