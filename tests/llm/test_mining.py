"""Hard negatives, collocations and online packing against plain versions, and their defined results on odd tables."""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import plain

from tessera.llm import collocations, hard_negatives, online_packing, word_encoder


def rows(df, *cols):  # noqa: ANN001, ANN201
    return [tuple(r) for r in df.select(*cols).collect()]


# 11 hard negatives ----------------------------------------------------------------------------------------------


def mined(data, every=100, positives=5, negatives=10, low=30, high=90):  # noqa: ANN001, ANN201
    """Brute force in Python integers over rows (vec_id, label, vector); a repeated anchor is asked once."""
    good = []
    for i, label, v in data:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, label, [math.floor(256 * x) for x in v]))
    out, seen = Counter(), set()
    for i, label, q in good:
        if i % every or (i, label, tuple(q)) in seen:
            continue
        seen.add((i, label, tuple(q)))
        scored = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j, m) for j, m, p in good if j != i and len(p) == len(q))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            found = [(t, n) for t, n, m in scored if m != label and 30 * -s <= 100 * -t <= 90 * -s] if (low, high) == (30, 90) else []
            out.update((i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(found[:negatives], 1))
    return out


SHAPE = "vec_id long, label long, embedding array<double>, q int, shard string, anchor string"


@pytest.mark.parametrize(("dim", "values"), [(24, 1 << 19), (24, 600), (1, 1 << 19), (5, 40)])
def test_hard_negatives(spark, dim, values, monkeypatch):
    monkeypatch.setattr(hard_negatives, "MOST_VALUES", values)
    monkeypatch.setattr(hard_negatives, "LEAST_VALUES", values)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(6, dim))
    data = [(i, int(rng.integers(3)), (centres[rng.integers(6)] + rng.normal(size=dim) * rng.choice([0.0, 0.3])).tolist()) for i in range(500)]
    df = spark.createDataFrame([(*r, 1, "s", "a") for r in data], SHAPE).repartition(3)
    got = Counter(rows(hard_negatives.mine(spark, df, every=20), "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    assert got == mined(data, every=20) and got


def test_hard_negatives_in_many_batches(spark):
    """A shard meets anchors that come in more than one Arrow batch."""
    rng = np.random.default_rng(3)
    data = [(i, int(rng.integers(3)), rng.normal(size=8).tolist()) for i in range(300)]
    df = spark.createDataFrame([(*r, 1, "s", "a") for r in data], SHAPE).repartition(3)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        got = Counter(rows(hard_negatives.mine(spark, df, every=3), "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    finally:
        spark.conf.set(key, before)
    assert got == mined(data, every=3) and got


def test_hard_negatives_odd(spark):
    inf = float("inf")
    data = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [0.5, 0.5]), (1, 1, [0.9, 0.1]), (1, 1, [0.9, 0.1]), (2, 2, [0.5, -0.5]), (3, 2, [0.5, -0.5]), (4, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (5, 1, None)]
    data += [(6, 1, [1.0, None]), (7, 1, [inf, 0.0]), (8, 1, [float("nan"), 0.0]), (9, 3, [0.7]), (100, 3, [0.9]), (10, 4, [0.6]), (200, 1, []), (11, 1, []), (12, 2, []), (300, 1, [-3e5, 2e5]), (13, 1, [-2.5e5, 1e5]), (14, 9, [-1e5, 2e4]), (400, 8, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, None, None, "a") for r in data], SHAPE)
    got = Counter(rows(hard_negatives.mine(spark, df), "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    assert got == mined(data) and hard_negatives.mine(spark, df.limit(0)).count() == 0
    assert hard_negatives.mine(spark, df.where("vec_id = 0")).count() == 0
    long = [(0, 1, [8e6, 8e6]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 0.0])]  # longer than 2^31: takes no part
    assert hard_negatives.mine(spark, spark.createDataFrame([(*r, 1, "s", "a") for r in long], SHAPE)).count() == 0


def test_bounds_discard_early():
    """Most rows go before their integer products, and the rotation changes no result."""
    rng = np.random.default_rng(3)
    q = np.floor(256 * rng.normal(size=(4000, 32)) * 0.6 ** np.arange(32)).astype(np.int64)
    turn = np.linalg.eigh((q.T @ q).astype(float))[1][:, ::-1]
    a, x, of = hard_negatives.Turned(q[:20], turn), hard_negatives.Turned(q, turn), np.arange(20)
    seen = []
    real = np.einsum
    try:
        hard_negatives.np.einsum = lambda e, u, v: seen.append(len(u)) or real(e, u, v)
        qi, xi, score = hard_negatives.best(a, x, np.arange(4000), np.ones((20, 4000), bool), of, np.full(20, -(1 << 62)), np.full(20, 1 << 62), 5, hard_negatives.slack(turn))
    finally:
        hard_negatives.np.einsum = real
    whole = q[:20] @ q.T
    want = [np.lexsort((np.arange(4000), -whole[i]))[:5].tolist() for i in range(20)]
    assert [xi[qi == i].tolist() for i in range(20)] == want and seen[-1] < 0.01 * 20 * 4000 and (score == whole[qi, xi]).all()


# 12 collocations ------------------------------------------------------------------------------------------------


def collocated(docs, least, longest=5, top=2000):  # noqa: ANN001, ANN201
    n, f = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(plain.LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if a >= least and len(p) >= 2}
        gone = {d[i : i + k] for d, b in kept.items() for k in range(2, len(d)) for i in range(len(d) - k + 1) if b >= kept[d[i : i + k]]}
        scored = []
        for p, a in kept.items():
            if p not in gone:
                s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out |= {(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)}
    return out


@pytest.mark.parametrize(("least", "slots"), [(3, 64), (3, 0), (20, 64)])
def test_collocations(spark, docs, least, slots, monkeypatch):
    """Also with one bitmap of 4,096 bits for all phrases, whose crowded slots must not change a count."""
    monkeypatch.setattr(collocations, "SLOTS", slots or 64)
    monkeypatch.setattr(collocations, "MOST_SLOTS", 1 << 28 if slots else 1 << 12)
    some = docs.where("doc_id % 2 = 0").select("doc_id", "lang", "text")
    got = rows(collocations.mine(spark, some, least=least), "lang", "rank", "phrase", "a", "l", "r", "n", "score")
    want = collocated(rows(some, "lang", "text"), least)
    assert set(got) == want and len(got) == len(want) > 20


def test_collocations_odd(spark, weird, none):
    extra = [("aa aa aa aa\taa", "xx"), ("no. break,here;x", None), ("a\x00b c\x0bd  e\tf A\x00B C", "xx"), (" .,", "xx"), ("É é ÉÉ é", "und")] * 2
    df = weird.select("lang", "text", "n", "rank", "m").unionByName(spark.createDataFrame([(l, t, None, None, None) for t, l in extra], "lang string, text string, n string, rank string, m string"))
    for least, top in ((2, 2000), (1, 7)):
        got = rows(collocations.mine(spark, df, least=least, top=top), "lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert set(got) == collocated(rows(df, "lang", "text"), least, top=top) and len(set(got)) == len(got)
    assert collocations.mine(spark, none).count() == 0


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = [(10**15 + 7, 9 * 10**16 + 1, 10**15 + 9, 3 * 10**15), (5, 7, 5, 5), (10**17, 10**17, 10**17, 10**17)]
    df = spark.createDataFrame(big, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(collocations.score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in big]


# 13 online packing ----------------------------------------------------------------------------------------------


def plain_ids(path, texts, end):  # noqa: ANN001, ANN201
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


def check_windows(docs, out, capacity=4096, end=2):  # noqa: ANN001, ANN201
    """Every id of every row in exactly one piece, offsets gapless, and padding."""
    want = Counter()
    for (i, _), ids in zip(docs, plain_ids(online_packing.default_tokenizer(), [t for _, t in docs], end), strict=True):
        want[i, ids.tobytes()] += 1
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, tokens, seq, offset in out:
        by_doc[doc].append((start, length, crc, tokens))
        by_seq[seq].append((offset, length))
    for i in {i for i, _ in want}:
        texts = [(np.frombuffer(b, "<u4"), n) for (j, b), n in want.items() if j == i]
        left = Counter(by_doc[i])
        if sum(n for _, n in texts) == 1:  # a doc_id of its own: its pieces stand one after the other
            at = 0
            for start, length, crc, tokens in sorted(by_doc[i]):
                assert start == at and tokens == len(texts[0][0]) and crc == zlib.crc32(texts[0][0][start : start + length].tobytes())
                at += length
            assert at == len(texts[0][0])
        else:
            assert sum(length * n for (_, length, _, _), n in left.items()) == sum(len(x) * n for x, n in texts)
    fill = []
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        fill.append(at)
    assert max(fill, default=0) <= capacity
    return fill


def test_online_packing(spark, docs):
    some = docs.select("doc_id", "text").repartition(7, "doc_id")
    for fan in (64, 3):  # in one round, and in several
        fill = check_windows(rows(some, "doc_id", "text"), rows(online_packing.pack(spark, some, fan=fan), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
        assert all(n == 4096 or n & (n - 1) == 0 for n in fill) and sum(n < 4096 for n in fill) <= 12
    out = rows(online_packing.pack(spark, some), "doc_id", "doc_tokens")
    whole = [d for d, n in Counter(out).items() if n == 1 and d[1] <= 4096]
    assert len(whole) > 0.7 * len({d for d in out if d[1] <= 4096})  # few documents are cut


def test_online_packing_odd(spark, weird, none):
    out = rows(online_packing.pack(spark, weird, capacity=64, open_=2), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    fill = check_windows(rows(weird, "doc_id", "text"), out, 64)
    assert all(n & (n - 1) == 0 for n in fill) and online_packing.pack(spark, none).count() == 0


def test_word_encoder(docs):
    path = online_packing.default_tokenizer()
    texts = [t for (t,) in rows(docs, "text")][:120] + ["", None, " ", "\n", "a  b", " lead", "tail ", "<|endoftext|> x", "it's o'clock.", "x́ ́y", "ΣΑΣ ΌΣ.", "tab\tand nbsp em", "İI ı", "1,234.5 end...", "日本 語。", "a\r\nb", "\x00 z", "é. é,"]
    for most in (400_000, 10):
        enc = word_encoder.WordEncoder(path, most)
        for _ in range(2):
            flat, bounds = enc.encode(pa.array(texts), 2)
            for k, ids in enumerate(plain_ids(path, texts, 2)):
                assert flat[bounds[k] : bounds[k + 1]].tolist() == ids.tolist(), texts[k]
        part = pa.array(texts, pa.large_string()).slice(7, 50)
        flat, bounds = enc.encode(part, 2)
        assert [flat[a:z].tolist() for a, z in zip(bounds, bounds[1:], strict=False)] == [x.tolist() for x in plain_ids(path, texts[7:57], 2)]
    import public_tokenizers

    enc = word_encoder.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not enc.cuts and enc.encode(pa.array(["a b"]), 0)[0].tolist() == [*enc.tok.encode("a b").ids, 0]
