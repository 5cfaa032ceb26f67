"""Each operator against a plain version, and its defined results on odd tables."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import plain
from compare import difference
from pyspark.sql import functions as F

from tessera.llm import decontaminate, encoding, id_store, jaccard_join, language_id, line_dedup, lm_score, packing, pii, queries, secrets, vptree


def rows(df, *cols):  # noqa: ANN001, ANN201
    return [tuple(r) for r in df.select(*cols).collect()]


def count(items):  # noqa: ANN001, ANN201
    return Counter(map(tuple, items))


# 1 line dedup ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, sf, name):
    assert difference(spark, queries.queries()[name], queries.oracle_sql()[name], sf) == ""


def test_line_dedup_odd(spark, weird, none):
    out = line_dedup.drop_lines(spark, weird)
    assert out.columns[: len(weird.columns)] == weird.columns and line_dedup.drop_lines(spark, none).count() == 0
    con = duckdb.connect()
    documents = weird.select("doc_id", "text").toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.register("documents", documents)
    want = count(set(con.sql(f"select doc_id, n_lines, n_dropped, text from ({line_dedup.SQL})").fetchall()))
    assert count(set(rows(out, "doc_id", "n_lines", "n_dropped", "text"))) == want and out.count() == weird.count()
    by = {r.doc_id: r for r in out.collect()}
    assert [by[k].n_dropped for k in (11, 12, 13, 14, 15)] == [1, 1, 1, 1, 1]
    assert "sage" not in by[14].text and by[1].n_dropped == by[3].n_dropped == 0 and by[4].text is None


def test_line_dedup_blocks_and_mixed_leaves(spark, monkeypatch):
    """Headers of several lines, several templates in one leaf, hot lines; copies stay whole."""
    licence = "\n".join(f"Licence clause {w} applies to the whole work" for w in ("alpha", "beta", "gamma"))
    names = "ann bob cid dan eve fay gus hal ida jon kim leo".split()
    data = []
    for k, w in enumerate(names):
        own = "\n".join(f"{w} wrote {' '.join((w + c) * 2 for c in 'abcdefgh')} {x}" for x in "pqr")
        log = f"at once the user {w} logged in safely" if k % 2 else f"at once the host {w} went away again"
        data.append((k, f"{licence}\n{own}\n{log}\n{own}{w}"))
    whole = "\n".join(f"copied text line {c * 3} of a long document {c * 5}" for c in "abcdefghij")
    data += [(100 + k, whole + f"\nedit {'xyz'[k] * 4} here") for k in range(3)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    by = {r.doc_id: r for r in line_dedup.drop_lines(spark, df).collect()}
    assert all(by[k].n_dropped == 4 and "Licence" not in by[k].text and "at once" not in by[k].text and w in by[k].text for k, w in enumerate(names))
    assert all(by[100 + k].n_dropped == 0 for k in range(3))
    monkeypatch.setattr(line_dedup, "HOT_LINES", 2)
    assert count(rows(line_dedup.drop_lines(spark, df), "doc_id", "text")) == Counter((k, r.text) for k, r in by.items())


# 2 decontamination ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [100_000, 40])
def test_decontamination(spark, sf, docs, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id < 6")
    extra = spark.createDataFrame([(900, "Of the"), (901, None), (902, " .,"), (903, "of THE")], "item_id long, text string")
    bench = bench.unionByName(extra)
    some = docs.where("doc_id % 3 = 0")
    got = {r.doc_id: r for r in decontaminate.digest(decontaminate.find(spark, some, bench)).collect()}
    base = some.select("doc_id", "text").collect()
    for (i, _), (n, hit, items) in zip(base, plain.contamination([t for _, t in base], [tuple(x) for x in bench.collect()]), strict=True):
        assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (n, hit, len(items))
        assert got[i].items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest() and got[i].contaminated == (hit > 0)


def test_decontamination_odd(spark, weird, none):
    bench = spark.createDataFrame([(1, " ".join(f"Pas{i}sage" for i in range(12))), (2, "one two"), (None, "word"), (None, "alpha1 beta gamma")], "item_id long, text string")
    got = decontaminate.find(spark, weird, bench)
    want = plain.contamination([t for (t,) in rows(weird, "text")], [tuple(r) for r in bench.collect()])
    assert count((n, sum(s["last"] - s["first"] for s in spans), tuple(items)) for n, spans, items in rows(got, "n_words", "spans", "items")) == count((n, h, tuple(i)) for n, h, i in want)
    left = decontaminate.remove(spark, weird, bench)
    assert left.columns == weird.columns and left.where("doc_id = 8").first().text == "" and left.where("doc_id = 10").first().text.strip() == "" and left.where("doc_id = 4").first().text is None
    assert left.where("doc_id = 11").first().text == weird.where("doc_id = 11").first().text
    assert decontaminate.find(spark, none, bench).count() == 0 and decontaminate.digest(decontaminate.find(spark, weird, bench.limit(0))).where("contaminated").count() == 0


def test_decontamination_removes_alike_in_any_blocks(spark, sf, docs, none, weird, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    passage = bench.where("size(split(text, ' ')) > 30").first().text.rstrip(". ?!")
    planted = spark.createDataFrame([(-1, f"clean, before {passage} and é behind."), (-2, None), (-3, passage), (-3, passage)], "doc_id long, text string")
    some = docs.select("doc_id", "text").unionByName(planted)
    whole = count(rows(decontaminate.remove(spark, some, bench), "doc_id", "text"))
    odd = count(rows(decontaminate.remove(spark, weird, bench), *weird.columns))
    monkeypatch.setattr(decontaminate, "BLOCK", 40)
    left = decontaminate.remove(spark, some, bench)
    assert count(rows(left, "doc_id", "text")) == whole and {r.doc_id: r.text for r in left.collect()}[-1] == "clean, before  and é behind."
    out = decontaminate.remove(spark, weird, bench)
    assert out.columns == weird.columns and count(rows(out, *weird.columns)) == odd and decontaminate.remove(spark, none, bench).count() == 0


def test_fm_index_locates():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(0, 4, 3000), 0)
    index = decontaminate.FMIndex(text, 3)
    for _ in range(40):
        n = int(rng.integers(1, 6))
        phrase = rng.integers(1, 4, n)
        lo, hi = index.search(phrase[None], np.array([n]))
        want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == phrase).all()]
        assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


# 3 language -----------------------------------------------------------------------------------------------------


def test_language_held_out(spark, docs):
    out = language_id.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in out)
    assert sum(not r.accepted for r in out) <= 0.01 * len(out)


def test_language_odd(spark, weird, none, docs):
    got = {r.doc_id: r for r in language_id.identify(spark, weird).collect()}
    assert {got[k].lang_pred for k in (4, 5, 6, 20)} == {"und"} and got[4].score == 0 and not got[4].accepted
    assert got[1].lang_pred in ("en", "fr") and None in got
    assert language_id.identify(spark, none).count() == 0
    unlabelled = language_id.identify(spark, weird.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    models = language_id.fit(spark, docs)
    junk = spark.createDataFrame([(1, "zqxv jkwq xxzq vvkq qqzx " * 20)], "doc_id long, text string")
    assert not language_id.predict(spark, junk, models).first().accepted


def test_kneser_ney_sums_to_one():
    key, n = np.unique(language_id.grams(*language_id.symbols(["the cat sat on the mat and the rat"])[:2])[0], return_counts=True)
    m = language_id.Models({"a": (key, n)})
    letters = np.unique(key & np.uint64(0xFFFF))
    for context in (key[5] >> np.uint64(16), key[9] >> np.uint64(16)):
        p = np.exp(m.log_probs((context << np.uint64(16)) | letters)[:, 0].astype(float)).sum()
        assert p + math.exp(m.log_probs(np.array([(context << np.uint64(16)) | np.uint64(9999)]))[0, 0]) == pytest.approx(1, abs=1e-4)


def plain_kneser_ney(texts):  # noqa: ANN001, ANN201
    """Nats a character of a text for each language, by dictionaries: interpolated Kneser-Ney over characters."""
    import unicodedata

    order = language_id.ORDER

    def chars(t):  # noqa: ANN001, ANN202
        return " " * (order - 1) + " ".join("".join(c if unicodedata.category(c)[0] in "LM" else " " for c in t.lower()).split()) + " "

    def grams(t, n):  # noqa: ANN001, ANN202
        return [chars(t)[k - n + 1 : k + 1] for k in range(order - 1, len(chars(t)))]

    models = {}
    for lang in {x for x, _ in texts}:
        c = {order: Counter(g for x, t in texts if x == lang for g in grams(t, order))}
        for n in range(order - 1, 0, -1):
            c[n] = Counter(g[1:] for g in c[n + 1])
        models[lang] = c
    alphabet = len({g for c in models.values() for g in c[1]}) + 1

    def p(c, g):  # noqa: ANN001, ANN202
        n = len(g)
        if not n:
            return 1 / alphabet
        n1, n2 = (sum(x == k for x in c[n].values()) for k in (1, 2))
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
        same = [k for h, k in c[n].items() if h[:-1] == g[:-1]]
        return p(c, g[1:]) if not same else (max(c[n][g] - d, 0) + d * len(same) * p(c, g[1:])) / sum(same)

    return lambda t: {lang: -sum(math.log(p(c, g)) for g in grams(t, order)) / len(grams(t, order)) for lang, c in models.items()}


def test_kneser_ney_against_plain(docs):
    texts = [(r.lang, r.text[:300]) for r in docs.where("lang in ('en', 'fr') and length(text) > 200").limit(12).collect()]
    langs = sorted({x for x, _ in texts})
    counted = {x: np.unique(language_id.grams(*language_id.symbols([t for y, t in texts if y == x])[:2])[0], return_counts=True) for x in langs}
    plain_h = plain_kneser_ney(texts)
    asked = [texts[0][1][:60], "Zażółć gęślą jaźń, 123 the END", "a", "  the ,cat  ", "日本語"]
    got = language_id.Models(counted).cross_entropies(asked)[0]
    for k, t in enumerate(asked):
        assert list(got[k]) == pytest.approx([plain_h(t)[x] for x in langs], rel=1e-4), t


# 4 packing ------------------------------------------------------------------------------------------------------


def check_packing(df, got, capacity=2048):  # noqa: ANN001, ANN201
    tok = encoding.encoder(encoding.default_tokenizer()).tok
    want = Counter()
    for i, t in rows(df, "doc_id", "text"):
        ids, at = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for k, n in enumerate(packing.cut_lengths(len(ids), capacity)):
            want[(i, k, at, n, zlib.crc32(ids[at : at + n].tobytes()))] += 1
            at += n
    assert count(rows(got, "doc_id", "piece", "start", "length", "ids_crc32")) == want
    by: dict[int, list] = {}
    for s, o, n in rows(got, "sequence_id", "offset", "length"):
        by.setdefault(s, []).append((o, n))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= capacity
    return len(by)


def test_packing(spark, docs, weird, none):
    got = packing.pack(spark, docs).cache()
    assert check_packing(docs, got) <= math.ceil(got.agg(F.sum("length")).first()[0] / 2048) + 2
    check_packing(weird, packing.pack(spark, weird))
    assert packing.pack(spark, none).count() == 0


def test_fullest_against_all_subsets():
    rng = np.random.default_rng(2)
    for _ in range(60):
        items = rng.integers(1, 20, rng.integers(0, 9)).tolist()
        counts = np.bincount(items, minlength=41)
        room = int(rng.integers(0, 40))
        best = max((s for s in ({sum(x for k, x in enumerate(items) if b >> k & 1) for b in range(1 << len(items))}) if s <= room), default=0)
        chosen = packing.fullest(counts, room)
        assert sum(chosen) == best and not Counter(chosen) - Counter(items)


# 5 Jaccard ------------------------------------------------------------------------------------------------------


def test_jaccard(spark, docs):
    base = rows(docs, "doc_id", "text")
    assert count(rows(jaccard_join.join(spark, docs), "doc_id", "n_shingles", "component_id")) == count(plain.jaccard_components(base))


def test_jaccard_odd(spark, weird, none):
    assert count(rows(jaccard_join.join(spark, weird), "doc_id", "n_shingles", "component_id")) == count(plain.jaccard_components(rows(weird, "doc_id", "text")))
    assert jaccard_join.join(spark, none).count() == 0


def test_jaccard_chains_and_ties(spark):
    """A chain whose ends are far apart, and a group of copies that each differ from the first."""
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(12):
        chain = base.copy()
        chain[: 3 * k] = [f"c{j}" for j in range(3 * k)]
        texts.append(" ".join(chain))
    for k in range(30):
        copy = [f"v{i}" for i in range(120)]
        copy[4 * k % 120] = f"edit{k}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)) + [(100, texts[0]), (0, texts[20])], "doc_id long, text string")
    assert count(rows(jaccard_join.join(spark, df), "doc_id", "n_shingles", "component_id")) == count(plain.jaccard_components(rows(df, "doc_id", "text")))


# 6 secrets ------------------------------------------------------------------------------------------------------


def base_spans(t):  # noqa: ANN001, ANN201
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark, docs, weird, none):
    for df in (docs, weird):
        want = Counter()
        for i, t in rows(df, "doc_id", "text"):
            s = base_spans(t or "")
            want[(i, *[sum(k == j for _, k, _ in s) for j in range(3)], hashlib.sha256(",".join(x for *_, x in s).encode()).hexdigest())] += 1
        assert count(rows(secrets.digest(secrets.find(spark, df)), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")) == want
    assert secrets.find(spark, none).count() == 0


def test_secrets_nested():
    plain_ = 'password = "hunter2abc"'
    b64 = base64.b64encode(plain_.encode()).decode()
    packed = base64.b64encode(gzip.compress(plain_.encode())).decode()
    twice = base64.b64encode(packed.encode()).decode()
    for text, kind in ((f"a {b64} z", "base64>assign"), (f"a {packed} z", "base64>deflate>assign"), (f"a {twice} z", "base64>base64>deflate>assign"), ("a pass%77ord=hunter22 z", "url>assign"), ("a \\u0070assword=hunter22 z", "unicode>assign"), ("a &#112;assword=hunter22 z", "unicode>assign"), (f"a {b64.replace('=', '%3D')} z", "base64>assign")):
        spans, _, _ = secrets.scan(text)
        found = [s for s in spans if s["kind"] == kind]
        assert found and 2 <= found[0]["start"] < found[0]["end"] <= len(text) - 2, text
    assert secrets.scan("%2525252541 %41")[1] >= 1


def test_secrets_in_every_place():
    b64 = base64.b64encode(b'password = "hunter2abc"').decode()
    for part, kind in ((b64, "base64>assign"), (base64.b64encode(gzip.compress(b"password = hunter2abc")).decode(), "base64>deflate>assign"), ("\npass%77ord=hunter22\n", "url>assign"), ("\n\\u0070assword=hunter22\n", "unicode>assign")):
        spans, layers, _ = secrets.scan(f"a {part} b {part} c")
        assert len([s for s in spans if s["kind"] == kind]) == 2 == layers, part
    levels = "%" + "25" * 30 + "41 &" + "#38;" * 30 + "#65; " * 2
    assert secrets.scan(levels)[1] < 5000


@pytest.mark.parametrize("lead", ["filler line é\n" * 330_000, "x" + "é" * 2_200_000 + ",", "ab" * 2_200_000 + " "])
def test_secrets_behind_four_megabytes(lead):
    inner = base64.b64encode(b"token = abcdefgh12").decode()
    packed = base64.b64encode(gzip.compress(f"{lead}password = hunter2abc\n{inner}\n".encode())).decode()
    assert len(lead.encode()) > 4 << 20
    spans, layers, cut = secrets.scan(f"a {packed} z")
    assert {"base64>deflate>assign", "base64>deflate>base64>assign"} <= {s["kind"] for s in spans} and layers == 2 and cut == 0
    assert {(s["start"], s["end"]) for s in spans} == {(2, 2 + len(packed))}


def test_secrets_layers_of_all_kinds():
    secret = b"password = hunter2abc"
    gz, z = gzip.compress(b"first member, nothing here\n") + gzip.compress(secret), zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = z.compress(secret + b" and some more text, and more of it") + z.flush()
    b64 = lambda x: base64.b64encode(x).decode()
    mime = base64.encodebytes(b"a long preface of plain words " * 4 + secret + b" and an end of it").decode()
    for text, kind in (
        (b64(gz), "base64>deflate>assign"), (b64(raw), "base64>deflate>assign"), (mime, "base64>assign"), (mime.replace("\n", "\r\n  "), "base64>assign"),
        (b64(b"\xff\xfe" + secret + b"\x80"), "base64>assign"), (b64(bytes(range(32)) + secret), "base64>assign"), ("path/x" + b64(secret), "base64>assign"), (b64(b"token=abcdef"), "base64>assign"),
        (b64(gzip.compress(bytes(range(256)) * 40 + b"\n" + secret + b"\n")), "base64>deflate>assign"),
    ):
        found = [s for s in secrets.scan(f"see ({text}) there")[0] if s["kind"] == kind]
        assert found and found[0]["secret"].strip() in ("hunter2abc", "abcdef") and 5 <= found[0]["start"] < found[0]["end"] <= len(text) + 5, text
    cut = b64(gzip.compress(secret + b"\n" + bytes(np.random.default_rng(0).integers(0, 256, 3000, np.uint8)))[:-900])
    assert secrets.scan(f"a {cut} z")[2] == 1


def test_secrets_spans_against_plain():
    """Added spans of escapes and base64 against decoding by hand: the span covers the written form of the match, no more."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        value = "".join(rng.choice(list("abcdefghij0123456789"), 12))
        match = f"token={value}"
        lead, tail = "," + "".join(rng.choice(list("xyz é,"), rng.integers(0, 30))) + ",", ",end"
        k = int(rng.integers(0, len(match)))
        text = lead + match[:k] + f"%{ord(match[k]):02x}" + match[k + 1 :] + tail
        spans = [s for s in secrets.scan(text)[0] if s["kind"] == "url>assign"]
        assert [(s["start"], s["end"]) for s in spans] == [(len(lead), len(text) - len(tail))]
        pre = "p" * int(rng.integers(0, 7))
        coded = base64.b64encode((pre + "," + match + ",z").encode()).decode()
        (got,) = [s for s in secrets.scan(lead + coded + tail)[0] if s["kind"] == "base64>assign"]
        n = len(pre) + 1
        assert (got["start"], got["end"]) == (len(lead) + n * 4 // 3, len(lead) + -(-(n + len(match)) * 4 // 3))


def test_secrets_many_in_one_run():
    """n escaped secrets in one run give n spans, each of its own characters."""
    parts = ["password=hunter22", "token=abcdefgh1", "secret=qwertyui", "api_key=0123456789"]
    percent = lambda t: "".join(f"%{b:02X}" for b in t.encode())
    units = lambda t: "".join(f"\\u{int.from_bytes(t.encode('utf-16-be')[i : i + 2]):04x}" for i in range(0, len(t.encode("utf-16-be")), 2))
    for coded, kind, size in ((percent, "url>assign", lambda t: 3 * len(t.encode())), (units, "unicode>assign", lambda t: 3 * len(t.encode("utf-16-be")))):
        for gap in (" ", " é€😀 ", "\n"):
            text, at, want = ">", 1, []
            for p in parts:
                want.append((at, at + size(p), p.split("=")[1]))
                text += coded(p + gap)
                at += size(p + gap)
            spans = [(x["start"], x["end"], x["secret"]) for x in secrets.scan(text)[0] if not x["base"]]
            assert spans == want and {x["kind"] for x in secrets.scan(text)[0] if not x["base"]} == {kind}
    for broken in ("%E2%82", "%FF", "%E2%82%E2%82%AC", "%F0%80", "%E9%41"):
        got = list(secrets._unpercent(broken + "%41"))
        assert "".join(c for c, *_ in got)[-1] == "A" and got[0][1] == 0 and all(a[2] == b[1] for a, b in zip(got, got[1:], strict=False)) and got[-1][2] == len(broken) + 3
    packed = base64.b64encode(zlib.compress(" ".join(parts[1:2] * 3 + parts[:1]).encode())).decode()
    inside = [x["secret"] for x in secrets.scan(packed)[0]]
    assert inside == ["abcdefgh1"] * 3 + ["hunter22"]


def test_secrets_layers_that_stand_oddly():
    """UTF-16, short lines, line ends written as escapes, values behind each other, streams behind each other, other methods."""
    import bz2
    import lzma
    import textwrap

    secret = "password = hunter2abc"
    b64 = lambda x: base64.b64encode(x).decode()
    one = b64(f"here is {secret} and more words to wrap".encode())
    cases = [
        (b64(secret.encode("utf-16")), "base64>assign"), (b64(secret.encode("utf-16-be")), "base64>assign"), (b64("é ".encode("utf-16-le") + secret.encode("utf-16-le")), "base64>assign"),
        *[("\n".join(textwrap.wrap(one, w)), "base64>assign") for w in (4, 8, 15, 76)], ("\\n".join(textwrap.wrap(one, 20)), "base64>assign"), ("\\r\\n".join(textwrap.wrap(one, 12)), "base64>assign"), ("begin\n" + "\n".join(textwrap.wrap(one, 10)), "base64>assign"),
        *[(b64(b"another plain value of some text"[:n]).rstrip("=") + "//" + one, "base64>assign") for n in (30, 31, 32)], (b64(zlib.compress(b"nothing in the first one")[:]+ zlib.compress(secret.encode())), "base64>deflate>assign"), (b64(gzip.compress(b"first") + zlib.compress(b"second") + bz2.compress(secret.encode())), "base64>deflate>assign"),
        (b64(bz2.compress(secret.encode())), "base64>bz2>assign"), (b64(lzma.compress(secret.encode())), "base64>xz>assign"),
    ]
    for text, kind in cases:
        found = [x for x in secrets.scan(f"<{text}>")[0] if x["kind"] == kind]
        assert [x["secret"] for x in found] == ["hunter2abc"], (text, kind, found)
        assert 1 <= found[0]["start"] < found[0]["end"] <= len(text) + 1


def test_secrets_long_line_is_bounded():
    import resource

    text = "word, " * 2_000_000 + "pass%77ord=hunter22"
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    spans, _, _ = secrets.scan(text)
    assert [(s["kind"], s["start"], s["end"]) for s in spans] == [("url>assign", 12_000_000, len(text))]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000


# 7 language model -----------------------------------------------------------------------------------------------


def test_lm_scores(spark, docs, weird, none):
    for df in (docs, weird):
        got = rows(lm_score.score(spark, df), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        tokens = [(i, [*plain.spaced(t), None]) for i, t in rows(df, "doc_id", "text")]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        c = Counter(w for i, ws in tokens if i is not None and not held(i) for w in ws)
        n, v = sum(c.values()), len(c)
        want = Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for i, ws in tokens)
        assert Counter((*r[:5], round(r[5], 4)) for r in got) == want and all(r[6] < 0 for r in got)
    assert lm_score.score(spark, none).count() == 0


def plain_tree(texts):  # noqa: ANN001, ANN201
    """log10 of a symbol behind a context, by dictionaries and recursion."""
    depth, c, n = lm_score.DEPTH, Counter(), Counter()
    coded = lambda t: (" ".join(plain.spaced(t)) + "\n").encode()
    for t in texts:
        s = b"\n" * depth + coded(t)
        for k in range(depth, len(s)):
            for d in range(depth + 1):
                c[s[k - d : k + 1]] += 1
                n[s[k - d : k]] += 1
    total, following = n[b""], {}
    for g, k in c.items():
        following.setdefault(g[:-1], {})[g[-1]] = k
    states = {x for x in n if 0 < len(x) <= lm_score.SHORT and n[x] >= lm_score.MIN_CONTEXT}
    for x in n:
        if len(x) > lm_score.SHORT and n[x] >= lm_score.MIN_CONTEXT:
            gain = sum(k * math.log((k / n[x]) / (c[x[1:] + bytes([b])] / n[x[1:]])) for b, k in following[x].items())
            if gain >= lm_score.DIVERGENCE:
                states |= {x[i:] for i in range(len(x) - lm_score.SHORT)}

    def p(x, b):  # noqa: ANN001, ANN202
        if not x:
            return (c[bytes([b])] + 0.5) / (total + 128)
        if x not in states:
            return p(x[1:], b)
        said = {y: k for y, k in following[x].items() if k >= lm_score.MIN_PAIR}
        weight = lm_score.PRIOR + n[x] - sum(said.values())
        return (said.get(b, 0) + weight * p(x[1:], b)) / (sum(said.values()) + weight)

    def score(t):  # noqa: ANN001, ANN202
        s = b"\n" * depth + coded(t)
        return sum(math.log10(p(s[k - depth : k], s[k])) for k in range(depth, len(s)))

    return p, score


def test_suffix_tree_against_plain(spark, docs, monkeypatch):
    """Every score against the plain tree, whether n-grams are in the broadcast or joined, in one chunk or many."""
    some = docs.where("length(text) < 1500").limit(60)
    base = rows(some, "doc_id", "text")
    p, score = plain_tree([t for i, t in base if zlib.crc32(str(i).encode()) % 5 != 1])
    for x in (b"\n", b" the", b"tion ", b"e", b"zzz"):
        assert sum(p(x, b) for b in range(256)) == pytest.approx(1, abs=1e-9)
    want = {i: score(t) for i, t in base}
    for common, grown in ((lm_score.COMMON, lm_score.GROWN), (300, 50)):
        monkeypatch.setattr(lm_score, "COMMON", common)
        monkeypatch.setattr(lm_score, "GROWN", grown)
        assert dict(rows(lm_score.score(spark, some), "doc_id", "score")) == pytest.approx(want, rel=1e-9)


# 8 id store -----------------------------------------------------------------------------------------------------


def test_id_store(spark, docs, weird, none, tmp_path):
    tok = encoding.encoder(encoding.default_tokenizer()).tok
    for df in (docs, weird):
        got = sorted(rows(id_store.round_trip(spark, df), "doc_id", "start", "n_tokens", "ids_crc32"), key=lambda r: (r[1], r[2]))
        ids = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in rows(df, "doc_id", "text")]
        assert Counter((i, n, c) for i, _, n, c in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
        assert [g[1] for g in got] == np.cumsum([0, *[g[2] for g in got]])[:-1].tolist()
        assert [g[0] for g in got] == sorted((i for i, _ in ids), key=lambda x: (x is not None, x or 0))
    assert id_store.round_trip(spark, none).count() == 0
    path = str(tmp_path / "store")
    id_store.write_store(spark, docs, path)
    one = docs.orderBy("doc_id").first()
    assert id_store.read_ids(spark, path, [one.doc_id]).first().ids == [*tok.encode(one.text, add_special_tokens=False).ids, 2]
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.select(F.sum(F.length("addresses") / 16)).first()[0] == chunks.select(F.explode(F.expr("transform(sequence(0, cast(length(addresses) / 16 as int) - 1), i -> substring(addresses, i * 16 + 1, 16))"))).distinct().count()
    spoiled = str(tmp_path / "spoiled")
    chunks.withColumn("addresses", F.concat(F.lit(b"\0"), F.expr("substring(addresses, 2)"))).write.parquet(f"{spoiled}/chunks")
    for t in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{t}").write.parquet(f"{spoiled}/{t}")
    with pytest.raises(Exception, match="does not match its address"):
        id_store.read_digest(spark, spoiled).collect()
    recipes = spark.read.parquet(f"{path}/recipes")
    last = recipes.agg(F.max("nth")).first()[0]
    for k, (wrong, told) in enumerate([
        (recipes.where("doc_id % 2 = 0"), "do not follow"), (recipes.where(f"nth < {last}"), "does not match the recipes"), (recipes.where("nth > 0"), "does not match the recipes"),
        (recipes.withColumn("start", F.lit(7).cast("long")), "do not follow"), (recipes.withColumn("doc_id", F.col("doc_id") + 1), "does not match the recipes"),
        (recipes.withColumn("start", F.col("start") + 5), "does not match the recipes"), (recipes.where("false"), "does not match the recipes"),
    ]):
        bad = str(tmp_path / f"bad{k}")
        wrong.write.parquet(f"{bad}/recipes")
        for t in ("chunks", "manifest"):
            spark.read.parquet(f"{path}/{t}").write.parquet(f"{bad}/{t}")
        with pytest.raises(Exception, match=told):
            id_store.read_digest(spark, bad).collect()


TRICKY = [
    "Plain words, and stops?! Words again.\nA line: é ünï 日本語. naïve; naïve, naïve", "it's we'll 's x's a1b2 12 3.4 ... .a a. (a) _b_ ÀÉ. Ωmega: \u00a0nb\u00a0sp", " lead", "trail ", "two  spaces", "tab\tin a\ttab", "", None, "\n", "a\n\nb", "\x01mark",
    "x" * 31 + " " + "x" * 32 + " " + "x" * 33 + ". " + "y" * 5000, "nul\0in nul nul\0in. nul.", "<|endoftext|> end<|endoftext|>of text", "Ġ Ġa aĠ Ġ. ĊB", "e\u0301 cafe\u0301. \u200bzero \ufeffbom", "A\nB\nC. D\nA. B\nÄ, B", "word. word, word; word: word! word? word",
]


@pytest.mark.parametrize("most", [450_000, 7, 0])
def test_encoder_gives_the_librarys_ids(docs, monkeypatch, most):
    """Whatever is remembered, also under one hash for all pieces; a slice of a column, and words met before."""
    texts = [*TRICKY, *(r.text for r in docs.limit(60).collect())]
    for mix in (encoding.mix, np.zeros_like):
        monkeypatch.setattr(encoding, "mix", mix)
        enc = encoding.Encoder(encoding.default_tokenizer(), most)
        want = [np.array([*enc.tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
        for lo, hi in ((0, len(texts)), (3, 30), (0, 0), (0, len(texts))):
            flat, bounds = enc.encode(pa.array(texts, pa.string()).slice(lo, hi - lo), 2)
            assert flat.tolist() == [i for w in want[lo:hi] for i in w.tolist()]
            assert bounds.tolist() == np.cumsum([0, *map(len, want[lo:hi])]).tolist()


def test_encoder_remembers_few_bytes_and_asks_once():
    """Long pieces don't stay, and what is known is not encoded again: no word goes to the library twice."""
    enc = encoding.Encoder(encoding.default_tokenizer())
    enc.encode(pa.array([" ".join(f"{i}" + "z" * 4000 for i in range(200))]), 2)
    assert enc.known.ids.nbytes < 10_000
    column = pa.array(["some words, and some more words. and words"] * 50)
    first = enc.encode(column, 2)[0]
    enc.tok = enc.bare = None  # a call would fail
    assert enc.encode(column, 2)[0].tolist() == first.tolist()


def test_encoder_with_a_tokenizer_that_merges_across_spaces(tmp_path):
    """Without the splitter's pattern a token may hold a space, and without a line end nothing marks a line; texts are then encoded whole."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    for pattern, more in ((True, {"Ċ": 5}), (True, {}), (False, {"Ċ": 5})):
        tok = Tokenizer(models.BPE({"a": 0, "Ġ": 1, "b": 2, "aĠ": 3, "aĠb": 4} | more, [("a", "Ġ"), ("aĠ", "b")]))
        tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=pattern)
        tok.save(path := str(tmp_path / f"{pattern}.json"))
        texts = ["a b a b", "b a b", "aa bb a\nb a b"]
        assert encoding.Encoder(path).encode(pa.array(texts), 9)[0].tolist() == [i for t in texts for i in [*tok.encode(t).ids, 9]]


def test_id_store_small_nodes_and_hot_chunks(spark, docs, monkeypatch):
    """Many levels of the manifest, every chunk a hot one, many buckets, numbers as texts."""
    want = count(rows(id_store.round_trip(spark, docs), "doc_id", "start", "n_tokens", "ids_crc32"))
    monkeypatch.setattr(id_store, "FANOUT_BITS", 2)
    monkeypatch.setattr(id_store, "HOT_USES", 1)
    monkeypatch.setattr(id_store, "BUCKET_BYTES", 1 << 13)
    assert count(rows(id_store.round_trip(spark, docs), "doc_id", "start", "n_tokens", "ids_crc32")) == want
    numbers = spark.createDataFrame([("2", 17), ("1", None)], "doc_id string, text int")
    assert [r[0] for r in rows(id_store.round_trip(spark, numbers).orderBy("start"), "doc_id")] == [1, 2]


# 9 personal data ------------------------------------------------------------------------------------------------


def test_pii(spark, docs, weird, none):
    found = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])|(?<![0-9])[0-9]{16}(?![0-9])|\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}")
    before = {r.doc_id: r.text for r in docs.collect()}
    out = pii.replace(spark, docs.select("doc_id", "text"), "k").collect()
    pairs: dict[str, str] = {}
    for r in out:
        old = found.findall(before[r.doc_id])
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(old)
        assert old or r.text == before[r.doc_id]
        for a, b in zip(old, found.findall(r.text), strict=True):
            assert a != b and pairs.setdefault(a, b) == b and len(a) == len(b)
    assert len(set(pairs.values())) == len(pairs) and not set(pairs) & set(pairs.values())
    odd = pii.replace(spark, weird, "k")
    assert odd.columns[: len(weird.columns)] == weird.columns and odd.count() == weird.count() and pii.replace(spark, none, "k").count() == 0
    by = {r.doc_id: r for r in odd.collect()}
    assert by[4].text is None and by[5].text == "" and re.fullmatch(r"mail [a-z]\.[a-z]@[a-z]\.[a-z]{7}\.com call \+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4} from 10(\.[0-9]{1,3}){3} card 4[0-9]{3}( [0-9]{4}){3}", by[17].text)


def surrogate_text(spark, *texts):  # noqa: ANN001, ANN201
    out = {r.doc_id: r for r in pii.replace(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    return [out[k] for k in range(len(texts))]


def ends(word, kind):  # noqa: ANN001, ANN201
    return word.lower().endswith(tuple(pii.ENDINGS[kind]))


def test_pii_names(spark):
    first, second, card, greek, other = surrogate_text(
        spark,
        "Mrs. Anna Smith met Mr Smith and Dr. Karl Weber; г-н Иван Петров. " + " ".join(f"Mr Family{chr(97 + i)}{chr(97 + j)}x." for i in range(8) for j in range(8)),
        "г-жа Анна Петрова и г-н Петров. Потом Петрова ушла, а Петров остался. Петровы нет.",
        "4111111111111111 and 4111111111111112",
        "Mr Γιώργος Παπαδάκης, Mrs Παπαδάκη. Mr Smith came. John Smith left, Smithson and SMITH stayed; Smith@home.example.org too.",
        "Dr Karl Weber, Mr. Karl Weber",
    )
    names = re.findall(r"Mr ([A-Z][a-z]+)", first.text)
    assert len(names) == 65 == len(set(names)) and first.n_person == 68
    head = re.match(r"Mrs\. (\S+) (\S+) met Mr (\S+) and Dr\. (\S+) (\S+); г-н (\S+) (\S+)\.", first.text)
    assert ends(head[1], "latin f") and head[2] == head[3] and ends(head[4], "latin m") and ends(head[6], "cyrillic m") and ends(head[7], "cyrillic family")
    her, name, his = re.match(r"г-жа (\S+) (\S+) и г-н (\S+)\.", second.text).groups()
    assert name == his + "а" and his == head[7] and ends(her, "cyrillic f") and second.text.endswith(f"Потом {name} ушла, а {his} остался. Петровы нет.") and second.n_bare == 2
    sums = [sum(sum(divmod(int(c) * (2 if k % 2 == 0 else 1), 10)) for k, c in enumerate(n)) % 10 for n in card.text.split(" and ")]
    assert sums == [0, 1] and card.n_card == 2
    g = re.match(r"Mr (\S+) (\S+), Mrs (\S+)\. Mr (\S+) came\. John (\S+) left, Smithson and SMITH stayed; (\S+)@", greek.text)
    assert ends(g[1], "greek m") and ends(g[2], "greek family") and g[3] == g[2][:-1] and g[4] == g[5] == head[3] and g[6] != "Smith"
    a, b = re.match(r"Dr (\S+ \S+), Mr\. (\S+ \S+)", other.text).groups()
    assert a == b


def test_pii_against_plain(spark, docs):
    """Mentions found by another engine, texts between them unchanged, one surrogate for each entity and none shared."""
    import regex

    pattern = regex.compile(pii.ANY)
    before = {r.doc_id: r.text or "" for r in docs.collect()}
    word, pairs = regex.compile(f"{pii.ANY}|{pii.WORD}"), {}
    for r in pii.replace(spark, docs.select("doc_id", "text"), "k").collect():
        old = [m[0] for m in pattern.finditer(before[r.doc_id])]
        assert r.n_email + r.n_ip + r.n_phone + r.n_card + r.n_ssn + r.n_person == len(old) and all(re.search(pii.HINT, m) for m in old)
        gaps = (word if r.n_person else pattern).split(before[r.doc_id])[:: 2]
        at = 0
        for g in gaps:
            assert (at := (r.text or "").find(g, at)) >= 0
            at += len(g)
        new = [m[0] for m in pattern.finditer(r.text or "")]
        for x, y in zip(old, new, strict=True):
            assert pairs.setdefault(x, y) == y != x
    flat = lambda x: x.lower() if "@" in x or x[0].isalpha() else re.sub("[^0-9+.]", "", x)
    assert len({flat(x) for x in pairs}) == len({flat(y) for y in pairs.values()}) and not {flat(x) for x in pairs} & {flat(y) for y in pairs.values()}


def test_pii_many_names_and_crowded_formats(spark):
    names = spark.range(50_000).select(F.lit("cyrillic family").alias("kind"), F.concat(F.lit("фам"), F.col("id").cast("string")).alias("norm"))
    ips = spark.range(700).select(F.lit("ip").alias("kind"), F.concat_ws(".", F.lit("10"), (F.col("id") % 9 + 1).cast("string"), (F.floor(F.col("id") / 9) % 9 + 1).cast("string"), (F.floor(F.col("id") / 81)).cast("string")).alias("norm"))
    mails = spark.range(26).select(F.lit("email").alias("kind"), F.concat(F.char(F.col("id") + 97), F.lit("@x.yz")).alias("norm"))
    ssn = spark.range(3000).select(F.lit("ssn").alias("kind"), F.lpad((F.col("id") * 7919).cast("string"), 9, "0").alias("norm"))
    entities = names.unionByName(ips).unionByName(mails).unionByName(ssn)
    got = [tuple(r) for r in pii.surrogates(spark, entities, "k").collect()]
    assert len(got) == 53_726 == len({(k, n) for k, n, _ in got}) == len({(k, s.lower()) for k, _, s in got})
    assert all(s.endswith(tuple(pii.ENDINGS[k])) and re.fullmatch("[А-Я][а-я]+", s) for k, _, s in got if k == "cyrillic family")
    assert all(re.fullmatch(r"10\.[0-9]\.[0-9]\.[0-9]", s) for k, _, s in got if k == "ip")
    known = {(k, n) for k, n, _ in got}
    assert not {(k, s) for k, _, s in got if k != "ip"} & known


def test_pii_every_title_alone(spark):
    titles = pii.MALE + pii.FEMALE + pii.OTHER
    texts = [(k, f"Yesterday {t} Quux spoke.") for k, t in enumerate(titles)]
    out = {r.doc_id: r for r in pii.replace(spark, spark.createDataFrame(texts, "doc_id long, text string"), "k").collect()}
    assert [t for k, t in enumerate(titles) if out[k].n_person != 1 or "Quux" in out[k].text or f"Yesterday {t} " not in out[k].text] == []


def test_pii_styles_written_by_hand(spark):
    """Twenty mentions in each of ten styles, listed without the module's patterns: none of their personal parts is left, what stands around them is."""
    first = "Alex John Mary Peter Linda Omar Ines Yusuf Karin Pavel Greta Hans Luis Nadia Erik Rosa Tom Vera Igor Lena".split()
    last = "Moore Smith Miller Jansen Garcia Weber Rossi Petrov Novak Dubois Larsen Costa Meyer Brown Clark Lopez Silva Adams Baker Young".split()
    styles = [
        lambda k: (f"Mr. {first[k][0]}. {last[k]}", [f"{first[k][0]}.", last[k]]), lambda k: (f"Mrs. O'{last[k]}", [last[k]]), lambda k: (f"Dr. Mc{last[k]}", [last[k]]), lambda k: (f"Herr van der {last[k]}", [last[k]]), lambda k: (f"MR. {last[k].upper()}", [last[k].upper()]),
        lambda k: (f"Mr {first[k]} {first[-1 - k]} {last[k]}", [first[k], first[-1 - k], last[k]]), lambda k: (f"jos\u00e9.{first[k].lower()}{k}@example.com", [first[k].lower(), "example"]), lambda k: (f"{555 + k}.{123 + k}.{4567 + k}", [str(4567 + k), f"{123 + k}.{4567 + k}"]),
        lambda k: (f"020 {7946 + k} {'%04d' % (958 + k)}", [f"{7946 + k} "]), lambda k: (f"2001:db8:{k:x}a1::{k + 0x8a2e:x}:7334", [f"{k + 0x8a2e:x}", "7334"]),
    ]
    texts, wants = [], []
    for n, style in enumerate(styles):
        for k in range(20):
            mention, parts = style(k)
            texts.append(f"On day {n} we met {mention} there, and later left.")
            wants.append(parts)
    assert len(texts) == 200
    out = surrogate_text(spark, *texts)
    missed = [(t, r.text) for t, r, parts in zip(texts, out, wants, strict=True) if any(p in r.text.split("we met")[1] for p in parts) or not re.fullmatch(r"On day [0-9] we met .+ there, and later left\.", r.text)]
    assert missed == []
    assert all(sum((r.n_email, r.n_ip, r.n_phone, r.n_card, r.n_ssn, r.n_person)) == 1 for r in out)


def test_pii_cards_addresses_and_clean_texts(spark):
    amex, diners, wrong, v6, clean, caps, dotted = surrogate_text(
        spark, "card 3782 822463 10005 and 378282246310005.", "30569309025904 or 4222222222222", "3782 822463 10006 is none, nor is 4222222222223", "from 2001:DB8::1:2 and fe80:0:0:0:1:2:3:4 at 12:34:56, std::vector, a::b, 00:1a:2b:3c:4d:5e",
        "On 01-02-2003 and 2003.04.05 at 10.5.2 we paid 0.123 456; version 1.2.3, id 1234567890123, O'Brien's bar, MR is a code. Van der Berg sings, 12:30:45.", "MR. SMITH LEFT. MRS. ANNA O'NEIL CAME.", "01 23 45 67 89, 0171/1234567, 030 123456",
    )
    a, b = re.fullmatch(r"card (3\d{3} \d{6} \d{5}) and (3\d{14})\.", amex.text).groups()
    assert a.replace(" ", "") == b != "378282246310005" and amex.n_card == 2 and diners.n_card == 2
    assert wrong.text.startswith("3782 822463 10006") and wrong.n_card == 0 and "4222222222223" in wrong.text
    got = re.fullmatch(r"from ([0-9A-F]{4}:[0-9A-F]{3}::\d:\d) and ([a-f]{2}\d\d(?::\d){7}) at 12:34:56, std::vector, a::b, 00:1a:2b:3c:4d:5e", v6.text)
    assert got and v6.n_ip == 2 and got[1] != "2001:DB8::1:2"
    assert clean.text.startswith("On 01-02-2003 and 2003.04.05") and "Van der Berg" in clean.text and clean.n_person + clean.n_phone + clean.n_card == 0
    assert re.fullmatch(r"MR\. [A-Z]+ LEFT\. MRS\. [A-Z]+ [A-Z]+ CAME\.", caps.text) and not re.search("SMITH|ANNA|NEIL", caps.text) and caps.n_person == 2
    assert dotted.n_phone == 3 and "1234567" not in dotted.text


def test_pii_one_surrogate_in_the_corpus(spark):
    """Whatever the title; a name met as a man's and a woman's has one for each."""
    a, b, c, d, e, f = surrogate_text(spark, "Dr. Alex Moore met.", "Mr Alex Moore met.", "PROF. MOORE met. Mr A. Moore met.", "Ms Kim Stone met.", "Mr Kim Stone met. Mr Kim Stone", "Dr Kim Stone met.")
    assert a.text.split()[1:3] == b.text.split()[1:3] and a.text.split()[2].upper() in c.text and a.text.split()[2] in c.text
    woman, man, doctor = d.text.split()[1], e.text.split()[1], f.text.split()[1]
    assert woman != man == doctor and ends(woman, "latin f") and ends(man, "latin m") and d.text.split()[2] == f.text.split()[2]


def test_clashing_result_and_helper_names(spark):
    """A user's columns keep their names and values, whatever helpers and results are called."""
    names = ["n_lines", "n_dropped", "_doc", "_drop", "_map", "_kinds", "_named", "n_email", "N_Person"]
    data = [(k, f"same line of text here\nown words {chr(97 + k) * 3} of this one and more\nMr Smith {k}", *[f"mine{k}"] * len(names)) for k in range(4)]
    df = spark.createDataFrame(data, ["doc_id", "text", *names])
    for out in (line_dedup.drop_lines(spark, df), pii.replace(spark, df, "k")):
        assert out.columns[: len(df.columns)] == df.columns and len({c.lower() for c in out.columns}) == len(out.columns)
        assert all(r[n] == f"mine{r.doc_id}" for r in out.collect() for n in names)
    assert {r["n_dropped_"] for r in line_dedup.drop_lines(spark, df).collect()} == {2}


# 10 nearest neighbours ------------------------------------------------------------------------------------------


def nearest_plain(data, k=5):  # noqa: ANN001, ANN201
    ids, v = np.array([i for i, _ in data]), np.array([x for _, x in data], float)
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = vptree.cosine(np.broadcast_to(v[q], v.shape), v)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[ids[q]] = [(ids[j], s[j]) for j in order]
    return out


def test_nearest_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = nearest_plain([(r.vec_id, r.embedding) for r in e.collect()])
    for factor, least in ((1.0, 1.0), (vptree.FACTOR, 0.9)):
        trees = vptree.index(spark, e, shard=150)
        got: dict[int, list] = {}
        for q, _, i, s in sorted(rows(vptree.search(spark, trees, e.where("vec_id % 50 = 0"), factor=factor), "query_id", "rank", "vec_id", "score")):
            got.setdefault(q, []).append((i, s))
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
        assert hits >= least * sum(map(len, want.values())) and set(got) == set(want)
        assert factor > 1 or all(got[q] == w for q, w in want.items())


def test_nearest_odd(spark):
    nan = float("nan")
    data = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (50, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [1.0, None]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (100, [0.0, 0.0]), (10, [-1.0, 1e-30])]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, shard string")
    got = sorted(rows(vptree.nearest(spark, df, factor=1.0), "query_id", "rank", "vec_id", "score"))
    assert [g[:3] for g in got if g[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 50), (0, 5, 10)] and {g[0] for g in got} == {0, 50}
    many = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    assert [g[1] for g in sorted(rows(vptree.nearest(spark, many), "query_id", "vec_id")) if g[0] == 0] == [1, 2, 3, 4, 5]
    assert vptree.nearest(spark, df.limit(0)).count() == 0


def test_nearest_ties(spark):
    """Parallel vectors of different lengths, and more points at one distance than are kept."""
    parallel = [(i, [3.0 * 2.0**-i, 4.0 * 2.0**-i, 0.0]) for i in range(40)]
    around = [(50 + i, [0.0, 0.0, 1.0] if i == 0 else [math.cos(i), math.sin(i), 0.0]) for i in range(1, 300)]
    hot = [(1000 + i, [float(j == i % 60) for j in range(60)]) for i in range(400)]
    for data in (parallel, [(0, [0.0, 0.0, 1.0]), *around], hot):
        df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
        want = nearest_plain(data)
        for shard in (vptree.SHARD, 50):
            trees = vptree.index(spark, df, shard=shard)
            got: dict[int, list] = {}
            for q, _, i, s in sorted(rows(vptree.search(spark, trees, df.where("vec_id % 50 = 0"), factor=1.0), "query_id", "rank", "vec_id", "score")):
                got.setdefault(q, []).append((i, s))
            assert got == want
