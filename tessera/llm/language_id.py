"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 per language is fitted on a bounded sample of labelled
documents (`sample_docs` a language, a documented parameter, chosen by a hash of
doc_id). Counting runs as a Spark aggregation. The models of all languages lie
side by side in arrays sorted by a 64-bit hash of the n-gram: for each order the
interpolated log probabilities of every n-gram that any language has, and each
context's back-off weights. A text goes to the language with the lowest
cross-entropy per character; a quarter of the sample, kept out of the counts,
calibrates the cross-entropy above which a text is rejected.

Characters are lower-cased letters and marks; all else is one space. Letters
above U+FFFF are folded to 16 bits.

Defined results: a null text, or one without a letter, is `und` with score 0 and
not accepted; with no labelled rows everything is `und`; repeated rows give
repeated results; an empty table gives no rows; ties go to the smaller language
name; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, pick, short_batches, slices

ORDER, SAMPLE_DOCS = 4, 2000
#: Text bytes that a worker scores at once; each takes about 120 bytes of arrays.
SLICE = 1 << 20
#: Rejection: the calibration quantile, what is added to it, and the allowance for short texts (nats a character).
QUANTILE, MARGIN, SHORT = 0.999, 1.0, 6.0
U64 = np.uint64


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its 16-bit symbol (space for what is no letter or mark), and whether it is a letter."""
    import unicodedata

    symbol, letter = np.full(0x110000, 32, np.uint16), np.zeros(0x110000, bool)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LM":
            symbol[cp] = cp if cp < 0x10000 else 0x8000 | (cp & 0x7FFF)
            letter[cp] = kind == "L"
    return symbol, letter


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts end to end, each text led by ORDER - 1 spaces and closed by one; its bounds; its letters."""
    symbol, letter = _classes()
    points = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    letters = np.array([int(letter[p].sum()) for p in points])
    parts, size = [], []
    for p in points:
        s = symbol[p]
        space = s == 32
        if len(s):
            s = s[~(space & np.r_[True, space[:-1]])]
        parts += [np.full(ORDER - 1, 32, np.uint16), s]
        closed = len(s) and s[-1] == 32
        if not closed:
            parts.append(np.full(1, 32, np.uint16))
        size.append(ORDER - 1 + len(s) + (not closed))
    return np.concatenate(parts).astype(U64), np.cumsum([0, *size]), letters


def grams(s: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-grams (16 bits a symbol) that end on each symbol behind the leading spaces, and each text's bounds."""
    key = np.zeros(len(s), U64)
    for k in range(ORDER):
        key[k:] |= s[: len(s) - k] << U64(16 * k)
    keep = np.ones(len(s), bool)
    for k in range(ORDER - 1):
        keep[bounds[:-1] + k] = False
    n = np.diff(bounds) - (ORDER - 1)
    return key[keep], np.concatenate([[0], np.cumsum(n)])


class Models:
    """Kneser-Ney models of all languages in sorted hash arrays."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """counts: per language, distinct ORDER-grams and how often each occurs."""
        self.langs = sorted(counts)
        k = len(self.langs)
        masks = {n: U64((1 << (16 * n)) - 1) for n in range(1, ORDER)}
        self.keys: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.back: list[np.ndarray] = []
        per: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in range(1, ORDER + 1)}
        for lang in self.langs:
            key, c = counts[lang]
            per[ORDER].append((key, c.astype(np.float64)))
            for n in range(ORDER - 1, 0, -1):
                # Continuation counts: how many different symbols stand before the shorter n-gram.
                longer = per[n + 1][-1][0]
                short, seen = np.unique(longer & masks[n], return_counts=True)
                per[n].append((short, seen.astype(np.float64)))
        alphabet = len(np.unique(np.concatenate([x[0] for x in per[1]]))) + 1 if k else 1
        self.floor = np.full(k, -np.log(alphabet))
        lower_keys, lower_p = None, None
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([x[0] for x in per[n]])) if k else np.zeros(0, U64)
            ctx = np.unique(keys >> U64(16)) if n > 1 else np.zeros(min(1, len(keys)), U64)
            p, back = np.zeros((len(keys), k)), np.ones((len(ctx), k))
            for j, (own, c) in enumerate(per[n]):
                n1, n2 = (c == 1).sum(), (c == 2).sum()
                d = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
                at = np.searchsorted(ctx, own >> U64(16) if n > 1 else np.zeros(len(own), U64))
                total, types = np.bincount(at, c, len(ctx)), np.bincount(at, minlength=len(ctx))
                back[:, j] = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
                p[np.searchsorted(keys, own), j] = (c - d) / total[at]
            under = np.exp(self.floor) if lower_p is None else lower_p[np.searchsorted(lower_keys, keys & masks[n - 1])]
            p += back[np.searchsorted(ctx, keys >> U64(16) if n > 1 else np.zeros(len(keys), U64))] * under
            lower_keys, lower_p = keys, p
            by, cby = np.argsort(h := mix(keys)), np.argsort(g := mix(ctx))
            self.keys.append(h[by])
            self.logp.append(np.log(p[by]).astype(np.float32))
            self.contexts.append(g[cby])
            self.back.append(np.log(back[cby]).astype(np.float32))
        self.limits = np.full(k, np.inf)

    @staticmethod
    def _at(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
        return at, keys[at] == want

    def log_probs(self, key: np.ndarray) -> np.ndarray:
        """Natural log probability of each ORDER-gram's last symbol, one column per language."""
        out = np.zeros((len(key), len(self.langs)), np.float32)
        live = np.arange(len(key))
        for n in range(ORDER, 0, -1):
            own = key[live] & U64((1 << (16 * n)) - 1) if n < ORDER else key[live]
            at, ok = self._at(self.keys[n - 1], mix(own))
            out[live[ok]] += self.logp[n - 1][at[ok]]
            live, own = live[~ok], own[~ok]
            if not len(live):
                return out
            at, ok = self._at(self.contexts[n - 1], mix(own >> U64(16) if n > 1 else np.zeros(len(own), U64)))
            out[live[ok]] += self.back[n - 1][at[ok]]
        out[live] += self.floor.astype(np.float32)
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats a character for each text and language, the characters, and the letters."""
        s, bounds, letters = symbols(texts)
        key, at = grams(s, bounds)
        total = np.add.reduceat(self.log_probs(key).astype(np.float64), at[:-1], axis=0)
        n = np.diff(at)
        return -total / n[:, None], n, letters


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled documents whose crc32(doc_id as text) mod 4 is not 2."""
    return docs.where("lang is not null and doc_id is not null and text is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def fit(spark: SparkSession, docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Models:
    """Learn from text and lang of about sample_docs training rows a language."""
    rows = training_rows(pick(docs, doc_id="doc_id", text="text", lang="lang"))
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return Models({})
    share = F.lit(0)
    for lang, n in totals.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 20, int(sample_docs / n * (1 << 20)) + 1))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 20))
    sample = rows.where(draw < share).withColumn("calibrates", F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(4)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            texts = b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                key, _ = grams(*symbols([texts[i] for i in np.flatnonzero(langs == lang)])[:2])
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = sample.where("not calibrates").select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow().to_pandas()  # bounded by the sample
    counts = {}
    for lang, part in got.groupby("lang"):
        key = part["gram"].to_numpy().view(U64)
        order = np.argsort(key)
        counts[lang] = (key[order], part["n"].to_numpy()[order])
    models = Models(counts)
    if models.langs:
        _calibrate(spark, models, sample.where("calibrates").select("lang", "text"))
    return models


def _calibrate(spark: SparkSession, models: Models, rows: DataFrame) -> None:
    """Set each language's limit from the cross-entropies of calibration texts that are long enough to be stable."""
    shared = spark.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            h, n, _ = shared.value.cross_entropies(b.column("text").to_pylist())
            at = {x: i for i, x in enumerate(shared.value.langs)}
            own = [at.get(x) for x in b.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([None if j is None else float(h[i, j]) for i, j in enumerate(own)], pa.float64()), pa.array(n, pa.int64())], names=["lang", "h", "n"])

    for r in rows.mapInArrow(measure, "lang string, h double, n long").where("n >= 100 and h is not null").groupBy("lang").agg(F.percentile("h", F.lit(QUANTILE)).alias("q")).collect():
        models.limits[models.langs.index(r.lang)] = r.q + MARGIN


def predict(spark: SparkSession, docs: DataFrame, models: Models, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """lang_pred, score, cross_entropy, accepted (behind prefix) beside the columns in keep (by default doc_id)."""
    keep = keep or ["doc_id"]
    held = "text" if "text" in keep and dict(docs.dtypes)["text"] == "string" else "_text"  # the text crosses to Python once
    new = [prefix + c for c in ("lang_pred", "score", "cross_entropy", "accepted")]
    shared = spark.sparkContext.broadcast(models)
    short_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, held, SLICE):
            texts = [t or "" for t in b.column(held).to_pylist()]
            n = len(texts)
            pred, score, bits, fine = ["und"] * n, np.zeros(n), np.zeros(n), np.zeros(n, bool)
            if m.langs:
                h, size, letters = m.cross_entropies(texts)
                best = h.argmin(axis=1)
                low = h[np.arange(n), best]
                # Evidence grows with length up to 200 characters, beyond which characters repeat themselves.
                odds = np.exp(-(h - low[:, None]) * np.minimum(size, 200)[:, None])
                known = letters > 0
                pred = [m.langs[j] if k else "und" for j, k in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, 1 / odds.sum(axis=1), 0.0)
                bits = np.where(known, low / np.log(2), 0.0)
                fine = known & (low <= m.limits[best] + SHORT / np.sqrt(size))
            cols = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score), pa.array(bits), pa.array(fine)], names=[*keep, *new])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *([F.col("text").cast("string").alias("_text")] if held == "_text" else []))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema)
    return rows.mapInArrow(run, f"{fields}, {new[0]} string, {new[1]} double, {new[2]} double, {new[3]} boolean")


def identify(spark: SparkSession, docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, accepted of every document."""
    out = predict(spark, pick(docs, doc_id="doc_id", text="text"), fit(spark, docs, sample_docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
