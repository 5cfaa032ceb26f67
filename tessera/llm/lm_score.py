"""Language-model scoring by a probabilistic suffix tree.

Symbols are the bytes of the normalised text: A-Z lowered, words with one space
between, and a line end behind the last word, so a sequence of tokens has one
symbol sequence and the model's probabilities of all sequences add up to 1.
Every n-gram of up to `DEPTH` + 1 symbols of every training text is counted by a
Spark aggregation. A context of more than `SHORT` symbols becomes a state of the tree when
it was met `MIN_CONTEXT` times and its next-symbol distribution diverges from its
parent's by `DIVERGENCE` nats in the log likelihood ratio (or a descendant's
does); shorter ones only need the count. Next-symbol probabilities are smoothed towards
the parent's down to the root's. A text is scored symbol by symbol in the state of the
longest suffix.

The counts are absolute, so the tree grows with the corpus. It is never held in one
place: the short contexts (a table of at most 256 ** 3 counters, whatever the corpus)
are broadcast, and the branches behind each three symbols, of which all contexts up to
`DEPTH` and their children number 256 ** 3 at most, are grown where Spark's shuffle brings
them together. What results is a table with the probability of every distinct n-gram. The most
frequent `COMMON` of them are looked up in a broadcast of that bound; the others meet
their probabilities in a join, as rare tokens meet their counts for the unigram base score.

Defined results: a null text is empty, its only token is the end; a row without a
doc_id is scored, never learned from, and held_out is false; with nothing to learn
from, base_score and score are those of empty counts; repeated rows count each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, byte_table, pick, shared_table, short_batches, slices, split_words, text_bytes

DEPTH, SHORT, MIN_CONTEXT, MIN_PAIR, DIVERGENCE, PRIOR = 5, 2, 8, 2, 3.0, 8.0
#: Tokens and n-grams in a broadcast, each (16 bytes apiece), and n-grams that a task grows branches of at once.
COMMON, GROWN = 1 << 20, 1 << 20
END = 10
#: The hash that stands for the end token (no word hash is built from no bytes).
END_TOKEN = U64(0x9E3779B97F4A7C15)


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with each text's bounds, and normalised symbols with each text's bounds."""
    starts, ends, hashes, first = split_words(data, offs, "space")
    lower, word = byte_table("space")
    lens, per_doc = ends - starts, np.diff(first)
    empty = per_doc == 0
    owner = np.repeat(np.arange(len(per_doc)), per_doc)
    before = np.arange(len(starts)) + (np.cumsum(empty) - empty)[owner]
    sizes = np.bincount(owner, lens, len(per_doc)).astype(np.int64) + np.maximum(per_doc, 1)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(bounds[-1], 32, np.uint8)
    body = lower[data[word[data]]]
    out[np.arange(len(body)) + np.repeat(before, lens)] = body
    out[bounds[1:] - 1] = END
    return hashes, first, out, bounds


def grams(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each symbol the DEPTH symbols before it (line ends before the text) and itself, a byte each."""
    docs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(len(s)) + DEPTH * (docs + 1)
    padded = np.full(len(s) + DEPTH * (len(bounds) - 1), END, np.uint8)
    padded[at] = s
    key = np.zeros(len(padded), U64)
    for k in range(DEPTH + 1):
        key[k:] |= padded[: len(padded) - k].astype(U64) << U64(8 * k)
    return key[at]


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *(np.bincount(at, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in (1, 2))


def counts(rows: DataFrame) -> DataFrame:
    """(kind, key, n, uses): tokens (kind 0) and n-grams (kind 1) with their number in the rows to learn from; uses counts n-grams in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])

        def out() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                if held[kind]:
                    cols = _merged(held[kind])
                    held[kind].clear()
                    for lo in range(0, len(cols[0]), 100_000):
                        k, n, uses = (c[lo : lo + 100_000] for c in cols)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n), pa.array(uses)], names=["kind", "key", "n", "uses"])

        size = 0
        for b in slices(batches):
            for learn in (True, False):
                part = b.filter(b.column("learn") if learn else pc.invert(b.column("learn")))
                if not part.num_rows:
                    continue
                hashes, _, s, bounds = symbols(*text_bytes(part.column("text")))
                if learn:
                    k, n = np.unique(np.concatenate([hashes, np.full(part.num_rows, END_TOKEN)]), return_counts=True)
                    held[0].append((k, n, n))
                k, n = np.unique(grams(s, bounds), return_counts=True)
                held[1].append((k, n if learn else np.zeros_like(n), n))
                size += len(s)
            if size > 96 << 20:  # bounds what a task holds
                yield from out()
                size = 0
        yield from out()

    return rows.select("learn", "text").mapInArrow(run, "kind int, key long, n long, uses long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))


def _low(key: np.ndarray, symbols_: int) -> np.ndarray:
    return key & U64((1 << (8 * symbols_)) - 1)


def rolled(key: np.ndarray, n: np.ndarray, depths: range) -> tuple[dict, dict]:
    """Per depth the pairs (context of d symbols + next symbol) and the contexts of n-grams, with their counts; keys ascending."""

    def summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, at = np.unique(keys, return_inverse=True)
        return u, np.bincount(at, n, len(u))

    return {d: summed(_low(key, d + 1)) for d in depths}, {d: summed(_low(key >> U64(8), d)) for d in depths}


class Tree:
    """States by depth, with the log10 probability of explicit next symbols and the log10 weight of the step to the parent.

    The first tree holds the root and the short contexts; one that continues another holds branches behind them.
    """

    def __init__(self, pairs: dict[int, tuple[np.ndarray, np.ndarray]], contexts: dict[int, tuple[np.ndarray, np.ndarray]], below: Tree | None = None) -> None:
        self.below, self.raw = below, (pairs, contexts)
        self.first, self.last = min(pairs), max(pairs)
        self.states, self.step, self.pairs, self.logp = {}, {}, {}, {}
        if below is None:
            root = np.full(256, 0.5)
            root[pairs[0][0].astype(np.int64)] += pairs[0][1]
            self.root, self.first = np.log10(root / root.sum()), 1
        keep = self._states()
        for d in range(self.first, self.last + 1):
            ctx, n = contexts[d][0][keep[d]], contexts[d][1][keep[d]]
            key, c = pairs[d]
            at, ok = self._find(ctx, key >> U64(8))
            ok &= c >= MIN_PAIR
            key, c, at = key[ok], c[ok], at[ok]
            said = np.bincount(at, c, len(ctx))
            weight = PRIOR + n - said  # what has no explicit pair follows the parent
            p = (c + weight[at] * 10.0 ** self.log10(_low(key, d), d - 1)) / (said + weight)[at]
            self.states[d], self.step[d] = ctx, np.log10(weight / (said + weight))
            self.pairs[d], self.logp[d] = key, np.log10(p)

    @staticmethod
    def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return at, keys[at] == want

    def _counted(self, d: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        pairs, contexts = self.raw if d in self.raw[0] else self.below.raw
        return pairs[d], contexts[d]

    def _states(self) -> dict[int, np.ndarray]:
        contexts = self.raw[1]
        keep = {d: contexts[d][1] >= MIN_CONTEXT for d in range(self.first, self.last + 1)}
        if self.below is None:
            return keep
        for d in keep:
            ((key, c), (ctx, n)), ((key_up, c_up), (ctx_up, n_up)) = self._counted(d), self._counted(d - 1)
            at, up = self._find(ctx, key >> U64(8))[0], _low(key, d)
            # Every pair has its context and its parent: all are rolled from the same n-grams.
            here, above = c / n[at], c_up[self._find(key_up, up)[0]] / n_up[self._find(ctx_up, up >> U64(8))[0]]
            keep[d] &= np.bincount(at, c * np.log(here / above), len(ctx)) >= DIVERGENCE
        for d in range(self.last, self.first, -1):  # a state's suffixes are states
            at, _ = self._find(contexts[d - 1][0], _low(contexts[d][0][keep[d]], d - 1))
            keep[d - 1][at] = True
        return keep

    def log10(self, key: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """log10 of each n-gram's last symbol in the state of the longest suffix of the symbols before it."""
        out, live = np.zeros(len(key)), np.arange(len(key))
        for d in range(min(depth, max(self.states, default=0)), self.first - 1, -1):
            own = _low(key[live], d + 1)
            at, ok = self._find(self.pairs[d], own)
            out[live[ok]] += self.logp[d][at[ok]]
            live, own = live[~ok], own[~ok]
            at, ok = self._find(self.states[d], own >> U64(8))
            out[live[ok]] += self.step[d][at[ok]]
        out[live] += self.root[_low(key[live], 1).astype(np.int64)] if self.below is None else self.below.log10(key[live], self.first - 1)
        return out


def short_tree(key: np.ndarray, n: np.ndarray) -> Tree:
    """The root and the contexts of up to SHORT symbols."""
    return Tree(*rolled(key, n, range(SHORT + 1)))


def branch_scores(key: np.ndarray, n: np.ndarray, below: Tree) -> np.ndarray:
    """log10 of each distinct n-gram's last symbol; all n-grams behind the same SHORT + 1 symbols are here or none."""
    learned = n > 0
    return Tree(*rolled(key[learned], n[learned], range(SHORT + 1, DEPTH + 1)), below).log10(key)


def fit(spark: SparkSession, counted: DataFrame) -> DataFrame:
    """(key, logp, uses): the tree's log10 probability of every distinct n-gram."""
    grams_ = counted.where("kind = 1")
    low = F.lit((1 << (8 * (SHORT + 1))) - 1).cast("long")
    short = grams_.where("n > 0").groupBy(F.col("key").bitwiseAND(low).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # at most 256 ** 3 rows
    below = spark.sparkContext.broadcast(short_tree(short.column("key").to_numpy().view(U64), short.column("n").to_numpy()))
    near = F.shiftrightunsigned("key", 8).bitwiseAND(low)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key = table.column("key").to_numpy().view(U64)
            logp = branch_scores(key, table.column("n").to_numpy(), below.value)
            yield from pa.table({"key": table.column("key"), "logp": logp, "uses": table.column("uses")}).combine_chunks().to_batches(max_chunksize=100_000)

        held = None
        for b in batches:
            one = pa.Table.from_batches([b])
            held = one if held is None else pa.concat_tables([held, one])
            if held.num_rows >= GROWN:
                last = held.column("near").to_numpy()
                cut = int(np.searchsorted(last, last[-1]))  # whole branches only
                if cut:
                    yield from scored(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from scored(held)

    return grams_.select("key", "n", "uses", near.alias("near")).repartition("near").sortWithinPartitions("near").mapInArrow(grow, "key long, logp double, uses long")


def _frequent(table: DataFrame, count: str) -> int:
    """The least count that leaves at most COMMON rows at or above it; counts that differ number under sqrt(2 n)."""
    least, have = 1 << 62, 0
    for r in table.groupBy(F.col(count).alias("c")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("c")).toLocalIterator():
        if have + r.rows > COMMON:
            break
        least, have = r.c, have + r.rows
    return least


def _lookup(table: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their values."""
    got = table.toArrow()
    key, v = got.column("key").to_numpy().view(U64), got.column(value).to_numpy()
    order = np.argsort(key)
    return key[order], v[order]


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    short_batches(spark)
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    counted = shared_table(spark, counts(rows.withColumn("learn", F.coalesce(rest != 1, F.lit(False)))), "lm-counts")
    model = shared_table(spark, fit(spark, counted), "lm-model")
    tokens = counted.where("kind = 0").select("key", F.col("n").alias("c"))
    sums = tokens.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = sums.n or 0, sums.v or 0
    least, least_gram = _frequent(tokens, "c"), _frequent(model, "uses")
    shared = spark.sparkContext.broadcast((_lookup(tokens.where(F.col("c") >= least), "c"), _lookup(model.where(F.col("uses") >= least_gram), "logp")))
    denominator = np.log10(n_all + 0.5 * (v_all + 1)) if n_all else np.log10(0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (words, times), (known_grams, logp) = shared.value
        base = TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "gram", "key", "tf"]

        def rare(gram: bool, row: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
            (row, key), tf = _pairs(row, key)
            for lo in range(0, len(tf), 100_000):
                part = slice(lo, lo + 100_000)
                m = len(tf[part])
                long, double = pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(row[part]), long, long, long, double, double, pa.array(np.full(m, gram)), pa.array(key[part].view(np.int64)), pa.array(tf[part])], names=names)

        for b in slices(batches):
            hashes, first, s, bounds = symbols(*text_bytes(b.column("text")))
            row = base + np.arange(b.num_rows)
            base += b.num_rows
            owner = np.repeat(np.arange(b.num_rows), np.diff(bounds))
            seen, at = np.unique(grams(s, bounds), return_inverse=True)
            place, ok = Tree._find(known_grams, seen)
            part = np.where(ok, logp[place], 0.0) if len(logp) else np.zeros(len(seen))
            total = np.bincount(owner, part[at], b.num_rows)
            if not ok.all():
                lost = ~ok[at]
                yield from rare(True, row[owner[lost]], seen[at[lost]])
            # The end token stands behind each text's words.
            docs_ = np.concatenate([np.repeat(np.arange(b.num_rows), np.diff(first)), np.arange(b.num_rows)])
            seen, at = np.unique(np.concatenate([hashes, np.full(b.num_rows, END_TOKEN)]), return_inverse=True)
            place, ok = Tree._find(words, seen)
            count = np.where(ok, times[place], 0) if len(times) else np.zeros(len(seen), np.int64)
            part = np.where(ok, np.log10(count + 0.5) - denominator, 0.0)
            have_ = np.bincount(docs_, part[at], b.num_rows)
            known = np.bincount(docs_, ok[at], b.num_rows).astype(np.int64)
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(row), b.column("doc_id"), pa.array(np.diff(first) + 1), pa.array(known), pa.array(have_), pa.array(total), pa.nulls(b.num_rows, pa.bool_()), none, none], names=names)
            if not ok.all():
                lost = ~ok[at]
                yield from rare(False, row[docs_[lost]], seen[at[lost]])

    scored = shared_table(spark, rows.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, gram boolean, key long, tf long"), "lm-scores")
    whole, left = scored.where("n_tokens is not null").drop("gram", "key", "tf"), scored.where("tf is not null").select("row", "gram", "key", "tf")
    met = left.where("not gram").join(tokens.where(F.col("c") < least), "key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    base = F.col("tf") * (F.log10(F.col("c") + 0.5) - F.lit(float(denominator)))
    met = met.select("row", base.alias("base"), F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("known"), F.lit(0.0).alias("more"))
    deep = left.where("gram").join(model.where(F.col("uses") < least_gram), "key").select("row", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), (F.col("tf") * F.col("logp")).alias("more"))
    more = met.unionByName(deep).groupBy("row").agg(F.sum("base").alias("base"), F.sum("known").alias("known"), F.sum("more").alias("more"))
    out = whole.join(more, "row", "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    return out.select(
        "doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def _pairs(row: np.ndarray, key: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct (row, key) pairs and how often each occurs."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
    return (row[new], key[new]), np.diff(np.r_[new, len(row)])
