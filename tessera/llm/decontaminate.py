"""Benchmark decontamination with an FM-index over each training shard.

A shard is a run of whole documents of about `SHARD_BYTES`. Its text is the
sequence of words, coded by the phrases' vocabulary; a word outside it, and the
end of a document, is a separator that no phrase can cross. The index holds the
Burrows-Wheeler transform in a wavelet matrix with ranked bit vectors, the symbol
starts, and sampled suffix positions. All phrases walk backwards together,
matching intervals give rows, rows walk to the next sampled position, and the
located word ranges are checked byte by byte and merged into removal spans.

The phrases are a stated query set. They are taken in blocks of at most about
`BLOCK` windows, each block is one broadcast of bounded size and one pass.

Defined results: null or word-less texts have no words and no hits; a null or
word-less item has no windows; an item with a null item_id hits words like any other, but has
no name to count or list (n_items and items leave it out); repeated rows give repeated results; empty tables
give no rows (documents) or no hits (benchmark); extra columns are ignored; very
long texts form a shard of their own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, shared_table, short_batches, slices, split_words, text_bytes

WINDOW, SHARD_BYTES, BLOCK, SAMPLE = 10, 2 << 20, 100_000, 16
FOUND = "row long, doc_id long, n_words long, spans array<struct<first:long,last:long,start:long,end:long>>, items array<string>"


class Bits:
    """A bit vector with constant-time rank: 64-bit words and their running counts."""

    def __init__(self, bits: np.ndarray) -> None:
        raw = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(raw)] = raw
        self.ahead = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.ahead[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = at >> 6
        return self.ahead[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """A wavelet matrix: rank and access of integer symbols below 2 ** bits."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels, self.zeros = [], []
        for k in range(bits - 1, -1, -1):
            on = (symbols >> k) & 1 == 1
            self.levels.append(Bits(on))
            symbols = np.concatenate([low := symbols[~on], symbols[on]])
            self.zeros.append(len(low))
        self.bits = bits

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a prefix of length `at` ends among the symbol's occurrences on the last level."""
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.rank(at)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its place on the last level."""
        symbol = np.zeros(len(at), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            on, ones = level.get(at), level.rank(at)
            at = np.where(on, zeros + ones, at - ones)
            symbol = symbol * 2 + on
        return symbol, at


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """The suffix array of codes, where every 0 is a symbol of its own, ordered by place (so suffixes differ)."""
    n = len(codes)
    width = max(1, n.bit_length())
    per = 62 // width
    zero = codes == 0
    first = np.where(zero, np.cumsum(zero) - 1, zero.sum() + codes.astype(np.int64) - 1)
    _, rank = np.unique(first, return_inverse=True)  # dense, below n
    rank = rank.astype(np.int64)

    def keys(at: np.ndarray, step: int) -> np.ndarray:
        key = rank[at]
        for k in range(1, per):
            nxt = at + k * step
            key = (key << width) | np.where(nxt < n, rank[np.minimum(nxt, n - 1)], 0)
        return key

    key = keys(np.arange(n), 1)
    order = np.argsort(key, kind="stable")
    new = np.r_[True, np.diff(key[order]) != 0]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # a group's rank is the place of its first suffix
    step = per
    while True:
        alone = new & np.r_[new[1:], True]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order
        at = order[open_]
        key = keys(at, step)
        sub = np.argsort(key, kind="stable")  # groups stay in place: a key begins with the group's rank
        order[open_] = at[sub]
        key = key[sub]
        fresh = np.r_[True, np.diff(key) != 0]
        new[open_] |= fresh
        head = open_[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        rank[order[open_]] = head
        step *= per


class FMIndex:
    """Backward search and location over one shard's codes (0 separates)."""

    def __init__(self, codes: np.ndarray, top: int) -> None:
        order = suffix_order(codes)
        before = codes[order - 1]
        self.wavelet = Wavelet(before.astype(np.int64), max(1, top.bit_length()))
        counts = np.bincount(codes, minlength=top + 2)
        self.first = np.cumsum(counts) - counts
        symbols = np.arange(top + 1)
        self.origin = self.wavelet.down(symbols, np.zeros(top + 1, np.int64))
        # Rows that the walk cannot leave (a separator stands before them) are sampled too.
        keep = (order % SAMPLE == 0) | (before == 0)
        self.sampled, self.places, self.size = Bits(keep), order[keep], len(codes)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of phrases laid out right-aligned in a matrix of codes."""
        n = len(phrases)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        for step in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= step) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, -step]
            base = self.first[c] - self.origin[c]
            lo[live] = base + self.wavelet.down(c, lo[live])
            hi[live] = base + self.wavelet.down(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk to a sampled row, then add the steps taken."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled.get(at[live])
            ready = live[done]
            out[ready] = self.places[self.sampled.rank(at[ready])] + steps[ready]
            live = live[~done]
            if len(live):
                c, down = self.wavelet.access(at[live])
                at[live] = self.first[c] + down - self.origin[c]
                steps[live] += 1
        return out


class Phrases:
    """One block of distinct windows: sorted word hashes, code matrix, lengths, bytes and the items of each."""

    def __init__(self, rows: list, width: int) -> None:
        windows = [r["words"] for r in rows]
        self.items = [sorted(r["items"]) for r in rows]
        self.text = [" ".join(w).encode() for w in windows]
        words = sorted({w for ws in windows for w in ws})
        raw = [w.encode() for w in words]
        data = np.frombuffer(b" ".join(raw), np.uint8)
        _, _, hashes, _ = split_words(data, np.array([0, len(data)]), "alnum")
        by_hash = np.argsort(hashes)
        self.hashes = hashes[by_hash]
        code = dict(zip([words[i] for i in by_hash], range(1, len(words) + 1), strict=True))
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.codes = np.zeros((len(windows), width), np.int64)
        for i, w in enumerate(windows):
            self.codes[i, width - len(w) :] = [code[x] for x in w]

    def code(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        # A small direct table by the hash's top bits spares most of the binary search.
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)


def windows_of(benchmark: DataFrame, width: int) -> DataFrame:
    """Distinct windows (arrays of lower-cased words) with the item_ids that hold them."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lowered, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    items = pick(benchmark, item_id="item_id", text="text").select(F.col("item_id").cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))
    windows = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("words"))
    return windows.groupBy("words").agg(F.collect_set("item").alias("items"))


def _merge(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Unite word ranges [first, last) that touch."""
    order = np.argsort(first, kind="stable")
    out: list[list[int]] = []
    for a, z in zip(first[order].tolist(), last[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def scan_shard(column: pa.Array, phrases: Phrases) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
    """Index one shard, search every phrase, and give each document its word count, spans and items."""
    data, offs = text_bytes(column)
    starts, ends, hashes, first = split_words(data, offs, "alnum")
    docs = len(column)
    counts = np.diff(first)
    codes = phrases.code(hashes)
    owner = np.repeat(np.arange(docs), counts)
    text = np.zeros(len(codes) + docs, np.int64)
    text[np.arange(len(codes)) + owner] = codes
    found: dict[int, list[np.ndarray]] = {}
    items: dict[int, set[str]] = {}
    if codes.any() and len(phrases.lengths):
        index = FMIndex(text, len(phrases.hashes))
        lo, hi = index.search(phrases.codes, phrases.lengths)
        hit = np.flatnonzero(lo < hi)
        if len(hit):
            which = np.repeat(hit, hi[hit] - lo[hit])
            rows = np.arange(len(which)) - np.repeat(np.cumsum(hi[hit] - lo[hit]) - (hi[hit] - lo[hit]), hi[hit] - lo[hit]) + np.repeat(lo[hit], hi[hit] - lo[hit])
            place = index.locate(rows)
            doc = np.searchsorted(first + np.arange(docs + 1), place, "right") - 1
            word = place - doc  # separators before it: one for each document
            low = bytes(data).translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
            for w, d, a in zip(which.tolist(), doc.tolist(), word.tolist(), strict=True):
                n = int(phrases.lengths[w])
                if b" ".join(low[s:e] for s, e in zip(starts[a : a + n].tolist(), ends[a : a + n].tolist(), strict=True)) == phrases.text[w]:
                    found.setdefault(d, []).append((a - int(first[d]), a - int(first[d]) + n))
                    items.setdefault(d, set()).update(phrases.items[w])
    spans = []
    for d in range(docs):
        got = found.get(d)
        if not got:
            spans.append([])
            continue
        pairs, base = np.array(got), int(first[d])
        body = bytes(data[offs[d] : offs[d + 1]])
        cut = lambda k: len(body[: k - int(offs[d])].decode())  # noqa: E731  code points before a byte
        spans.append([{"first": a, "last": z, "start": cut(int(starts[base + a])), "end": cut(int(ends[base + z - 1]))} for a, z in _merge(pairs[:, 0], pairs[:, 1])])
    return counts, spans, [sorted(items.get(d, ())) for d in range(docs)]


def _found(batch: pa.RecordBatch, phrases: Phrases) -> pa.RecordBatch:
    counts, spans, items = scan_shard(batch.column("text"), phrases)
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")]))
    return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], names=["row", "doc_id", "n_words", "spans", "items"])


def _cut(text: str | None, spans: list[dict]) -> str | None:
    """text without its spans, which are in order and apart."""
    if not spans:
        return text
    at = [0, *(c["end"] for c in spans)]
    return "".join(text[a:z] for a, z in zip(at, [*(c["start"] for c in spans), None], strict=True))


def _without(batch: pa.RecordBatch, phrases: Phrases) -> pa.RecordBatch:
    _, spans, _ = scan_shard(batch.column("text"), phrases)
    texts = [_cut(t, s) for t, s in zip(batch.column("text").to_pylist(), spans, strict=True)]
    return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole documents gathered to about SHARD_BYTES, across the batches that Spark hands over."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in slices(batches, most=SHARD_BYTES):
        n = int(text_bytes(b.column("text"))[1][-1])
        if held and size + n > SHARD_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += n
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blocks(spark: SparkSession, benchmark: DataFrame, window: int) -> Iterator:
    """Broadcasts of at most about BLOCK windows each."""
    windows = shared_table(spark, windows_of(benchmark, window), "windows")
    blocks = max(1, -(-windows.count() // BLOCK))
    for k in range(blocks):
        mine = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).collect()
        yield spark.sparkContext.broadcast(Phrases(mine, window))


def find(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (merged word ranges with code point places), items of every document."""
    short_batches(spark)
    rows = pick(docs, doc_id="doc_id", text="text").select(F.lit(None).cast("long").alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    phrases = list(_blocks(spark, benchmark, window))
    if len(phrases) == 1:
        return _scanned(rows, phrases[0]).drop("row")
    rows = shared_table(spark, rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    return _over_blocks(rows, phrases).drop("row")


def _scanned(rows: DataFrame, shared) -> DataFrame:  # noqa: ANN001
    return rows.mapInArrow(lambda batches: (_found(b, shared.value) for b in _shards(batches)), FOUND)


def _over_blocks(rows: DataFrame, phrases: list) -> DataFrame:
    """FOUND of numbered rows, the spans and items of all blocks of phrases merged."""
    every = functools.reduce(DataFrame.unionByName, [_scanned(rows, shared) for shared in phrases])
    merged = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return merged.select("row", "doc_id", "n_words", _united("spans").alias("spans"), "items")


def _united(name: str):  # noqa: ANN202
    """Merge sorted, touching spans: a fold over the array."""
    kind = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"
    return F.expr(
        f"aggregate({name}, cast(array() as {kind}), (acc, x) -> if(size(acc) > 0 and x.first <= element_at(acc, -1).last,"
        " concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'last', greatest(element_at(acc, -1).last, x.last),"
        " 'start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))), concat(acc, array(x))))"
    )


def digest(found: DataFrame) -> DataFrame:
    """The query's columns: counts and the digest of the items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def remove(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the text of hit words; other texts stay as they are, and so do all columns.

    Every text is cut once, by the merged spans of all blocks, so neither the number
    of blocks nor the dealing of windows to them changes the result.
    """
    short_batches(spark)
    out = docs.withColumn("text", F.col("text").cast("string"))
    phrases = list(_blocks(spark, benchmark, window))
    if len(phrases) == 1:
        return out.mapInArrow(lambda batches, shared=phrases[0]: (_without(b, shared.value) for b in _shards(batches)), out.schema)
    whole = F.struct(*[F.col(f"`{c}`") for c in out.columns]).alias("whole")
    numbered = shared_table(spark, out.select(F.monotonically_increasing_id().alias("row"), whole), "numbered")
    rows = numbered.select("row", F.lit(None).cast("long").alias("doc_id"), F.col("whole.text").alias("text"))
    cuts = shared_table(spark, _over_blocks(rows, phrases).where(F.size("spans") > 0).select("row", "spans"), "cuts")
    text = F.col("whole.text")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda c: c["end"]))
    starts = F.concat(F.transform("spans", lambda c: c["start"]), F.array(F.length(text).cast("long")))
    left = F.array_join(F.zip_with(ends, starts, lambda a, z: F.substring(text, (a + 1).cast("int"), (z - a).cast("int"))), "")
    kept = F.when(F.col("spans").isNull(), text).otherwise(left)
    return numbered.join(cuts, "row", "left").select(*[kept.alias(c) if c == "text" else F.col(f"whole.`{c}`").alias(c) for c in out.columns])


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The query in DuckDB's SQL: windows joined to all word runs of their length.
SQL = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bi as (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) as i from b where len(w) > 0),
bw as (select distinct item_id, array_to_string(w[i:i + {WINDOW - 1}], ' ') as g, len(w[i:i + {WINDOW - 1}]) as n from bi),
dn as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n),
dg as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from dn),
m as (select doc_id, i, n, item_id from dg join bw using (g, n)),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from m)) group by 1),
t as (select doc_id, count(item) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item_id::varchar as item from m) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join t using (doc_id)"""
