"""Collocations by level-wise Apriori passes.

A pass for each phrase length. The first counts all words. Pass k rebuilds, in each slice of
text, only those k-grams of which both overlapping (k-1)-grams are frequent. Most of these
are rare, so they are first counted by a 64-bit hash, which is short to shuffle; the next
pass counts those of a frequent hash by the phrase itself, beside the hashes of its own
level. So the level tables are exact. What is frequent goes to every task as a bitmap of
phrase hashes (`SLOTS` slots for each phrase, and `MOST_SLOTS` bits in all, 32 MB at most,
whatever the corpus's size); two phrases in one slot, or of one hash, only let a few grams
more be counted. Within a slice grams are told apart by integers: dictionary codes of words,
then pairs of codes of the level below.

The level tables hold every phrase of `least` occurrences or more with its count. A cut of a
candidate finds both its parts there, since parts of a frequent phrase are frequent.

Defined results: null text is empty; a null lang is `und`; a null doc_id does no harm; a
repeated row counts again; an empty table gives no rows; a very long text is one slice of
its own; extra columns are ignored. Ties: see `mine`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _powers, mix, pick, shared_table, short_batches, slices, small, text_bytes

U64 = np.uint64
#: What ends a piece; a space or tab ends a word.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
SLOTS, MOST_SLOTS = 64, 1 << 28
#: Hash counts that a task merges before it hands them on.
MERGED = 1 << 22
COUNTED = "lang string, phrase string, n long, hash long"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    ends = np.zeros(256, bool)
    ends[list(BREAKS)] = True
    word = ~ends
    word[list(BLANKS)] = False
    return lower, word, ends


LOWER, WORD, END = _tables()


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """All words of texts laid end to end, the text of each, and whether a word follows the one before it in the same piece."""
    inside = WORD[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    firsts = offs[:-1][offs[:-1] < offs[1:]]
    begin[firsts] = inside[firsts]
    starts = np.flatnonzero(begin)
    sizes = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    flat = LOWER[data[inside]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat)])
    text = np.searchsorted(offs, starts, "right") - 1
    breaks = np.cumsum(END[data])
    piece = breaks[starts] if len(starts) else starts
    joined = np.zeros(len(starts), bool)
    joined[1:] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    return words, text, joined


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each (non-empty) word."""
    data, offs = text_bytes(words)
    sizes = np.diff(offs)
    out = np.empty(len(sizes), U64)
    lo = 0
    while lo < len(sizes):  # whole words, about a megabyte at a time
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + (1 << 20))) - 1)
        at = offs[lo:hi] - offs[lo]
        pos = np.arange(offs[hi] - offs[lo]) - np.repeat(at, sizes[lo:hi])
        out[lo:hi] = np.add.reduceat((data[offs[lo] : offs[hi]].astype(U64) + U64(1)) * _powers(int(sizes[lo:hi].max()))[pos], at)
        lo = hi
    return mix(out)


class Grams:
    """The grams of a slice, level by level: at each word the code of the gram that begins there (-1: none), and of each code a place and a hash."""

    def __init__(self, b: pa.RecordBatch) -> None:
        words, text, joined = words_of(*text_bytes(b.column("text")))
        coded = words.dictionary_encode()
        self.words, self.at, self.joined, self.length = coded.dictionary, coded.indices.to_numpy().astype(np.int64), joined, 1
        langs = b.column("lang").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy().astype(np.int64)[text]
        keys = np.array([zlib.crc32(x.encode()) for x in self.langs], U64)
        self.word_hash, self.lang_hash = hashes(self.words), mix(keys + U64(1))
        self._code(np.arange(len(self.at)), self.lang * max(1, len(self.words)) + self.at)

    def _code(self, places: np.ndarray, keys: np.ndarray) -> None:
        _, first, code, self.n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        self.code = np.full(len(self.at), -1, np.int64)
        self.code[places] = code
        self.first = places[first]
        total = self.lang_hash[self.lang[self.first]] if len(self.first) else np.zeros(0, U64)
        for k in range(self.length):
            total = total + self.word_hash[self.at[self.first + k]] * (_powers(8)[k])
        self.hash = mix(total)

    def among(self, frequent: np.ndarray) -> np.ndarray:
        """Which codes' hashes a bitmap holds."""
        slot = (self.hash & U64(len(frequent) * 8 - 1)).astype(np.int64)
        return (frequent[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)

    def extend(self, frequent: np.ndarray) -> None:
        """Grams of one word more, of which both shorter grams are frequent."""
        kept = np.append(self.among(frequent), False)[self.code]
        pair = kept[:-1] & kept[1:]
        if self.length == 1:
            pair &= self.joined[1:]
        places = np.flatnonzero(pair)
        self.length += 1
        self._code(places, self.code[places] * max(1, len(self.n)) + self.code[places + 1])

    def counted(self, which: np.ndarray) -> pa.RecordBatch:
        """lang, phrase and count of some codes."""
        first, n, hash_ = self.first[which], self.n[which].astype(np.int64), self.hash[which]
        names = [self.words.take(pa.array(self.at[first + k])) for k in range(self.length)]
        phrase = pc.binary_join_element_wise(*names, pa.scalar(b" ", pa.large_binary())) if self.length > 1 else names[0]
        lang = pa.array(self.langs, pa.string()).take(pa.array(self.lang[first]))
        return pa.record_batch({"lang": lang, "phrase": phrase.cast(pa.large_string()).cast(pa.string()), "n": pa.array(n), "hash": pa.array(hash_.view(np.int64))})

    def totals(self) -> pa.RecordBatch:
        """All words of each lang, under the empty phrase, which is no word."""
        n = np.bincount(self.lang, minlength=len(self.langs)).astype(np.int64)
        return pa.record_batch({"lang": pa.array(self.langs, pa.string()), "phrase": pa.array([""] * len(n), pa.string()), "n": pa.array(n), "hash": pa.array(np.zeros(len(n), np.int64))})


class Sums:
    """Counts by hash, merged over a task's slices and handed on when there are `MERGED` of them."""

    def __init__(self) -> None:
        self.hash, self.n = [np.zeros(0, U64)], [np.zeros(0, np.int64)]

    def add(self, hash_: np.ndarray, n: np.ndarray) -> None:
        hashes_, back = np.unique(np.concatenate([*self.hash, hash_]), return_inverse=True)
        n = np.bincount(back, np.concatenate([*self.n, n]), len(hashes_)).astype(np.int64)
        self.hash, self.n = [hashes_], [n]

    def drain(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        h, n = np.concatenate(self.hash), np.concatenate(self.n)
        if len(h) >= least:
            null = pa.nulls(len(h), pa.string())
            yield pa.record_batch({"lang": null, "phrase": null, "n": pa.array(n), "hash": pa.array(h.view(np.int64))})
            self.__init__()


def _pass(texts: DataFrame, length: int, longest: int, maps: list[Broadcast], least: int) -> DataFrame:
    """lang, phrase, n, hash of what occurs `least` times or more.

    The first pass counts words (and each lang's total, under the empty phrase). Pass `length` counts the phrases of
    one word less by name and its own, up to `longest`, by hash alone (null lang and phrase).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for b in slices(batches, most=8 << 20):
            grams = Grams(b)
            if length == 1:
                yield grams.totals()
                yield grams.counted(np.ones(len(grams.n), bool))
                continue
            for m in maps[:-1]:
                grams.extend(m.value)
            if length > 2:
                yield grams.counted(grams.among(maps[-1].value))
            if length <= longest:
                grams.extend(maps[-1].value)
                sums.add(grams.hash, grams.n)
                yield from sums.drain(MERGED)
        yield from sums.drain()

    counts = texts.mapInArrow(run, COUNTED).groupBy("lang", "phrase", "hash").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= least) | (F.col("phrase") == ""))


def bitmap(spark: SparkSession, level: DataFrame) -> Broadcast:
    """The hashes of a level's phrases as bits: `SLOTS` for each phrase, MOST_SLOTS at most."""
    bits = min(MOST_SLOTS, max(1 << 12, 1 << (SLOTS * level.count() - 1).bit_length()))
    slot = F.col("hash").bitwiseAND(F.lit(bits - 1))
    filled = level.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((hash & {bits - 1}L) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    return spark.sparkContext.broadcast(out.view(np.uint8))


def levels(spark: SparkSession, docs: DataFrame, longest: int = 5, least: int = 100) -> list[DataFrame]:
    """The level tables (lang, phrase, n, hash) for 1 to `longest` words; the first also holds each lang's total under the empty phrase."""
    short_batches(spark)
    texts = pick(docs, lang="lang", text="text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    out: list[DataFrame] = []
    maps: list[Broadcast] = []
    for length in range(1, longest + 2):
        found = shared_table(spark, _pass(texts, length, longest, maps, least), f"pass-{length}")
        if length != 2:
            out.append(found.where("phrase is not null"))
        if length <= longest:
            maps.append(bitmap(spark, found.where("phrase <> ''" if length == 1 else "phrase is null")))
    return out


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return left.join(small(right), on, how)


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), exact while the products have no more than 38 digits."""
    d = lambda c: c.cast("decimal(18,0)")
    top = (d(a) * d(n)).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (d(left) * d(right)).cast("decimal(38,0)"))


def mine(spark: SparkSession, docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's best phrases of 2 to `longest` words.

    A phrase is scored by its weakest cut (ties: the shortest first part). One that lies in a
    longer candidate of the same count is dropped; looking one word further is enough, since
    a phrase between two of equal counts has that count as well. Ranks go by score, count and
    the phrase's bytes.
    """
    tables = levels(spark, docs, longest, least)
    columns = ("lang", "phrase", "n")
    totals = tables[0].where("phrase = ''").select("lang", F.col("n").alias("total"))
    parts = shared_table(spark, _union([t.where("phrase <> ''").select(*columns) for t in tables[:-1]]), "level-parts")
    words = F.split("phrase", " ")
    found = []
    for k, t in enumerate(tables[1:], 2):
        one = t.select("lang", "phrase", F.col("n").alias("a"))
        if k < longest:
            longer = tables[k].select("lang", "n", F.explode(F.array(_words(F.split("phrase", " "), 0, k), _words(F.split("phrase", " "), 1, k))).alias("phrase"))
            held = shared_table(spark, longer.groupBy("lang", "phrase").agg(F.max("n").alias("held")), "level-held")
            one = _join(one, held, ["lang", "phrase"], "left").where("held is null or held < a").drop("held")
        cuts = F.array(*[F.struct(F.lit(c).alias("cut"), _words(words, 0, c).alias("head"), _words(words, c, k - c).alias("tail")) for c in range(1, k)])
        found.append(one.select("lang", "phrase", "a", F.inline(cuts)))
    rows = _join(_union(found), parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    rows = _join(rows, parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    rows = _join(rows, shared_table(spark, totals, "level-totals"), ["lang"])
    rows = rows.withColumn("score", score(F.col("a"), F.col("total"), F.col("l"), F.col("r")))
    weakest = rows.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    chosen = weakest.select("lang", "phrase", "a", "w.l", "w.r", F.col("total").alias("n"), "w.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # A hot lang is ranked in parts first, so that the last rank sees `top` rows of each part.
    parted = chosen.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    first = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part", "rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _words(words: Column, start: int, size: int) -> Column:
    return F.array_join(F.slice(words, start + 1, size), " ")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from words group by lang),
grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from words, range(1, 6) as t(k)),
counts as (select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 100),
candidates as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from counts where k >= 2),
longer as (
  select lang, sub, max(a) as held from (
    select lang, a, unnest(list_concat(
      list_transform(range(1, 3), lambda i: array_to_string(w[i:i + k - 2], ' ')),
      list_transform(range(1, 4), lambda i: case when k > 3 then array_to_string(w[i:i + k - 3], ' ') end),
      list_transform(range(1, 5), lambda i: case when k > 4 then array_to_string(w[i:i + k - 4], ' ') end))) as sub
    from candidates where k > 2) group by lang, sub),
kept as (select c.* from candidates c left join longer l on c.lang = l.lang and c.phrase = l.sub where held is null or 100 * held < 100 * a),
cuts as (select lang, phrase, a, c, array_to_string(w[1:c], ' ') as head, array_to_string(w[c + 1:k], ' ') as tail from kept, range(1, 5) as t(c) where c < k),
scored as (
  select x.lang, x.phrase, x.a, c, h.f as l, t.f as r, n, ((1000::hugeint * a * n) // (h.f::hugeint * t.f))::bigint as score
  from cuts x join counts h on x.lang = h.lang and x.head = h.phrase join counts t on x.lang = t.lang and x.tail = t.phrase join totals on x.lang = totals.lang),
weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1)
select lang, rank, phrase, a, l, r, n, score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from weakest) where rank <= 2000"""
