"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes.

A text's set holds the 64-bit hashes of its distinct word shingles. All sets are
ordered by one global order, rare shingles first. The expected frequency of a
shingle is what the frequencies of its words give, or what its own count shows
above the noise, whichever is larger; both come from count sketches of a fixed
size over every text (an order only decides cost, never the result).
Two sets with similarity t or more that are cut to prefixes of n - ceil(t n) + l
elements share l elements of these prefixes. Each document picks its own l by
estimated cost: a longer prefix means more lists to read but fewer candidates,
since l matches are asked for. A pair must share the smaller l of the two, and
as many prefix elements as its own required overlap leaves no room to miss.

Equal sets form one class, which takes part once. Links are found in three steps,
none of which lists all pairs of a group:

1. every document is verified against the smallest document of a prefix list, for
   the list owner it shares most elements with; the links found join documents into
   components;
2. documents that these votes connect and that are still in different components are
   compared in blocks of bounded size, with one count of shared elements for each document and
   block; a block returns only links that join components;
3. all other pairs whose documents are in different components are counted and
   verified, in full, so no link between components is lost.

Defined results: a null or word-less text has an empty set, links with nothing
and is its own component; fewer words than a shingle form one element; rows
with equal doc_id share a component; a null doc_id takes no part (component_id
null); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, mix, pick, shared_table, short_batches, slices, split_words, text_bytes

SHINGLE, PERCENT, MOST_MATCHES, BLOCK, CARRIED = 3, 90, 4, 200, 256
#: Counters of each sketch (4 bytes each), units of a binary logarithm, and the ids that a side may have to be broadcast (16 bytes each).
COUNTERS, SLICE, LOG_UNIT, BROADCAST_IDS = 1 << 21, 1 << 15, 1024, 2_000_000
#: Relative cost of reading one list entry and of verifying one candidate.
READ, VERIFY = 1.0, 50.0
_ODD = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def need(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The least overlap of a set of n elements with any set that links to it."""
    return (percent * n + 99) // 100


def shingles(words: np.ndarray, width: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of one text's word hashes, ascending, and the summed word weights of each."""
    n = len(words)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    w = np.zeros(n, np.int64) if weight is None else weight
    if n < width:  # the whole sequence, told apart from a shingle by its length
        h = np.array([n], U64)
        for k in range(n):
            h = mix(h * _ODD[3] + words[k : k + 1])
        return h, np.array([w.sum()])
    h, total = mix(words[: n - width + 1] * _ODD[0]), w[: n - width + 1].copy()
    for k in range(1, width):
        h = mix((h + words[k : n - width + 1 + k]) * _ODD[k % 4])
        total += w[k : n - width + 1 + k]
    h, first = np.unique(h, return_index=True)
    return h, total[first]


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    _, _, hashes, first = split_words(*text_bytes(batch.column("text")), "space")
    return hashes, first


def summarise(docs: DataFrame, width: int) -> DataFrame:
    """Per document its set's size and 128-bit digest; per task the slices of its word and its shingle sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(2 * COUNTERS, np.uint32)
        names = ["doc_id", "n", "h1", "h2", "slice", "counts"]
        for b in slices(batches):
            hashes, first = _words(b)
            sketch[:COUNTERS] += np.bincount((hashes & U64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            rows, every = [], [np.zeros(0, U64)]
            for a, z in zip(first.tolist(), first[1:].tolist(), strict=False):
                s, _ = shingles(hashes[a:z], width)
                every.append(s)
                rows.append((len(s), int(s.sum().astype(np.int64)) if len(s) else 0, int(mix(s ^ _ODD[1]).sum().astype(np.int64)) if len(s) else 0))
            sketch[COUNTERS:] += np.bincount((np.concatenate(every) & U64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            none = pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], *none], names=names)
        part = [(k, sketch[k * SLICE : (k + 1) * SLICE].tobytes()) for k in range(2 * COUNTERS // SLICE)]
        none = [pa.nulls(len(part), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*none, pa.array([k for k, _ in part], pa.int32()), pa.array([c for _, c in part], pa.binary())], names=names)

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, slice int, counts binary")


def _sketch(summary: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches: 2 * COUNTERS numbers, whatever the corpus's size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                got = np.frombuffer(c, np.uint32).astype(np.uint64)
                total[k] = total[k] + got if k in total else got
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slice", "counts"])

    out = np.zeros(2 * COUNTERS, np.uint64)
    for r in summary.where("slice is not null").select("slice", "counts").repartition(2 * COUNTERS // SLICE, "slice").mapInArrow(add, "slice int, counts binary").toLocalIterator():
        out[r.slice * SLICE : (r.slice + 1) * SLICE] += np.frombuffer(r.counts, np.uint64)
    return out


def matches(expected: np.ndarray, n: int, documents: int, percent: int) -> int:
    """The l of least estimated cost: reads of the l-prefix, plus verified candidates by a Poisson tail."""
    alpha = need(n, percent)
    best, chosen, factorial = np.inf, 1, 1.0
    for level in range(1, min(MOST_MATCHES, alpha) + 1):
        factorial *= level
        reads = expected[: n - alpha + level].sum()
        cost = READ * reads + VERIFY * min(reads, documents * (reads / documents) ** level / factorial)
        if cost < best:
            best, chosen = cost, level
    return chosen


def prefixes(spark: SparkSession, docs: DataFrame, sketch: np.ndarray, documents: int, width: int, percent: int) -> DataFrame:
    """Rows (token, doc_id, n, ell): the elements of each document's prefix for its own match count."""
    words, own = sketch[:COUNTERS].astype(np.float64), sketch[COUNTERS:].astype(np.float64)
    scale = int(round(np.log2(max(1.0, words.sum())) * LOG_UNIT))
    # Whole numbers of 1 / LOG_UNIT bits, made here once, so that every executor orders alike.
    by_word = np.rint(np.log2(words + 1.0) * LOG_UNIT).astype(np.int32) - scale
    excess = np.maximum(0.0, own - own.mean() - 4 * np.sqrt(own.mean()))
    by_self = np.rint(np.log2(excess + 1.0) * LOG_UNIT).astype(np.int32)
    shared = spark.sparkContext.broadcast((by_word, by_self))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_weight, self_weight = shared.value
        for b in slices(batches):
            hashes, first = _words(b)
            weight = word_weight[(hashes & U64(COUNTERS - 1)).astype(np.int64)].astype(np.int64)
            cols: tuple[list, ...] = ([], [], [], [])
            for doc, a, z in zip(b.column("doc_id").to_pylist(), first.tolist(), first[1:].tolist(), strict=False):
                s, rare = shingles(hashes[a:z], width, weight[a:z])
                n = len(s)
                if not n:
                    continue
                rare = np.maximum(rare + scale, self_weight[(s & U64(COUNTERS - 1)).astype(np.int64)])
                size = n - need(n, percent) + min(MOST_MATCHES, need(n, percent))
                order = np.lexsort((s, rare))[:size]
                ell = matches(np.exp2(np.minimum(rare[order] / LOG_UNIT, 60.0)), n, documents, percent)
                one = n - need(n, percent) + 1
                order = order[: one + ell - 1]
                cols[0].append(s[order].view(np.int64))
                cols[1].append(np.full(len(order), doc, np.int64))
                cols[2].append(np.full(len(order), n, np.int64))
                cols[3].append(np.full(len(order), ell, np.int32))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["token", "doc_id", "n", "ell"])

    return docs.mapInArrow(run, "token long, doc_id long, n long, ell int")


def among(docs: DataFrame, ids: DataFrame, how: str = "left_semi", on: str = "doc_id") -> DataFrame:
    """Rows of docs whose id is (not) in ids: ids are broadcast while they are few, else both sides are shuffled."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), on, how)


def verified(spark: SparkSession, docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = among(docs, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for b in slices(batches, "tb"):
            sides = []
            for c in ("ta", "tb"):
                _, _, hashes, first = split_words(*text_bytes(b.column(c)), "space")
                sides.append((hashes, first))
            keep = []
            for i, a in enumerate(b.column("a").to_pylist()):
                (ha, fa), (hb, fb) = sides
                mine = ha[fa[i] : fa[i + 1]]
                if last is None or a != last[0] or len(mine) != len(last[1]) or (mine != last[1]).any():
                    last, left = (a, mine), shingles(mine, width)[0]
                right = shingles(hb[fb[i] : fb[i + 1]], width)[0]
                if len(left) and len(right):
                    at = np.minimum(np.searchsorted(left, right), len(left) - 1)
                    common = int((left[at] == right).sum())
                    if 100 * common >= percent * (len(left) + len(right) - common):
                        keep.append(i)
            got = b.select(["a", "b"]).take(pa.array(keep, pa.int64()))
            yield got

    both = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return both.sortWithinPartitions("a").mapInArrow(run, "a long, b long").distinct()


def linked_in_blocks(spark: SparkSession, docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between members (owner, doc_id, component) of one neighbourhood and different components.

    A neighbourhood's members are dealt to blocks of about BLOCK; each pair of blocks is one task's
    group, which joins components as it goes and returns only the links that do.
    """
    sizes = members.groupBy("owner").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi")
    asked = members.join(sizes.select("owner", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "owner")
    asked = shared_table(spark, asked.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), "blocks-asked")
    texts = among(docs, asked.select("doc_id").distinct())
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = asked.select("owner", "doc_id", "component", "block", other.alias("other")).select("owner", "doc_id", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = sent.join(texts.select("doc_id", "text"), "doc_id")

    def link(t: pa.Table) -> pa.Table:
        ids, comps = t.column("doc_id").to_pylist(), t.column("component").to_pylist()
        sets: list[np.ndarray] = []
        for b in slices(iter(t.select(["text"]).combine_chunks().to_batches())):
            hashes, first = _words(b)
            sets += [shingles(hashes[a:z], width)[0] for a, z in zip(first.tolist(), first[1:].tolist(), strict=False)]
        size = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(token, kind="stable")
        lists = np.searchsorted(token[order], np.arange(token.max(initial=-1) + 2))
        bounds, holders = np.concatenate([[0], np.cumsum(size)]), owner[order]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        found = []
        for x in range(len(sets)):
            mine = token[bounds[x] : bounds[x + 1]]
            if not len(mine):
                continue
            held = [holders[lists[k] : lists[k + 1]] for k in mine.tolist()]
            common = np.bincount(np.concatenate(held), minlength=len(sets))
            for y in np.flatnonzero(100 * common >= percent * (size[x] + size - common)).tolist():
                a, b = root(comps[x]), root(comps[y])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return rows.groupBy("owner", "i", "j").applyInArrow(link, "a long, b long")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """doc_id, component (its smallest reachable id) of every id in edges (a, b), by alternating large and small stars."""
    now = shared_table(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        now = shared_table(spark, small, "edges")
        r = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (r.n, r.h) == state:
            break
        state = (r.n, r.h)
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "doc_id")


def join(spark: SparkSession, docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    short_batches(spark)
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    summary = shared_table(spark, summarise(rows, width), "set-summaries")
    sets = summary.where("slice is null").select("doc_id", "n", "h1", "h2")
    sketch = _sketch(summary)
    known = sets.where("n > 0 and doc_id is not null")
    classes = shared_table(spark, known.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    copies = known.select("doc_id").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti").distinct()
    live = among(rows.where("doc_id is not null"), shared_table(spark, copies, "copies"), "left_anti")
    documents = max(1, classes.count())
    tokens = prefixes(spark, live, sketch, documents, width, percent)
    tokens = shared_table(spark, tokens, "prefixes")
    # Lists with one entry make no candidates; counts are pre-aggregated, and only their keys meet the rows again.
    lists = tokens.groupBy("token").agg(F.min(F.struct("doc_id", "n", "ell")).alias("o"), F.max("doc_id").alias("last")).where("o.doc_id <> last")
    lists = lists.select("token", F.col("o.doc_id").alias("owner"), F.col("o.n").alias("owner_n"), F.col("o.ell").alias("owner_ell"))
    shared = shared_table(spark, tokens.join(lists, "token"), "shared-prefixes")
    fits = lambda x, y: (F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y))

    def least(n_x: Column, n_y: Column, ell_x: Column, ell_y: Column) -> Column:
        """Prefix elements that linked sets share at least. All common elements up to the end of the prefix that ends

        first are counted, so the overlap is at most their number plus what one of the two has behind its prefix.
        """
        overlap = F.ceil((n_x + n_y) * percent / F.lit(100 + percent))
        behind = F.greatest(F.ceil(n_x * percent / 100) - ell_x, F.ceil(n_y * percent / 100) - ell_y)
        return F.greatest(F.least(ell_x, ell_y), overlap - behind)

    # Step 1: each document against the list owner that it shares most with. Other owners' lists may hold some of
    # what the two share, so half of the bound is asked for; step 2 counts in full.
    mine = shared.where("doc_id <> owner").where(fits(F.col("n"), F.col("owner_n")))
    votes = mine.groupBy("doc_id", "owner", "n", "ell", "owner_n", "owner_ell").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") * 2 >= least(F.col("n"), F.col("owner_n"), F.col("ell"), F.col("owner_ell")))
    stars = votes.groupBy("doc_id").agg(F.max_by("owner", F.struct("common", -F.col("owner"))).alias("a")).select("a", F.col("doc_id").alias("b"))
    stars = shared_table(spark, stars, "stars")
    links = shared_table(spark, verified(spark, rows, stars, width, percent), "links")
    first = shared_table(spark, components(spark, links), "first-components")

    # Step 2: documents that votes connect, block by block.
    label = shared_table(spark, components(spark, stars).withColumnRenamed("component", "owner"), "neighbourhoods")
    members = label
    members = members.join(first, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    links = shared_table(spark, links.unionByName(linked_in_blocks(spark, rows, members, width, percent)), "links")
    second = components(spark, links)

    # Step 3: all pairs across owners and components that share enough of both prefixes.
    placed = shared.join(second, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_lists = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    placed = placed.join(open_lists, "token").select("token", "doc_id", "n", "ell", "component").join(label, "doc_id", "left").withColumn("label", F.coalesce("owner", "doc_id")).drop("owner")
    # Short documents carry their open elements, so a pair is counted where it first meets and only candidates leave
    # the join; longer ones are counted by one row for each shared element.
    held = placed.groupBy("doc_id").agg(F.collect_list("token").alias("all")).where(F.size("all") <= CARRIED)
    placed = shared_table(spark, placed.join(held, "doc_id", "left"), "open-lists")
    x, y = placed.alias("x"), placed.alias("y")
    asked = least(F.col("x.n"), F.col("y.n"), F.col("x.ell"), F.col("y.ell"))
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.label") != F.col("y.label")) & fits(F.col("x.n"), F.col("y.n"))
    both = F.array_intersect("x.all", "y.all")
    counted_here = both.isNotNull()
    meet = meet & (~counted_here | ((F.array_min(both) == F.col("x.token")) & (F.size(both) >= asked)))
    counted = x.join(y, meet).groupBy(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).agg(F.sum(F.when(counted_here, F.size(both)).otherwise(1)).alias("common"), F.min(asked).alias("least"))
    pairs = shared_table(spark, counted.where("common >= least").select("a", "b").join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "candidates")
    every = links.unionByName(verified(spark, rows, pairs, width, percent))
    # Equal sets, and rows with one doc_id and different texts, tie together through their class's smallest id.
    same = known.join(classes, ["n", "h1", "h2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    final = components(spark, every.unionByName(same))
    return sets.join(final, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


#: The query in DuckDB's SQL: all pairs that share a shingle, counted, then a closure over the links.
SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
i as (select doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) as i from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') as g from i),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= {PERCENT} * (a.n + b.n - c)),
r(x, y) as (select x, y from l union select r.x, l.y from r join l on l.x = r.y),
k as (select x, min(y) as y from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(k.y, d.doc_id)) as component_id from d left join n using (doc_id) left join k on k.x = d.doc_id"""
