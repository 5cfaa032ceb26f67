"""A content-addressed store for token ids.

A rolling hash over the last `WINDOW` ids cuts each document's id stream where
its low bits vanish, so equal passages give equal chunks wherever they stand.
A chunk's address is the hash of its ids. Three Parquet tables make the format:

* `chunks`: (bucket, hashes, lengths, data) -- unique chunks, each stored once in
  the bucket its address names, data compressed;
* `recipes`: in ascending doc_id order (range-partitioned files; a null doc_id first),
  doc_id, start, n_tokens, the chunks' addresses and lengths, and a Merkle root over the
  addresses;
* `manifest`: a Merkle tree over the recipes. A leaf hashes doc_id, start, n_tokens,
  lengths and root of one document; a node has the counts, the start and the root of up
  to `FANOUT` neighbours of the level below, up to one top node.

Chunk bytes cross the network once, packed by bucket and compressed; the number of
buckets follows the bytes of the texts. Reading back builds the tree anew from the
recipes and compares every node with the manifest, so lost, added, moved or edited
recipes raise, as do starts with a gap; every chunk is verified against its address and
every recipe against its root. A document's crc is the xor of its chunks' crcs shifted
by the bytes that follow, so it needs no second move of the data; chunks with very many
uses meet them in a broadcast, not in one task.

Defined results: a null text is empty (its ids are the end id alone); repeated
rows and equal doc_ids each give a row, in a stable order; a null doc_id is kept and
comes first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, pick, shared_dir, shared_table, short_batches, slices, small
from .encoding import default_tokenizer, encode_column

WINDOW, ADDRESS, TABLE = 16, 16, 1 << 16
#: Chunks hold 64 ids at least, 8192 at most and about 64 + 512 on average.
LEAST, MOST, MEAN_BITS = 64, 8192, 9
#: Children of a manifest node (a power of 2), text bytes of a bucket, and uses that make a chunk a hot one.
FANOUT_BITS, BUCKET_BYTES, HOT_USES = 12, 64 << 20, 5000
FANOUT = 1 << FANOUT_BITS
CHILD = "child long, start long, n_tokens long, documents long, root binary"
NODE = "node long, start long, n_tokens long, documents long, root binary"
STAGED = "doc_id long, n_tokens long, addresses binary, lengths binary, root binary, bucket int, data binary"


@functools.cache
def _id_hashes() -> np.ndarray:
    return mix(np.arange(TABLE, dtype=np.uint64) + np.uint64(1))


def cut_points(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Per stream of ids laid end to end, the places where its chunks end: where the rolling hash of the last WINDOW ids is 0 in its low bits.

    A window that reaches into the stream before never decides, since a chunk is longer than a window.
    """
    rolled, step = _id_hashes()[ids] if len(ids) and int(ids.max()) < TABLE else mix(ids.astype(np.uint64) + np.uint64(1)), 1
    while step < WINDOW:  # sum of hash(id) << age over the window, by doubling
        older = rolled[:-step] << np.uint64(step)
        rolled[step:] += older
        step *= 2
    marks = np.flatnonzero((rolled >> np.uint64(WINDOW)) & np.uint64((1 << MEAN_BITS) - 1) == 0) + 1
    out, k, marks = [], 0, [*marks.tolist(), len(ids) + 1]
    for last, end in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        ends: list[int] = []
        while marks[k] <= last:
            k += 1
        while marks[k] < end:
            m = marks[k]
            if m - last >= LEAST:
                ends += range(last + MOST, m, MOST)
                ends.append(m)
                last = m
            k += 1
        ends += range(last + MOST, end, MOST)
        ends.append(end)
        out.append(ends)
    return out


def address(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=ADDRESS).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree; an odd node moves up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [address(b"\x01" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return address(b"\x00" + level[0])


@functools.cache
def _zero_tables() -> np.ndarray:
    """[k, byte position, value]: a crc32 register moved over 4 * 2**k zero bytes, for 40 values of k."""
    def step(reg: int) -> int:
        for _ in range(8):
            reg = (reg >> 1) ^ (0xEDB88320 if reg & 1 else 0)
        return reg

    def apply(cols: list[int], reg: int) -> int:
        out = 0
        while reg:
            low = reg & -reg
            out ^= cols[low.bit_length() - 1]
            reg ^= low
        return out

    cols = [1 << b for b in range(32)]
    for _ in range(4):
        cols = [step(c) for c in cols]
    tables = np.zeros((40, 4, 256), np.uint32)
    for k in range(40):
        for pos in range(4):
            for v in range(256):
                tables[k, pos, v] = apply(cols, v << (8 * pos))
        cols = [apply(cols, c) for c in cols]
    return tables


def shift_crc(crc: np.ndarray, ids_after: np.ndarray) -> np.ndarray:
    """The crc's share in the crc of a longer stream with so many 4-byte ids behind it."""
    tables, out, left = _zero_tables(), crc.astype(np.uint32), ids_after.astype(np.int64)
    for k in range(40):
        on = (left >> k) & 1 == 1
        if on.any():
            x = out[on]
            out[on] = tables[k, 0, x & 255] ^ tables[k, 1, (x >> 8) & 255] ^ tables[k, 2, (x >> 16) & 255] ^ tables[k, 3, x >> 24]
        if not (left >> (k + 1)).any():
            break
    return out


def stage(docs: DataFrame, tokenizer: str, end_id: int, buckets: int) -> DataFrame:
    """Recipe rows (doc_id set) and, per task and bucket, packed rows of chunks new to the task (data set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
        names = [x.split()[0] for x in STAGED.split(", ")]
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        size, seen = 0, set()

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        def packed() -> list[tuple]:
            return [(None, None, b"".join(a for a, _ in got), np.array([len(r) // 4 for _, r in got], "<u4").tobytes(), None, k, press.compress(narrow(b"".join(r for _, r in got)))) for k, got in sorted(held.items())]

        for b in slices(batches, most=8 << 20):
            rows = []
            flat, bounds = encode_column(b.column("text"), tokenizer, end_id)
            raw = flat.tobytes()
            for doc, at, ends in zip(b.column("doc_id").to_pylist(), bounds.tolist(), cut_points(flat, bounds), strict=False):
                n, names_, lengths = ends[-1] - at, [], []
                for z in ends:
                    p = raw[4 * at : 4 * z]
                    a = address(p)
                    names_.append(a)
                    lengths.append(z - at)
                    at = z
                    if a not in seen:
                        seen.add(a)
                        held.setdefault(int.from_bytes(a[:4], "little") % buckets, []).append((a, p))
                        size += len(p)
                rows.append((doc, n, b"".join(names_), np.array(lengths, "<u4").tobytes(), merkle(names_), None, None))
            yield emit(rows)
            if size > 32 << 20:  # bounds what a task holds
                yield emit(packed())
                held, size = {}, 0
        if held:
            yield emit(packed())

    return docs.mapInArrow(run, STAGED)


def narrow(raw: bytes) -> bytes:
    """Ids in two planes of 16 bits; small vocabularies leave the upper one all zero."""
    ids = np.frombuffer(raw, "<u4")
    return (ids & 0xFFFF).astype("<u2").tobytes() + (ids >> 16).astype("<u2").tobytes()


def widen(raw: bytes) -> bytes:
    half = len(raw) // 2
    return (np.frombuffer(raw[:half], "<u2").astype("<u4") | (np.frombuffer(raw[half:], "<u2").astype("<u4") << 16)).astype("<u4").tobytes()


def unpack(addresses: bytes, lengths: bytes, data: bytes) -> Iterator[tuple[bytes, bytes]]:
    import zstandard

    raw, at = widen(zstandard.ZstdDecompressor().decompress(data)), 0
    for k, n in enumerate(np.frombuffer(lengths, "<u4").tolist()):
        yield addresses[k * ADDRESS : (k + 1) * ADDRESS], raw[at : at + 4 * n]
        at += 4 * n


def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket follow each other: keep each address's first chunk."""
    import zstandard

    press, bucket, seen = zstandard.ZstdCompressor(level=3), None, set()
    for b in batches:
        rows = []
        for k, adr, lengths, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "addresses", "lengths", "data")), strict=True):
            if k != bucket:
                bucket, seen = k, set()
            new = []
            for a, raw in unpack(adr, lengths, data):
                if a not in seen:
                    seen.add(a)
                    new.append((a, raw))
            if new:
                rows.append((k, b"".join(a for a, _ in new), np.array([len(r) // 4 for _, r in new], "<u4").tobytes(), press.compress(narrow(b"".join(r for _, r in new)))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "addresses", "lengths", "data"])


def write_store(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, buckets: int | None = None) -> None:
    """Write `chunks`, `recipes` and `manifest` below path."""
    short_batches(spark)
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if buckets is None:
        buckets = max(32, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    staged = shared_table(spark, stage(rows, tokenizer or default_tokenizer(), end_id, buckets), "staged")
    (
        staged.where("data is not null").select("bucket", "addresses", "lengths", "data")
        .repartition(buckets, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_unique, "bucket int, addresses binary, lengths binary, data binary")
        .write.option("compression", "none").parquet(f"{path}/chunks")
    )
    # The row's place in the written table parts repeated rows, however many.
    order = ["doc_id", "root", "place"]
    ranged = staged.where("root is not null").select("doc_id", "n_tokens", "addresses", "lengths", "root", F.monotonically_increasing_id().alias("place")).repartitionByRange(*order).sortWithinPartitions(*order).drop("place")
    placed = shared_table(spark, ranged.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "recipes")
    sums = placed.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each range of documents, not for each document.
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    running = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    (
        placed.withColumn("ahead", running).join(before, "part")
        .select("doc_id", (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", "addresses", "lengths", "root", "part", "nth")
        .write.option("compression", "zstd").parquet(f"{path}/recipes")
    )
    tree(spark, spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A leaf of the manifest's tree for each recipe."""
    for b in batches:
        roots = [
            address(b"\x02" + struct.pack("<?qqq", doc is None, doc or 0, start, n) + lengths + root)
            for doc, start, n, lengths, root in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "lengths", "root")), strict=True)
        ]
        one = pa.array(np.ones(b.num_rows, np.int64))
        yield pa.RecordBatch.from_arrays([b.column("nth"), b.column("start"), b.column("n_tokens"), one, pa.array(roots, pa.binary())], names=["child", "start", "n_tokens", "documents", "root"])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node over its children (at most FANOUT), whose starts follow each other without a gap."""
    for b in batches:
        out = []
        for node, children in zip(b.column("node").to_pylist(), b.column("children").to_pylist(), strict=True):
            at = children[0]["start"]
            for c in children:
                if c["start"] != at:
                    raise ValueError(f"recipes do not follow each other at {c['child']}: start {c['start']}, not {at}")
                at += c["n_tokens"]
            out.append((node, children[0]["start"], at - children[0]["start"], sum(c["documents"] for c in children), merkle([c["root"] for c in children])))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], names=["node", "start", "n_tokens", "documents", "root"])


def tree(spark: SparkSession, recipes: DataFrame) -> DataFrame:
    """level, node, start, n_tokens, documents, root of the Merkle tree over recipes: each level is grouped from the one below."""
    children = recipes.select("doc_id", "start", "n_tokens", "lengths", "root", "nth").mapInArrow(_leaves, CHILD)
    levels: list[DataFrame] = []
    while True:
        packed = children.groupBy(F.shiftright("child", FANOUT_BITS).alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "start", "n_tokens", "documents", "root"))).alias("children"))
        now = shared_table(spark, packed.mapInArrow(_nodes, NODE), "manifest-level")
        levels.append(now.select(F.lit(len(levels)).alias("level"), "*"))
        if now.count() <= 1:
            return functools.reduce(DataFrame.unionByName, levels)
        children = now.withColumnRenamed("node", "child")


def verify(spark: SparkSession, path: str) -> None:
    """Raise unless the recipes give the manifest's tree, node by node, from the first id on."""
    stored = spark.read.parquet(f"{path}/manifest")
    found = tree(spark, spark.read.parquet(f"{path}/recipes"))
    cols = ["start", "n_tokens", "documents", "root"]
    pairs = stored.select("level", "node", F.struct(*cols).alias("stored")).join(found.select("level", "node", F.struct(*cols).alias("found")), ["level", "node"], "full")
    wrong = pairs.where(~F.col("stored").eqNullSafe(F.col("found")))
    first = wrong.orderBy("level", "node").first()
    if first is not None:
        raise ValueError(f"the manifest does not match the recipes: level {first.level}, node {first.node}")
    ends = found.agg(F.min("start").alias("start"), F.max_by("node", "level").alias("top")).first()
    if ends.start not in (None, 0):
        raise ValueError(f"the first recipe starts at {ends.start}")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Address, length and crc of every stored chunk, after verifying the bytes against the address."""
    for b in batches:
        for adr, lengths, data in zip(*(b.column(c).to_pylist() for c in ("addresses", "lengths", "data")), strict=True):
            got = list(unpack(adr, lengths, data))
            for a, raw in got:
                if address(raw) != a:
                    raise ValueError(f"chunk {a.hex()} does not match its address")
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.binary()), pa.array([len(r) // 4 for _, r in got], pa.int64()), pa.array([zlib.crc32(r) for _, r in got], pa.int64())], names=["address", "ids", "crc"])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk of a recipe, with the ids behind it, after verifying the recipe's Merkle root."""
    for b in slices(batches, "addresses", 1 << 20):
        cols: tuple[list, ...] = ([], [], [], [], [])
        for part, nth, adr, lengths, root in zip(*(b.column(c).to_pylist() for c in ("part", "nth", "addresses", "lengths", "root")), strict=True):
            names = [adr[i : i + ADDRESS] for i in range(0, len(adr), ADDRESS)]
            if merkle(names) != root:
                raise ValueError(f"recipe {nth} does not match its root")
            n = np.frombuffer(lengths, "<u4").astype(np.int64)
            cols[0].append(np.full(len(n), part, np.int32))
            cols[1].append(np.full(len(n), nth))
            cols[2].extend(names)
            cols[3].append(n.sum() - np.cumsum(n))
            cols[4].append(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cols[0])), pa.array(np.concatenate(cols[1])), pa.array(cols[2], pa.binary()), pa.array(np.concatenate(cols[3])), pa.array(np.concatenate(cols[4]))], names=["part", "nth", "address", "behind", "ids"])


def _shifted(crc, behind):  # noqa: ANN001, ANN202
    import pandas as pd

    return pd.Series(shift_crc(crc.to_numpy(), behind.to_numpy()).astype(np.int64))


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; what is missing or altered raises."""
    verify(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(_checked, "address binary, ids long, crc long").withColumnRenamed("ids", "stored")
    recipes = spark.read.parquet(f"{path}/recipes")
    steps = shared_table(spark, recipes.select("part", "nth", F.col("addresses"), "lengths", "root").mapInArrow(_steps, "part int, nth long, address binary, behind long, ids long"), "recipe-steps")
    # At most one in HOT_USES uses names a hot chunk; these meet their uses in a broadcast while it is small.
    hot = shared_table(spark, steps.groupBy("address").agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") >= HOT_USES).select("address"), "hot-addresses")
    known = small(hot)
    often = shared_table(spark, chunks.join(known, "address", "left_semi"), "hot-chunks")
    used = steps.join(known, "address", "left_anti").join(chunks, "address", "left").unionByName(steps.join(known, "address", "left_semi").join(small(often), "address", "left"))
    shifted = F.pandas_udf(_shifted, "long")
    crc = F.when(F.col("stored").isNull() | (F.col("stored") != F.col("ids")), F.raise_error(F.lit("a chunk is missing or has another length"))).otherwise(F.col("crc"))
    by_doc = used.groupBy("part", "nth").agg(F.bit_xor(shifted(crc.cast("long"), F.col("behind"))).alias("ids_crc32"), F.sum("ids").alias("got"))
    ok: Column = F.when(F.col("got") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a recipe's chunks don't add up")))
    return recipes.select("doc_id", "start", "n_tokens", "part", "nth").join(by_doc, ["part", "nth"], "left").select("doc_id", "start", "n_tokens", ok.cast("long").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids (array) of some documents, put together from their chunks."""
    recipes = spark.read.parquet(f"{path}/recipes").where(F.col("doc_id").isin(doc_ids))
    chunks = spark.read.parquet(f"{path}/chunks")

    def open_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for adr, lengths, data in zip(*(b.column(c).to_pylist() for c in ("addresses", "lengths", "data")), strict=True):
                got = list(unpack(adr, lengths, data))
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.binary()), pa.array([np.frombuffer(r, "<u4").astype(np.int64).tolist() for _, r in got], pa.list_(pa.int64()))], names=["address", "ids"])

    steps = recipes.mapInArrow(_steps, "part int, nth long, address binary, behind long, ids long").drop("ids")
    parts = steps.join(chunks.mapInArrow(open_chunks, "address binary, ids array<long>"), "address")
    whole = parts.groupBy("part", "nth").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("behind")).alias("k"), "ids"))), lambda x: x["ids"])).alias("ids"))
    return recipes.select("doc_id", "part", "nth").join(whole, ["part", "nth"]).select("doc_id", "ids")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write a store in the shared folder and return what its files say of every document."""
    path = f"{shared_dir(spark)}/id-store-{uuid.uuid4().hex}"
    write_store(spark, docs, path, tokenizer, end_id)
    return read_digest(spark, path)
