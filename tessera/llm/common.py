"""Shared helpers of the training-data operators: the shared folder, Arrow
batches, byte-level word splitting and 64-bit hashing.

Everything here works on one Arrow batch at a time, inside a Spark task; the
distribution is always done by the caller's DataFrame plan.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Rows in one Arrow batch handed to Python; texts are long, so batches are short.
BATCH_ROWS = "1000"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local master only; on a cluster each
    executor would write to its own disk, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dir()


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def shared_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast df, a written table, behind a check of its bytes (as JSON, which is no shorter than the rows); beyond it both sides are shuffled."""
    from pyspark.sql import functions as F

    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df.hint("merge")


def short_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python in short Arrow batches, which bounds a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the columns an operator needs, under its own names, so that clashing extra columns do no harm."""
    from pyspark.sql import functions as F

    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in names.items()])


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until no column bears it in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (or a binary column's bytes) and its n + 1 offsets; null is empty."""
    raw_kind = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    col = column.fill_null(b"" if raw_kind else "").cast(pa.large_binary() if raw_kind else pa.large_string())
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `most` text bytes (a longer text stands alone)."""
    for b in batches:
        _, offs = text_bytes(b.column(column))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi
    pa.default_memory_pool().release_unused()  # the worker may wait long for its next task


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix64), vectorised."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@functools.cache
def byte_table(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(lower, is_word): A-Z lowered; kind 'alnum' is [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F], 'space' is [^\\x20\\x09-\\x0D]."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    if kind == "alnum":
        word = np.zeros(256, bool)
        word[48:58] = word[97:123] = True
        word[128:] = True
    else:
        word = np.ones(256, bool)
        word[[32, 9, 10, 11, 12, 13]] = False
    return lower, word[lower]


_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, dtype=U64), dtype=U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, 0x9E3779B97F4A7C15 | 1, dtype=U64), dtype=U64)
    return _POWERS


def split_words(data: np.ndarray, offs: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased texts laid end to end: byte starts, byte ends, 64-bit hashes, and first word of each text (n + 1).

    A byte of 0x80 or more is a word byte in both kinds, so byte and code point views agree.
    """
    lower, word = byte_table(kind)
    inside = word[data]
    starts_mask = inside.copy()
    starts_mask[1:] &= ~inside[:-1]
    firsts = offs[:-1][offs[:-1] < offs[1:]]
    starts_mask[firsts] = inside[firsts]
    starts = np.flatnonzero(starts_mask)
    ends_mask = np.empty(len(data) + 1, bool)
    if len(data):
        ends_mask[0] = False
        ends_mask[1:-1] = inside[:-1] & (~inside[1:] | starts_mask[1:])
        ends_mask[-1] = inside[-1]
        ends = np.flatnonzero(ends_mask)
    else:
        ends = starts
    first_word = np.searchsorted(starts, offs)
    hashes = np.empty(len(starts), U64)
    # Blocks of whole words keep the 8-byte temporaries small whatever the text's length.
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + (1 << 20))))
        a, z = starts[lo], ends[hi - 1]
        keep = inside[a:z]
        lens = ends[lo:hi] - starts[lo:hi]
        at = np.cumsum(lens) - lens
        pos = np.arange(at[-1] + lens[-1]) - np.repeat(at, lens)
        vals = (lower[data[a:z][keep]].astype(U64) + U64(1)) * _powers(int(lens.max()))[pos]
        hashes[lo:hi] = np.add.reduceat(vals, at)
        lo = hi
    return starts, ends, mix(hashes), first_word
