"""Best-fit packing by minimum bin slack.

The lengths of all pieces are summed into one histogram, which has at most
`capacity` counters whatever the corpus's size. On it, each bin takes the
longest length left and a bitset subset-sum dynamic program finds the fullest
feasible company for it; the combination is removed as often as the counters
allow. The plan is a set of (length, rank range) -> (sequence, offset) runs;
every piece finds its own place by its rank among the pieces of its length.

Defined results: a null text is empty (one piece holding the end id); a null doc_id is
packed like any other; repeated rows are packed once each; an empty table gives no rows; extra columns are
ignored. Ranks follow the written piece table, so any order is as good.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, shared_table, short_batches, slices, small
from .encoding import default_tokenizer, encode_column

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Only what exceeds the capacity is cut; all pieces but the first are full."""
    if n <= capacity:
        return [n]
    first = n % capacity or capacity
    return [first] + [capacity] * ((n - first) // capacity)


def piece_table(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece with its crc, its Spark partition and its rank there among pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in slices(batches, most=8 << 20):
            rows: list[tuple] = []
            flat, bounds = encode_column(b.column("text"), tokenizer, end_id)
            for doc, lo, hi in zip(b.column("doc_id").to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                ids, at = flat[lo:hi], 0
                for k, n in enumerate(cut_lengths(len(ids), capacity)):
                    rows.append((doc, k, at, n, zlib.crc32(ids[at : at + n].tobytes()), part, int(seen[n])))
                    seen[n] += 1
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, PIECES)


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths (with repeats, as available) whose sum is as near to room as any subset's: bitset subset-sum."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        steps.append((length, reach))
        left, copies = min(int(counts[length]), room // length), 1
        while left:
            k = min(copies, left)
            reach |= (reach << (k * length)) & mask
            left, copies = left - k, copies * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        while not before >> total & 1:
            out.append(length)
            total -= length
    return out


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Runs (length, first rank, copies, first sequence, offset) that place every piece of the histogram."""
    left, used, runs, seq = counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64), [], 0
    for longest in range(capacity, 0, -1):
        while left[longest]:
            left[longest] -= 1
            items = [longest, *fullest(left, capacity - longest)]
            left[longest] += 1
            kinds, need = np.unique(items, return_counts=True)
            times = int((left[kinds] // need).min())
            at = 0
            for n in items:
                runs.append((n, int(used[n]), times, seq, at))
                used[n] += times
                at += n
            left[kinds] -= need * times
            seq += times
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    short_batches(spark)
    pieces = shared_table(spark, piece_table(docs, tokenizer or default_tokenizer(), capacity, end_id), "pieces")
    by_part = shared_table(spark, pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = shared_table(spark, by_part.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")), "piece-bases")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r.length] = r.n
    runs = plan(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    key = runs[:, 0] * (1 << 44) + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(small(base), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
