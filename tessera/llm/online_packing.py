"""Bounded-space online packing.

Each partition encodes its documents in their order and keeps `OPEN` windows open. What is
longer than a window is cut into full ones; the rest, or a document as it is, goes into the
open window that it fits best (the one with the least room that is enough; an empty one
last). When none fits, the fullest window takes as much as it has room for and is emitted,
and what is left over is placed again. So an emitted window is always full and a document
is cut only where no window has room.

At the end of a partition its open windows are left over. They are merged by the same
method, `FAN` partitions' leftovers in a task, round after round, until one task holds the
last ones: a round's task sees `FAN * OPEN` part-filled windows at most, whatever the
corpus's size. The last task closes its windows by filling one from another; what remains
at the very end is cut at powers of two, which need no padding.

Defined results: null text is empty (one piece holding the end id); a null doc_id is packed
like any other; repeated rows are packed once each; an empty table gives no rows; extra
columns are ignored. Which of equal windows takes a piece is settled by its number, so the
order of a partition's rows settles all. Result tables stay in the shared folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, shared_table, short_batches, slices
from .word_encoder import encoder

#: Windows that a partition keeps open, and partitions whose leftovers meet in one task.
OPEN, FAN = 32, 16
PIECES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int32()), ("nth", pa.int32()), ("ids", pa.binary())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, nth int, ids binary"
#: A sequence's number: the round, the partition and a count within it.
ROUND, PART = 56, 34


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Windows:
    """The open windows of one partition. A piece is (doc_id, start, ids, doc_tokens); `rows` gathers the emitted ones."""

    def __init__(self, capacity: int, open_: int, first: int) -> None:
        self.capacity, self.next = capacity, first
        self.room = np.full(open_, capacity, np.int64)
        self.held: list[list[tuple]] = [[] for _ in range(open_)]
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, tokens in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids), tokens, self.next, offset))
            offset += len(ids)
        self.next += 1

    def _put(self, w: int, piece: tuple) -> None:
        self.held[w].append(piece)
        self.room[w] -= len(piece[2])
        if not self.room[w]:
            self._emit(self.held[w])
            self.held[w], self.room[w] = [], self.capacity

    def place(self, doc: int | None, start: int, ids: np.ndarray, tokens: int) -> None:
        while len(ids) >= self.capacity:
            self._emit([(doc, start, ids[: self.capacity], tokens)])
            ids, start = ids[self.capacity :], start + self.capacity
        while len(ids):
            fits = np.where(self.room >= len(ids), self.room, self.capacity + 1)
            best = int(fits.argmin())
            if fits[best] > self.capacity:  # none fits: the fullest takes what it has room for
                best = int(self.room.argmin())
            n = min(len(ids), int(self.room[best]))
            self._put(best, (doc, start, ids[:n], tokens))
            ids, start = ids[n:], start + n

    def close(self) -> None:
        """Fill full windows from what is left, then cut the remainder at powers of two."""
        left = [p for w in np.argsort(self.room, kind="stable").tolist() for p in self.held[w]]
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity) + [1 << k for k in reversed(range(self.capacity.bit_length())) if total % self.capacity >> k & 1]
        for size in sizes:
            pieces = []
            while size:
                doc, start, ids, tokens = left.pop(0)
                pieces.append((doc, start, ids[:size], tokens))
                if len(ids) > size:
                    left.insert(0, (doc, start + size, ids[size:], tokens))
                size -= len(pieces[-1][2])
            self._emit(pieces)

    def drain(self) -> list[tuple]:
        out, self.rows = [(*r, None, None, None) for r in self.rows], []
        return out

    def leftovers(self, part: int) -> list[tuple]:
        pieces = [p for w in range(len(self.room)) for p in self.held[w]]
        return [(doc, start, len(ids), zlib.crc32(ids), tokens, None, None, part, k, ids.tobytes()) for k, (doc, start, ids, tokens) in enumerate(pieces)]


def _arrays(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), PIECES, strict=True)] if rows else [pa.array([], t) for _, t in PIECES]


def _first_pass(docs: DataFrame, tokenizer: str, capacity: int, open_: int, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        windows = Windows(capacity, open_, part << PART)
        names = [n for n, _ in PIECES]
        for b in slices(batches, most=8 << 20):
            flat, bounds = encoder(tokenizer).encode(b.column("text"), end_id)
            for doc, lo, hi in zip(b.column("doc_id").to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                windows.place(doc, 0, flat[lo:hi], hi - lo)
            for held in windows.held:  # what stays must not hold the whole slice
                held[:] = [(d, s, ids.copy() if ids.base is not None else ids, n) for d, s, ids, n in held]
            yield pa.RecordBatch.from_arrays(_arrays(windows.drain()), names=names)
        yield pa.RecordBatch.from_arrays(_arrays(windows.leftovers(part)), names=names)

    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, SCHEMA)


def _merge(capacity: int, open_: int, base: int, last: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """Leftovers of FAN partitions in the order of partitions; the last task leaves nothing over."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        group = key[0].as_py()
        windows = Windows(capacity, open_, base + (group << PART))
        t = t.sort_by([("part", "ascending"), ("nth", "ascending")])
        for doc, start, tokens, ids in zip(*(t.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
            windows.place(doc, start, np.frombuffer(ids, "<u4"), tokens)
        if last:
            windows.close()
        rows = windows.drain() + ([] if last else windows.leftovers(group))
        return pa.Table.from_arrays(_arrays(rows), names=[n for n, _ in PIECES])

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, open_: int = OPEN, end_id: int = 2, fan: int = FAN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document."""
    short_batches(spark)
    table = shared_table(spark, _first_pass(docs, tokenizer or default_tokenizer(), capacity, open_, end_id), "windows")
    done = [table.where("sequence_id is not null")]
    left, rounds = table.where("sequence_id is null"), 0
    while True:
        highest = left.agg(F.max("part")).first()[0]
        if highest is None:
            break
        rounds += 1
        last = highest < fan
        grouped = left.groupBy(F.floor(F.col("part") / fan).cast("int").alias("group"))
        table = shared_table(spark, grouped.applyInArrow(_merge(capacity, open_, rounds << ROUND, last), SCHEMA), f"merged-{rounds}")
        done.append(table.where("sequence_id is not null"))
        if last:
            break
        left = table.where("sequence_id is null")
    out = done[0]
    for t in done[1:]:
        out = out.unionByName(t)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
