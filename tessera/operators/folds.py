"""Order-dependent folds over the rows of each key, read in order and piece by piece.

Rows are dealt by key and sorted within their task; the fold sees one Arrow batch at a time and
keeps only its state, so a key of any size needs no more memory than a batch. Sorting spills.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _laid(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _schema(df: DataFrame, keys: list[str], more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), more])


def clusters(df: DataFrame, keys: list[str], at: str, tolerance: float) -> DataFrame:
    """keys, center, n: distinct positions on a line grouped in order. A position joins the open cluster while it is within tolerance of its mean."""
    rows = df.select(*keys, F.col(at).cast("double").alias("_at")).where("_at is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mean, n, kinds = None, 0.0, 0, None
        done: list[tuple] = []

        def give() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[] for _ in range(len(keys) + 2)]
            out = [pa.array(c, t) for c, t in zip(columns, [*kinds, pa.float64(), pa.int32()], strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(out, names=[*keys, "center", "n"])

        for b in batches:
            kinds = [b.schema.field(k).type for k in keys]
            for key, x in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), b.column("_at").to_pylist(), strict=True):
                if key == now and abs(x - mean) <= tolerance:
                    mean, n = (mean * n + x) / (n + 1), n + 1
                else:
                    if n:
                        done.append((*now, mean, n))
                    now, mean, n = key, x, 1
            yield give()
        if n:
            done.append((*now, mean, n))
            yield give()

    return _laid(rows, keys, ["_at"]).mapInArrow(run, _schema(df, keys, "center double, n int"))


def pack(df: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """group, order, size, bin: parts put into bins in order. A bin is closed when the next part would exceed the limit; a larger part stands alone; a null size is 0."""
    rows = df.select(group, order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bin_, fill, begun = None, 0, 0, False
        for b in batches:
            bins = []
            for key, s in zip(b.column(group).to_pylist(), b.column(size).to_pylist(), strict=True):
                if not begun or key != now:
                    now, bin_, fill, begun = key, 0, s, True
                elif fill + s <= limit:
                    fill += s
                else:
                    bin_, fill = bin_ + 1, s
                bins.append(bin_)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bins, pa.int32())], names=[*b.schema.names, "bin"])

    return _laid(rows, [group], [order]).mapInArrow(run, _schema(rows, [group, order, size], "bin int"))
