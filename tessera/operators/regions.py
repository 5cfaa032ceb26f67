"""Regions of pages: a hash of the words in them, in the order of the page's containers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of height in one block, by which objects meet regions.
BLOCK = 64


def token_hashes(objects: DataFrame, regions: DataFrame) -> DataFrame:
    """region, tokens, hash: SHA-256 of the words of all objects that a region cuts, one to a line.

    objects: page, path (array of integers; null: none), z, x0, y0, x1, y1, text. regions: region, page, x0, y0, x1, y1.
    Paths are compared number by number, a shorter one first; an object without one stands by its box before those
    with one. Tasks read their regions' words in order and feed them to the hash piece by piece, so a region
    of any size needs no more memory than a batch. A region without words hashes the empty text.
    """
    box = ["x0", "y0", "x1", "y1"]
    blocks = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / BLOCK), F.floor(F.greatest(F.col(low), F.col(high)) / BLOCK)))
    r = regions.select("region", "page", *[F.col(b).alias(f"r_{b}") for b in box])
    held = objects.withColumn("_b", blocks("y0", "y1"))
    j = held.join(r.withColumn("_b", blocks("r_y0", "r_y1")), ["page", "_b"])
    j = j.where("x0 < r_x1 and x1 > r_x0 and y0 < r_y1 and y1 > r_y0")
    # An object and a region that share several blocks meet in the first of these.
    j = j.where(F.col("_b") == F.greatest(F.floor(F.col("y0") / BLOCK), F.floor(F.col("r_y0") / BLOCK)))
    words = j.select("region", "path", "y0", "x0", "z", F.regexp_replace(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), " ", "\n").alias("words")).where("words <> ''")
    laid = words.repartition("region").sortWithinPartitions("region", "path", "y0", "x0", "z", "words").select(F.col("region").cast("string").alias("region"), "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, count = None, None, 0
        for b in batches:
            done: list[tuple] = []
            for region, text in zip(b.column("region").to_pylist(), b.column("words").to_pylist(), strict=True):
                if digest is None or region != now:
                    if digest is not None:
                        done.append((now, count, digest.hexdigest()))
                    now, digest, count = region, hashlib.sha256(), 0
                digest.update(("\n" if count else "").encode() + text.encode())
                count += text.count("\n") + 1
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["region", "tokens", "hash"])
        if digest is not None:
            yield pa.record_batch([pa.array([now]), pa.array([count], pa.int64()), pa.array([digest.hexdigest()])], names=["region", "tokens", "hash"])

    found = laid.mapInArrow(run, "region string, tokens long, hash string")
    every = regions.select(F.col("region").cast("string").alias("region")).distinct()
    return every.join(found, "region", "left").select("region", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("hash", F.lit(hashlib.sha256(b"").hexdigest())).alias("hash"))
