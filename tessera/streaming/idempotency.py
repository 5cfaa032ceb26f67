"""Idempotent requests as a stream: the first request under a key is stored, repeats get its response, until it expires.

State is one record for each key, kept in RocksDB and in the checkpoint, so a restarted run goes
on where the last one ended. A record is dropped by an event-time timer once the watermark has
passed its end; a request later than the watermark is left out by Spark.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 24 * 3600
#: How long a key must be.
SHORTEST, LONGEST = 16, 128
ANSWERED = "scope string, key string, request long, ts timestamp, disposition string, status int, answered_by long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# The processors go to the workers whole, which then need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Replay(StatefulProcessor):
    """One key's record: the hash and number of the request that was stored, and when it expires (microseconds)."""

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "hash string, request long, expires long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        held = self.record.get() if self.record.exists() else None
        fresh = False
        # A micro-batch's requests of one key, in order; the source's files per trigger bound them.
        for r in sorted(rows, key=lambda r: (r.at, r.request)):
            if held is None or held[2] <= r.at:
                held, fresh = (r.hash, r.request, r.at + self.ttl), True
                said = ("stored", 201)
            elif held[0] == r.hash:
                said = ("replayed", 201)
            else:
                said = ("conflict", 409)
            yield Row(scope=key[0], key=key[1], request=r.request, ts=r.ts, disposition=said[0], status=said[1], answered_by=held[1] if said[1] == 201 else None)
        if fresh:
            self.record.update(held)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-held[2] // 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        if self.record.exists() and self.record.get()[2] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.record.clear()
        return iter(())

    def close(self) -> None:
        pass


def respond(spark: SparkSession, requests: DataFrame, late: str, ttl_seconds: int = DAY) -> DataFrame:
    """scope, key, request, ts, disposition, status, answered_by of a stream of requests.

    requests: scope, key, request (a number), hash, ts. A key shorter or longer than allowed is refused and
    holds no state. A repeat with another hash is a conflict. What is stored answers for `ttl_seconds`.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    key = F.trim(F.coalesce("key", F.lit("")))
    r = requests.withColumn("key", key).withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    good = F.length("key").between(SHORTEST, LONGEST)
    refused = r.where(~good).select("scope", "key", "request", "ts", F.lit("refused").alias("disposition"), F.lit(400).alias("status"), F.lit(None).cast("long").alias("answered_by"))
    kept = r.where(good).groupBy("scope", "key").transformWithState(Replay(ttl_seconds), ANSWERED, outputMode="append", timeMode="EventTime")
    return kept.unionByName(refused)


def run_into(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process all there is into a table of files, going on from the checkpoint; each row is written once."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


DECIDED = "job string, result long, ts timestamp, attempt long, sequence long, disposition string"


class Commit(StatefulProcessor):
    """One job's attempt, what it has committed (hash and sequence) and whether it ended; dropped when nothing came for `idle` seconds."""

    def __init__(self, idle_seconds: int) -> None:
        self.idle = idle_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "attempt long, hash string, sequence long, ended boolean, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        attempt, hash_, sequence, ended, seen = tuple(self.job.get()) if self.job.exists() else (None, None, None, False, 0)
        for r in sorted(rows, key=lambda r: (r.at, r.result)):
            seen = max(seen, r.at)
            newer = attempt is None or r.attempt > attempt
            if r.ends:
                said = "obsolete" if not newer and r.attempt < attempt else "ended"
                if newer:
                    attempt, hash_, sequence, ended = r.attempt, None, None, True
                elif said == "ended":
                    ended = True
            elif not r.good:
                said = "hash_invalid"
            elif newer:
                said, attempt, hash_, sequence, ended = "publish", r.attempt, r.hash, r.sequence, False
            elif r.attempt < attempt:
                said = "obsolete"
            elif hash_ is not None and r.hash != hash_:
                said = "hash_conflict"
            elif sequence is not None and r.sequence < sequence:
                said = "out_of_order"
            elif r.hash == hash_:
                said = "duplicate"
            elif ended:
                said = "terminal"
            else:
                said, hash_, sequence = "publish", r.hash, r.sequence
            yield Row(job=key[0], result=r.result, ts=r.ts, attempt=r.attempt, sequence=r.sequence, disposition=said)
        if attempt is not None:
            self.job.update((attempt, hash_, sequence, ended, seen))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-(seen + self.idle) // 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        if self.job.exists() and self.job.get()[4] + self.idle <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.job.clear()
        return iter(())

    def close(self) -> None:
        pass


def commit(spark: SparkSession, results: DataFrame, late: str, idle_seconds: int = 30 * DAY) -> DataFrame:
    """job, result, ts, attempt, sequence, disposition of a stream of worker results, in the order of arrival.

    results: job, attempt, sequence, result (a number), hash (64 hexadecimal digits), ends (the attempt ended, without a result), ts.
    The first result of an attempt is published; the same one again is a duplicate, another one a hash conflict, one of a smaller sequence out of
    order, one after the end terminal, one of an older attempt obsolete. A newer attempt starts anew.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    good = F.coalesce(F.col("hash").rlike("^[a-f0-9]{64}$"), F.lit(False))
    r = results.withColumn("good", good).withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    return r.groupBy("job").transformWithState(Commit(idle_seconds), DECIDED, outputMode="append", timeMode="EventTime")
