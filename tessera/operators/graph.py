"""Lineage graphs: transitive closure, cycle check, layers, invalidation, fingerprints."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rounds after which a growing table is written as one again.
COMPACT = 8
#: Rows that are broadcast at most.
FEW = 20_000


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where it is unset, a temporary one serves a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(root or _own_dir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of an iteration: a table in the shared folder."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side(df: DataFrame) -> DataFrame:
    """A written table as one side of a join: broadcast behind a count of its rows, shuffled beyond FEW.

    Spark's own choice goes by the bytes of its files, of which a few megabytes hold millions of rows.
    """
    return F.broadcast(df) if df.count() <= FEW else df.hint("merge")


def closure(spark: SparkSession, edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(src, dst, depth): everything reachable by one edge or more, with the least number of steps.

    Semi-naive: only pairs found in the last round are extended, and known pairs are
    taken out before they are stored, so cycles end. With seeds (src), only from these.
    """
    step = edges.select("src", "dst").distinct()
    now = step if seeds is None else step.join(seeds.select("src").distinct(), "src", "left_semi")
    every = stored(spark, now.withColumn("depth", F.lit(1)), "closure")
    fresh, depth = every, 1
    while fresh.limit(1).count():
        depth += 1
        nxt = fresh.select("src", F.col("dst").alias("_m")).join(step.select(F.col("src").alias("_m"), "dst"), "_m").select("src", "dst").distinct()
        fresh = stored(spark, nxt.join(every.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        every = every.unionByName(fresh)
        if depth % COMPACT == 0:
            every = stored(spark, every, "closure")
    return every


def would_cycle(spark: SparkSession, edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """proposed (src, dst) with closes_cycle: the edge is a loop, or src is reachable from dst already."""
    reach = closure(spark, edges, proposed.select(F.col("dst").alias("src"))).select(F.col("src").alias("dst"), F.col("dst").alias("src")).withColumn("_hit", F.lit(True))
    return proposed.join(reach, ["src", "dst"], "left").withColumn("closes_cycle", F.coalesce("_hit", F.col("src") == F.col("dst"))).drop("_hit")


def layers(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, layer): leaves are pruned round by round; nodes on or behind a cycle get no layer (null)."""
    left = stored(spark, edges.select("src", "dst").distinct(), "layers")
    nodes = stored(spark, left.select(F.col("src").alias("node")).union(left.select("dst")).distinct(), "layers")
    done, layer = None, 0
    while True:
        free = nodes.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("layer", F.lit(layer))
        free = stored(spark, free, "layers")
        if not free.limit(1).count():
            break
        done = free if done is None else done.unionByName(free)
        nodes = stored(spark, nodes.join(free, "node", "left_anti"), "layers")
        left = stored(spark, left.join(free.select(F.col("node").alias("src")), "src", "left_anti"), "layers")
        layer += 1
    rest = nodes.withColumn("layer", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def invalidate(spark: SparkSession, edges: DataFrame, changed: DataFrame, jobs: DataFrame) -> DataFrame:
    """jobs (job, input, state) with the new state: what reads a changed node, or one behind it, becomes stale.

    Finished jobs go stale, running ones are asked to stop, others keep their state.
    """
    hit = closure(spark, edges, changed).select("dst").union(changed.select("src")).distinct().select(F.col("dst").alias("input")).withColumn("_hit", F.lit(True))
    j = jobs.join(hit, "input", "left").groupBy("job", "state").agg(F.max("_hit").alias("_hit"))
    new = F.when(F.col("_hit") & (F.col("state") == "done"), "stale").when(F.col("_hit") & (F.col("state") == "running"), "cancel_requested").otherwise(F.col("state"))
    return j.select("job", "state", new.alias("new_state"))


def set_digest(item: Column) -> Column:
    """An aggregate: a hash of a multiset of texts that does not depend on their order. Sums of four 60-bit parts of each item's hash, so partial sums combine and no group is collected."""
    h = F.sha2(item, 256)
    sums = [F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    return F.sha2(F.concat_ws(":", *sums), 256)


def fingerprint(df: DataFrame, keys: list[str], key: Column, content: Column) -> DataFrame:
    """keys, fingerprint, components, repeated: a hash of each set of components, and how many of their keys stand more than once."""
    parts = df.groupBy(*keys, key.alias("_k")).agg(F.count(F.lit(1)).alias("_n"), set_digest(F.concat_ws("=", key, content)).alias("_h"))
    return parts.groupBy(*keys).agg(set_digest(F.concat_ws("=", "_k", "_h")).alias("fingerprint"), F.sum("_n").alias("components"), F.count_if(F.col("_n") > 1).alias("repeated"))


def best_first(spark: SparkSession, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(graph, node, way): all that roots reach, in the order in which a queue that always yields its least node would visit them.

    edges: graph, src, dst; roots: graph, node. Such a queue visits v behind u unless greater nodes stand
    between them, so v's way is u's way without the nodes up to v, then v: a falling sequence. Its order is
    that of sequences, the least way counts, and ways only grow along edges; so the ways are
    found like shortest paths, by rounds in which only improved nodes are followed. Sort by `way` for the order.
    """
    step = stored(spark, edges.select("graph", "src", "dst").distinct(), "order-edges")
    now = stored(spark, roots.select("graph", "node").distinct().withColumn("way", F.array("node")), "order")
    every, rounds = now, 0
    while now.limit(1).count():
        behind = now.withColumnRenamed("node", "src").join(step, ["graph", "src"])
        way = F.concat(F.expr("filter(way, x -> x > dst)"), F.array("dst"))
        best = behind.select("graph", F.col("dst").alias("node"), way.alias("way")).groupBy("graph", "node").agg(F.min("way").alias("way"))
        known = every.groupBy("graph", "node").agg(F.min("way").alias("_known"))
        now = stored(spark, best.join(known, ["graph", "node"], "left").where("_known is null or way < _known").drop("_known"), "order")
        every, rounds = every.unionByName(now), rounds + 1
        if rounds % COMPACT == 0:
            every = stored(spark, every.groupBy("graph", "node").agg(F.min("way").alias("way")), "order")
    return every.groupBy("graph", "node").agg(F.min("way").alias("way"))
