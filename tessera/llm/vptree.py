"""Approximate nearest neighbours by vantage-point trees, one per shard.

Vectors are normalised, so that cosine order is the order of Euclidean distance,
a metric. Rows are dealt to shards of about `SHARD` by a hash; each shard grows
one tree (vantage point, median radius, inside, outside, down to leaves) in one
task, and the trees are written to the shared folder. Queries go in packed
blocks to every shard, all queries of a block walk a tree together, and a
subtree is skipped when its triangle-inequality bound times `factor` exceeds the
query's k-th distance so far. Factor 1 is exact; a larger one skips more. The
best of all shards are ranked by the cosine of the original vectors in double
precision.

A tree holds directions. A vector that stands in a shard many times is kept once with
its k + 1 smallest ids, which is exact because ties go to smaller ids; vectors of one
direction share a point, and all of them are scored where the point is found. Of points
at equal distance (to 12 digits of the cosine) those with the smallest ids are kept, so
ties beyond k are decided as asked for.

Defined results: a row whose vec_id or vector is null, whose vector is empty,
zero or has a null or non-finite component takes no part; vectors of different
lengths are never compared; rows that bear the query's own vec_id are no
candidates; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, shared_table

SHARD, LEAF = 8192, 128
#: Queries sent to a shard in one row (about as large as a shard), and those that walk its tree together.
QUERY_BLOCK, TOGETHER = 4096, 512
#: Production setting of the pruning factor; tests hold its recall to 0.9 and more.
FACTOR = 2.0
SPARE, DIGITS = 8, 12
#: Entries scored at once.
SCORED = 1 << 20


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), dim of the rows that take part."""
    r = pick(rows, vec_id="vec_id", v="embedding").where("vec_id is not null and v is not null and size(v) > 0")
    r = r.select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>").alias("v"), F.size("v").alias("dim"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return r.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0.0))


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaling first keeps very large and very small components finite."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def build(points: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """A tree over unit points: per node its vantage point, radius, children (-1: none), and leaf range in `order`."""
    rng = np.random.default_rng(seed)
    nodes: list[list[float]] = []
    order: list[int] = []

    def grow(at: np.ndarray) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, 0, 0])
        if len(at) <= LEAF:
            nodes[me][4:] = [len(order), len(order) + len(at)]
            order.extend(at.tolist())
            return me
        pick_ = int(rng.integers(len(at)))
        vantage, rest = at[pick_], np.delete(at, pick_)
        d = np.sqrt(np.maximum(0, 2 - 2 * points[rest] @ points[vantage]))
        by = np.argsort(d, kind="stable")
        half = len(by) // 2
        nodes[me][0], nodes[me][1] = int(vantage), float(d[by[half]])
        nodes[me][2] = grow(rest[by[:half]])
        nodes[me][3] = grow(rest[by[half:]])
        return me

    if len(points):
        grow(np.arange(len(points)))
    table = np.array(nodes, dtype=np.float64).reshape(-1, 6)
    return {"vantage": table[:, 0].astype(np.int64), "radius": table[:, 1], "inside": table[:, 2].astype(np.int64), "outside": table[:, 3].astype(np.int64), "leaf": table[:, 4:].astype(np.int64), "order": np.array(order, np.int64)}


def walk(points: np.ndarray, low: np.ndarray, tree: dict[str, np.ndarray], queries: np.ndarray, k: int, factor: float) -> np.ndarray:
    """Point numbers of the k nearest found for each unit query (-1 where there are fewer); equal cosines go to the smaller `low`."""
    nq = len(queries)
    cos, best = np.full((nq, k), -np.inf), np.full((nq, k), -1, np.int64)

    def offer(q: np.ndarray, at: np.ndarray) -> np.ndarray:
        c = np.round(queries[q] @ points[at].T, DIGITS)
        every = np.concatenate([cos[q], c], axis=1)
        ids = np.concatenate([best[q], np.broadcast_to(at, c.shape)], axis=1)
        top = np.argpartition(-every, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(every, top, 1).min(axis=1)
        tied = np.flatnonzero((every >= least[:, None]).sum(axis=1) > k)
        if len(tied):
            top[tied] = np.lexsort((np.where(ids[tied] >= 0, low[ids[tied]], np.iinfo(np.int64).max), -every[tied]), axis=1)[:, :k]
        cos[q], best[q] = np.take_along_axis(every, top, 1), np.take_along_axis(ids, top, 1)
        return np.sqrt(np.maximum(0, 2 - 2 * c))

    def visit(node: int, q: np.ndarray) -> None:
        if not len(q):
            return
        if tree["vantage"][node] < 0:
            lo, hi = tree["leaf"][node]
            offer(q, tree["order"][lo:hi])
            return
        d = offer(q, np.array([tree["vantage"][node]]))[:, 0]
        radius, near = tree["radius"][node], d < tree["radius"][node]
        visit(tree["inside"][node], q[near])
        visit(tree["outside"][node], q[~near])
        reach = np.sqrt(np.maximum(0, 2 - 2 * cos[q].min(axis=1)))
        far = np.abs(d - radius) * factor <= reach + 1e-6  # rounding moves small distances that much
        visit(tree["outside"][node], q[near & far])
        visit(tree["inside"][node], q[~near & far])

    if len(points):
        visit(0, np.arange(nq))
    return best


def directions(v: np.ndarray, ids: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """A shard's entries (id and vector) in the order of their directions: v, ids, owner (an id's vector), begin (a direction's entries), and the tree."""
    by = np.argsort(ids, kind="stable")
    v, ids = v[by] + 0.0, ids[by]  # -0.0 equals 0.0
    _, first, same = np.unique(v, axis=0, return_index=True, return_inverse=True)
    same = same.reshape(-1)
    order = np.argsort(same, kind="stable")
    nth = np.arange(len(ids)) - np.searchsorted(same[order], same[order])
    keep = order[nth <= k]  # the k + 1 smallest ids of each distinct vector
    v, ids, owner = v[first], ids[keep], same[keep]
    _, way = np.unique(np.round(unit(v), DIGITS) + 0.0, axis=0, return_inverse=True)
    way = way.reshape(-1)
    by = np.argsort(way, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    v, way, owner = v[by], way[by], place[owner]
    by = np.argsort(owner, kind="stable")
    ids, owner = ids[by], owner[by]
    count = int(way[-1]) + 1 if len(way) else 0
    heads = np.searchsorted(way, np.arange(count))
    return {"v": v, "ids": ids, "owner": owner, "heads": heads, "begin": np.searchsorted(way[owner], np.arange(count + 1)), **build(unit(v[heads]))}


def answer(held: dict[str, np.ndarray], qid: np.ndarray, qv: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, vec_id, score of the k nearest found in one shard."""
    best = walk(held["unit"], held["low"], held, unit(qv), min(k + 1 + SPARE, max(1, len(held["heads"]))), factor)
    out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    entries = np.where(best >= 0, (held["begin"][1:] - held["begin"][:-1])[best], 0)
    lo = 0
    while lo < len(qid):  # as many queries as have about SCORED entries
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(entries[lo:].sum(axis=1)), SCORED, "right")) + lo)
        # Every entry of a found direction is a candidate, but the query's own row.
        row, point = np.nonzero(best[lo:hi] >= 0)[0] + lo, best[lo:hi][best[lo:hi] >= 0]
        copies = held["begin"][point + 1] - held["begin"][point]
        at = np.repeat(held["begin"][point] - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())
        row, ids = np.repeat(row, copies), held["ids"][at]
        other = ids != qid[row]
        row, ids, at = row[other], ids[other], at[other]
        score = cosine(qv[row], held["v"][held["owner"][at]])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((qid[row[top]], ids[top], score[top]))
        lo = hi
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def index(spark: SparkSession, rows: DataFrame, k: int = 5, shard: int = SHARD) -> DataFrame:
    """One row per shard: dim, shard, shards, blob (vectors, ids, tree). Every usable row is in one."""
    good = usable(rows)
    sizes = good.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / shard)).cast("int").alias("shards"))
    dealt = good.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))  # a row for each vector length

    def grow(key: tuple, t: pa.Table) -> pa.Table:
        blob = _pack(**directions(_matrix(t.column("v")), t.column("vec_id").to_numpy(), k))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "shards": pa.array([t.column("shards")[0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

    return shared_table(spark, dealt.groupBy("dim", "shard").applyInArrow(grow, "dim int, shard int, shards int, blob binary"), "vp-trees")


def search(spark: SparkSession, trees: DataFrame, queries: DataFrame, k: int = 5, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query row, from every shard's tree."""
    asked = usable(queries).select(F.col("vec_id").alias("query_id"), "v", "dim")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    packed = asked.groupBy("dim", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "v")).alias("q"))  # about QUERY_BLOCK rows
    shards = trees.select("dim", "shard")
    sent = packed.join(shards, "dim")  # each block of the stated query set goes to each shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for b in batches:
            for i in range(b.num_rows):
                where = (b.column("dim")[i].as_py(), b.column("shard")[i].as_py())
                if where != last:
                    last, held = where, dict(np.load(io.BytesIO(b.column("blob")[i].as_py())))
                    held["unit"] = unit(held["v"][held["heads"]])
                    held["low"] = np.minimum.reduceat(held["ids"], held["begin"][:-1])
                q = b.column("q")[i].values
                qid, qv = q.field("query_id").to_numpy(), _matrix(q.field("v"))
                for lo in range(0, len(qid), TOGETHER):
                    part = slice(lo, lo + TOGETHER)
                    got = answer(held, qid[part], qv[part], k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["query_id", "vec_id", "score"])

    found = sent.join(trees.select("dim", "shard", "blob"), ["dim", "shard"]).sortWithinPartitions("dim", "shard").mapInArrow(run, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(spark: SparkSession, rows: DataFrame, k: int = 5, every: int = 50, factor: float = FACTOR) -> DataFrame:
    """The k nearest of every row whose id is divisible by `every`, against all rows."""
    return search(spark, index(spark, rows, k), rows.where(F.col("vec_id") % every == 0), k, factor)
