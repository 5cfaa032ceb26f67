"""Hard negatives by an orthogonal PCA rotation.

Components become integers, so a score (the inner product of two rows) is exact. One
orthogonal rotation, the eigenvectors of the second moments of all rows, moves most of a
score into its leading components. Rows are dealt to shards of a bounded size, and every
anchor meets every shard in a task that holds one shard at a time. There partial products
of the leading components are accumulated; what is missing lies between plus and minus the
product of both residual norms, and a slack covers the rounding of the rotation. A row goes
as soon as its bounds leave the wanted window or fall below the k-th best lower bound;
what survives is verified with integer products. The rotation decides only how early rows
go, never the result.

Two passes: the best rows of the anchor's own label (its positives), then, for each
positive, the best rows of other labels whose score is in the window that the positive's
score sets. Each shard returns at most k rows a window, and these are merged by rank.

Defined results: a row whose vec_id, label or vector is null or that has a null or
non-finite component takes no part; nor does one whose integer vector is longer than
2^31, whose scores need not fit 64 bits. Vectors of different lengths are never compared.
A repeated row is a candidate each time and an anchor once; rows that bear the anchor's
own vec_id are no candidates. Ties go to the smaller vec_id. An empty table, an anchor
without positives and a window without rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, shared_table

#: Values (rows times components) of a shard at most; and where more cores wait, at least.
MOST_VALUES, LEAST_VALUES = 1 << 19, 1 << 15
#: Eighths of the components after which the bounds are tested.
STEPS = (1, 2, 4, 5, 6, 7)
#: Share of pairs below which the survivors go on pair by pair; values gathered and window tests made at once.
SPARSE, GATHERED, TESTED = 1 / 16, 1 << 20, 1 << 21
ANY = (np.iinfo(np.int64).min, np.iinfo(np.int64).max)


def usable(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, q (array<int>: floor(scale * x)), dim of the rows that take part."""
    r = pick(rows, vec_id="vec_id", label="label", v="embedding").where("vec_id is not null and label is not null and v is not null")
    r = r.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("v").cast("array<double>").alias("v"))
    # A non-finite or too long component becomes null.
    number = F.transform("v", lambda x: F.when(F.abs(x) < float(1 << 31) / scale, F.floor(x * F.lit(float(scale))).cast("int")))
    r = r.select("vec_id", "label", number.alias("q"), F.size("v").alias("dim")).where(F.forall("q", lambda x: x.isNotNull()))
    length = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return r.where(length < float(1 << 62))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.int64)


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the eigenvectors of the second moments of all rows, largest eigenvalue first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                q = _matrix(b.column("q").filter(pa.array(dims == d)), d).astype(np.float64)
                sums[d] = sums.get(d, 0.0) + q.T @ q
        for d, m in sums.items():
            yield pa.record_batch({"dim": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "m": pa.array(list(m), pa.list_(pa.float64()))})

    def add(key: tuple, t: pa.Table) -> pa.Table:
        d = key[0].as_py()
        total = t.column("m").combine_chunks().flatten().to_numpy().reshape(-1, d).sum(axis=0)
        return pa.table({"dim": pa.array([d], pa.int32()), "i": pa.array([key[1].as_py()], pa.int32()), "m": pa.array([total], pa.list_(pa.float64()))})

    kind = "dim int, i int, m array<double>"
    found: dict[int, np.ndarray] = {}
    for r in rows.select("dim", "q").mapInArrow(moments, kind).groupBy("dim", "i").applyInArrow(add, kind).collect():  # a row of sums for each component
        found.setdefault(r.dim, np.zeros((r.dim, r.dim)))[r.i] = r.m
    return {d: np.ascontiguousarray(np.linalg.eigh(m)[1][:, ::-1]) for d, m in found.items()}


class Turned:
    """Integer rows with their rotation, the norms of what is left behind each step, and whole norms."""

    def __init__(self, q: np.ndarray, turn: np.ndarray) -> None:
        dim = q.shape[1]
        self.q, self.rot = q, q.astype(np.float64) @ turn
        self.cuts = sorted({max(1, dim * s // 8) for s in STEPS}) if dim else []
        behind = np.cumsum((self.rot**2)[:, ::-1], axis=1)[:, ::-1]
        self.left = [np.sqrt(behind[:, c]) if c < dim else np.zeros(len(q)) for c in self.cuts]
        self.norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))


def slack(turn: np.ndarray) -> float:
    """What rounding may move a bound by, as a share of both norms' product: the rotation's own defect, and sums of dim terms."""
    dim = len(turn)
    return float(np.linalg.norm(turn.T @ turn - np.eye(dim))) + 16 * (dim + 4) * np.finfo(np.float64).eps


def best(a: Turned, x: Turned, ids: np.ndarray, open_: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, loose: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): for each query i, whose anchor is a[of[i]], the k best rows of x with low[i] <= score <= high[i] among open_[of[i]]."""
    floor, top = low.astype(np.float64), high.astype(np.float64)
    alive, done, part = open_[of], 0, np.zeros((len(a.q), len(x.q)))
    for step, cut in enumerate(a.cuts):
        part += a.rot[:, done:cut] @ x.rot[:, done:cut].T
        done = cut
        reach = a.left[step][:, None] * x.left[step] + loose * a.norm[:, None] * x.norm
        most, least = (part + reach)[of], (part - reach)[of]
        alive &= (most >= floor[:, None]) & (least <= top[:, None])
        if alive.shape[1] > k:
            sure = np.where(alive & (least >= low[:, None].astype(np.float64)) & (most <= top[:, None]), least, -np.inf)
            floor = np.maximum(floor, np.partition(sure, -k, axis=1)[:, -k])
            alive &= most >= floor[:, None]
        if alive.mean() < SPARSE:
            break
    qi, xi = np.nonzero(alive)
    tested = a.cuts.index(done) if done else -1
    score = np.empty(len(qi), np.int64)
    keep = np.ones(len(qi), bool)
    width = max(1, GATHERED // max(1, a.q.shape[1]))
    for lo in range(0, len(qi), width):
        at = np.arange(lo, min(lo + width, len(qi)))
        from_, sum_ = done, part[of[qi[at]], xi[at]]
        for step in range(tested + 1, len(a.cuts)):
            to, one, other = a.cuts[step], of[qi[at]], xi[at]
            sum_ = sum_ + np.einsum("ij,ij->i", a.rot[one, from_:to], x.rot[other, from_:to])
            reach = a.left[step][one] * x.left[step][other] + loose * a.norm[one] * x.norm[other]
            ok = (sum_ + reach >= floor[qi[at]]) & (sum_ - reach <= top[qi[at]])
            keep[at[~ok]] = False
            at, sum_, from_ = at[ok], sum_[ok], to
        score[at] = np.einsum("ij,ij->i", a.q[of[qi[at]]], x.q[xi[at]])
    qi, xi, score = qi[keep], xi[keep], score[keep]
    ok = (score >= low[qi]) & (score <= high[qi])
    qi, xi, score = qi[ok], xi[ok], score[ok]
    order = np.lexsort((ids[xi], np.negative(score), qi))
    qi, xi, score = qi[order], xi[order], score[order]
    first = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[first], xi[first], score[first]


def deal(spark: SparkSession, rows: DataFrame, scale: int = 256) -> DataFrame:
    """The rows that take part, each in one shard: dim, shard, shards, vec_id, label, q."""
    good = shared_table(spark, usable(rows, scale).withColumn("place", F.monotonically_increasing_id()), "negatives-rows")
    cells = F.count(F.lit(1)) * F.greatest("dim", F.lit(1))
    cores = spark.sparkContext.defaultParallelism
    sizes = good.groupBy("dim").agg(F.greatest(F.ceil(cells / MOST_VALUES), F.least(F.lit(cores), F.ceil(cells / LEAST_VALUES))).cast("int").alias("shards"))
    dealt = good.join(F.broadcast(sizes), "dim")  # a row for each vector length
    return dealt.select("dim", F.pmod(F.xxhash64("place"), F.col("shards")).cast("int").alias("shard"), "shards", "vec_id", "label", "q")


ASKED = "array<struct<id: bigint, score: bigint>>"


def _meet(spark: SparkSession, rows: DataFrame, anchors: DataFrame, turns, k: int, percent: tuple[int, int] | None) -> DataFrame:  # noqa: ANN001
    """Each anchor against each shard. Without `percent`: the k best of its own label; with it: for each of its `asked` the k best of other labels in the window."""
    null = F.lit(None)
    held = rows.select("dim", "shard", F.lit(0).alias("kind"), "label", "vec_id", "q", null.cast("long").alias("anchor"), null.cast(ASKED).alias("asked"))
    sent = anchors.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), "label", "vec_id", "q", "anchor", F.col("asked").cast(ASKED).alias("asked"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = held.unionByName(sent).repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "kind", "label")

    def answer(held: dict, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dim, turn = held["dim"], turns.value[held["dim"]] if held["dim"] else np.zeros((0, 0))
        q, names, labels, numbers = _matrix(asked.column("q"), dim), asked.column("vec_id").to_numpy(), asked.column("label").to_numpy(), asked.column("anchor").to_numpy()
        wants = asked.column("asked").to_pylist() if percent else [None] * len(q)
        if "rows" not in held:  # a shard may meet more than one batch of anchors
            held["ids"], held["labels"] = np.concatenate(held["ids"]), np.concatenate(held["labels"])
            held["rows"], held["loose"] = Turned(np.concatenate(held.pop("q")), turn), slack(turn)
        most = max(1, TESTED // max(1, len(held["ids"])) // (5 if percent else 1))
        lo = 0
        while lo < len(q):
            hi = min(int(np.searchsorted(labels[lo:], labels[lo], "right")) + lo, lo + most)  # anchors of one label
            first, last = np.searchsorted(held["labels"], labels[lo]), np.searchsorted(held["labels"], labels[lo], "right")
            a, mine = Turned(q[lo:hi], turn), slice(lo, hi)
            if percent:
                open_ = held["ids"] != names[mine, None]
                open_[:, first:last] = False
                of = np.repeat(np.arange(hi - lo), [len(w) for w in wants[mine]])
                pid = np.array([p["id"] for w in wants[mine] for p in w], np.int64)
                scores = [p["score"] for w in wants[mine] for p in w]
                low = np.array([-(-percent[0] * s // 100) for s in scores], np.int64)
                high = np.array([percent[1] * s // 100 for s in scores], np.int64)
                x, ids = held["rows"], held["ids"]
                nth = np.concatenate([np.arange(len(w)) for w in wants[mine]]) if len(of) else of
            else:
                x, ids = Turned.__new__(Turned), held["ids"][first:last]
                whole = held["rows"]
                x.q, x.rot, x.norm, x.cuts, x.left = whole.q[first:last], whole.rot[first:last], whole.norm[first:last], whole.cuts, [c[first:last] for c in whole.left]
                open_ = ids != names[mine, None]
                of = np.arange(hi - lo)
                low, high = (np.full(hi - lo, v, np.int64) for v in ANY)
            if len(of) and len(ids):
                qi, xi, score = best(a, x, ids, open_, of, low, high, k, held["loose"])
                got = {"anchor": numbers[mine][of[qi]], "anchor_id": names[mine][of[qi]], "id": ids[xi], "score": score}
                got |= {"nth": nth[qi], "positive_id": pid[qi], "positive_score": np.array(scores, np.int64)[qi]} if percent else {c: np.zeros(len(qi), np.int64) for c in ("nth", "positive_id", "positive_score")}
                yield pa.record_batch({c: pa.array(v, pa.int64()) for c, v in got.items()})
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            key = b.column("dim").to_numpy().astype(np.int64) << 32 | b.column("shard").to_numpy()
            kind = b.column("kind").to_numpy()
            edges = np.flatnonzero(np.diff(key * 2 + kind)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                s = b.slice(lo, hi - lo)
                if held.get("key") != key[lo]:
                    held = {"key": key[lo], "dim": int(key[lo] >> 32), "q": [], "ids": [], "labels": []}
                if kind[lo] == 0:
                    held["q"].append(_matrix(s.column("q"), held["dim"]))
                    held["ids"].append(s.column("vec_id").to_numpy())
                    held["labels"].append(s.column("label").to_numpy())
                elif len(held["ids"]):  # a shard may have no rows
                    yield from answer(held, s)

    return laid.mapInArrow(run, "anchor long, anchor_id long, id long, score long, nth long, positive_id long, positive_score long")


def mine(spark: SparkSession, rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90), scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors, the rows whose vec_id is divisible by `every`."""
    dealt = shared_table(spark, deal(spark, rows, scale), "negatives-shards")
    turns = spark.sparkContext.broadcast(rotations(dealt))  # a square matrix for each vector length
    anchors = dealt.where(F.col("vec_id") % every == 0).select("dim", "shards", "label", "vec_id", "q").distinct()
    anchors = shared_table(spark, anchors.withColumn("anchor", F.monotonically_increasing_id()), "negatives-anchors")
    near = _meet(spark, dealt, anchors.withColumn("asked", F.lit(None)), turns, positives, None)
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    near = near.withColumn("place", place).where(F.col("place") <= positives)
    asked = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("id", "score"))).alias("asked"))  # `positives` entries at most
    asked = shared_table(spark, anchors.join(asked, "anchor"), "negatives-asked")
    found = _meet(spark, dealt, asked, turns, negatives, percent)
    rank = F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The query over `embeddings` in SQL: one label in seven is moved on first, as the query does.
SQL = """
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where label is not null and vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as id, list_inner_product(a.q, b.q)::bigint as score
  from usable a join usable b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 100 = 0),
positives as (
  select anchor_id, id as positive_id, score as positive_score
  from scored where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from (
  select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as integer) as rank, id as negative_id, positive_score, score as negative_score
  from positives p join scored s on p.anchor_id = s.anchor_id and not same
  where 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
where rank <= 10"""
