"""Exact k best by inner product where vectors and queries are both too many for a driver or a broadcast.

Both sides are cut into cells around the same pivots (a bounded sample of the vectors) and cells into blocks of at most ``block`` vectors,
each with its centroid c and radius r. By Cauchy-Schwarz no pair of a query block and a vector block scores more than

    cq.cv + rq |cv| + rv |cq| + rq rv.

A query block first meets the few blocks of its nearest cell that promise most. The k-th best score of each of its queries is then a bar, and
only pairs of blocks whose bound reaches the lowest bar are compared: the rest is skipped unread, and nothing is lost.
Pairs are found through pairs of cells (at most ``cells`` squared) by equi-joins over summaries, and blocks travel only to
the pairs that are left. A task sends k rows a query and block pair; Spark keeps k per task before it shuffles them.

Results equal ``vectors.top_k``: scores rounded to six digits, ties by vec_id, no query its own hit, vectors of another
width left out. Null and empty query vectors have no hits; queries of several widths are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.sources.scratch import if_small, kept

CELLS, BLOCK = 256, 2048
#: Blocks that a query block meets for its bar.
FIRST = 2
#: Scores are rounded to six digits.
SLACK = 2e-6
SUMMARY = ["cell", "block", "n", "centroid", "radius"]
HITS = "query_id long, vec_id long, score double"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), width)


def pivots(vectors: DataFrame, cells: int) -> np.ndarray:
    """Up to ``cells`` distinct vectors, those of least hash."""
    some = vectors.select("embedding").distinct().orderBy(F.xxhash64("embedding")).limit(cells).collect()
    return np.array([r[0] for r in some], np.float64)


def blocks(rows: DataFrame, around: np.ndarray, block: int = BLOCK) -> DataFrame:
    """SUMMARY with ids and vectors as bytes, of (id, embedding); written once, since blocks depend on the order of rows.

    A cell with many rows is dealt over several tasks.
    """
    spark, width = rows.sparkSession, around.shape[1]
    size = (around * around).sum(1)
    salts = max(1, rows.count() // (block * 16))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), width)
            cell = (size - 2 * x @ around.T).argmin(1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *b.columns], ["cell", "id", "embedding"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, []

        def one(cell: int) -> pa.RecordBatch:
            nonlocal made
            ids, x = (np.concatenate(v) for v in zip(*held, strict=True))
            centre = x.mean(0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(1).max())) * (1 + 1e-12)
            made += 1
            return pa.RecordBatch.from_pylist([{"cell": cell, "block": (part << 32) + made, "n": len(ids), "centroid": centre.tolist(), "radius": radius, "ids": ids.tobytes(), "data": x.tobytes()}], pa.schema([("cell", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("centroid", pa.list_(pa.float64())), ("radius", pa.float64()), ("ids", pa.binary()), ("data", pa.binary())]))

        now = None
        for b in batches:
            cell, ids, x = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), _matrix(b.column(2), width)
            edges = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else []
            for a, z in zip(edges, [*edges[1:], len(cell)], strict=True):
                if now != cell[a] and held:
                    yield one(int(now))
                    held = []
                now = cell[a]
                while a < z:
                    take = min(z - a, block - sum(len(h[0]) for h in held))
                    held.append((ids[a : a + take].astype(np.int64), x[a : a + take]))
                    a += take
                    if sum(len(h[0]) for h in held) == block:
                        yield one(int(now))
                        held = []
        if held:
            yield one(int(now))

    kind = dict(rows.dtypes)["embedding"]
    cells = rows.mapInArrow(assign, f"cell int, id long, embedding {kind}")
    dealt = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", F.pmod(F.xxhash64("id"), F.lit(salts))).sortWithinPartitions("cell")
    return kept(dealt.mapInArrow(pack, "cell int, block long, n int, centroid array<double>, radius double, ids binary, data binary"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def bounded(pairs: DataFrame) -> DataFrame:
    """Adds ``near`` (product of the centroids) and ``bound`` to pairs of summaries q_* and v_*."""
    near = pairs.withColumn("near", dot(F.col("q_centroid"), F.col("v_centroid")))
    length = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    bound = F.col("near") + F.col("q_radius") * length("v_centroid") + F.col("v_radius") * length("q_centroid") + F.col("q_radius") * F.col("v_radius")
    return near.withColumn("bound", bound + F.abs(bound) * 1e-12 + SLACK)


def named(summary: DataFrame, side: str) -> DataFrame:
    return summary.select(*[F.col(c).alias(f"{side}_{c}") for c in SUMMARY])


def around_cells(summary: DataFrame) -> DataFrame:
    """One summary a cell, around the mean of its blocks' centroids."""
    width = F.max(F.size("centroid"))
    size = summary.agg(width.alias("w")).first().w or 0
    total = F.sum(F.col("n").cast("double"))
    centre = summary.groupBy("cell").agg(F.array(*[F.sum(F.col("centroid")[i] * F.col("n")) / total for i in range(size)]).alias("c"))
    off = summary.join(if_small(centre), "cell")
    gap = F.sqrt(F.aggregate(F.zip_with("centroid", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return off.groupBy("cell").agg(F.first("c").alias("centroid"), F.max(gap + F.col("radius")).alias("radius")).select("cell", F.lit(0).cast("long").alias("block"), F.lit(0).alias("n"), "centroid", "radius")


def pairs_of_cells(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(q_cell, v_cell, near, bound) of all pairs of cells: the summaries of at most CELLS cells a side come to the driver, whatever the sizes of the sides."""
    (q, v) = (x.collect() for x in (queries, vectors))
    a, b = (np.array([r.centroid for r in x]) for x in (q, v))
    ra, rb = (np.array([r.radius for r in x]) for x in (q, v))
    near = a @ b.T
    bound = near + ra[:, None] * np.linalg.norm(b, axis=1) + rb * np.linalg.norm(a, axis=1)[:, None] + ra[:, None] * rb
    rows = [(x.cell, y.cell, float(near[i, j]), float(bound[i, j] + abs(bound[i, j]) * 1e-12) + SLACK) for i, x in enumerate(q) for j, y in enumerate(v)]
    return queries.sparkSession.createDataFrame(rows, "q_cell int, v_cell int, near double, bound double")


def compared(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, floor: float, width: int) -> DataFrame:
    """HITS with q_block of the pairs (q_block, v_block): the k best of each query in each pair."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_block, qi, qd, vi, vd in zip(*(c.to_pylist() for c in b.columns), strict=True):
                qs, vs = np.frombuffer(qi, np.int64), np.frombuffer(vi, np.int64)
                score = np.round(np.frombuffer(qd).reshape(-1, width) @ np.frombuffer(vd).reshape(-1, width).T, 6)
                score[qs[:, None] == vs[None, :]] = -np.inf
                order = np.argsort(vs, kind="stable")
                n = min(k, len(vs))
                pick = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, :n]]
                row = np.repeat(np.arange(len(qs)), n)
                s = score[row, pick.ravel()]
                ok = (s >= floor) & (s > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(ok.sum()), q_block)), pa.array(qs[row][ok]), pa.array(vs[pick.ravel()][ok]), pa.array(s[ok])], ["q_block", "query_id", "vec_id", "score"])

    q = queries.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    v = vectors.select(F.col("block").alias("v_block"), F.col("ids").alias("v_ids"), F.col("data").alias("v_data"))
    met = pairs.select("q_block", "v_block").join(q, "q_block").join(v, "v_block")
    return met.select("q_block", "q_ids", "q_data", "v_ids", "v_data").mapInArrow(task, f"q_block long, {HITS}")


def k_best(hits: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k).drop("rn")


def plan(vectors: DataFrame, queries: DataFrame, k: int, floor: float = -2.0, block: int = BLOCK, cells: int = CELLS) -> tuple[DataFrame, DataFrame, int] | None:
    """(hits, pairs of blocks compared, how many pairs there are); None if a side is empty."""
    widths = [r[0] for r in queries.filter(F.size("embedding") > 0).select(F.size("embedding")).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError("query vectors of several widths")
    if not widths:
        return None
    width = widths[0]
    fit = vectors.filter(F.size("embedding") == width).select(F.col("vec_id").alias("id"), "embedding")
    around = pivots(fit, cells)
    if not len(around):
        return None
    v = blocks(fit, around, block)
    q = blocks(queries.filter(F.size("embedding") == width).select(F.col("query_id").alias("id"), "embedding"), around, block)
    vs, qs = v.select(*SUMMARY), q.select(*SUMMARY)
    near_cells = pairs_of_cells(around_cells(qs), around_cells(vs))
    nearest = near_cells.withColumn("rn", F.row_number().over(W.partitionBy("q_cell").orderBy(F.desc("near"), "v_cell"))).filter("rn = 1").select("q_cell", "v_cell")
    first = bounded(named(qs, "q").join(F.broadcast(nearest), "q_cell").join(named(vs, "v"), "v_cell"))
    first = kept(first.withColumn("rn", F.row_number().over(W.partitionBy("q_block").orderBy(F.desc("near"), "v_block"))).filter(F.col("rn") <= FIRST).select("q_block", "v_block"))
    begun = kept(compared(first, q, v, k, floor, width))
    kth = k_best(begun, k).groupBy("q_block", "query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    bars = kth.groupBy("q_block").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("n") >= k, F.col("low"))).alias("bar"), F.min(F.col("n") >= k).alias("full"))
    # a block whose queries do not all have k hits has no bar but the floor
    asks = qs.select(F.col("block").alias("q_block"), F.col("n").alias("of")).join(bars, "q_block", "left")
    bar = F.greatest(F.when(F.col("full") & (F.col("n") == F.col("of")), F.col("bar")), F.lit(floor))
    asks = asks.select("q_block", bar.alias("bar"))
    wanted = named(qs, "q").join(asks, "q_block").join(F.broadcast(near_cells.select("q_cell", "v_cell", F.col("bound").alias("cell_bound"))), "q_cell").filter("cell_bound >= bar")
    seen = bounded(wanted.drop("cell_bound").join(named(vs, "v"), "v_cell"))
    rest = kept(seen.filter("bound >= bar").select("q_block", "v_block").join(first, ["q_block", "v_block"], "left_anti"))
    hits = begun.unionByName(compared(rest, q, v, k, floor, width)).select("query_id", "vec_id", "score")
    return k_best(hits, k), first.unionByName(rest), q.count() * v.count()


def top_k(vectors: DataFrame, queries: DataFrame, k: int, floor: float = -2.0, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """(query_id, vec_id, score) of (vec_id, embedding) and (query_id, embedding)."""
    made = plan(vectors, queries, k, floor, block, cells)
    return vectors.sparkSession.createDataFrame([], HITS) if made is None else made[0]
