"""Vectors: normalising, exact top-k by inner product, merging of query variants."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors and scores that a task works on at a time: what it holds beside its k best, whatever the numbers of vectors and queries.
SLICE, CELLS = 1_024, 1 << 20


def normalized(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / (norm + F.lit(1e-12)))


class Nearest:
    """The k best vectors so far of some queries: all that a task keeps of what it has seen."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, floor: float):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.query, self.vec, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.bar = np.full(len(ids), floor)

    def add(self, found: np.ndarray, x: np.ndarray) -> None:
        score = self.matrix @ x.T
        np.round(score, 6, out=score)
        score[self.ids[:, None] == found[None, :]] = -np.inf
        np.copyto(score, -np.inf, where=np.isnan(score))
        near = score >= self.bar[:, None]
        if score.shape[1] > self.k and np.count_nonzero(near) > 2 * self.k * len(self.ids):
            # what is below the k-th best of this slice is not among the k best of all; ties with it may be
            near &= score >= np.partition(score, -self.k, axis=1)[:, -self.k, None]
        query, at = np.nonzero(near)
        if not len(query):
            return
        query, vec, score = np.concatenate((self.query, query)), np.concatenate((self.vec, found[at])), np.concatenate((self.score, score[query, at]))
        order = np.lexsort((vec, -score, query))
        many = np.bincount(query, minlength=len(self.ids))
        start = np.cumsum(many) - many
        keep = order[np.arange(len(order)) - np.repeat(start, many) < self.k]
        self.query, self.vec, self.score = query[keep], vec[keep], score[keep]
        last = (start + self.k - 1)[many >= self.k]
        self.bar[many >= self.k] = score[order[last]]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query]), pa.array(self.vec), pa.array(self.score)], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int, floor: float = -2.0, block: int = 5_000) -> DataFrame:
    """(query_id, vec_id, score), the k best of all vectors per query; ties by vec_id.

    Queries are a stated set: they are brought to the driver in blocks of ``block`` and go
    out with the tasks, so a slice of vectors and queries is one matrix product. A task holds
    and returns its own k best per query, and a window over these picks the k best of all.
    Vectors that are null or of another width than the queries take no part; queries of
    several widths are refused.
    """
    asked = queries.filter("embedding is not null").orderBy("query_id").toLocalIterator()
    parts = None
    while some := list(islice(asked, block)):
        if len({len(r[1]) for r in some}) > 1:
            raise ValueError("query vectors of several widths")
        ids, matrix = np.array([r[0] for r in some]), np.array([r[1] for r in some], np.float64)

        def task(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix) -> Iterator[pa.RecordBatch]:
            rows = max(1, CELLS // SLICE)
            held = [Nearest(ids[at : at + rows], matrix[at : at + rows], k, floor) for at in range(0, len(ids), rows)]
            for b in batches:
                for at in range(0, b.num_rows, SLICE):
                    piece = b.slice(at, SLICE)
                    found = piece.column(0).to_numpy(zero_copy_only=False)
                    x = np.asarray(piece.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(found), matrix.shape[1])
                    for h in held:
                        h.add(found, x)
            for h in held:
                yield h.batch()

        made = vectors.filter(F.size("embedding") == matrix.shape[1]).select("vec_id", "embedding").mapInArrow(task, "query_id long, vec_id long, score double")
        parts = made if parts is None else parts.unionByName(made)
    if parts is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k).drop("rn")


def best_of_variants(hits: DataFrame) -> DataFrame:
    """The best score of each vector over the variants of a question."""
    return hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def thresholded(hits: DataFrame, least: float, floor: float, n: int) -> DataFrame:
    """Scores of at least ``least``; where a query has none, its n best of at least ``floor``."""
    every = W.partitionBy("query_id")
    rn = F.row_number().over(every.orderBy(F.desc("score"), "vec_id"))
    marked = hits.withColumns({"some": F.max("score").over(every) >= least, "rn": rn})
    return marked.filter((F.col("some") & (F.col("score") >= least)) | (~F.col("some") & (F.col("score") >= floor) & (F.col("rn") <= n))).drop("some", "rn")
