"""Embedding whitening by hierarchical SVD merging.

A summary of a set of vectors is (n, mean, R): R holds all singular values of the centred vectors times their right
singular vectors, so R'R is the scatter matrix and no dimension is cut off. Two summaries merge into the SVD of
both R, one below the other, and one row more that corrects for the means: sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2). Tasks summarise
their vectors block by block; summaries merge in groups of ``FAN_IN``, level by level, each level written to the shared
folder, until one is left. A task holds a block of vectors and at most FAN_IN summaries, each of width**2 numbers.

Vectors become integers first, so equal ones are equal; each distinct one counts once. Sums by dimension are exact integers.
The whitened vectors of the fit list are summarised in the same way, and their covariance is compared with the
identity: ``identity_error`` is measured, not assumed.

Defined results: rows without a vector, or with a null or non-finite component, go. The width is that of most vectors. A
vector of another width, or with a component whose integer is beyond 2**53, stays with null deviation and whitened values and is not
fitted. Components without variance (fewer distinct vectors than dimensions, or equal vectors only) have null whitened values and explain 0;
with no variance at all, explained and identity_error are null. Deviations beyond a bigint are null. Rows and ids that repeat are rows of
their own, null ids too; vectors of fewer than four dimensions have as many components. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillstone.llm._shared import give_memory_back, persisted, table
from quillstone.llm._vectors import common_width, finite_rows, floors, matrix, usable

SCALE, COMPONENTS = 256, 4
FAN_IN = 16
#: Vectors of a block are about so many numbers.
BLOCK = 1 << 19
LARGEST = 1 << 53
SUMMARY = "part long, n long, mean array<double>, r array<double>"

Summary = tuple[int, np.ndarray, np.ndarray]


def reduced(rows: np.ndarray) -> np.ndarray:
    """Singular values times right singular vectors; all of them."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def summary(x: np.ndarray) -> Summary:
    mean = x.mean(0)
    return len(x), mean, reduced(x - mean)


def merged(a: Summary, b: Summary) -> Summary:
    n = a[0] + b[0]
    step = (a[1] - b[1])[None, :]
    return n, a[1] - step[0] * (b[0] / n), reduced(np.vstack([a[2], b[2], np.sqrt(a[0] * b[0] / n) * step]))


def summarised(vectors: DataFrame, column: str, width: int) -> Summary | None:
    """The summary of a list column of one width, merged level by level; None without rows. The one that is left comes to the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_memory_back()
        found, step = None, max(1, BLOCK // max(1, width))
        for b in batches:
            for at in range(0, b.num_rows, step):
                own = summary(matrix(b.column(0).slice(at, step), width, np.float64))
                found = merged(found, own) if found else own
        if found:
            n, mean, r = found
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "n": n, "mean": mean.tolist(), "r": r.ravel().tolist()}], pa.schema([("part", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("r", pa.list_(pa.float64()))]))

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = None
        for row in group.sort_values("part").itertuples():
            own = row.n, np.asarray(row.mean), np.asarray(row.r).reshape(-1, width)
            found = merged(found, own) if found else own
        n, mean, r = found
        return pd.DataFrame({"part": [key[0]], "n": [n], "mean": [mean], "r": [r.ravel()]})

    level = persisted(vectors.select(column).mapInArrow(task, SUMMARY), "summaries")
    while level.count() > 1:
        level = persisted(level.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInPandas(join, SUMMARY), "summaries")
    last = level.first()
    return (last.n, np.array(last["mean"]), np.array(last.r).reshape(-1, width)) if last else None


def principal(found: Summary, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as rows, trace) of the covariance, by falling eigenvalue. The largest entry of an eigenvector is positive."""
    n, _, r = found
    _, s, vt = np.linalg.svd(r, full_matrices=True)
    values = np.zeros(len(vt))
    values[: len(s)] = np.where(s > s.max(initial=0) * max(r.shape) * 2.0**-52, s, 0) ** 2 / n
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)]) if vt.size else np.ones(0)
    return values[:most], (vt * sign[:, None])[:most], float(values.sum())


def projected(rows: DataFrame, width: int, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """rows (.., x) with deviation and the array whitened instead of x; null where x is null, NaN where a component has no variance."""
    others = [c for c in rows.columns if c != "x"]
    scaled = np.divide(vectors, np.sqrt(values)[:, None], out=np.full(vectors.shape, np.nan), where=values[:, None] > 0).T
    largest = max(map(abs, sums.tolist()), default=0)

    def deviations(x: np.ndarray) -> list[int | None]:
        reach = n * int(np.abs(x).max(initial=0)) + largest
        exact = x if width * reach * reach < 1 << 63 else x.astype(object)
        off = exact * n - sums
        return [v if v < 1 << 63 else None for v in (off * off).sum(1).tolist()] if width else [0] * len(x)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_memory_back()
        for b in batches:
            column = b.column(b.schema.get_field_index("x"))
            ok = column.is_valid().to_numpy(zero_copy_only=False)
            x = matrix(column.drop_null(), width)
            far, white = iter(deviations(x)), iter(((x - sums.astype(np.float64) / max(n, 1)) @ scaled).tolist())
            made = [pa.array([next(far) if v else None for v in ok], pa.int64()), pa.array([next(white) if v else None for v in ok], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in others] + made, names=[*others, "deviation", "whitened"])

    return rows.mapInArrow(task, rows.select(*others).schema.add("deviation", "long").add("whitened", ArrayType(DoubleType())))


def whitened(rows: DataFrame, scale: int = SCALE, most: int = COMPONENTS) -> DataFrame:
    """From (vec_id, embedding): a row for each vector and component."""
    whole = persisted(finite_rows(rows).select("vec_id", floors(scale).alias("x")), "integer-vectors")
    width = common_width(whole)
    ready = whole.withColumn("x", F.when(usable("x", width, LARGEST), F.col("x")))
    fit = persisted(ready.filter("x is not null").select("x").distinct(), "fit-list")
    n = fit.count()
    found = summarised(fit, "x", width)
    by_place = {r.pos: r.total for r in fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("total")).collect()}
    totals = [int(by_place.get(i, 0)) for i in range(width)]
    sums = np.array(totals, np.int64 if max(map(abs, totals), default=0) < 1 << 62 else object)
    values, vectors, trace = principal(found, most) if found else (np.zeros(min(most, width)), np.eye(min(most, width), width), 0.0)
    varied = int((values > 0).sum())
    error = None
    if varied:
        white = projected(fit, width, n, sums, values[:varied], vectors[:varied]).select("whitened")
        count, _, r = summarised(white, "whitened", varied)
        error = float(np.abs(r.T @ r / count - np.eye(varied)).max())
    made = projected(ready, width, n, sums, values, vectors)
    explained = F.array(*[F.lit(float(v) / trace if trace else None).cast("double") for v in values])
    each = made.select("vec_id", "deviation", "whitened", F.explode(F.sequence(F.lit(1), F.lit(len(values)))).alias("component")) if len(values) else made.select("vec_id", "deviation", "whitened", F.lit(0).alias("component")).limit(0)
    value = F.get("whitened", F.col("component") - 1)
    return each.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", F.when(~F.isnan(value), value).alias("whitened"), F.get(explained, F.col("component") - 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whiten all ``embeddings``."""
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
