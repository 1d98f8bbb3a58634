"""Vector columns as integers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_rows(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there, and all of whose components are there and finite."""
    return rows.filter(F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))))


def floors(scale: int, column: str = "embedding"):
    """floor(scale * x) of each component, as array<bigint>; those beyond a bigint stop at its ends. ``scale`` is a power of two, so products are exact."""
    return F.transform(column, lambda x: F.floor(x.cast("double") * scale))


def common_width(rows: DataFrame, column: str = "x") -> int:
    """The width of most vectors, the larger one of two that are equally common; 0 without rows. One row comes to the driver."""
    found = rows.groupBy(F.size(column).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return found.width if found else 0


def usable(column: str, width: int, limit: int):
    """Whether a vector has the common width and stays within +-limit."""
    return (F.size(column) == width) & F.forall(column, lambda x: (x >= -limit) & (x <= limit))


def matrix(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), width)
