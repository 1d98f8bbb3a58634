"""Results that several parts of a plan use: computed once, kept in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources import hadoop

#: Used only where one machine does everything and the session names no shared folder.
LOCAL = "/tmp/checkpoints/quillstone"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. A cluster must name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a shared folder")
        context.setCheckpointDir(root or LOCAL)
    return (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders that ``kept`` has written in this process, for ``clear``.
_written: list[str] = []


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: computed once, lineage cut, lost executors survived. (``checkpoint`` would compute it twice.)"""
    spark = df.sparkSession
    path = new_folder(spark, "kept")
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's setting that shuffle files go when the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str, more: bool = False) -> None:
    """df written to a folder (``more``: beside what is there), small on disk. Shuffle files that this took go at once, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").mode("append" if more else "errorifexists").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


@contextmanager
def brief(df: DataFrame) -> Iterator[DataFrame]:
    """As ``kept``, for as long as the block lasts."""
    spark = df.sparkSession
    path = new_folder(spark, "brief")
    try:
        written(df, path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        hadoop.delete(spark, path)


def mark() -> int:
    """How many folders there are so far, for ``clear``."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Delete what ``kept`` wrote after a mark. Only once the results that use it are written."""
    for path in _written[since:]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _written[since:]


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan with fewer partitions than there are cores, dealt over all of them: for work that is much for few bytes. Large tables have more and stay as they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def if_small(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` rows, which are counted."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
