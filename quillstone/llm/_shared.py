"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where one machine does everything (a local master) and the session names no shared folder.
LOCAL_SHARED = "/tmp/checkpoints/quillstone"
ROWS_AT_ONCE = 512
WORD = r"[^\x20\x09-\x0D]+"


#: Folders written by this process, for ``clear_scratch``.
_scratch: list[str] = []


@lru_cache(1)
def give_memory_back() -> None:
    """In a Python worker: freed arrays of 1 MB or more go back to the system at once, so that reused workers stay small. glibc only."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        pa.set_memory_pool(pa.system_memory_pool())
    except (AttributeError, OSError):
        pass


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a shared folder")
        root = LOCAL_SHARED
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def scratch_mark() -> int:
    """How many folders have been written so far, for ``clear_scratch``."""
    return len(_scratch)


def clear_scratch(spark: SparkSession, since: int = 0, keep_last: bool = True) -> None:
    """Delete the folders written after a mark, but for the last one. Only for results that are written already."""
    for path in _scratch[since : len(_scratch) - keep_last]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _scratch.remove(path)


def persisted(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_shards(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def n_ranges(docs: DataFrame, text: str = "text", tokens: int = 1 << 21) -> tuple[int, int]:
    """(ranges, estimated words): as many hash ranges as the input's size asks for, about ``tokens`` words each, so that a range's task has the same work at any size."""
    words = (docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0) // 6
    return max(n_shards(docs.sparkSession), -(-words // tokens)), words


def crc_mod(col: str, m: int):
    """crc32 of the id as text, modulo m; null ids count as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string")), F.lit(m)), F.lit(0))


#: Hashes that choose samples lie below this.
SPAN = 1 << 40


def least_hash(wanted: int, distinct: int) -> int:
    """A bound for hashes below SPAN that lets through a few times ``wanted`` of ``distinct`` values: none too few but with a chance below e**-40."""
    return int(min(1.0, (4 * wanted + 40) / max(1, distinct)) * SPAN)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(df: DataFrame, *made: str) -> DataFrame:
    """Columns that are named like those an operator makes, as ``<name>_given``, so that both are in the result."""
    for c in [c for c in df.columns if c in made]:
        name = f"{c}_given"
        while name in df.columns or name in made:
            name += "_given"
        df = df.withColumnRenamed(c, name)
    return df


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without making Python strings."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def selected(df: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, str]:
    """The ``keep`` columns, and the text once: its name where it is kept, else ``__text`` after them."""
    if text in keep:
        return df.select(*keep), text
    return df.select(*keep, df[text].alias("__text")), "__text"


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in order, in pieces of about ``most`` bytes of ``column``; a longer text is a piece of its own. Nulls count as empty.

    Only ROWS_AT_ONCE texts of a batch are held as Python objects at a time.
    """
    give_memory_back()
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            texts = [x or b"" for x in utf8(batch.column(batch.schema.get_field_index(column)))]
            start = size = 0
            for i, x in enumerate(texts):
                if size and size + len(x) > most:
                    yield batch.slice(start, i - start), texts[start:i]
                    start, size = i, 0
                size += len(x)
            yield batch.slice(start), texts[start:]
